"""DataFrame operators: detection, overlap resolution, numbering, splicing, audits."""
