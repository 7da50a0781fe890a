"""DataFrame sources: given tables, chunk scans, derived contact cards, sinks."""
