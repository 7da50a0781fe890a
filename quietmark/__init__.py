"""Find, replace and audit personal data in large text tables with Spark."""

from quietmark.operators.detectors import PARITY, STRICT, Rules, detect, span_rows
from quietmark.plans.redaction import Redaction, redact, redact_documents, redact_hashed
from quietmark.sources.chunks import assemble, chunk_text, field_table, page_chunks, redaction_scope

__all__ = [
    "PARITY",
    "STRICT",
    "Redaction",
    "Rules",
    "assemble",
    "chunk_text",
    "detect",
    "field_table",
    "page_chunks",
    "redact",
    "redact_documents",
    "redact_hashed",
    "redaction_scope",
    "span_rows",
]
