"""Redaction flows.

Chunks without any pattern match never leave their task: they pass straight to
the output.  Only chunks with a match are resolved, written once to the stage
folder and shuffled, and of those only the spans, not the text, take part in
the dictionary.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions.placeholders import hashed_placeholder, norm_key, placeholder
from quietmark.functions.predicates import is_placeholder
from quietmark.functions.text import empty_array, let, running
from quietmark.operators.detectors import MAX_LITERAL_NAMES, SPAN, STRICT, Rules, detect, has_candidates, spans_in, with_spans
from quietmark.operators.dictionary import DictionaryTable, build_dictionary, numbered_within_rows, replace_values, value_spans
from quietmark.operators.overlaps import resolve, with_merged
from quietmark.operators.splice import splice
from quietmark.session import save_stage
from quietmark.sources.chunks import chunk_text

@dataclass
class Redaction:
    """Result tables of one run; all lazy except the staged ones."""

    chunks: DataFrame  # doc_id, chunk_no, kind, ..., text, redacted_text, n_redactions
    findings: DataFrame  # doc_id, chunk_no, st, en, type, value, norm_key, replacement
    dictionary: DataFrame  # type, norm_key, first, uses, n, replacement


def _redacted_columns(spans: Column, text_col: str = "text") -> dict[str, Column]:
    return {
        "redacted_text": splice(F.col(text_col), spans),
        "n_redactions": F.coalesce(F.size(spans), F.lit(0)).cast("bigint"),
    }


def _unchanged(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    return chunks.withColumns({"redacted_text": F.col(text_col), "n_redactions": F.lit(0).cast("bigint")})


def _busy(rules: Rules, found: str | None) -> Column:
    """Does a chunk have anything to resolve?"""
    matches = has_candidates(F.col("text"), rules)
    return matches if found is None else matches | F.coalesce(F.size(found) > 0, F.lit(False))


def find_merged(chunks: DataFrame, rules: Rules = STRICT, extra: DataFrame | None = None, found: str | None = None) -> DataFrame:
    """Chunks that may have findings, with resolved spans in ``merged``.

    ``extra`` holds span rows from other sources (listed names from a table,
    filtered entity candidates): ``doc_id, chunk_no, start, end, type, value,
    detector_rank``.  They are grouped per chunk and joined on the chunk key.
    ``found`` names an array column of such spans that the chunks already carry
    (``with_entity_spans``); then nothing is joined.  It is dropped from the result.
    """
    if extra is None:
        spans = detect(chunks, rules) if found is None else with_spans(chunks.where(_busy(rules, found)), rules)
    else:
        joined = chunks.join(_extra_spans(extra), ["doc_id", "chunk_no"], "left")
        busy = joined.where(_busy(rules, found) | F.col("_extra").isNotNull())
        spans = with_spans(busy, rules)
        spans = spans.withColumn("spans", F.concat("spans", F.coalesce("_extra", empty_array(SPAN)))).drop("_extra")
    if found is not None:
        spans = spans.withColumn("spans", F.concat("spans", F.coalesce(found, empty_array(SPAN)))).drop(found)
    return with_merged(spans, rules.overlap)


def _long_lists(chunks: DataFrame, rules: Rules, extra: DataFrame | None) -> tuple[Rules, DataFrame | None]:
    """Name lists too long for literals become span rows of their own."""
    if max(len(rules.explicit_names), len(rules.known_names)) <= MAX_LITERAL_NAMES:
        return rules, extra
    from quietmark.operators import gazetteer

    lists = {"explicit": rules.explicit_names, "known": rules.known_names}
    wanted = {tag: names for tag, names in lists.items() if not rules.only or f"{tag}_names" in rules.only}
    spans = gazetteer.gazetteer_spans(chunks, gazetteer.gazetteer(chunks.sparkSession, wanted))
    spans = spans.where(~is_placeholder(F.col("value"), rules.extended_placeholders))
    return replace(rules, explicit_names=(), known_names=()), spans if extra is None else extra.unionByName(spans)


def _extra_spans(extra: DataFrame) -> DataFrame:
    span = F.struct(
        F.col("start").cast("int").alias("st"),
        (F.col("start") - F.col("end")).cast("int").alias("neg"),
        F.col("detector_rank").cast("int").alias("rk"),
        F.col("end").cast("int").alias("en"),
        "type",
        "value",
    )
    return extra.groupBy("doc_id", F.col("chunk_no").cast("int").alias("chunk_no")).agg(F.collect_list(span).alias("_extra"))


def redact(
    chunks: DataFrame,
    rules: Rules = STRICT,
    numbering: str = "corpus",
    extra: DataFrame | None = None,
    table: DictionaryTable | None = None,
    delivery: int = 0,
    found: str | None = None,
) -> Redaction:
    """Detect, resolve, number, replace.

    Spans from other sources come as rows (``extra``) or, without a join, as an array
    column of the chunks (``found``); see ``find_merged``.

    ``numbering``: ``corpus`` keeps one placeholder per value over the whole
    table, ``document`` starts again in every document.  For placeholders
    without a numbering barrier see ``redact_hashed``.  With a ``table`` values
    keep the placeholders of earlier deliveries and new ones are added to it.
    """
    rules, extra = _long_lists(chunks, rules, extra)
    merged = save_stage(find_merged(chunks, rules, extra, found))
    values = value_spans(merged, rules)
    # Read several times (top keys, join, reports), so numbered once.
    if table is not None and numbering != "corpus":
        raise ValueError("a dictionary table is numbered over all documents")
    dictionary = save_stage(build_dictionary(values, numbering, rules) if table is None else table.extend(values, delivery))
    findings = replace_values(values, dictionary, numbering)
    per_chunk = findings.groupBy("doc_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("st", "en", "type", "value", "replacement"))).alias("replaced")
    )
    busy = merged.drop("merged").join(per_chunk, ["doc_id", "chunk_no"], "left")
    busy = busy.withColumns(_redacted_columns(F.col("replaced"))).drop("replaced")
    plain = chunks if found is None else chunks.drop(found)
    if extra is None:
        quiet = _unchanged(chunks.where(~_busy(rules, found)).select(*plain.columns))
    else:
        quiet = _unchanged(plain.join(merged.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_anti"))
    return Redaction(busy.unionByName(quiet), findings, dictionary)


def redact_hashed(chunks: DataFrame, rules: Rules = STRICT, *, secret: str, found: str | None = None) -> DataFrame:
    """Redaction with tokens derived from each value: one narrow pass, no shuffle.

    Equal values get equal tokens in every run and stream, so no dictionary is
    needed to keep them consistent.  ``found`` as in ``redact``.
    """
    busy = find_merged(chunks, rules, found=found)
    replaced = F.transform(
        "merged",
        lambda s: F.struct(
            s["st"].alias("st"),
            s["en"].alias("en"),
            hashed_placeholder(s["type"], norm_key(s["type"], s["value"], rules.canonical_keys), secret).alias("replacement"),
        ),
    )
    busy = busy.withColumn("replaced", replaced).drop("merged")
    busy = busy.withColumns(_redacted_columns(F.col("replaced"))).drop("replaced")
    quiet = chunks.where(~_busy(rules, found))
    return busy.unionByName(_unchanged(quiet if found is None else quiet.drop(found)))


@lru_cache(maxsize=32)
def _line_spans(rules: Rules) -> Column:
    """Resolved spans of every element of ``_lines``; built once per rule set."""
    return F.transform("_lines", lambda x: let(spans_in(x, rules), lambda s: resolve(s, rules.overlap)))


def redact_each(docs: DataFrame, rules: Rules = STRICT, text_col: str = "text") -> DataFrame:
    """Whole documents, numbered within each, without leaving their rows.

    Adds ``redacted_text, n_redactions`` and ``redactions``, an array of ``st, en,
    type, value, n, replacement`` in document offsets (null where nothing is found).
    Lines are matched, resolved, numbered and spliced as arrays of one row: no
    exchange, no dictionary, no key, so any id, a stream too.
    """
    whole = f"_text_{uuid.uuid4().hex[:8]}"
    base = docs.select("*", F.explode(F.array(text_col)).alias(whole))
    busy = base.where(has_candidates(F.col(whole), rules)).withColumn("_lines", F.split(whole, "\n", -1))
    ends = running(F.transform("_lines", lambda x: F.length(x) + 1), "sum")

    def placed(spans: Column, at: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                (s["st"] + at).alias("st"), (s["en"] + at).alias("en"), s["type"].alias("type"), s["value"].alias("value"),
                norm_key(s["type"], s["value"], rules.canonical_keys).alias("norm_key"),
            ),
        )

    starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size("_lines") - 1))
    found = F.flatten(F.zip_with(_line_spans(rules), starts, placed))
    busy = numbered_within_rows(busy.withColumn("_found", found).drop("_lines"), "_found")

    def replaced(s: Column, n: Column) -> Column:
        kept = [s[c].alias(c) for c in ("st", "en", "type", "value")]
        return F.struct(*kept, n.alias("n"), placeholder(s["type"], n, rules.overflow).alias("replacement"))

    busy = busy.withColumn("redactions", F.zip_with("_found", "_numbers", replaced)).drop("_found", "_numbers")
    busy = busy.withColumns(_redacted_columns(F.col("redactions"), whole))
    kind = busy.schema["redactions"].dataType
    quiet = _unchanged(base.where(~has_candidates(F.col(whole), rules)), whole).withColumn("redactions", F.lit(None).cast(kind))
    new = ("redacted_text", "n_redactions", "redactions")
    keep = [*(c for c in docs.columns if c not in new), *new]
    return busy.select(*keep).unionByName(quiet.select(*keep))


def redact_documents(
    docs: DataFrame,
    rules: Rules = STRICT,
    numbering: str = "corpus",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Whole documents back, redacted line by line, blank lines kept.

    Documents without a match are copied by a narrow filter.  Under document
    numbering the others are redacted within their rows (``redact_each``).  Under
    corpus numbering the replacements (not the lines) are grouped per document,
    moved to document offsets and spliced once.
    """
    if numbering == "document" and max(len(rules.explicit_names), len(rules.known_names)) <= MAX_LITERAL_NAMES:
        return redact_each(docs, rules, text_col).drop("redactions")
    whole = f"_text_{uuid.uuid4().hex[:8]}"
    base = docs.select("*", F.explode(F.array(text_col)).alias(whole))
    result = redact(chunk_text(docs, id_col, text_col), rules, numbering)
    per_doc = result.findings.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "st", "en", "replacement"))).alias("found")
    )
    # A match inside a line is a match in the whole text too, so this filter
    # keeps every document that has a busy line.
    suspects = base.where(has_candidates(F.col(whole), rules))
    busy = suspects.join(per_doc, suspects[id_col] == F.col("_doc"), "left").drop("_doc")
    lines = F.split(whole, "\n", -1)
    ends = running(F.transform(lines, lambda x: F.length(x) + 1), "sum")
    busy = busy.withColumn("ends", F.when(F.col("found").isNotNull(), ends))
    moved = F.transform(
        "found",
        lambda s: F.struct(
            (s["st"] + F.coalesce(F.get("ends", s["chunk_no"] - 2), F.lit(0))).alias("st"),
            (s["en"] + F.coalesce(F.get("ends", s["chunk_no"] - 2), F.lit(0))).alias("en"),
            s["replacement"].alias("replacement"),
        ),
    )
    busy = busy.withColumn("replaced", moved).withColumns(_redacted_columns(F.col("replaced"), whole))
    keep = [*(c for c in docs.columns if c not in ("redacted_text", "n_redactions")), "redacted_text", "n_redactions"]
    quiet = _unchanged(base.where(~has_candidates(F.col(whole), rules)), whole)
    return busy.select(*keep).unionByName(quiet.select(*keep))
