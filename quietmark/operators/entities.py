"""Entity candidates from outside: a table contract and its filters.

``ner_candidates(doc_id, chunk_no, start, end, label, text)`` with labels
PERSON, ORG, GPE, LOC.  No model is shipped; a user fills the table with a
pandas UDF of their own, fed by ``segments``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions.predicates import address_score, clean_person, is_organization, is_placeholder, looks_like_person
from quietmark.functions.text import let, match_spans, not_blank, slice_text, strip
from quietmark.operators.detectors import STRICT, Rules

LABELS = ("PERSON", "ORG", "GPE", "LOC")
SEGMENT = 2_000
ENTITY_RANK = 13
TITLE_CASE = r"\b[A-Z][A-Za-z'-]+(?: [A-Z][A-Za-z'.-]+)+"


def segments(chunks: DataFrame, size: int = SEGMENT, overlap: int = 0) -> DataFrame:
    """Fixed windows over long chunks, with the offset to shift results back.

    ``overlap`` repeats that many characters at each seam so that no entity is
    cut; overlap resolution removes what is then found twice.
    """
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1 - F.lit(overlap), F.lit(0)), F.lit(step))
    cut = chunks.select("doc_id", "chunk_no", "text", F.explode(starts).alias("offset"))
    return cut.select(
        "doc_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("offset").cast("bigint").alias("offset"),
        slice_text(F.col("text"), F.col("offset"), F.col("offset") + size).alias("segment"),
    ).where(not_blank(F.col("segment")))


def shift_back(found: DataFrame) -> DataFrame:
    """Candidates found in segments, moved to chunk offsets; seam repeats dropped."""
    return found.select(
        "doc_id", "chunk_no", (F.col("offset") + F.col("start")).alias("start"),
        (F.col("offset") + F.col("end")).alias("end"), "label", "text",
    ).distinct()


def title_case_candidates(chunks: DataFrame) -> DataFrame:
    """Runs of capitalised words as stand-in candidates.

    Not a model: it exists so that the filters can run on the given tables.  A
    run with a company term is labelled ORG, all others PERSON.
    """
    found = match_spans(F.col("text"), TITLE_CASE)
    rows = chunks.where(F.col("text").rlike(TITLE_CASE)).select(
        "doc_id", "chunk_no", F.explode_outer(found).alias("s")
    ).where(F.col("s.st").isNotNull())
    return rows.select(
        "doc_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("s.st").cast("bigint").alias("start"),
        F.col("s.en").cast("bigint").alias("end"),
        F.when(is_organization(F.col("s.value")), "ORG").otherwise("PERSON").alias("label"),
        F.col("s.value").alias("text"),
    )


def _spans(df: DataFrame, kind: str, start: Column, end: Column) -> DataFrame:
    return df.select(
        "doc_id",
        "chunk_no",
        start.cast("bigint").alias("start"),
        end.cast("bigint").alias("end"),
        F.lit(kind).alias("type"),
        "value",
        F.lit(ENTITY_RANK).cast("bigint").alias("detector_rank"),
    )


def filter_people(
    candidates: DataFrame, chunks: DataFrame, rules: Rules = STRICT, known: tuple[str, ...] = ()
) -> DataFrame:
    """PERSON candidates that are names and do not sit inside an address.

    Name rules run before the join with the chunk texts, which is only needed
    for the context window.  The span is the raw entity; ``trim_spans`` narrows
    it to the cleaned name.
    """
    name = clean_person(F.col("entity"), rules.generic_words)
    kept = (
        candidates.where(F.col("label") == "PERSON")
        .withColumnRenamed("text", "entity")
        .withColumn("value", name)
        .where(
            F.lower("value").isin(*[k.lower() for k in known])
            | looks_like_person(F.col("value"), rules.generic_words, rules.non_person_words, rules.non_person_phrases)
        )
        .where(~is_placeholder(F.col("value"), rules.extended_placeholders))
    )
    texts = chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text")
    outside = kept.join(texts, ["doc_id", "chunk_no"]).where(
        address_score(F.col("text"), F.col("start").cast("int"), F.col("end").cast("int")) < 3
    )
    start, end = F.col("start"), F.col("end")
    if rules.trim_spans:
        lead = F.instr(F.col("entity"), F.substring("value", 1, 1)) - 1
        exact = F.col("entity").contains(F.col("value"))
        start = F.when(exact, F.col("start") + lead).otherwise(F.col("start"))
        end = F.when(exact, start + F.length("value")).otherwise(F.col("end"))
    return _spans(outside, "person", start, end)


def filter_organizations(candidates: DataFrame, rules: Rules = STRICT) -> DataFrame:
    """ORG candidates with a company term that are more than one generic word."""
    orgs = candidates.where(F.col("label") == "ORG").withColumn("value", strip(F.col("text")))
    kept = orgs.where(is_organization(F.col("value"))).where(
        ~is_placeholder(F.col("value"), rules.extended_placeholders)
    )
    return _spans(kept, "organization", F.col("start"), F.col("end"))


def inventory(candidates: DataFrame) -> DataFrame:
    """All candidates with one of the four labels."""
    return candidates.where(F.col("label").isin(*LABELS)).select(
        F.col("label").alias("category"), "doc_id", "chunk_no", F.col("text").alias("value")
    )


def residual_entities(candidates: DataFrame) -> DataFrame:
    """Distinct PERSON and ORG values left in redacted text, placeholders removed."""
    value = strip(F.col("text"))
    own = F.when(F.col("label") == "PERSON", F.col("value").rlike(r"(?i)^Person \d+$")).otherwise(
        F.col("value").rlike(r"(?i)^Example Organization \d+$")
    )
    return (
        candidates.where(F.col("label").isin("PERSON", "ORG"))
        .select("label", value.alias("value"))
        .where((F.col("value") != "") & ~own)
        .distinct()
    )
