"""What a corpus holds: looser detectors, one row per finding, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions import patterns as P
from quietmark.functions.phones import NUMBERING_PLAN, likely_phone
from quietmark.functions.predicates import luhn_valid, valid_ip
from quietmark.functions.text import empty_array, extract_all, has_digit
from quietmark.sources.chunks import location

CATEGORIES = ("EMAIL", "PHONE", "IP_ADDRESS", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH")


def _finds(text: Column, guard: Column, pattern: str, group: int = 0, keep=None) -> Column:
    found = extract_all(text, pattern, group)
    return F.when(guard, found if keep is None else F.filter(found, keep)).otherwise(empty_array("string"))


def inventory(chunks: DataFrame, categories: tuple[str, ...] = CATEGORIES, plan=NUMBERING_PLAN) -> DataFrame:
    """``category, doc_id, chunk_no, location, value`` of every finding.

    All six detectors run in one pass over the chunk and are exploded together.
    """
    text = F.col("text")
    digit = has_digit(text)
    values = {
        "EMAIL": _finds(text, F.contains(text, F.lit("@")), P.EMAIL),
        "PHONE": _finds(text, digit, P.PHONE_LOOSE, 0, lambda v: likely_phone(v, text, plan)),
        "IP_ADDRESS": _finds(text, digit & F.contains(text, F.lit(".")), P.IP_LOOSE, 0, valid_ip),
        "SSN": _finds(text, digit & F.contains(text, F.lit("-")), P.SSN),
        "CREDIT_CARD": _finds(text, digit, P.CARD_LOOSE, 0, luhn_valid),
        "DATE_OF_BIRTH": _finds(text, digit, P.BIRTH_DATE_LOOSE, 1),
    }
    found = F.array(*[F.struct(F.lit(c).alias("category"), values[c].alias("values")) for c in categories])
    return (
        chunks.where(digit | F.contains(text, F.lit("@")))
        .select("doc_id", "chunk_no", location().alias("location"), F.explode(found).alias("f"))
        .select(
            F.col("f.category").alias("category"),
            "doc_id",
            F.col("chunk_no").cast("bigint").alias("chunk_no"),
            "location",
            F.explode("f.values").alias("value"),
        )
    )


def address_inventory(chunks: DataFrame) -> DataFrame:
    """Chunks that mention an address, whole, and every six-digit postal code."""
    text = F.col("text")
    context = F.when(text.rlike(P.ADDRESS_CONTEXT), F.array(text)).otherwise(empty_array("string"))
    pins = F.when(has_digit(text), extract_all(text, P.PIN)).otherwise(empty_array("string"))
    found = F.array(
        F.struct(F.lit("EXPLICIT_ADDRESS_CONTEXT").alias("category"), context.alias("values")),
        F.struct(F.lit("PIN_CODE").alias("category"), pins.alias("values")),
    )
    return chunks.select("doc_id", "chunk_no", location().alias("location"), F.explode(found).alias("f")).select(
        F.col("f.category").alias("category"),
        "doc_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        "location",
        F.explode("f.values").alias("value"),
    )


def counts(findings: DataFrame) -> DataFrame:
    """Findings per category, sorted by category."""
    return findings.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def scan_totals(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Chunks scanned and candidates found: one row of two partial counts."""
    scanned = chunks.agg(F.count("*").alias("chunks_scanned"))
    return scanned.withColumn("candidates_found", findings.agg(F.count("*").alias("n")).scalar())
