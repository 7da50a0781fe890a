"""Listed names: lists of any size as a table, and the final name sweep."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietmark.functions.placeholders import placeholder
from quietmark.functions.text import extract_all, match_spans
from quietmark.operators.detectors import name_pattern
from quietmark.operators.dictionary import number_in_order
from quietmark.operators.names import occurrences
from quietmark.plans.redaction import Redaction
from quietmark.session import Stages

RANKS = {"explicit": 2, "known": 11}
BROADCAST_BYTES = 64 * 1024 * 1024


def gazetteer(spark: SparkSession, lists: dict[str, Iterable[str]]) -> DataFrame:
    """``list STRING, name STRING`` from a mapping of list tag to names."""
    rows = [(tag, name) for tag, names in lists.items() for name in names]
    return spark.createDataFrame(rows, "list string, name string")


def _ngram_pattern(words: int, max_gap: int) -> str:
    """Captures every run of ``words`` letter runs, one at each word start."""
    more = rf"(?:[^A-Za-z]{{1,{max_gap}}}[A-Za-z]++){{{words - 1}}}" if words > 1 else ""
    return rf"(?<![A-Za-z])(?=([A-Za-z]++{more}))"


def core(name: Column) -> Column:
    """The part of a name from its first to its last ASCII letter, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, r"(?s)[A-Za-z](?:.*[A-Za-z])?", 0))


@dataclass(frozen=True)
class ListProfile:
    """What a join with a name list needs to know; one small aggregate."""

    size: int  # bytes of text, an upper bound of what a broadcast carries
    lengths: tuple[int, ...]  # words per core, as present in the list
    max_gap: int  # longest run of non-letters inside a core
    coreless: int  # names without an ASCII letter


def profile_names(names: DataFrame) -> ListProfile:
    gaps = extract_all(core(F.col("name")), "[^A-Za-z]+")
    longest = F.coalesce(F.array_max(F.transform(gaps, F.length)), F.lit(1))
    whole = core(F.col("name")) != ""
    row = names.agg(
        F.coalesce(F.sum(F.octet_length("name") * 2 + F.octet_length("list") + 64), F.lit(0)).alias("size"),
        F.sort_array(F.collect_set(F.when(whole, F.size(gaps) + 1))).alias("lengths"),
        F.coalesce(F.max(longest), F.lit(1)).alias("gap"),
        F.count_if(~whole & (F.col("name") != "")).alias("coreless"),
    ).first()
    return ListProfile(row["size"], tuple(row["lengths"]), row["gap"], row["coreless"])


def _broadcast_hits(chunks: DataFrame, names: DataFrame, profile: ListProfile) -> DataFrame:
    """Chunks with their text, paired with names that have an ASCII letter.

    Word n-grams of the lengths in the list are taken from the raw text and
    joined with the cores of the names on equality, so the cost per word does not
    depend on the list size; a name that goes on beyond its core (an accented
    first or last letter, say) is then looked for in the matching chunks only.
    """
    keys = ["doc_id", "chunk_no"]
    listed = names.withColumn("gram", core(F.col("name"))).where("gram != ''")
    grams = F.concat(F.expr("cast(array() as array<string>)"), *[extract_all(F.col("text"), _ngram_pattern(n, profile.max_gap), 1) for n in profile.lengths])
    # Lower-case all of them in one string operation.
    grams = F.array_distinct(F.split(F.lower(F.array_join(grams, "\u001f")), "\u001f"))
    hits = chunks.select(*keys, "text", F.explode_outer(grams).alias("gram")).join(F.broadcast(listed), "gram")
    return hits.select(*keys, "text", "list", "name").where(F.regexp_like(F.col("text"), name_pattern(F.col("name"))))


def _split_list(names: DataFrame) -> tuple[DataFrame, ListProfile, DataFrame | None]:
    """Names for the broadcast join, its profile, and names for the shuffled one.

    A list of at most ``BROADCAST_BYTES`` is broadcast; a larger one, and names
    without an ASCII letter, are joined by their beginnings (see ``names``).
    """
    listed = names.groupBy("list", F.lower("name").alias("_key")).agg(F.min("name").alias("name")).drop("_key")
    profile = profile_names(listed)
    if profile.size > BROADCAST_BYTES:
        return listed.where("false"), replace(profile, lengths=()), listed
    return listed, profile, listed.where(core(F.col("name")) == "") if profile.coreless else None


def name_hits(chunks: DataFrame, names: DataFrame, stages: Stages | None = None) -> DataFrame:
    """``doc_id, chunk_no, list, name``: chunks paired with the listed names that occur in them."""
    near, profile, rest = _split_list(names)
    columns = ["doc_id", "chunk_no", "list", "name"]
    hits = _broadcast_hits(chunks, near, profile).select(*columns)
    if rest is None:
        return hits
    more = occurrences(chunks, rest, stages=stages).select(*columns).distinct()
    return hits.unionByName(more) if profile.lengths else more


def gazetteer_spans(chunks: DataFrame, names: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Span rows of listed names, for ``redact(..., extra=...)``.

    Offsets are computed only for matching (chunk, name) pairs.
    """
    near, profile, rest = _split_list(names)
    spans = match_spans(F.col("text"), name_pattern(F.col("name")))
    hits = _broadcast_hits(chunks, near, profile).select("doc_id", "chunk_no", "list", F.explode_outer(spans).alias("s"))
    found = hits.where(F.col("s.st").isNotNull()).select("doc_id", "chunk_no", "list", F.col("s.st").alias("start"), F.col("s.en").alias("end"), F.col("s.value").alias("value"))
    if rest is not None:
        more = occurrences(chunks, rest, stages=stages).select(*found.columns)
        found = found.unionByName(more) if profile.lengths else more
    rank = F.lit(None).cast("bigint")
    for tag, r in RANKS.items():
        rank = F.when(F.col("list") == tag, F.lit(r)).otherwise(rank)
    return found.select(
        "doc_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
        F.lit("person").alias("type"),
        "value",
        F.coalesce(rank, F.lit(2)).cast("bigint").alias("detector_rank"),
    )


def sweep_names(
    result: Redaction, names: list[str] | DataFrame, bounded: bool = True, overflow: bool = True, stages: Stages | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace every listed name still in the redacted text; a list of any length and script.

    ``names`` is a list, or a table ``name_no, name``.  Returns the chunks with
    ``swept_text`` and one finding per chunk and name.  Known names keep their
    dictionary placeholder; the others are numbered on from the largest person
    number, by first sight.  Under document numbering both hold within each
    document.  ``bounded=False`` also replaces names inside longer words.  Names
    meet the text by their beginnings; a chunk's names are then replaced in the
    order of ``name_no``.
    """
    spark = result.chunks.sparkSession
    stages = stages or Stages(spark)
    if not isinstance(names, DataFrame):
        if not names:
            raise ValueError("no names")
        names = spark.createDataFrame(list(enumerate(names)), "name_no int, name string")
    scope = ["doc_id"] if "doc_id" in result.dictionary.columns else []
    # A join of text and replacements, read twice below; dealt evenly, as looking for names costs much.
    chunks = stages.save(result.chunks.repartition("doc_id", "chunk_no"))
    hits = occurrences(chunks.select("doc_id", "chunk_no", F.col("redacted_text").alias("text")), names.select("name_no", "name"), bounded, stages)
    findings = stages.save(hits.select("doc_id", "chunk_no", "name_no", "name", F.lower("name").alias("norm_key")).distinct())

    people = result.dictionary.where(F.col("type") == "person")
    seen = findings.groupBy(*scope, "name_no", "name", "norm_key").agg(F.min(F.struct("doc_id", "chunk_no", "name_no")).alias("first"))
    known = seen.join(people.select(*scope, "norm_key", "replacement"), [*scope, "norm_key"], "left")
    group = scope or ["_all"]
    new = number_in_order(known.where("replacement is null").drop("replacement").withColumn("_all", F.lit(0)), group, "first")
    tops = people.withColumn("_all", F.lit(0)).groupBy(*group).agg(F.max("n").alias("top"))
    new = new.join(tops, group, "left").withColumn("n", F.col("n") + F.coalesce("top", F.lit(0)))
    new = new.withColumn("replacement", placeholder(F.lit("person"), F.col("n"), overflow))
    columns = [*scope, "name_no", "replacement"]
    entries = known.where("replacement is not null").select(*columns).unionByName(new.select(*columns))
    done = stages.save(findings.join(entries, [*scope, "name_no"]))

    per_chunk = done.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("name_no", "name", "replacement"))).alias("_names"))
    moved = done.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("replacement") + 48), F.lit(0)).alias("b")).first()["b"]
    swept = chunks.join(F.broadcast(per_chunk) if moved <= BROADCAST_BYTES else per_chunk, ["doc_id", "chunk_no"], "left")
    text = F.col("redacted_text")
    replaced = F.aggregate("_names", text, lambda acc, x: F.regexp_replace(acc, name_pattern(x["name"], bounded), x["replacement"]))
    swept = swept.withColumn("swept_text", F.coalesce(replaced, text)).select(*chunks.columns, "swept_text")
    return swept, done.select(
        "doc_id", "chunk_no", F.lit("person").alias("type"), F.col("name").alias("original"), "replacement", F.lit("final sweep").alias("location")
    )
