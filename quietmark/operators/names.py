"""Occurrences of listed names, for lists of any length in any script.

A name is looked up by its beginning: the first ``ANCHOR`` code points (all of a
shorter one) without regard to case.  Every place of a text where a name may
begin carries a window as long as the longest name, so a match is decided where
the names meet it, and no text travels.

1. Places are those where the first two characters of some name stand (the first
   one, if the list has more than ``MAX_BEGINNINGS`` pairs; all, if it has more
   first characters), whole texts being passed over by one regular expression.
2. The beginnings of the list make a sieve: 64-bit words, three bits set a name,
   grouped and merged by ``bit_or`` in tasks, with the lengths of its names.  It
   has at most ``SIEVE_WORDS`` rows whatever the list's length, and is broadcast;
   places whose beginning it does not hold go before anything is shuffled.
3. What is left meets the list on equality of the whole name, once for every
   length the sieve names, so a beginning that many names and many places share
   makes no pairs.  A list of at most ``BROADCAST_BYTES`` is broadcast; for a longer
   one the places are written and joined, and a name that a great many places share
   is split over several tasks by a salt and repeated for each.
4. Of occurrences of one name that overlap each other the leftmost stay.

No name of more than one character reaches the driver or a plan; only the number
of names, their lengths and bytes, and those first characters do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions.text import empty_array, extract_all, running, split_all
from quietmark.operators.detectors import name_pattern
from quietmark.session import Stages

ANCHOR = 6
MAX_BEGINNINGS = 2_000
BROADCAST_BYTES = 16 * 1024 * 1024
NAMES_A_WORD = 4
SIEVE_WORDS = 1 << 19
#: Places of one name that one task should meet, and how many names may be split at most.
SPLIT = 100_000
MAX_SPLIT = 10_000


def fold(text: Column) -> Column:
    """Equal for texts that are equal without regard to case, in any script."""
    return F.upper(F.lower(F.translate(text, "İ", "I")))


def _sieved(rows: DataFrame, words: int) -> DataFrame:
    """Add the word of the sieve that a beginning falls into, and its three bits there."""
    hashed = rows.withColumn("_h", F.xxhash64("_anchor"))
    bit = lambda at: f"shiftleft(1L, cast(shiftright(_h, {at}) & 63 as int))"
    return hashed.withColumns({"_word": F.expr(f"pmod(shiftright(_h, 18), {words}L)"), "_mask": F.expr(f"{bit(0)} | {bit(6)} | {bit(12)}")}).drop("_h")


def sieve(listed: DataFrame, words: int, *more: Column) -> DataFrame:
    """The sieve of a list by ``_anchor``: at most ``words`` rows, with ``more`` aggregates."""
    return _sieved(listed, words).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"), *more)


def sifted(rows: DataFrame, held: DataFrame, words: int) -> DataFrame:
    """The rows whose ``_anchor`` the sieve holds, and a few more."""
    return _sieved(rows, words).join(F.broadcast(held), "_word").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))


def _beginnings(listed: DataFrame) -> str:
    """A pattern for the first characters of every name in any case, never a whole name of several; empty if there are too many."""
    for most in (2, 1):
        first = F.left("name", F.greatest(F.lit(1), F.least(F.lit(most), F.col("_n") - 1)))
        found = [r.first for r in listed.select(first.alias("first")).distinct().limit(MAX_BEGINNINGS + 1).collect()]
        if len(found) <= MAX_BEGINNINGS:
            break
    else:
        return ""
    point = lambda c: rf"\x{{{ord(c):x}}}"
    after: dict[str, set[str]] = {}
    for text in found:
        after.setdefault(point(text[0]), set()).add("".join(map(point, text[1:])))
    pairs = "|".join(c if "" in more else f"{c}[{''.join(sorted(more))}]" for c, more in sorted(after.items()))
    return f"(?iu:(?=[{''.join(sorted(after))}])(?:{pairs}))" if after else "(?!)"


def _places(chunks: DataFrame, width: int, lengths: list[int], bounded: bool, begin: str = "") -> DataFrame:
    """``doc_id, chunk_no, start, _window, _k, _anchor`` for every place where a name may begin.

    The pattern eats the first code point of every place, so the gaps between places
    give the offsets; ``_k`` is the length of the beginning.
    """
    left = "(?<![A-Za-z])" if bounded else ""
    windows = extract_all(F.col("text"), rf"(?s){left}(?={begin})(?=(.{{1,{width}}})).", 1)
    cut = chunks.select("doc_id", "chunk_no", windows.alias("_w"), split_all(F.col("text"), rf"(?s){left}(?={begin}).").alias("_g"))
    before = running(F.transform("_g", lambda gap: F.length(gap) + 1), "sum")
    cut = cut.withColumn("_e", F.when(F.size("_w") > 0, before))
    near = F.zip_with("_w", F.slice("_e", F.lit(1), F.size("_w")), lambda w, e: F.struct(w.alias("w"), (e - 1).alias("at")))
    rows = cut.select("doc_id", "chunk_no", F.explode_outer(near).alias("x")).where(F.col("x.w").isNotNull())
    rows = rows.select("doc_id", "chunk_no", F.col("x.at").alias("start"), F.col("x.w").alias("_window"))
    begin_of = [F.when(F.length("_window") >= n, F.struct(F.lit(n).alias("k"), F.left("_window", F.lit(n)).alias("a"))) for n in lengths]
    rows = rows.withColumn("x", F.explode_outer(F.array(*begin_of))).where("x is not null")
    return rows.withColumns({"_k": F.col("x.k"), "_anchor": fold(F.col("x.a"))}).drop("x")


def _leftmost(spans: Column) -> Column:
    """Of sorted spans of equal length those that a left-to-right search finds."""

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (last["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept)

    apart = F.forall(F.sequence(F.lit(1), F.size(spans)), lambda i: (i == F.size(spans)) | (F.get(spans, i - 1)["end"] <= F.get(spans, i)["start"]))
    return F.when(apart, spans).otherwise(F.aggregate(spans, empty_array("struct<start:int,end:int,value:string>"), step))


def _salted(near: DataFrame, listed: DataFrame, stages: Stages, on=("_folded", "_n"), place=("doc_id", "chunk_no", "start")) -> DataFrame:
    """Join of places and names on the whole name; names with many places are split over several tasks."""
    size = max(SPLIT, near.count() // MAX_SPLIT)
    often = near.groupBy("_folded").agg(F.count("*").alias("_places")).where(F.col("_places") > size)
    often = F.broadcast(stages.save(often.select("_folded", F.ceil(F.col("_places") / size).alias("_parts"))))  # at most MAX_SPLIT rows
    part = F.coalesce(F.pmod(F.xxhash64(*place), F.col("_parts")), F.lit(0))
    left = near.join(often, "_folded", "left").withColumn("_part", part).drop("_parts")
    right = listed.join(often, "_folded", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return left.join(right, [*on, "_part"])


def occurrences(chunks: DataFrame, names: DataFrame, bounded: bool = True, stages: Stages | None = None) -> DataFrame:
    """``doc_id, chunk_no``, the columns of ``names``, ``start, end, value`` of every occurrence.

    ``names`` has a column ``name``; equal rows count once, and null or empty names
    are in no text.  Bounded names touch no ASCII letter on either side.
    """
    stages = stages or Stages(chunks.sparkSession)
    columns, size = names.columns, F.length("name")
    listed = names.where("name != ''").distinct().withColumns({
        "_n": size, "_anchor": fold(F.left("name", F.least(size, F.lit(ANCHOR)))), "_folded": fold(F.col("name")),
    })
    listed = stages.save(listed)
    shape = listed.agg(
        F.count("*").alias("n"), F.max("_n").alias("longest"), F.sort_array(F.collect_set("_n")).alias("sizes"),
        F.sum(F.octet_length("_folded") * 3 + 64).alias("bytes"),
    ).first()
    words = min(SIEVE_WORDS, 1 + shape["n"] // NAMES_A_WORD)
    sizes = F.bit_or(F.expr("shiftleft(1L, _n & 63)")).alias("_sizes")
    lengths = sorted({min(n, ANCHOR) for n in shape["sizes"]}) or [1]
    places = _places(chunks, 1 + (shape["longest"] or 0), lengths, bounded, _beginnings(listed))
    near = sifted(places, sieve(listed, words, sizes), words)
    listed_sizes = F.expr(f"cast(array({', '.join(map(str, shape['sizes']))}) as array<int>)")
    fits = F.filter(listed_sizes, lambda n: (F.least(n, F.lit(ANCHOR)) == F.col("_k")) & (n <= F.length("_window")) & (F.getbit("_sizes", n.bitwiseAND(F.lit(63))) == 1))
    near = near.withColumn("_n", F.explode_outer(fits)).where("_n is not null")
    near = near.select("doc_id", "chunk_no", "start", "_n", F.left("_window", F.col("_n") + 1).alias("_window"), fold(F.left("_window", F.col("_n"))).alias("_folded"))
    listed = listed.drop("_anchor")
    if (shape["bytes"] or 0) <= BROADCAST_BYTES:
        met = near.join(F.broadcast(listed), ["_folded", "_n"])
    else:
        met = _salted(stages.save(near), listed, stages)
    met = met.where(F.regexp_like("_window", F.concat(F.lit("^(?:"), name_pattern(F.col("name"), bounded), F.lit(")"))))
    span = F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("_n")).cast("int").alias("end"), F.left("_window", F.col("_n")).alias("value"))
    found = met.groupBy("doc_id", "chunk_no", *columns).agg(F.array_sort(F.collect_list(span)).alias("_s"))
    found = found.select("doc_id", "chunk_no", *columns, F.explode_outer(_leftmost(F.col("_s"))).alias("_s"))
    return found.select("doc_id", "chunk_no", *columns, "_s.start", "_s.end", "_s.value")
