"""MinHash near-dedup with circulant permutations.

A document's set are its distinct five-word shingles.  All ``K`` signature values
come from two permutations: the first places a shingle in a universe of ``D``
places, the second, shifted by ``k`` places, gives its rank for the ``k``-th
value.  A shingle's ``K`` ranks are thus one contiguous slice of one table, and a
signature is the minimum of such slices.

1. Rows with equal sets become one class (128-bit digest of the set), so copies
   cost nothing below.
2. Signatures are cut into bands; classes that share a band share a bucket.
   Each bucket has a hub, the class with the most company in all its buckets: in a
   group of near copies that is the one nearest to their common text.  Sizes and a
   sketch (four bits of every signature value) screen the pairs of a class and its
   hubs, and of those left the class's nearest one is compared on the full sets: a
   pair a class, however large a bucket is.
3. Links join classes to components.  Buckets that now lie within one component
   are done.  In the others every class outside the component of the bucket's hub
   meets the classes of other components, again behind the screen, now over
   twice as many signature values: of the members of a group that are similar at
   0.57, by calculation one pair in 3,000 passes (of the first one in eight does).
   This is one join whose hot keys Spark splits.  The sets of the classes that have
   a plausible partner give two exact bounds.  Shingles that a class shares
   with none of the others cannot be common, so a class with many of its own is
   similar to nothing.  And each set is hashed to the parities of some bits: where two
   sets' parities differ, a shingle is in one of them only, so classes just below
   the limit are told apart without listing their pairs.  No pair that shares a
   bucket is left out for any other reason, but pairs within a component are never
   listed.

Two documents at the limit of 0.75 share no band of 51 with probability 1e-6; the
screens drop such a pair with probability 1e-6 each.

Null or empty text, or text without words: an empty set, linked with nothing.
Null id: takes no part, ``component_id`` null, kept.  Rows that share an id but
not a text are judged one by one; wholly repeated rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.llm.common import Stages, attach, fresh, giving_back, packed, row_tag
from quietmark.llm.components import components
from quietmark.llm.words import FOLD_CASE, SPACES, Words, groups, mix, pieces, rolling, text_bytes

SHINGLE = 5
THRESHOLD = 75  # per cent
D = 1 << 20
#: Signature values; bands and the first sketch take the first half.
K = 512
NARROW = K // 2
ROWS = 5
BANDS = NARROW // ROWS
#: Differing sketch values, of NARROW: mean 60, deviation 6.8 at a similarity of 0.75.
SCREEN = 94
LONGS = NARROW // 16
#: The same of all K values: mean 120, deviation 9.6.
WIDE_SCREEN = 168
#: Longs of 64 bits that hold the parities of a full set.
PARITIES = 32
SEED = 20_250_601
SIGNED = "id long, tag long, n long, cls binary, sketch array<long>, more array<long>, bands array<long>"

_RANKS: list[np.ndarray] = []


def ranks() -> np.ndarray:
    """Row ``p``: the ranks of place ``p`` under the second permutation shifted by 0 .. K-1."""
    if not _RANKS:
        p = np.random.default_rng(SEED).permutation(D).astype(np.int32)
        _RANKS.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: K - 1]]), K))
    return _RANKS[0]


def shingle_sets(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, sorted within each, and where each text begins."""
    words = Words(buf, at, SPACES, FOLD_CASE)
    counts, left = words.counts, words.left()
    long = left >= SHINGLE
    text = np.repeat(np.arange(len(counts)), counts)
    h, text_of = rolling(words.hash, SHINGLE)[long], text[long]
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):  # the whole sequence is the only shingle
        whole = [rolling(words.hash[words.first[t] : words.first[t + 1]], SHINGLE)[0] for t in few]
        h = np.concatenate([h, mix(np.array(whole, np.uint64) + counts[few].astype(np.uint64))])
        text_of = np.concatenate([text_of, few])
    order = np.lexsort((h, text_of))
    h, text_of = h[order], text_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])
    h, text_of = h[new], text_of[new]
    return h, np.searchsorted(text_of, np.arange(len(counts) + 1))


def signature(shingles: np.ndarray) -> np.ndarray:
    place = (mix(shingles ^ np.uint64(SEED)) % np.uint64(D)).astype(np.int64)
    table = ranks()
    out = table[place[:1024]].min(axis=0)
    for lo in range(1024, len(place), 1024):
        np.minimum(out, table[place[lo : lo + 1024]].min(axis=0), out=out)
    return out


def _digest(h: np.ndarray) -> bytes:
    return packed(np.array([mix(h).sum(dtype=np.uint64), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]), np.uint64)


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, tag, text) to size, class, sketch and band keys; no bands for an empty set."""
    buf, at = text_bytes(batch.column(2))
    n = np.zeros(batch.num_rows, np.int64)
    cls: list[bytes] = []
    values = np.zeros((batch.num_rows, K), np.int32)
    for lo, hi in groups(at):
        h, first = shingle_sets(buf, at[lo : hi + 1])
        n[lo:hi] = np.diff(first)
        for t in range(hi - lo):
            own = h[first[t] : first[t + 1]]
            cls.append(_digest(own))
            if len(own):
                values[lo + t] = signature(own)
    # Four bits of a hash of each value, not of the rank: small ranks are the likely minima.
    four = (mix(values.astype(np.uint64) + np.arange(K, dtype=np.uint64) * np.uint64(D)) >> np.uint64(60)).astype(np.uint8)
    sketch = np.ascontiguousarray(four[:, ::2] << 4 | four[:, 1::2]).view(np.int64)
    by_band = values[:, : BANDS * ROWS].astype(np.uint64).reshape(len(values), BANDS, ROWS)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(values), 1))
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + by_band[:, :, j])
    keys = keys.view(np.int64)
    used = n > 0
    offsets = np.concatenate([[0], np.cumsum(used * BANDS)]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[used].reshape(-1)))
    first, more = (pa.array(list(half), pa.list_(pa.int64())) for half in (sketch[:, :LONGS], sketch[:, LONGS:]))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(n), pa.array(cls, pa.binary()), first, more, bands],
        names=["id", "tag", "n", "cls", "sketch", "more", "bands"],
    )


@giving_back
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, 2):
        yield _signed(piece)


def _parities(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """Of each set, which of ``64 * PARITIES`` bits an odd number of its hashes fall on."""
    bits = np.zeros((len(first) - 1, 64 * PARITIES), np.uint8)
    place = (mix(h ^ np.uint64(SEED + 1)) % np.uint64(bits.shape[1])).astype(np.int64)
    np.bitwise_xor.at(bits, (np.repeat(np.arange(len(bits)), np.diff(first)), place), 1)
    return pa.array(list(np.packbits(bits, axis=1).view(np.int64)), pa.list_(pa.int64()))


@giving_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, at = text_bytes(batch.column(0))
        for lo, hi in groups(at):
            h, first = shingle_sets(buf, at[lo : hi + 1])
            cls = [_digest(h[a:b]) for a, b in zip(first, first[1:])]
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), sets, _parities(h, first)], names=["cls", "shingles", "parity"])


def _sets_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame, stages: Stages) -> DataFrame:
    """``cls, shingles, parity``: the full sets of the classes in ``wanted``, made from one text of each."""
    ids = stages.save(wanted.join(classes.select("cls", F.col("rep").alias("id"), "tag"), "cls").select("id", "tag").distinct())
    sets = attach(texts, ids, ["id", "tag"], "left_semi", 40).select("text").mapInArrow(_sets, "cls binary, shingles array<long>, parity array<long>")
    sets = stages.save(sets.dropDuplicates(["cls"]))
    stages.drop(ids)
    return sets


def _linked(pairs: DataFrame, sets: DataFrame, stages: Stages) -> DataFrame:
    """Of screened pairs (``a, b``), those whose full sets are similar enough."""
    sets = sets.select("cls", "shingles")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return stages.save(both.where(100 * common >= THRESHOLD * union).select("a", "b"))


def _differing(one: str, other: str) -> Column:
    """How many of the 4-bit values in two sketches differ."""
    return reduce(lambda x, y: x + y, (_differing_in(F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(LONGS)))


def _differing_in(x: Column) -> Column:
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _plausible() -> Column:
    """Sizes ``n, o`` allow the similarity and the sketches do not speak against it."""
    sizes = 100 * F.least("n", "o") >= THRESHOLD * F.greatest("n", "o")
    return sizes & (_differing("sketch", "other") <= SCREEN)


def _plausible_wide() -> Column:
    """The same over all values of the signature."""
    return _plausible() & (_differing("sketch", "other") + _differing("more", "other_more") <= WIDE_SCREEN)


def _at_least_apart(one: str, other: str) -> Column:
    """How many shingles at least are in one of two sets only: equal parities hide differences, but make none."""
    odd = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(odd, F.lit(0), lambda so_far, x: so_far + x)


def _lonely(sets: DataFrame) -> DataFrame:
    """``cls, lonely, parity``: how many shingles of a class are in no other of the sets."""
    each = sets.select("cls", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("cls").alias("cls"), F.count("*").alias("m"))
    alone = each.where("m = 1").groupBy("cls").agg(F.count("*").alias("lonely"))
    return sets.select("cls", "parity").join(alone, "cls", "left").na.fill(0, ["lonely"]).select("cls", "lonely", "parity")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stages: Stages | None = None) -> DataFrame:
    """``id, tag, n_shingles, component_id, kept`` for every row; ``tag`` is ``row_tag(text)``."""
    stages = stages or Stages(docs.sparkSession)
    texts = docs.select(F.col(id_col).try_cast("long").alias("id"), row_tag(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    signed = stages.save(texts.mapInArrow(_sign, SIGNED))
    usable = signed.where("id is not null and n > 0")
    classes = stages.save(
        usable.groupBy("cls").agg(
            F.min(F.struct("id", "tag")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("more").alias("more"), F.first("bands").alias("bands")
        ).select("cls", F.col("r.id").alias("rep"), F.col("r.tag").alias("tag"), "n", "sketch", "more", "bands")
    )
    placed = classes.select("cls", F.explode("bands").alias("key"))
    shared = stages.save(placed.join(placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"))
    weights = shared.groupBy("cls").agg(F.sum("m").alias("w"))
    hubs = shared.join(weights, "cls").groupBy("key").agg(F.max(F.struct("w", "cls"))["cls"].alias("hub"))
    buckets = stages.save(shared.select("key", "cls").join(hubs, "key"))
    stages.drop(shared)
    narrow = classes.select("cls", "n", "sketch")
    right = narrow.toDF("b", "o", "other")

    # Every class meets the hub that its sketch is nearest to: a pair a class, however large a bucket is.
    stars = buckets.where("cls != hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(narrow.withColumnRenamed("cls", "a"), "a").join(right, "b").where(_plausible())
    near = stages.save(stars.groupBy("a").agg(F.min(F.struct(_differing("sketch", "other"), "b"))["b"].alias("b")))
    sets = _sets_of(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), classes, texts, stages)
    links = _linked(near, sets, stages)
    roots = stages.save(components(links, stages))
    stages.drop(near, sets, links)

    def root_of(c: str, out: str) -> DataFrame:
        return roots.select(F.col("node").alias(c), F.col("root").alias(out))

    # Buckets over several components: classes outside the hub's component meet all classes of other components.
    member = buckets.join(root_of("cls", "r"), "cls", "left").withColumn("r", F.coalesce("r", "cls"))
    member = stages.save(member.join(root_of("hub", "hr"), "hub", "left").withColumn("hr", F.coalesce("hr", "hub")))
    strays = stages.save(member.where("r != hr").select("key", "cls", "r"))
    if not strays.isEmpty():
        wide = classes.select("cls", "n", "sketch", "more")
        left = strays.join(wide, "cls").select("key", F.col("cls").alias("a"), "r", "n", "sketch", "more")
        rest = member.join(strays.select("key").distinct(), "key", "left_semi").join(wide, "cls")
        rest = rest.select("key", F.col("cls").alias("b"), F.col("r").alias("q"), (F.col("r") == F.col("hr")).alias("home"), F.col("n").alias("o"), F.col("sketch").alias("other"), F.col("more").alias("other_more"))
        apart = (left["key"] == rest["key"]) & (F.col("r") != F.col("q")) & _plausible_wide()
        # Only classes with a plausible partner go on, and of their pairs only those that the sets' sizes still allow
        # when the shingles that none of the others has are taken off, and that the sets' parities allow.
        left, rest = stages.save(left.join(rest, apart, "left_semi")), stages.save(rest.join(left, apart, "left_semi"))
        sets = _sets_of(left.select(F.col("a").alias("cls")).union(rest.select("b")).distinct(), classes, texts, stages)
        lonely = stages.save(_lonely(sets))
        left, rest = left.join(lonely.toDF("a", "u", "odd"), "a"), rest.join(lonely.toDF("b", "v", "other_odd"), "b")

        def enough(common: Column) -> Column:
            return 100 * common >= THRESHOLD * (F.col("n") + F.col("o") - common)

        allowed = enough(F.least(F.col("n") - F.col("u"), F.col("o") - F.col("v"))) & _plausible_wide()
        allowed &= enough((F.col("n") + F.col("o") - _at_least_apart("odd", "other_odd")) / 2)
        once = F.col("home") | (F.col("a") < F.col("b"))
        met = left.join(rest, (left["key"] == rest["key"]) & (F.col("r") != F.col("q")) & once & allowed)
        more = _linked(stages.save(met.select("a", "b").distinct()), sets, stages)
        so_far = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stages.save(components(so_far.union(more), stages))
        stages.drop(sets, lonely)
    stages.drop(buckets, member, strays)

    smallest = roots.join(classes.select(F.col("cls").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("c"))
    named = classes.select("cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(smallest, "root", "left")
    named = named.select("cls", F.coalesce("c", "rep").alias("component_id"))
    out = signed.select("id", "tag", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return out.select("id", "tag", "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stages: Stages | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id.

    Among rows that share this id, the one with the smallest tag stays, and of
    wholly repeated rows one.  Rows without an id or without words all stay.
    """
    stages = stages or Stages(docs.sparkSession)
    judged = stages.save(near_duplicates(docs, id_col, text_col, stages))
    heads = judged.where("kept and id is not null and n_shingles > 0").groupBy("id").agg(F.min("tag").alias("head"), F.count("*").alias("m"))
    shared = stages.save(heads.where("m > 1").drop("m"))
    extra = judged.join(shared, "id").where("tag != head").select("id", "tag")
    lost = stages.save(judged.where("not kept").select("id", "tag").union(extra).distinct())
    key, tag, copy = fresh("id"), fresh("tag"), fresh("copy")
    keyed = docs.withColumn(key, F.col(id_col).try_cast("long")).withColumn(tag, row_tag(F.col(text_col)))
    left = attach(keyed, lost.toDF(key, tag), [key, tag], "left_anti", 40)
    if shared.isEmpty():
        return left.drop(key, tag)
    again = shared.toDF(key, tag)
    single = attach(left, again, [key, tag], "left_anti", 40)
    several = attach(left, again, [key, tag], "left_semi", 40).withColumn(copy, F.monotonically_increasing_id())
    first = several.dropDuplicates([key, tag]).drop(copy)
    return single.unionByName(first).drop(key, tag)
