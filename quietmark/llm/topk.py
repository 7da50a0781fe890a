"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights: component ``t`` of a vector is a
posting of term ``t``.  Queries and candidates are dealt into blocks; every pair
of blocks is one group of one shuffle.  Inside a group each query scatters
``weight * posting`` term by term into a dense array of scores, one place a
candidate, and a partition selection keeps its ``k`` best; the lists of the
blocks are merged by rank.  A group holds ``QUERY_BLOCK`` queries and
``CANDIDATE_BLOCK`` candidates whatever the size of the table, and no block
depends on a value, so equal vectors or ids cannot make one block large.

Weights are ``floor(scale * x)``, as 64-bit integers (larger ones stop at the limits
of that type); missing components count as zero.  Blocks whose scores may leave 64
bits are added up in integers of any length, and a score beyond 64 bits is reported
as the limit of that type.  Null vectors, vectors with null or non-finite
components and rows without an id take no part.  Candidates of a query row are all
other rows, also those with its id; query rows that share an id have a list each.
Ties go to the smaller id.
Fewer candidates than ``k`` give a shorter list, an empty table an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietmark.llm.common import Stages

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
LONGEST = (1 << 63) - 1
#: The largest double below 2**63.
LIMIT = float((1 << 63) - 1024)
LISTS = "query long, query_id long, vec_id long, score long"


def weights(vector: Column, scale: int = 256) -> Column:
    """The vector as integers; null where it can take no part."""
    doubles = vector.cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(doubles, lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x, F.lit(-LIMIT)), F.lit(LIMIT))))
    return F.when(~F.exists(doubles, odd), whole)


def _postings(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """Term to (places, weights); a term that every row has needs no list of places."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = lists.flatten().to_numpy()
    some = value != 0
    row, term, value = row[some], term[some], value[some]
    order = np.argsort(term, kind="stable")
    row, term, value = row[order], term[order], value[order]
    kinds, first = np.unique(term, return_index=True)
    out = {}
    for t, lo, hi in zip(kinds.tolist(), first, np.append(first[1:], len(term))):
        out[t] = (slice(None) if hi - lo == len(sizes) else row[lo:hi], value[lo:hi])
    return out


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids, numbers = candidates["vec_id"].to_numpy(), candidates["number"].to_numpy()
        index = _postings(candidates["w"])
        most = {t: max(abs(int(posting.max())), abs(int(posting.min()))) for t, (_, posting) in index.items()}
        out_n, out_q, out_v, out_s = [], [], [], []
        if len(ids):
            for number, qid, row in zip(queries["number"].to_pylist(), queries["vec_id"].to_pylist(), queries["w"]):
                row = row.values.to_numpy()
                fits = sum(abs(w) * most.get(t, 0) for t, w in enumerate(row.tolist())) <= LONGEST
                scores = np.zeros(len(ids), np.int64 if fits else object)
                for t, weight in enumerate(row if fits else row.tolist()):
                    if weight and t in index:
                        places, posting = index[t]
                        scores[places] += weight * (posting if fits else posting.astype(object))
                free = np.flatnonzero(numbers != number)
                own = scores[free]
                if len(own) > k:  # all that reach the k-th score, so that ties are settled by id
                    free = free[own >= np.partition(own, len(own) - k)[len(own) - k]]
                rank = np.argsort(ids[free], kind="stable")
                best = free[rank[np.argsort(-scores[free[rank]], kind="stable")[:k]]]
                out_n += [number] * len(best)
                out_q += [qid] * len(best)
                out_v.append(ids[best])
                out_s.append(np.clip(scores[best], -LONGEST - 1, LONGEST).astype(np.int64))
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        return pa.table({"query": pa.array(out_n, pa.int64()), "query_id": pa.array(out_q, pa.int64()), "vec_id": join(out_v), "score": join(out_s)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "vec", scale: int = 256, stages: Stages | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``is_query`` holds (it may read any input column)."""
    stages = stages or Stages(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).try_cast("long").alias("vec_id"), weights(F.col(vector_col), scale).alias("w"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # The number of a row in its scan: the same whenever the scan is repeated, and even over blocks.
    rows = stages.save(rows.where("w is not null and vec_id is not null").withColumn("number", F.monotonically_increasing_id()))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda d, own, other, m, r: d.withColumn(own, F.pmod(F.xxhash64("number"), F.lit(m))).withColumn(other, F.explode(F.expr(f"sequence(0L, {r - 1}L)")))
    queries = deal(rows.where("q").select("number", "vec_id", "w"), "qb", "cb", query_blocks, blocks)
    candidates = deal(rows.select("number", "vec_id", "w"), "cb", "qb", blocks, query_blocks)
    lists = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(_search(k), LISTS)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
