"""Overlap resolution: a sorted, disjoint span array per chunk."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions.text import empty_array, let, running
from quietmark.operators.detectors import SPAN


def with_merged(detected: DataFrame, policy: str = "cover") -> DataFrame:
    """Replace the ``spans`` column by the resolved ``merged``."""
    return detected.withColumn("merged", _merged(policy)).drop("spans")


@lru_cache(maxsize=4)
def _merged(policy: str) -> Column:
    return resolve(F.col("spans"), policy)


def resolve(spans: Column, policy: str = "cover") -> Column:
    """Disjoint spans in text order.

    Spans are ordered by start, longest first, detector rank, and cut into runs
    in which each span overlaps an earlier one; runs do not affect each other.

    ``longest`` walks a run and lets a strictly longer span replace the last
    kept one, which can leave the head of the replaced span uncovered.
    ``cover`` makes one span of the whole run; type and value are those of its
    longest member, lowest rank on ties.
    """
    inside = _walk if policy == "longest" else _cover

    def runs(s: Column) -> Column:
        starts = let(
            running(F.transform(s, lambda x: x["en"]), "max"),
            lambda reach: F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: (i == 0) | (F.get(s, i)["st"] >= F.get(reach, i - 1)),
            ),
        )
        return let(
            starts,
            lambda b: F.transform(
                b, lambda x, k: F.slice(s, x + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - x)
            ),
        )

    def resolved(s: Column) -> Column:
        return F.flatten(F.transform(runs(s), lambda r: F.when(F.size(r) == 1, r).otherwise(inside(r))))

    return F.when(F.size(spans) <= 1, spans).otherwise(let(F.array_sort(spans), resolved))


def _walk(run: Column) -> Column:
    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        head = F.slice(kept, F.lit(1), F.size(kept) - 1)
        return (
            F.when((F.size(kept) == 0) | (s["st"] >= last["en"]), F.concat(kept, F.array(s)))
            .when(s["neg"] < last["neg"], F.concat(head, F.array(s)))
            .otherwise(kept)
        )

    return F.aggregate(run, empty_array(SPAN), step)


def _cover(run: Column) -> Column:
    def union(top: Column) -> Column:
        st, en = run[0]["st"], F.array_max(F.transform(run, lambda s: s["en"]))
        return F.struct(
            st.alias("st"),
            (st - en).alias("neg"),
            top["o"]["rk"].alias("rk"),
            en.alias("en"),
            top["o"]["type"].alias("type"),
            top["o"]["value"].alias("value"),
        )

    ranked = F.transform(run, lambda s: F.struct(s["neg"].alias("neg"), s["rk"].alias("rk"), s.alias("o")))
    return F.array(let(F.array_min(ranked), union))
