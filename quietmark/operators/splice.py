"""Put replacements into text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietmark.functions.text import let, slice_text


def splice(text: Column, spans: Column) -> Column:
    """Cut ``text`` at disjoint, sorted ``spans`` and insert their ``replacement``.

    Pieces are built per span and joined once; text without spans is unchanged.
    """

    def joined(s: Column) -> Column:
        pieces = F.transform(
            s,
            lambda x, i: F.concat(
                slice_text(text, F.coalesce(F.get(s, i - 1)["en"], F.lit(0)), x["st"]), x["replacement"]
            ),
        )
        tail = slice_text(text, F.element_at(s, -1)["en"], F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(spans, joined))
