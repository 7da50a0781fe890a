"""Text and array helpers on Columns; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def has_digit(c: Column) -> Column:
    """``rlike '(?U)\\d'`` with a fast path: ASCII digits are found by byte search."""
    ascii_digit = reduce(lambda a, b: a | b, [F.contains(c, F.lit(str(d))) for d in range(10)])
    return ascii_digit | F.when(F.octet_length(c) > F.length(c), c.rlike(r"(?U)\d")).otherwise(False)


def literals(words) -> Column:
    """A literal array, built in one call."""
    quoted = ("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({', '.join(quoted)})")


def strip(c: Column) -> Column:
    """Trim all white space at both ends (``trim`` only takes spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def not_blank(c: Column) -> Column:
    return c.rlike(r"(?U)\S")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def empty_array(of: str) -> Column:
    return F.expr(f"cast(array() as array<{of}>)")


def extract_all(text: Column, pattern: str | Column, group: int = 0) -> Column:
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_extract_all(text, p, F.lit(group))


def split_all(text: Column, pattern: str | Column) -> Column:
    return F.split(text, F.lit(pattern) if isinstance(pattern, str) else pattern, -1)


def running(values: Column, op: str) -> Column:
    """Inclusive running ``sum`` or ``max`` over an ``array<int>``.

    A plain fold copies its growing result at every step, which is quadratic.
    The array is cut into blocks: each block is folded alone, the block totals
    are folded next, and the two are added up, so the work is about linear.
    """

    def combine(a: Column, b: Column) -> Column:
        return a + b if op == "sum" else F.greatest(a, b)

    def last(xs: Column) -> Column:
        return F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit(0))

    def scan(xs: Column) -> Column:
        return F.aggregate(
            xs, empty_array("int"), lambda acc, x: F.concat(acc, F.array(combine(last(acc), x)))
        )

    def blocked(xs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")),
            lambda b: scan(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))),
        )
        return let(
            blocks,
            lambda bs: F.flatten(
                F.zip_with(
                    bs,
                    let(
                        scan(F.transform(bs, last)),
                        lambda totals: F.concat(
                            F.array(F.lit(0)), F.slice(totals, F.lit(1), F.size(totals) - 1)
                        ),
                    ),
                    lambda block, carry: F.transform(block, lambda x: combine(x, carry)),
                )
            ),
        )

    return let(values, lambda xs: F.when(F.size(xs) <= BLOCK, scan(xs)).otherwise(blocked(xs)))


PART = "struct<m:array<string>,v:array<string>,g:array<string>>"
RAW = "array<struct<st:int,en:int,value:string>>"


def match_parts(text: Column, pattern: str | Column, group: int = 0, matches: Column | None = None) -> Column:
    """Matches, group values and gaps of one pattern: the input of ``part_spans``."""
    m = extract_all(text, pattern) if matches is None else matches
    v = m if group == 0 else extract_all(text, pattern, group)
    parts = F.struct(m.alias("m"), v.alias("v"), split_all(text, pattern).alias("g"))
    none = empty_array("string")
    return F.when(F.size(m) > 0, parts).otherwise(F.struct(none.alias("m"), none.alias("v"), none.alias("g")))


def part_spans(p: Column) -> Column:
    """``array<struct<st,en,value>>`` of every match, offsets in code points.

    ``regexp_extract_all`` gives the matches and ``split`` the gaps of the same
    match sequence, so running lengths give the offsets.  With ``group=1`` the
    span is that of the group, which must end where the match ends.
    """
    ends = running(
        F.zip_with(p["m"], F.slice(p["g"], F.lit(1), F.size(p["m"])), lambda a, b: F.length(a) + F.length(b)), "sum"
    )
    spans = F.zip_with(
        p["v"], ends, lambda v, e: F.struct((e - F.length(v)).alias("st"), e.alias("en"), v.alias("value"))
    )
    return F.when(F.size(p["m"]) > 0, spans).otherwise(F.expr(f"cast(array() as {RAW})"))


def match_spans(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return let(match_parts(text, pattern, group), part_spans)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with zero-based code-point offsets."""
    return F.substring(text, start + 1, end - start)
