"""Boolean and scalar rules on values: placeholders, names, cards, addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietmark.functions import patterns as P
from quietmark.functions import vocab as V
from quietmark.functions.text import digits, extract_all, let, literals, slice_text, strip

EDGE = r"[ /,:;.\-*^&()\[\]{}]"


def is_placeholder(value: Column, extended: bool = True) -> Column:
    """True for text this engine generates itself.

    ``extended`` adds the full address, the constant date and bracket forms.
    """
    shapes = list(P.PLACEHOLDER_SHAPES.values()) + (list(P.EXTRA_SHAPES) if extended else [])
    return strip(value).rlike(f"(?i)^(?:{'|'.join(shapes)})$")


def luhn_valid(value: Column) -> Column:
    """13-19 digits whose Luhn sum is a multiple of ten."""

    def total(d: Column) -> Column:
        doubled = F.transform(
            F.sequence(F.lit(1), F.length(d)),
            lambda i: let(
                F.substring(d, i, F.lit(1)).cast("int") * F.when((F.length(d) - i) % 2 == 1, 2).otherwise(1),
                lambda x: F.when(x > 9, x - 9).otherwise(x),
            ),
        )
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)

    return let(
        digits(value), lambda d: F.when(F.length(d).between(13, 19), total(d) % 10 == 0).otherwise(False)
    )


def valid_ip(value: Column) -> Column:
    """Four parts, each 0-255; leading zeros are allowed."""
    parts = F.split(value, r"\.", -1)
    return (F.size(parts) == 4) & F.forall(parts, lambda x: x.cast("int").between(0, 255))


def words_of(value: Column) -> Column:
    return F.filter(F.split(value, r"(?U)\s+", -1), lambda w: w != "")


def clean_person(value: Column, generic=V.GENERIC_WORDS) -> Column:
    """Strip punctuation at both ends, drop trailing generic words, collapse spaces."""
    core = F.regexp_replace(strip(value), f"^{EDGE}+|{EDGE}+$", "")

    def kept(words: Column) -> Column:
        bare = lambda w: F.regexp_replace(F.lower(w), f"^{EDGE}+|{EDGE}+$", "")
        last = F.array_max(
            F.transform(words, lambda w, i: F.when(F.array_contains(literals(generic), bare(w)), 0).otherwise(i + 1))
        )
        return F.array_join(F.slice(words, F.lit(1), F.coalesce(last, F.lit(0))), " ")

    return let(words_of(core), kept)


def looks_like_person(
    value: Column,
    generic=V.GENERIC_WORDS,
    non_person=V.NON_PERSON_WORDS,
    phrases=(),
) -> Column:
    """At least two words, all of them name-shaped and none on a rejecting list."""

    def check(name: Column) -> Column:
        flat = strip(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^a-z\s]", " "), r"(?U)\s+", " "))
        words = words_of(name)
        lettered = F.filter(
            F.transform(words, lambda w: F.regexp_replace(w, "[^A-Za-z'-]", "")), lambda w: w != ""
        )
        return (
            F.when(F.size(words) < 2, False)
            .when(F.array_contains(literals(phrases), flat) if phrases else F.lit(False), False)
            .otherwise(
                let(
                    lettered,
                    lambda ws: (F.size(ws) >= 2)
                    & ~F.arrays_overlap(F.transform(ws, F.lower), literals(sorted(set(non_person) | set(generic))))
                    & F.forall(ws, lambda w: w.rlike("^[A-Za-z][A-Za-z'-]*$")),
                )
            )
        )

    return F.coalesce(let(clean_person(value, generic), check), F.lit(False))


def is_organization(
    value: Column, terms=V.ORGANIZATION_TERMS, generic=V.GENERIC_ORGANIZATION_WORDS
) -> Column:
    """Contains a company term, and is more than one generic word."""
    low = F.lower(strip(value))
    return reduce(lambda a, b: a | b, [low.contains(t) for t in terms]) & ~low.isin(*generic)


def address_score(text: Column, start: Column, end: Column, radius: int = 80, words=V.ADDRESS_WORDS) -> Column:
    """Number of distinct address words within ``radius`` characters of a span."""
    left = slice_text(text, F.greatest(start - radius, F.lit(0)), start)
    right = slice_text(text, end, end + radius)
    near = extract_all(F.lower(F.concat_ws(" ", left, right)), "[a-z]+")
    return F.size(F.array_intersect(near, literals(words)))


def survives(kind: Column, value: Column, text: Column, lowered: Column, exact: bool = False) -> Column:
    """Is ``value`` still in ``text``?

    The default is a case-insensitive substring test; phones also survive as a
    bare run of 10-13 digits.  ``exact`` asks for a match that no letter or
    digit touches; it runs only where the substring test passes, or where letters
    beyond ASCII, whose cases the two tests may see differently, stand on either side.
    """
    inside = F.contains(lowered, F.lower(value))
    if exact:
        quoted = F.concat(
            F.lit(r"(?iU)(?<![\p{Alnum}])\Q"), value, F.lit(r"\E(?![\p{Alnum}])")
        )
        beyond = (F.octet_length(text) > F.length(text)) | (F.octet_length(value) > F.length(value))
        found = F.when(~(inside | beyond), False).otherwise(F.regexp_like(text, quoted))
    else:
        found = inside
    run = F.when(kind == "phone", F.array_contains(extract_all(text, P.DIGIT_RUN), digits(value)))
    return found | F.coalesce(run, F.lit(False))
