"""License scan with a positional index of rare words; DataFrame functions only.

Words are runs of ASCII letters and digits and of other scripts' characters.
The corpus gives the document frequency of every template word; the ``RARE``
rarest words of a template that occur at all (the highest IDF; ties by the word)
are its index entries, with their places in the template.  In a file, every occurrence of an
index entry proposes a start for the template; a start holds if at least
``AGREE`` entries stand at their relative places and all words of the
template's key phrases do.  Its coverage is the share of all template words in
place, and the file's score is the best coverage over the templates.

Base phrases are found by the same rare-word look-up: the places where all words
of a phrase stand one after another.  A file with a base phrase only has a score
of 0.5, one without a finding 0.

The scan is narrow: one row in, one row out, no join on files.  Only the
frequencies (one number a template word) are aggregated, by a map-side combined
count.  Null text is empty text.  An empty table gives an empty result.  Input
columns stay, but for those named like an output column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions.text import let, literals
from quietmark.llm.common import fresh

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3
AGREE = 2

#: Phrases and labels that the contract names.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label, grant wording, key phrase that must stand in it.
TEMPLATES = (
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
)


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def key_place(template: str, key: str) -> tuple[int, int]:
    """Half-open range of the key phrase's words in the template."""
    t, k = template.split(), key.split()
    at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
    return at, at + len(k)


def frequencies(words: DataFrame, column: str, templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> dict[str, int]:
    """In how many texts each template word stands; at most one number a template word."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    found = words.select(F.explode(F.array_intersect(column, literals(vocabulary))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in found.collect()}


def rare_words(template: str, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The template's index entries: (word, place of its first occurrence)."""
    t = template.split()
    return [(w, t.index(w)) for w in sorted(set(t), key=lambda w: (not frequency[w], frequency[w], w))[:RARE]]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _at(words: Column, place: Column, word: str) -> Column:
    return F.coalesce(F.get(words, place) == word, F.lit(False))


def _starts(hits: Column, entries: list[tuple[str, int]]) -> Column:
    """Where a template would begin, by every hit on one of its entries."""

    def by(word: str, place: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - place)

    return F.array_distinct(F.concat(*(by(w, p) for w, p in entries)))


def _coverage(words: Column, hits: Column, template: str, key: str, entries: list[tuple[str, int]]) -> Column:
    """Best share of template words in place over the starts that hold; null without one."""
    t = template.split()
    lo, hi = key_place(template, key)

    def share(b: Column) -> Column:
        agree = sum((F.when(_at(words, b + p, w), 1).otherwise(0) for w, p in entries), F.lit(0))
        holds = (agree >= min(AGREE, len(entries))) & _all([_at(words, b + i, t[i]) for i in range(lo, hi)])
        matched = sum((F.when(_at(words, b + i, w), 1).otherwise(0) for i, w in enumerate(t)), F.lit(0))
        return F.when(holds, matched / F.lit(float(len(t))))

    return F.array_max(F.transform(_starts(hits, entries), share))


FOUND = "struct<base:array<array<int>>,coverage:array<double>>"


def _found(words: Column, index: list[list[tuple[str, int]]], templates: Sequence[tuple[str, str, str]]) -> Column:
    anchors = sorted({p.split()[0] for p, _ in BASE} | {w for entries in index for w, _ in entries})

    def places(hits: Column, phrase: list[str]) -> Column:
        stands = lambda h: (h["w"] == phrase[0]) & _all([_at(words, h["i"] + k, w) for k, w in enumerate(phrase) if k])
        return F.transform(F.filter(hits, stands), lambda h: h["i"])

    def scan(hits: Column) -> Column:
        base = [places(hits, p.split()) for p, _ in BASE]
        cover = [_coverage(words, hits, t, key, entries) for (_, t, key), entries in zip(templates, index)]
        return F.struct(F.array(*base).alias("base"), F.array(*cover).alias("coverage"))

    marked = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(anchors))
    return F.when(F.arrays_overlap(words, literals(anchors)), let(marked, scan)).otherwise(F.lit(None).cast(FOUND))


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: Sequence[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score, coverage``.

    ``coverage`` holds the best coverage of each template (null: none holds).
    """
    words, found = fresh("words"), fresh("found")
    counted = docs.select(words_of(F.col(text_col)).alias(words))
    frequency = frequencies(counted, words, templates)
    index = [rare_words(t, frequency) for _, t, _ in templates]
    out = docs.withColumn(words, words_of(F.col(text_col)))
    out = out.withColumn(found, _found(F.col(words), index, templates))
    base, coverage = F.col(f"{found}.base"), F.col(f"{found}.coverage")
    places = F.flatten(base)
    own = [F.when(F.size(base[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]
    more = [F.when(coverage[i].isNotNull(), F.lit(label)) for i, (label, _, _) in enumerate(templates)]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    n_base = F.coalesce(F.size(places), F.lit(0)).cast("long")
    n_base = F.when(F.col(found).isNull(), F.lit(0).cast("long")).otherwise(n_base)
    final = {
        "n_words": F.size(words).cast("long"),
        "n_base": n_base,
        "first_word": F.array_min(places).cast("long"),
        "last_word": F.array_max(places).cast("long"),
        "base_labels": F.coalesce(joined(own), F.lit("")),
        "labels": F.coalesce(joined(own + more), F.lit("")),
        "score": F.coalesce(F.greatest(F.array_max(coverage), F.when(n_base > 0, 0.5)), F.lit(0.0)),
        "coverage": coverage,
    }
    return out.withColumns(final).drop(words, found)


def oracle() -> str:
    """The digest in SQL, from the same phrases and templates."""
    rows = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        lo, hi = key_place(text, key)
        rows += [f"({t}, '{label}', {i}, '{w}', {str(lo <= i < hi).lower()})" for i, w in enumerate(text.split())]
    phrases = [f"({b}, '{label}', {k}, '{w}', {len(p.split())})" for b, (p, label) in enumerate(BASE) for k, w in enumerate(p.split())]
    return rf"""
WITH tpl(t, label, i, w, key) AS (VALUES {", ".join(rows)}),
phr(b, label, k, w, n) AS (VALUES {", ".join(phrases)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
f AS (SELECT v.w, count(DISTINCT w.r) AS n FROM (SELECT DISTINCT w FROM tpl) v LEFT JOIN w ON w.w = v.w GROUP BY v.w),
entry AS (SELECT t, w, p FROM (SELECT t, w, p, row_number() OVER (PARTITION BY t ORDER BY n = 0, n, w) AS k
  FROM (SELECT t, w, min(i) AS p FROM tpl GROUP BY t, w) JOIN f USING (w)) WHERE k <= {RARE}),
start AS (SELECT r, t, pos - p AS s FROM w JOIN entry USING (w) GROUP BY ALL HAVING count(*) >= {AGREE}),
fit AS (SELECT s.r, s.t, s.s, tpl.label, count(w.pos) AS m, count(*) AS n, bool_and(NOT tpl.key OR w.pos IS NOT NULL) AS ok
  FROM start s JOIN tpl ON tpl.t = s.t LEFT JOIN w ON w.r = s.r AND w.pos = s.s + tpl.i AND w.w = tpl.w GROUP BY ALL),
best AS (SELECT r, label, max(m / n::DOUBLE) AS share FROM fit WHERE ok GROUP BY ALL),
place AS (SELECT r, b, label, pos - k AS s FROM w JOIN phr USING (w) GROUP BY r, b, label, pos - k, n HAVING count(*) = n),
base AS (SELECT r, count(*) AS n_base, min(s) AS a, max(s) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM place GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM place UNION SELECT r, label FROM best) GROUP BY r),
top AS (SELECT r, max(share) AS share FROM best GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(base.l, '') AS base_labels, coalesce(every.l, '') AS labels,
  coalesce(greatest(share, CASE WHEN n_base > 0 THEN 0.5 END), 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN top USING (r)
"""
