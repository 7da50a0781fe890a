"""Entity candidates that stay in the row of their chunk.

A caller's function (a model, a rule) looks at the texts, and what it finds becomes
an array column next to the text: ``array<struct<start,end,label,text>>`` in chunk
offsets.  The filters read the text around a candidate in the same row, and ``redact``
takes the resulting spans as a column, so no chunk is joined with its candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quietmark.functions.predicates import address_score, clean_person, is_organization, is_placeholder, looks_like_person
from quietmark.functions.text import match_spans, strip
from quietmark.operators.detectors import STRICT, Rules, _span
from quietmark.operators.entities import ENTITY_RANK, SEGMENT, TITLE_CASE

ENTITY = "start int, end int, label string, text string"
OVERLAP = 200
#: Characters at a cut edge in which a function may be misled: a cut word, a missing neighbour.
MARGIN = 32
ROWS = 256

Entity = tuple[int, int, str]
Function = Callable[[Sequence[str]], Iterable[Iterable[Entity]]]


def segment_bounds(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``size`` characters over a text of ``n``, each beginning ``overlap`` before the end of the last."""
    bounds = [(0, min(size, n))]
    while bounds[-1][1] < n:
        begin = bounds[-1][1] - overlap
        bounds.append((begin, min(begin + size, n)))
    return bounds


def settle(pieces: list[tuple[int, int, list[Entity]]], margin: int = MARGIN) -> list[Entity]:
    """Entities of a whole text from those of its segments ``(begin, end, entities)``, in text offsets.

    Within ``margin`` of a cut edge a segment is not trusted alone.  What ends there and
    begins where the next segment sees it whole is left to that segment; what began
    earlier is united with all of its label that the next segment has in its place.  What
    begins at a cut edge counts only as such a continuation.  Of the rest, repeats count
    once and a longer entity replaces a shorter one that it overlaps.
    """
    whole: set[Entity] = set()
    pending: list[Entity] = []
    for k, (begin, end, found) in enumerate(pieces):
        following = pieces[k + 1][0] if k + 1 < len(pieces) else None
        edge = end if following is None else end - margin
        taken: set[Entity] = set()
        ahead: list[Entity] = []
        for start, stop, label in pending:
            reach = [e for e in found if e[2] == label and e[0] < stop and e[1] > start]
            taken.update(reach)
            joined = (start, max([stop, *(e[1] for e in reach)]), label)
            ahead.append(joined) if joined[1] > edge else whole.add(joined)
        for entity in found:
            start, stop, _ = entity
            if entity in taken or (k and start < begin + margin):
                continue
            if stop <= edge:
                whole.add(entity)
            elif start < following + margin:
                ahead.append(entity)
        pending = ahead
    kept: list[Entity] = []
    for entity in sorted(whole, key=lambda e: (e[0], -e[1], e[2])):
        if not kept or entity[0] >= kept[-1][1]:
            kept.append(entity)
        elif entity[1] - entity[0] > kept[-1][1] - kept[-1][0]:
            kept[-1] = entity
    return kept


def _found(texts: list[str | None], function: Function, size: int, overlap: int, margin: int, batch: int) -> list[list[dict]]:
    """Settled entities of every text; the function sees ``batch`` segments at a time."""
    places = [(i, a, b) for i, t in enumerate(texts) if t for a, b in segment_bounds(len(t), size, overlap)]
    pieces: list[list[tuple[int, int, list[Entity]]]] = [[] for _ in texts]
    for at in range(0, len(places), batch):
        some = places[at : at + batch]
        for (i, a, b), found in zip(some, function([texts[i][a:b] for i, a, b in some]), strict=True):
            inside = ((int(s), int(e), label) for s, e, label in found)
            pieces[i].append((a, b, [(a + s, a + e, label) for s, e, label in inside if 0 <= s < e <= b - a]))
    return [
        [{"start": s, "end": e, "label": label, "text": text[s:e]} for s, e, label in settle(p, margin)] if p else []
        for text, p in zip(texts, pieces, strict=True)
    ]


def with_found(
    chunks: DataFrame,
    load: Callable[[], Function],
    column: str = "found",
    size: int = SEGMENT,
    overlap: int = OVERLAP,
    margin: int = MARGIN,
    batch: int = 64,
    text_col: str = "text",
) -> DataFrame:
    """Add ``column``: what the caller's function finds in the text of every row.

    ``load()`` is called once a task and returns the function (load a model there).  It
    gets a list of segment texts and returns, for each, ``(start, end, label)`` in code
    points of the segment; empty or outside spans are dropped.  Entities of up to
    ``overlap - 2 * margin`` characters come out as from the uncut text, longer ones are
    put together again.  Null and empty texts have no entities and are not shown to the
    function.  All columns pass through; one named ``column`` is replaced.  Nothing is
    shuffled.  Write the result before reading it twice, or the function runs twice.
    """
    if not 0 <= 2 * margin < overlap < size:
        raise ValueError("needs 2 * margin < overlap < size")
    kept = [c for c in chunks.columns if c != column]
    base = chunks.select(*kept)
    schema = StructType([*base.schema.fields, StructField(column, ArrayType(StructType.fromDDL(ENTITY)))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = load()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                texts = part.column(kept.index(text_col)).to_pylist()
                found = pa.array(_found(texts, function, size, overlap, margin, batch), kind)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*kept, column])

    return base.mapInArrow(run, schema)


def title_case(text: Column) -> Column:
    """The stand-in of ``title_case_candidates`` as an array of the row."""
    label = lambda v: F.when(is_organization(v), "ORG").otherwise("PERSON")
    found = F.transform(
        match_spans(text, TITLE_CASE),
        lambda s: F.struct(s["st"].alias("start"), s["en"].alias("end"), label(s["value"]).alias("label"), s["value"].alias("text")),
    )
    return F.when(text.rlike(TITLE_CASE), found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,label:string,text:string>>)"))


def candidate_rows(annotated: DataFrame, column: str = "found") -> DataFrame:
    """The array as rows of the candidate table: ``doc_id, chunk_no, start, end, label, text``."""
    rows = annotated.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.explode_outer(column).alias("f"))
    return rows.where(F.col("f.start").isNotNull()).select(
        "doc_id", "chunk_no", F.col("f.start").cast("bigint").alias("start"), F.col("f.end").cast("bigint").alias("end"), "f.label", "f.text"
    )


def person_spans(text: Column, found: Column, rules: Rules = STRICT, known: tuple[str, ...] = ()) -> Column:
    """``filter_people`` for candidates in the row: the text around them is at hand."""
    named = F.transform(
        F.filter(found, lambda f: f["label"] == "PERSON"),
        lambda f: F.struct(f["start"].alias("st"), f["end"].alias("en"), f["text"].alias("entity"), clean_person(f["text"], rules.generic_words).alias("value")),
    )

    def kept(f: Column) -> Column:
        name = looks_like_person(f["value"], rules.generic_words, rules.non_person_words, rules.non_person_phrases)
        listed = F.lower(f["value"]).isin(*[k.lower() for k in known]) if known else F.lit(False)
        own = is_placeholder(f["value"], rules.extended_placeholders)
        return (listed | name) & ~own & (address_score(text, f["st"], f["en"]) < 3)

    def span(f: Column) -> Column:
        start, end = f["st"], f["en"]
        if rules.trim_spans:
            exact = F.contains(f["entity"], f["value"])
            start = F.when(exact, f["st"] + F.call_function("locate", f["value"], f["entity"]) - 1).otherwise(f["st"])
            end = F.when(exact, start + F.length(f["value"])).otherwise(f["en"])
        return _span(start, end, ENTITY_RANK, "person", f["value"])

    return F.transform(F.filter(named, kept), span)


def organization_spans(found: Column, rules: Rules = STRICT) -> Column:
    """``filter_organizations`` for candidates in the row."""
    orgs = F.filter(found, lambda f: F.coalesce((f["label"] == "ORG") & is_organization(f["text"]), F.lit(False)))
    spans = F.transform(orgs, lambda f: _span(f["start"], f["end"], ENTITY_RANK, "organization", strip(f["text"])))
    return F.filter(spans, lambda s: ~is_placeholder(s["value"], rules.extended_placeholders))


def with_entity_spans(annotated: DataFrame, rules: Rules = STRICT, known: tuple[str, ...] = (), column: str = "found") -> DataFrame:
    """Replace the candidates by the spans of those that pass the filters, as ``redact(found=...)`` takes them."""
    text, found = F.col("text"), F.col(column)
    return annotated.withColumn(column, F.concat(person_spans(text, found, rules, known), organization_spans(found, rules)))
