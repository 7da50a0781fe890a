"""Chunk scans: the unit every detector looks at.

``chunks(doc_id BIGINT, chunk_no INT, kind STRING, table_no INT, row_no INT,
col_no INT, text STRING)``.  ``paragraph`` mode makes one chunk per line,
``cell`` mode keeps the whole text, newlines included, as one chunk.
"""

from __future__ import annotations

from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions.text import extract_all, let, not_blank, running, split_all, strip

CHUNK_KEY = ("doc_id", "chunk_no")


def chunk_text(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "paragraph"
) -> DataFrame:
    """Non-blank chunks of a text column; a narrow operation in both modes."""
    base = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if mode not in ("paragraph", "cell"):
        raise ValueError(f"unknown chunk mode: {mode}")
    # A generator in both modes: filters on ``text`` stay above it, and so above
    # a repartition that spreads a small input over all cores.  The outer form,
    # because the plain one infers a size filter that would split every text twice.
    parts = F.split("text", "\n", -1) if mode == "paragraph" else F.array("text")
    rows = base.select("doc_id", F.posexplode_outer(parts).alias("pos", "text"))
    return rows.where(not_blank(F.col("text"))).select(
        "doc_id", (F.col("pos") + 1).alias("chunk_no"), *_place(F.lit("paragraph")), "text"
    )


def _place(kind: Column, table_no=None, row_no=None, col_no=None) -> list[Column]:
    none = F.lit(None)
    return [
        kind.alias("kind"),
        (none if table_no is None else table_no).cast("int").alias("table_no"),
        (none if row_no is None else row_no).cast("int").alias("row_no"),
        (none if col_no is None else col_no).cast("int").alias("col_no"),
    ]


def field_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Read ``label: value`` lines as a two-column table, one cell per chunk.

    Row i of table 1 is line i; column 1 holds the label, column 2 the rest.
    Cells are numbered row by row, as a document walk would meet them.
    """
    line = F.col("line")
    cut = F.when(F.contains(line, F.lit(":")), F.instr(line, ":")).otherwise(F.length(line))
    cells = F.array(F.substring(line, F.lit(1), cut), F.substring(line, cut + 1, F.length(line)))
    return (
        df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.posexplode_outer(F.split(text_col, "\n", -1)).alias("r", "line"))
        .select("doc_id", "r", F.posexplode(cells).alias("c", "text"))
        .where(not_blank(F.col("text")))
        .select(
            "doc_id",
            (F.col("r") * 2 + F.col("c") + 1).alias("chunk_no"),
            *_place(F.lit("cell"), F.lit(1), F.col("r") + 1, F.col("c") + 1),
            "text",
        )
    )


#: Elements that begin and end a chunk, and formatting inside a word.
BLOCK_TAGS = (
    "html|head|title|body|main|article|section|aside|nav|header|footer|div|p|h[1-6]|ul|ol|li|dl|dt|dd|table|caption|thead|tbody|tfoot|tr|td|th"
    "|blockquote|pre|hr|form|fieldset|legend|label|button|select|option|textarea|figure|figcaption|address|details|summary|noscript|iframe"
)
FORMAT_TAGS = "b|i|u|s|em|strong|span|font|small|big|mark|sub|sup|wbr|ins|del|tt"
#: Named references: those of HTML 4 by the standard library's table, and names that hide marks of an address.
NAMED = {**name2codepoint, "apos": 39, "commat": 64, "period": 46, "colon": 58, "num": 35, "plus": 43, "lowbar": 95, "sol": 47, "hyphen": 0x2010, "dash": 0x2010}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"
HIDDEN = (r"(?s)<!--.*?(?:-->|\z)", r"(?is)<script\b.*?(?:</script\s*>|\z)", r"(?is)<style\b.*?(?:</style\s*>|\z)")
MARK = "\u0001"


@lru_cache(maxsize=1)
def _named() -> Column:
    return F.expr("map(" + ", ".join(f"'{name}', {code}" for name, code in NAMED.items()) + ")")


def _character(code: Column) -> Column:
    """The character of a code point; a blank for the no-break space, U+FFFD for what is none."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    point = F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")
    return F.when(code == 0xA0, " ").otherwise(F.decode(F.unhex(point), "UTF-32"))


def _referred(reference: Column) -> Column:
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    number = F.when(F.lower(F.left(body, F.lit(2))) == "#x", F.conv(F.substring(body, 3, 6), 16, 10)).when(F.left(body, F.lit(1)) == "#", F.substring(body, 2, 7))
    code = F.coalesce(number.cast("bigint"), F.try_element_at(_named(), body).cast("bigint"))
    return F.when(code.isNull(), reference).otherwise(_character(code))


def decode_references(text: Column) -> Column:
    """Numeric (decimal and hexadecimal) and named character references, each decoded once; unknown names stay."""

    def decoded(t: Column) -> Column:
        chars = F.concat(F.transform(extract_all(t, REFERENCE), _referred), F.array(F.lit("")))
        return F.array_join(F.zip_with(split_all(t, REFERENCE), chars, lambda gap, c: F.concat(gap, c)), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def _tag_text(fragment: Column) -> Column:
    plain = F.regexp_replace(fragment, rf"(?i)</?(?:{FORMAT_TAGS})\b[^>]*>", "")
    return strip(decode_references(F.regexp_replace(plain, "<[^>]*>", " ")))


def _shown(html: Column) -> Column:
    shown = F.replace(F.coalesce(html, F.lit("")), F.lit(MARK), F.lit(" "))
    for hidden in HIDDEN:
        shown = F.regexp_replace(shown, hidden, " ")
    return shown


#: The inside of an opening tag, quoted values whole, and one attribute in it.
TAG = r"""<[A-Za-z][A-Za-z0-9]*+((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)"""
ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`]+)"""
TEXT_ATTRIBUTES = ("href", "alt", "title", "value", "content", "placeholder", "aria-label", "summary")


def page_attributes(df: DataFrame, id_col: str = "page_id", html_col: str = "html", names: tuple[str, ...] = TEXT_ATTRIBUTES) -> DataFrame:
    """Text that a page holds in attributes: one chunk of kind ``attribute`` each, with the column ``attribute``.

    Attributes are read in order from opening tags outside comments, scripts and styles;
    ``chunk_no`` counts those with one of ``names``.  References are decoded.  Of
    ``mailto:`` and ``tel:`` links the address alone is the text; other links stay whole.
    Null pages and blank values have no chunk.
    """
    tags = extract_all(_shown(F.col(html_col)), TAG, 1)
    pairs = F.flatten(F.transform(tags, lambda t: F.arrays_zip(extract_all(t, ATTRIBUTE, 1).alias("n"), extract_all(t, ATTRIBUTE, 2).alias("v"))))
    wanted = F.filter(pairs, lambda p: F.lower(p["n"]).isin(*names))
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.posexplode_outer(wanted).alias("pos", "p")).where(F.col("pos").isNotNull())
    value = F.regexp_replace(F.col("p.v"), r"""^["']|["']$""", "")
    address = F.regexp_replace(strip(decode_references(value)), r"(?is)^(?:mailto|tel):([^?]*).*$", "$1")
    rows = rows.select("doc_id", (F.col("pos") + 1).alias("chunk_no"), *_place(F.lit("attribute")), F.lower("p.n").alias("attribute"), address.alias("text"))
    return rows.where(not_blank(F.col("text")))


def page_chunks(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """All shown text of web pages (attributes: ``page_attributes``), each piece in exactly one chunk, in document order.

    Comments, scripts and styles are hidden; everything else is text.  A page is
    cut before every block tag, so headings, list items, plain ``div`` text and
    text between elements are chunks of their own, closed or not.  Inside ``nav``
    or ``header`` a chunk is the section header, inside ``footer`` the section
    footer; after a ``td`` or ``th`` and before the end of its cell, row or table
    it is a cell, with its table, row and column counted over the page.  All else
    is a paragraph.  Text is trimmed, blank chunks are dropped.
    """
    parts = F.split(F.regexp_replace(_shown(F.col(html_col)), rf"(?i)(</?(?:{BLOCK_TAGS})\b)", f"{MARK}$1"), MARK, -1)
    cut = df.select(F.col(id_col).cast("bigint").alias("doc_id"), parts.alias("parts"))
    tags = F.transform("parts", lambda x: F.lower(F.regexp_extract(x, r"^<(/?[A-Za-z0-9]+)", 1)))
    cut = cut.withColumn("tags", tags)

    def steps(up: tuple[str, ...], down: tuple[str, ...] = ()) -> Column:
        one = lambda t: F.when(t.isin(*up), 1).otherwise(F.when(t.isin(*down), -1).otherwise(0) if down else 0)
        return running(F.transform("tags", one), "sum")

    def latest(*names: str) -> Column:
        """Number of the last such tag so far, from 1."""
        return running(F.transform("tags", lambda t, i: F.when(t.isin(*names), i + 1).otherwise(0)), "max")

    def so_far(count: str, at: tuple[str, ...]) -> Column:
        """What ``count`` was at the last of the tags ``at``."""
        return running(F.transform(F.arrays_zip("tags", count), lambda x: F.when(x["tags"].isin(*at), x[count]).otherwise(0)), "max")

    cut = cut.withColumns({
        "head": steps(("nav", "header"), ("/nav", "/header")), "foot": steps(("footer",), ("/footer",)),
        "opened": latest("td", "th"), "ended": latest("/td", "/th", "tr", "/tr", "table", "/table"),
        "tables": steps(("table",)), "rows": steps(("tr",)), "cells": steps(("td", "th")),
    })
    cut = cut.withColumns({"rows_before": so_far("rows", ("table",)), "cells_before": so_far("cells", ("tr", "table"))})
    texts = cut.withColumn("texts", F.transform("parts", _tag_text))
    fields = ("texts", "head", "foot", "opened", "ended", "tables", "rows", "cells", "rows_before", "cells_before")
    rows = texts.select("doc_id", F.posexplode_outer(F.arrays_zip(*fields)).alias("pos", "x")).where(F.col("x.texts") != "")
    cell = F.col("x.opened") > F.col("x.ended")
    kind = F.when(F.col("x.foot") > 0, "footer").when(F.col("x.head") > 0, "header").when(cell, "cell").otherwise("paragraph")
    at = lambda n, before=None: F.when(kind == "cell", F.greatest(F.lit(1), F.col(f"x.{n}") - (F.col(f"x.{before}") if before else 0)))
    return rows.select(
        "doc_id", (F.col("pos") + 1).alias("chunk_no"), *_place(kind, at("tables"), at("rows", "rows_before"), at("cells", "cells_before")), F.col("x.texts").alias("text")
    )


def redaction_scope(chunks: DataFrame) -> DataFrame:
    """Body text and table cells; headers and footers are only profiled."""
    return chunks.where(F.col("kind").isin("paragraph", "cell"))


def location() -> Column:
    """Human-readable place of a chunk, built from its numeric parts."""
    return (
        F.when(F.col("kind") == "cell", F.format_string("table %d, row %d, column %d", F.coalesce("table_no", F.lit(1)), F.coalesce("row_no", F.lit(1)), F.coalesce("col_no", F.lit(1))))
        .when(F.col("kind").isin("header", "footer"), F.format_string("section %d %s", F.coalesce("row_no", F.lit(1)), F.col("kind")))
        .when(F.col("kind") == "attribute", F.lit("attribute"))
        .otherwise(F.lit("paragraph"))
    )


def assemble(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole text per document: its chunks in order, joined with newlines."""
    return (
        chunks.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.col(text_col).alias("t")))).alias("parts"))
        .select("doc_id", F.concat_ws("\n", F.col("parts.t")).alias(text_col))
    )
