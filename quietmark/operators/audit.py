"""Audits of redacted text: survival, residuals, placeholder counts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.functions import patterns as P
from quietmark.functions.predicates import luhn_valid, survives
from quietmark.functions.phones import valid_phone
from quietmark.functions.text import digits, empty_array, extract_all, has_digit, let, strip
from quietmark.operators.detectors import STRICT, Rules, ahead
from quietmark.operators import names
from quietmark.operators.names import fold
from quietmark.session import Stages

AUDIT_TYPES = ("email", "phone", "ip", "credit_card", "ssn")

#: What stands where a value may stand: a number (none of the four types is shorter), three
#: parts of an address, and the characters of an email with those that fold to its letters.
#: Phones of more digits are looked for by ``occurrences``; ``RUN`` marks bare runs of digits.
NUMBER = r"(?U)\d[\d\s().-]{5,}\d"
QUAD = r"(?:\d{1,3}\.){3}"
LOCAL = r"[A-Za-z0-9._%+\-\x{130}\x{131}\x{17f}\x{212a}]"
HOST = r"[A-Za-z0-9.\-\x{130}\x{131}\x{17f}\x{212a}]"
LONGEST_PHONE = 32
RUN = "#"


def sensitive_values(text: Column, rules: Rules = STRICT) -> Column:
    """``array<struct<type,value>>`` of the five structured types, distinct.

    Emails are lower-cased.  ``rules.luhn`` decides whether cards must pass the
    checksum; with it off, every 16-digit group counts.
    """
    none = empty_array("string")
    digit = has_digit(text)
    phone = lambda v: valid_phone(v, rules.min_phone_digits, rules.max_phone_digits, rules.default_country, rules.plan)
    cards = extract_all(text, ahead(P.CARD, r"\d"))
    found = {
        "email": F.when(F.contains(text, F.lit("@")), F.transform(extract_all(text, P.EMAIL), F.lower)).otherwise(none),
        "phone": F.when(digit, F.filter(extract_all(text, ahead(P.PHONE, r"[+\d]")), phone)).otherwise(none),
        "ip": F.when(digit, extract_all(text, ahead(P.IP, r"\d"))).otherwise(none),
        "credit_card": F.when(digit, F.filter(cards, luhn_valid) if rules.luhn else cards).otherwise(none),
        "ssn": F.when(digit, extract_all(text, ahead(P.SSN, r"\d"))).otherwise(none),
    }
    return F.array_distinct(F.concat(*[F.transform(found[t], _tagged(t)) for t in AUDIT_TYPES]))


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))


def value_rows(docs: DataFrame, rules: Rules = STRICT, text_col: str = "text") -> DataFrame:
    """Distinct sensitive values per document."""
    text = F.col(text_col)
    busy = docs.where(has_digit(text) | F.contains(text, F.lit("@")))
    return (
        busy.select("doc_id", F.explode_outer(sensitive_values(text, rules)).alias("v"))
        .where(F.col("v").isNotNull())
        .select("doc_id", F.col("v.type").alias("type"), F.col("v.value").alias("value"))
    )


def distinct_values(docs: DataFrame, rules: Rules = STRICT) -> DataFrame:
    """Distinct values per type over the whole table; exact."""
    return value_rows(docs, rules).select("type", "value").distinct().groupBy("type").agg(F.count("*").alias("n"))


def pair_documents(original: DataFrame, redacted: DataFrame) -> DataFrame:
    """Original and redacted text of each document in one row.

    Rows of ``redact`` and ``redact_documents`` already hold both; this join is
    only for tables stored apart (bucket both by ``doc_id`` to save its shuffle).
    """
    return original.select("doc_id", "text").join(redacted.select("doc_id", "redacted_text"), "doc_id")


def survivor_rows(pairs: DataFrame, rules: Rules = STRICT, exact: bool = False) -> DataFrame:
    """Every original value with a flag: is it still in its own document?

    Each test looks at one document only, inside its row; no values are paired
    across documents and nothing is shuffled.
    """
    after = F.col("redacted_text")
    busy = pairs.where(has_digit(F.col("text")) | F.contains(F.col("text"), F.lit("@")))
    flags = let(
        F.lower(after),
        lambda low: F.transform(
            "_values",
            lambda v: F.struct(
                v["type"].alias("type"),
                v["value"].alias("value"),
                survives(v["type"], v["value"], after, low, exact).alias("survived"),
            ),
        ),
    )
    return (
        busy.withColumn("_values", sensitive_values(F.col("text"), rules))
        .select("doc_id", F.explode_outer(flags).alias("v"))
        .where(F.col("v").isNotNull())
        .select("doc_id", "v.type", "v.value", "v.survived")
    )


def survival_report(survivors: DataFrame) -> DataFrame:
    """Original and surviving values per type, totals, and the verdict.

    All five types are listed, also those without values; ``type='total'`` is
    the last line of the report.
    """
    aggs = []
    for t in AUDIT_TYPES:
        mine = F.col("type") == t
        aggs.append(
            F.struct(
                F.lit(t).alias("type"),
                F.count_if(mine).alias("original"),
                F.count_if(mine & F.col("survived")).alias("survived"),
            )
        )
    total = F.struct(
        F.lit("total").alias("type"), F.count(F.lit(1)).alias("original"), F.count_if("survived").alias("survived")
    )
    return (
        survivors.agg(F.array(*aggs, total).alias("lines"))
        .select(F.inline("lines"))
        .withColumn("status", F.when(F.col("survived") == 0, "PASS").otherwise("FAIL"))
    )


def corpus_survivors(original: DataFrame, redacted: DataFrame, rules: Rules = STRICT) -> DataFrame:
    """Original values detected again anywhere in the redacted table.

    Both sides are made distinct first, so a value found in a third of all rows
    is one row in the join; phones compare by digits.
    """
    key = F.when(F.col("type") == "phone", F.regexp_replace("value", r"(?U)\D", "")).otherwise(F.lower("value"))
    before = value_rows(original, rules).select("type", key.alias("key")).distinct()
    after = value_rows(redacted, rules, "redacted_text").select("type", key.alias("key")).distinct()
    return before.join(after, ["type", "key"], "left_semi")


def _standing(text: Column, phones: dict[int, set[str]], locals_: list[int], hosts: list[int]) -> Column:
    """``array<string>``: every piece of a text that has the shape of a value, wherever it stands.

    A number is given by its first place and how many digits it has (``phones``: the first
    characters by that), an email by the lengths of its two parts.  The pieces hold more than the
    detectors accept, as they meet the values as a whole; no piece is left out that a value
    can be.  Greedy runs of digits come once more, behind ``RUN``.  Lambdas stay behind
    tests that few texts pass, as they are not compiled.
    """
    none = empty_array("string")
    cut = lambda *shapes: F.concat(none, *[extract_all(text, rf"(?U)(?=({shape}))", 1) for shape in shapes])
    lengths = lambda ns: F.expr(f"cast(array({', '.join(map(str, sorted(ns)))}) as array<int>)")

    def mails(place: Column) -> Column:
        local, host = F.substring_index(place, "@", 1), F.substring_index(place, "@", -1)
        heads = F.transform(F.filter(lengths(locals_), lambda n: n <= F.length(local)), lambda n: F.right(local, n))
        tails = F.transform(F.filter(lengths(hosts), lambda n: n <= F.length(host)), lambda n: F.left(host, n))
        tails = F.filter(tails, lambda t: t.rlike(r"\.[A-Z]{2,}$"))
        return let(tails, lambda ts: F.flatten(F.transform(heads, lambda h: F.transform(ts, lambda t: F.concat(h, F.lit("@"), t)))))

    at = extract_all(text, rf"(?<!{LOCAL})(?=({LOCAL}++@{HOST}++)){LOCAL}++@", 1)
    point = lambda c: rf"\x{{{ord(c):x}}}"
    runs = [rf"(?=[{''.join(map(point, sorted(firsts)))}])\+?\d(?:[\s().-]*+\d){{{n - 1}}}+" for n, firsts in sorted(phones.items())]
    found = [
        F.when(F.contains(text, F.lit("@")), F.flatten(F.transform(at, lambda x: let(fold(x), mails)))),
        F.when(text.rlike(NUMBER), cut(*runs, r"(?:\d{4}[- ]?){3}\d{4}", r"\d{3}-\d{2}-\d{4}")),
        F.when(text.rlike(rf"(?U){QUAD}\d"), cut(*[rf"{QUAD}\d{{{n}}}" for n in (1, 2, 3)])),
        F.when(text.rlike(P.DIGIT_RUN), F.transform(extract_all(text, P.DIGIT_RUN), lambda x: F.concat(F.lit(RUN), x))),
    ]
    return F.array_distinct(F.concat(*[x.otherwise(none) for x in found]))


def _anchored(rows: DataFrame) -> DataFrame:
    """What the sieve looks at: the length, the beginning, and the host of an email."""
    host = F.when(F.contains("_folded", F.lit("@")), F.substring_index("_folded", "@", -1))
    return rows.withColumn("_anchor", F.concat_ws("\n", F.length("_folded"), F.left("_folded", F.lit(names.ANCHOR)), host))


def substring_survivors(original: DataFrame, redacted: DataFrame, rules: Rules = STRICT, stages: Stages | None = None) -> DataFrame:
    """Original values that still stand anywhere in the redacted table: ``type, value, chunks``.

    Unlike ``corpus_survivors`` a value counts inside a longer string too, where no
    detector finds it again; letter case does not matter, and a phone also survives as a
    bare run of its digits.  Every piece of the redacted text with the shape of a value is
    cut out (``_standing``), passes the sieve of ``occurrences`` by its length and
    beginning, and meets the values by equality; phones of more than ``LONGEST_PHONE``
    digits, which only rules without a limit know, are looked for by ``occurrences``.
    Every value has a digit or an at sign, so other chunks are not looked at.  ``redacted``
    has ``doc_id, chunk_no, redacted_text``; ``chunks`` counts its rows with the value.
    """
    stages = stages or Stages(original.sparkSession)
    value, mail, phone = F.col("value"), F.col("type") == "email", F.col("type") == "phone"
    own, run = F.when(mail, fold(value)).otherwise(value), F.concat(F.lit(RUN), digits(value))
    listed = value_rows(original, rules).select("type", "value").distinct()
    listed = stages.save(listed.withColumn("_folded", F.explode_outer(F.when(phone, F.array(own, run)).otherwise(F.array(own)))))
    part = lambda at: F.collect_set(F.when(mail, F.length(F.substring_index("value", "@", at))))
    shape = listed.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("_folded") * 2 + 80).alias("bytes"),
        F.collect_set(F.when(phone, F.struct(F.length(digits(value)), F.left(value, F.lit(1))))).alias("phones"), part(1).alias("locals"), part(-1).alias("hosts"),
    ).first()
    text = F.col("redacted_text")
    busy = redacted.where(has_digit(text) | F.contains(text, F.lit("@")))
    phones: dict[int, set[str]] = {}
    for n, first in shape["phones"]:
        phones.setdefault(n, set()).add(first)
    short = {n: firsts for n, firsts in phones.items() if n <= LONGEST_PHONE}
    pieces = F.explode_outer(_standing(text, short, shape["locals"], shape["hosts"])).alias("_folded")
    pieces = busy.select("doc_id", "chunk_no", pieces).where("_folded is not null")
    words = min(names.SIEVE_WORDS, 1 + shape["n"] // names.NAMES_A_WORD)
    near = names.sifted(_anchored(pieces), names.sieve(_anchored(listed), words), words).select("doc_id", "chunk_no", "_folded")
    if (shape["bytes"] or 0) <= names.BROADCAST_BYTES:
        met = near.join(F.broadcast(listed), "_folded")
    else:
        met = names._salted(stages.save(near), listed, stages, ["_folded"], ["doc_id", "chunk_no"])
    met = met.select("doc_id", "chunk_no", "type", "value")
    if len(short) < len(phones):
        long = listed.where(phone & (F.length(digits(value)) > LONGEST_PHONE)).select("type", value.alias("name"))
        found = names.occurrences(busy.select("doc_id", "chunk_no", text.alias("text")), long, bounded=False, stages=stages)
        met = met.unionByName(found.select("doc_id", "chunk_no", "type", F.col("name").alias("value")))
    return met.distinct().groupBy("type", "value").agg(F.count("*").alias("chunks"))


def placeholder_counts(docs: DataFrame, text_col: str = "redacted_text") -> DataFrame:
    """Occurrences of each placeholder shape, one line per type."""
    text = F.col(text_col)
    lines = F.array(
        *[
            F.struct(
                F.lit(t).alias("type"), F.coalesce(F.sum(F.regexp_count(text, F.lit(f"(?i){shape}"))), F.lit(0)).cast("bigint").alias("n")
            )
            for t, shape in P.PLACEHOLDER_SHAPES.items()
        ]
    )
    return docs.agg(lines.alias("lines")).select(F.inline("lines"))


def character_counts(pairs: DataFrame) -> DataFrame:
    """Characters before and after."""
    return pairs.agg(
        F.sum(F.length("text")).cast("bigint").alias("original_characters"),
        F.sum(F.length("redacted_text")).cast("bigint").alias("redacted_characters"),
    )


def residual_values(docs: DataFrame, rules: Rules = STRICT, text_col: str = "redacted_text") -> DataFrame:
    """Distinct structured values left in redacted text, placeholders removed.

    Looser than detection: phones have no upper digit limit, cards need no
    checksum, emails keep their case.
    """
    loose = replace(rules, max_phone_digits=None, luhn=False)
    text = F.col(text_col)
    emails = F.when(F.contains(text, F.lit("@")), extract_all(text, P.EMAIL)).otherwise(empty_array("string"))
    others = F.filter(sensitive_values(text, loose), lambda v: v["type"] != "email")
    found = F.concat(F.transform(emails, _tagged("email")), others)
    own = F.lit(False)
    for t in AUDIT_TYPES:
        own = own | ((F.col("type") == t) & strip(F.col("value")).rlike(f"(?i)^(?:{P.PLACEHOLDER_SHAPES[t]})$"))
    busy = docs.where(has_digit(text) | F.contains(text, F.lit("@")))
    return (
        busy.select(F.explode_outer(found).alias("v"))
        .where(F.col("v").isNotNull())
        .select("v.type", "v.value")
        .where(~own)
        .distinct()
    )
