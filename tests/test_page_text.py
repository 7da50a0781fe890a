"""Character references and attributes of crafted pages, and values that survive inside longer strings."""

import html
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quietmark.operators import audit, inventory, names
from quietmark.operators.detectors import PARITY
from quietmark.plans import oracle
from quietmark.sources.chunks import decode_references, page_attributes, page_chunks

PAGES = [
    (1, "<p>mail&#x40;b.org or a&#64;b.org, a&commat;c&period;org &eacute;&#233;&#XE9; &amp;#64; &bogus; &#0; &#xD800; & &;</p>"),
    (2, """<a href="mailto:ann@b.org?subject=x">w</a><img alt='Call +1 415-555-2671' src=x.png><input value=10.0.0.7 TITLE = "a > b">"""),
    (3, "<!-- <a href='mailto:no@b.org'> --><script>x='<a title=no>'</script><a title='href=&quot;no&quot;' href=\"TEL:+1&#45;2\">x</a><b alt=''>"),
    (4, None),
    (5, ""),
    (6, "plain <a href='/p?e=x@y.org'>"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, html string")


def test_references_are_decoded_once_by_code_point(spark):
    texts = ["a&#64;b", "&#x40;&#X1F600;", "&amp;lt; &lt;", "&eacute;&Omega;&unknown;", "no reference", "", "&", "&;&#;", "&copy;&middot;&#8364;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_references(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: html.unescape(t) for t in texts}
    odd = spark.createDataFrame([("&#0;&#xD800;&#9999999;|&nbsp;|&#160;",), (None,)], "t string").select(decode_references(F.col("t")).alias("d")).collect()
    assert [r.d for r in odd] == ["�" * 3 + "| | |".rstrip("|"), None]


def test_hidden_values_are_found(spark):
    found = inventory.inventory(page_chunks(pages(spark)))
    assert {(r.doc_id, r.value) for r in found.where("category = 'EMAIL'").collect()} == {(1, "mail@b.org"), (1, "a@b.org"), (1, "a@c.org")}
    found = inventory.inventory(page_attributes(pages(spark)))
    assert {(r.category, r.doc_id, r.value) for r in found.where("category <> 'PHONE'").collect()} == {("EMAIL", 2, "ann@b.org"), ("IP_ADDRESS", 2, "10.0.0.7"), ("EMAIL", 6, "x@y.org")}
    assert {r.location for r in found.collect()} == {"attribute"} and found.where("category = 'PHONE'").count() == 1


def test_attributes_equal_the_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", PAGES)
    want = con.execute(oracle.build()["page_attributes"]).fetchall()
    got = page_attributes(pages(spark)).select("doc_id", "chunk_no", "attribute", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [(r.attribute, r.text) for r in got if r.doc_id in (2, 3)] == [
        ("href", "ann@b.org"), ("alt", "Call +1 415-555-2671"), ("value", "10.0.0.7"), ("title", "a > b"), ("title", 'href="no"'), ("href", "+1-2"),
    ]


def test_substring_survivors_equal_brute_force(spark):
    rng = random.Random(5)
    values = [("email", "ann@b.org"), ("ip", "10.0.0.7"), ("ssn", "123-45-6789"), ("phone", "+91 98765 43210"), ("credit_card", "4111 1111 1111 1111")]
    noise = ["x", "7", "@", "ANN@B.ORGx", "110.0.0.70", "919876543210", "9876543210", "a123-45-67890", " ", "", "4111 1111 1111 1112"]
    original = spark.createDataFrame([(1, " ; ".join(v for _, v in values)), (2, None), (3, "")], "doc_id long, text string")
    after = [(i, 1, "".join(rng.choices(noise, k=rng.randrange(5)))) for i in range(120)] + [(500, 1, None)]
    redacted = spark.createDataFrame(after, "doc_id long, chunk_no int, redacted_text string")
    want = {}
    for row in audit.value_rows(original, PARITY).select("type", "value").distinct().collect():
        digits = "".join(c for c in row.value if c.isdigit())
        hit = [t for _, _, t in after if t and (row.value.lower() in t.lower() or (row.type == "phone" and digits in runs(t)))]
        if hit:
            want[row.type, row.value] = len(hit)
    got = {(r.type, r.value): r.chunks for r in audit.substring_survivors(original, redacted, PARITY).collect()}
    assert got == want and {t for t, _ in got} >= {"email", "ip", "ssn", "phone"}
    assert audit.substring_survivors(original.limit(0), redacted, PARITY).count() == 0
    assert audit.substring_survivors(original, redacted.limit(0), PARITY).count() == 0


def runs(text):
    import re

    return re.findall(r"\d{10,13}", text)


@pytest.mark.parametrize("longest, most", [(32, 1 << 24), (11, 0)])
def test_substring_survivors_in_pieces_that_share_characters(spark, monkeypatch, longest, most):
    """Values within, beside and across each other, in odd case and digits; long phones by another way; rows that share a key."""
    monkeypatch.setattr(audit, "LONGEST_PHONE", longest)
    monkeypatch.setattr(names, "BROADCAST_BYTES", most)
    monkeypatch.setattr(names, "SPLIT", 3)
    rng = random.Random(8)
    values = ["sik@mail.test", "ik@mail.te", "a.b+c@x-y.org", "b@c.org", "10.0.0.1", "10.0.0.12", "1.10.0.0", "123-45-6789", "+91 98765 43210", "9876543210", "098765 43210", "+1 (212) 555-0100", "4539 1488 0343 6467", "4539148803436467", "\u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669"]
    noise = [*values, "S\u0130k@MAIL.TEST", "\u017f\u0131k@mail.tested", "a@b@c.org", "@", ".", "x", "9", " ", "-", "+", "919876543210", "10.0.0.123", "\u0661\u0662"]
    original = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(None, "ann@b.org"), (None, None)], "doc_id long, text string")
    after = [(i % 90 if i % 7 else None, i % 3, "".join(rng.choices(noise, k=rng.randrange(5)))) for i in range(400)] + [(None, None, None)]
    redacted = spark.createDataFrame(after, "doc_id long, chunk_no int, redacted_text string")
    folded = lambda t: t.replace("\u0130", "I").lower().upper()
    want = {}
    for row in audit.value_rows(original, PARITY).select("type", "value").distinct().collect():
        digits = "".join(c for c in row.value if c.isdigit())
        hit = {(d, c) for d, c, t in after if t and (folded(row.value) in folded(t) or (row.type == "phone" and digits in runs(t)))}
        if hit:
            want[row.type, row.value] = len(hit)
    assert {t for t, _ in want} == set(audit.AUDIT_TYPES) and len(want) >= 12
    assert {(r.type, r.value): r.chunks for r in audit.substring_survivors(original, redacted, PARITY).collect()} == want


def test_substring_survivors_takes_a_value_shape_for_one_place(spark, monkeypatch):
    """Emails of many lengths that begin alike, and numbers no value can be in: one row a chunk meets the values, not one a length or a digit."""
    monkeypatch.setattr(names, "BROADCAST_BYTES", 0)
    near, salted = [], names._salted
    monkeypatch.setattr(names, "_salted", lambda *given: near.append(given[0]) or salted(*given))
    original = spark.createDataFrame([(k, f"person{10 ** (k % 6) + k}@example.com, 4539 1488 0343 {k:04d}") for k in range(60)], "doc_id long, text string")
    after = [(k, 1, f"Email: person{900000 + k}@example.com, 4111-1111-1111-{k:04d}, 01 January 1990") for k in range(200)]
    redacted = spark.createDataFrame(after, "doc_id long, chunk_no int, redacted_text string")
    assert audit.substring_survivors(original, redacted, PARITY).count() == 0
    assert near[0].count() <= len(after)
