"""Offsets against ``re``, overlap resolution and splicing against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quietmark.functions import patterns as P
from quietmark.functions.text import has_digit, match_spans, running
from quietmark.operators.detectors import PARITY, SPAN, STRICT, detect, only, span_rows
from quietmark.operators.overlaps import resolve
from quietmark.operators.splice import splice
from quietmark.sources.chunks import chunk_text

ALPHABETS = {
    "EMAIL": "ab1.@-_ é\n",
    "IP": "0125. é",
    "CARD": ["1234", "5678", "12345", "9", " ", "-", "", "a", "é"],
    "SSN": ["123", "45", "6789", "-", "-", "é", " "],
    "PHONE": "+123 ().-a\n",
    "PHONE_LOOSE": ["+", "12", "345", "6789", " ", "-", ".", "(02)", "1234567890", "a"],
    "CARD_LOOSE": "12 -",
    "PIN": "12a é",
    "BIRTH_DATE": None,
    "LABELLED_ORGANIZATION": None,
    "LABELLED_NAME": None,
    "ADDRESS_LABEL": None,
}
WORDS = [
    "dob", "D.O.B.", "born on", "date  of birth", ":", "-", " ", "\n", "1/2/1990", "3 March 1981", "June 5, 1999", "x",
    "organization", "Name", "full name", "Asha", "Varma", "B.", "O'Neil", "registered office", "mailing\taddress", "é",
]


def python_pattern(name):
    p = getattr(P, name)
    if p.startswith("(?iU)"):
        return re.compile(p[5:], re.IGNORECASE)
    return re.compile(p.removeprefix("(?U)"))


@pytest.mark.parametrize("name", list(ALPHABETS))
def test_offsets_equal_finditer(spark, name):
    rng = random.Random(name)
    letters = ALPHABETS[name]
    if letters:
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    else:
        texts = ["".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    group = 1 if name.startswith("LABELLED") else 0
    pattern = python_pattern(name)
    want = {
        i: [(m.start(group), m.end(group), m.group(group)) for m in pattern.finditer(t)] for i, t in enumerate(texts)
    }
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {
        r["id"]: [tuple(s) for s in r["s"]]
        for r in df.select("id", match_spans(F.col("t"), getattr(P, name), group).alias("s")).collect()
    }
    assert got == want
    assert sum(map(len, want.values())) > 0


def test_running_crosses_blocks(spark):
    values = [random.Random(5).randint(0, 9) for _ in range(1000)]
    df = spark.createDataFrame([(values[:n],) for n in (0, 1, 255, 256, 257, 512, 1000)], "v array<int>")
    for row in df.select("v", running(F.col("v"), "sum").alias("s"), running(F.col("v"), "max").alias("m")).collect():
        total, top, sums, tops = 0, 0, [], []
        for v in row["v"]:
            total, top = total + v, max(top, v)
            sums.append(total)
            tops.append(top)
        assert (row["s"], row["m"]) == (sums, tops)


def longest(spans):
    kept = []
    for s in sorted(spans, key=lambda x: (x["st"], x["neg"], x["rk"])):
        if kept and s["st"] < kept[-1]["en"]:
            if s["neg"] < kept[-1]["neg"]:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def cover(spans):
    runs = []
    for s in sorted(spans, key=lambda x: (x["st"], x["neg"], x["rk"])):
        if runs and s["st"] < max(x["en"] for x in runs[-1]):
            runs[-1].append(s)
        else:
            runs.append([s])
    out = []
    for run in runs:
        top = min(run, key=lambda x: (x["neg"], x["rk"]))
        st, en = run[0]["st"], max(x["en"] for x in run)
        out.append({**top, "st": st, "en": en, "neg": st - en})
    return out


def random_spans(rng, most=8, reach=30):
    out = []
    for rk in range(rng.randint(0, most)):
        st, n = rng.randint(0, reach), rng.randint(1, 10)
        out.append({"st": st, "neg": -n, "rk": rk + 1, "en": st + n, "type": "t", "value": f"v{rk}"})
    return out


@pytest.mark.parametrize("policy,model", [("longest", longest), ("cover", cover)])
def test_overlaps_equal_the_model(spark, policy, model):
    rng = random.Random(policy)
    lists = [random_spans(rng) for _ in range(2000)] + [random_spans(rng, 600, 3000) for _ in range(10)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lists)], f"id int, spans array<{SPAN}>")
    got = {r["id"]: [s.asDict() for s in r["m"]] for r in df.select("id", resolve(F.col("spans"), policy).alias("m")).collect()}
    for i, spans in enumerate(lists):
        assert got[i] == model(spans)
        assert all(a["en"] <= b["st"] for a, b in zip(got[i], got[i][1:]))


def test_splice(spark):
    text = "añb 123 cd 45 é"
    spans = [(0, 3, "X"), (4, 7, "<1>"), (11, 13, "")]
    schema = "t string, s array<struct<st:int,en:int,replacement:string>>"
    df = spark.createDataFrame([(text, spans), (text, []), (text, None), ("", [])], schema)
    assert [r[0] for r in df.select(splice(F.col("t"), F.col("s"))).collect()] == ["X <1> cd  é", text, text, ""]


def found(spark, text, rules, mode="cell"):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [(r["start"], r["end"], r["type"], r["value"]) for r in span_rows(detect(chunk_text(df, mode=mode), rules)).collect()]


def test_label_may_cross_the_line_end(spark):
    text = "Name: Nilam Varden\nEmail: x"
    rules = only(PARITY, "labelled_name")
    assert found(spark, text, rules) == [(6, 24, "person", "Nilam Varden\nEmail")]
    assert found(spark, text, only(STRICT, "labelled_name")) == [(6, 18, "person", "Nilam Varden")]
    assert found(spark, text, rules, "paragraph") == [(6, 18, "person", "Nilam Varden")]


def test_address_window(spark):
    rules = only(PARITY, "address_window")
    near = "Registered Office: 4 Lake Road, Pune 411001 x 411002"
    assert found(spark, near, rules) == [(0, 43, "address", near[:43])]
    assert found(spark, "Registered Office: Box 411001", rules) == []
    filler = "far " * 125
    assert found(spark, f"Registered Office: {filler}Road 411001", rules) == []
    # the component may come after the code
    assert found(spark, "Mailing Address : 411001 Lake Road", rules)[0][:2] == (0, 24)


def test_span_of_labelled_values(spark):
    text = "Organization:   Lind & Sons  \nnext"
    assert found(spark, text, only(PARITY, "labelled_organization")) == [(16, 29, "organization", "Lind & Sons")]
    assert found(spark, text, only(STRICT, "labelled_organization")) == [(16, 27, "organization", "Lind & Sons")]


def test_unicode_text(spark):
    assert found(spark, "caféabc@mail.com", only(PARITY, "email")) == []
    phone = "tel 98765 43210 é"
    assert found(spark, phone, only(PARITY, "phone")) == [(4, 15, "phone", "98765 43210")]
    df = spark.createDataFrame([("abc",), ("é",), ("é٣",), ("a1",), ("",)], "t string")
    assert [r[0] for r in df.select(has_digit(F.col("t"))).collect()] == [False, False, True, True, False]


def test_blank_and_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (4, "a\n\n b ")], "doc_id bigint, text string")
    assert [(r["doc_id"], r["chunk_no"], r["text"]) for r in chunk_text(df).orderBy("chunk_no").collect()] == [(4, 1, "a"), (4, 3, " b ")]
    assert chunk_text(df, mode="cell").count() == 1


def test_patterns_that_look_ahead_match_what_they_did(spark):
    """Every detector's pattern begins with a test of its first character, and finds the same as the plain pattern."""
    from quietmark.functions import patterns as P
    from quietmark.functions.text import extract_all
    from quietmark.operators.detectors import PARITY, any_name_pattern, detectors

    plain = {
        "labelled_name": P.LABELLED_NAME, "ip": P.IP, "credit_card": P.CARD, "ssn": P.SSN, "dob": P.BIRTH_DATE, "phone": P.PHONE,
        "labelled_address": P.LABELLED_ADDRESS, "address_window": P.ADDRESS_LABEL,
    }
    texts = [
        "x10.0.0.1 10.0.0.1, 010.1.1.1 ١٠.1.1.1 1.2.3.4.5", "4539 1234-5678 9012 45391234567890123 ٤539-1234-5678-9012", "123-45-6789 a123-45-6789 ١٢٣-45-6789",
        "+91 98765 43210 5+91 98765 43210 (020) 255-1234-12 ٠20 255-1234-1234", "DOB: 1/2/1990 ſdob 1/2/90 BORN ON March 3, 1990 d.o.b. - 3 May 1999",
        "Name: Ann Lee\nfull  NAME : Bo Lee fULL name:Cy Lee surname: Di Lee", "Home Address: here\nxwork address: there\nOFFICE ADDRESS : a", "REGISTERED OFFICE: b Mailing address : c correſpondence addreſs:",
        "ann lee Ann Leeds xAnn Lee ſam KIT Kit", "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = [(d.pattern, plain[d.id]) for d in detectors(PARITY) if d.id in plain]
    assert len(pairs) == len(plain) and all("(?=" in quick and quick != slow for quick, slow in pairs)
    names = any_name_pattern(("Ann Lee", "Sam", "kit"))
    assert "(?=[" in names
    pairs.append((names, r"(?iu)(?<![A-Za-z])(?:\QAnn Lee\E|\QSam\E|\Qkit\E)(?![A-Za-z])"))
    for quick, slow in pairs:
        got, want = ([r[0] for r in rows.select(extract_all(F.col("text"), p)).collect()] for p in (quick, slow))
        assert got == want and any(want)
