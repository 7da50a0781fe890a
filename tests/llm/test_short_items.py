"""Benchmark items of any length and script, against the definition in plain Python."""

import random

import pytest

from quietmark.llm import decontaminate
from quietmark.llm.decontaminate import contaminated, find_overlaps
from quietmark.llm.queries import QUERIES
from quietmark.sources.tables import table

WITHIN = lambda c, spans: any(lo <= ord(c) <= hi for lo, hi in spans)


def units(text):
    out = []
    for c in text.lower():
        if WITHIN(c, decontaminate.MARKS) or (c < "\x80" and not c.isalnum()):
            out.append(" ")
        else:
            out.append(f" {c} " if WITHIN(c, decontaminate.IDEOGRAPHS + decontaminate.ALPHABETS) else c)
    return "".join(out).split()


def found(text, items):
    words, out = units(text), set()
    for i, item in items:
        w = units(item)
        letters = sum(WITHIN(x[0], decontaminate.ALPHABETS) for x in w)
        signs = letters + sum(WITHIN(x[0], decontaminate.IDEOGRAPHS) for x in w)
        scale = 4 if 2 * letters > len(w) else 2 if 2 * signs > len(w) else 1
        n = min(len(w), 13 * scale)
        allowed = 2 * (n // 13) if n >= 13 else 2 * n // 13 if scale == 1 else 0
        for p in range(len(w) - n + 1) if w else ():
            for s in range(len(words) - n + 1):
                if sum(a != b for a, b in zip(w[p : p + n], words[s : s + n])) <= allowed:
                    out.add(i)
    return out


@pytest.mark.parametrize("block", [500_000, 60])
def test_every_item_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(4)
    kinds = [
        lambda: " " + rnd.choice("abcdefghijkl") + rnd.choice("éñxyz"),
        lambda: chr(rnd.randint(0x4E00, 0x4E40)),
        lambda: rnd.choice("あいうえおカキクケコ漢字"),
        lambda: chr(rnd.randint(0x0E01, 0x0E2E)),
        lambda: chr(rnd.randint(0x20000, 0x20020)),
    ]
    mixed = lambda: rnd.choice(kinds)()
    items = []
    for i in range(60):
        unit = [*kinds, mixed][i % 6]
        items.append((i, [unit() for _ in range(rnd.choice([2, 4, 6, 7, 9, 12, 13, 20, 26, 30, 52, 60]))]))
    docs = []
    for i in range(150):
        parts = [[mixed() for _ in range(rnd.randint(0, 20))]]
        for _, item in rnd.sample(items, i % 3):
            copy = list(item)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 5, 8, 9])):
                copy[rnd.randrange(len(copy))] = mixed()
            parts += [copy, [mixed() for _ in range(rnd.randint(0, 9))]]
        docs.append((i, rnd.choice([" ", "。", "　", " — "]).join("".join(p) for p in parts)))
    items = [(i, "".join(w)) for i, w in items]
    bench = spark.createDataFrame([*items, (100, None), (None, "a b c d e f"), (101, ""), (102, "。")], "item_id long, text string")
    df = spark.createDataFrame([*docs, (200, None), (201, "")], "doc_id long, text string")
    got = {r.doc_id: {c.item_id for c in r.contamination} for r in find_overlaps(df, bench).collect()}
    assert got == {i: found(t, items) for i, t in docs} | {200: set(), 201: set()} and sum(map(bool, got.values())) > 50


def test_short_items_and_scripts_without_blanks(spark):
    items = [
        (1, "Who wrote Hamlet?"),  # under five words
        (2, "which planet has the most known moons today"),  # 8 words
        (3, "下列哪一项是光合作用的主要产物并且在叶绿体中生成请选择正确答案"),
        (4, "ข้อใดต่อไปนี้เป็นเมืองหลวงของประเทศไทยและตั้งอยู่ริมแม่น้ำเจ้าพระยา"),
    ]
    docs = [
        (1, "quiz: who wrote Hamlet? Marlowe"),
        (2, "Which planet has the most NAMED moons today?"),
        (3, "问题:下列哪一项是光合作用的主要产品,并且在叶绿体中生成?请选择。"),
        (4, "ถามว่า" + items[3][1] + "ครับ"),
        (5, "who wrote it? which planet has the fewest named moons 光合作用的主要产物 ประเทศไทย"),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [(c.item_id, c.first_word, c.end_word) for c in r.contamination] for r in find_overlaps(df, bench).collect()}
    assert got[1] == [(1, 1, 4)] and got[2] == [(2, 0, 8)] and got[5] == []
    assert {c[0] for c in got[3]} == {3} and {c[0] for c in got[4]} == {4}


def test_few_words_do_not_speak_against_a_document(spark):
    items = [(1, "answer"), (2, "the answer is forty two"), (3, "光合作用"), (4, None)]
    docs = [(1, "an answer"), (2, "so the answer is forty two"), (3, "光合作用"), (4, "nothing here"), (5, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (bool(r.contamination), r.bad) for r in find_overlaps(df, bench).withColumn("bad", contaminated()).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, False), 4: (False, False), 5: (False, False)}


def test_query_finds_short_items(spark, tmp_path):
    table(spark, "/root/testdata/sf0.001", "documents").limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    bench = "SELECT doc_id AS item_id, array_join(slice(split(trim(text), '[^A-Za-z]+'), 2, 3), ' ') AS text FROM {d} WHERE size(split(trim(text), '[^A-Za-z]+')) > 5 AND text RLIKE '^[ -~\\n]*$'"
    spark.sql(bench, d=spark.read.parquet(f"{tmp_path}/documents.parquet")).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {r.item_id for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()}
    got = {r.doc_id: r.item_ids for r in QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()}
    assert want and all(i in got[i] for i in want)
