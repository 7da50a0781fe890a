"""Tokens, the plan and the pieces; the pipeline stage by stage."""

import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import contaminated, cut_passages, near_components
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from quietmark.llm import common, encoding, near_dedup, packing
from quietmark.llm.encoding import Encoder
from quietmark.llm.packing import best_fit, cut, pack, plan
from quietmark.session import Stages

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet="ab Zé ñ\n\t\r\u3000\u00a0\x1c,.'!1²中<|>", max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_ids_of_given_cases_and_a_full_memo(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_ENTRIES", 3)
    small = Encoder(PATH)
    for text in ["a  b \n c  d  ", "it's don't I'll 12 ab12", "<|endoftext|> x", "of.\nThat end.\n\nNew", " lead", "x" * 3000, "a\n b\n\n c \n", "word, " * 50]:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("n", [0, 1, 30, 3000])
def test_plan_places_every_piece_once(n):
    rng = np.random.default_rng(n)
    capacity = 64
    counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
    rows, sequences = plan(counts, capacity)
    used = np.zeros(sequences * capacity, int)
    placed = np.zeros(capacity + 1, int)
    for i, (s, first, copies, sequence, offset) in enumerate(rows):
        after = next((f for t, f, *_ in rows[i + 1 :] if t == s), counts[s])
        assert first == placed[s]
        for t in range(after - first):
            at = (sequence + t // copies) * capacity + offset + t % copies * s
            used[at : at + s] += 1
        placed[s] = after
    assert (placed == counts).all() and used.max(initial=0) <= 1
    for s in used.reshape(sequences, capacity):  # gapless from 0
        assert s.any() and not np.any(np.diff(s) > 0)
    assert sequences <= max(1.02 * (counts @ np.arange(capacity + 1)) / capacity + 1, 0)


def check_pieces(docs, rows, capacity):
    by, space = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        space.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in docs:
        own = [*ids(text), 2]
        want = [(k, s, n, zlib.crc32(np.array(own[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cut(len(own), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    for spans in space.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(space)


def test_pack(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["alpha", "be", "gamma,", "x\ny"]) for _ in range(rnd.choice([0, 1, 5, 40, 300])))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in docs], "doc_id long, text string, length int, part string").repartition(4)
    rows = pack(df, PATH, capacity=128, keep_ids=True).collect()
    n = check_pieces(docs, rows, 128)
    counts = np.bincount([r.length for r in rows], minlength=129)
    assert n <= sum(times for _, times in best_fit(counts, 128)) and all(len(r.ids) == r.length for r in rows)
    again = pack(df.union(df.limit(1)).withColumn("doc_id", df.doc_id.cast("string")), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in again}) == len(again)
    assert pack(df.limit(0), PATH).count() == 0


def test_pipeline_stages(spark):
    """Every stage on its predecessor's rows, against brute force where there is one."""
    folder = "/root/testdata/sf0.001"
    stages = Stages(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "benchmark_passages", "packing"]
    read = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, columns = read(docs), docs.columns
        docs = stages.save(stage(spark, docs, folder))
        if name != "packing":
            assert docs.columns == columns
            after = read(docs)
        if name == "quality":
            assert 0.75 * len(before) < len(after) <= len(before) and set(after) <= set(before)
        elif name == "near_duplicates":
            assert sorted(i for i, _ in after) == sorted(i for i, (_, c) in near_components(before).items() if i == c)
        elif name == "repeated_passages":
            want = {(i, kept.decode() if gone else t) for (i, t), (_, gone, kept) in zip(before, cut_passages(before))}
            assert set(after) == want
        elif name == "benchmark_passages":
            assert sorted(after) == sorted(x for x in before if not contaminated(x[1], items))
        else:
            check_pieces(before, docs.collect(), 1024)
    stages.close()


def test_pipeline_on_odd_and_empty_tables(spark):
    folder = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, dedup int"
    rows = [(None, None, None, None, None, None, None), (1, None, None, None, None, "a", 1), (2, "", "en", None, 0, "b", 2), (2, "", "en", None, 0, "b", 2)]
    rows += [(3, "one two three", "en", "s", 13, "c", 3)] * 2 + [(4, "word " * 30_000, "en", "s", 150_000, "d", 4)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() <= max(1000, len(data))
            if name == "near_duplicates" and data:
                assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 2, 2, 3, 4]


def test_a_word_is_kept_once():
    encoder, words = Encoder(PATH), ["zebra", "quartz", "été", "Zug"]
    for text in (" ".join(["", *words]), " ".join(w + "," for w in ["", *words]), "start " + ". ".join(words), "start " + "\n".join(words)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(text)
    mapped = {("Ġ" + w.encode().decode("latin-1").translate(encoder._letters)) for w in words}
    assert {*words} <= encoder._memo.keys() and not mapped & encoder._unit_memo.keys()


def test_pieces_leave_in_batches_of_bounded_text(monkeypatch):
    """A large batch of the reader is not turned into one large batch of pieces."""
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    texts = [None, "", *["word " * 60_000] * 8]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array(texts)], names=["id", "text"])
    out = list(packing._tokenize(PATH, 1024, 2, False)(iter([batch, batch.slice(0, 0)])))
    assert len(out) > 1 and max(len(set(b["id"].to_pylist())) for b in out) <= 5
    whole = pa.Table.from_batches(out).to_pydict()
    n = -(-len([*ids(texts[2]), 2]) // 1024)
    assert whole["id"] == [0, 1, *(i for i in range(2, 10) for _ in range(n))] and {*whole["part"]} == {3}
    full = [r for r, length in zip(whole["rank"], whole["length"]) if length == 1024]
    assert full == [*range(len(full))]


def test_memory_is_given_back_when_a_task_holds_nothing_any_more(monkeypatch):
    """What a task made is gone before memory is given back; else the worker keeps it under later stages."""
    made, left = [], []
    batch, inner = pa.RecordBatch.from_arrays, near_dedup.text_bytes

    def read(column):
        buf, at = inner(column)
        own = buf.copy()
        made.append(weakref.ref(own))
        return own, at

    give_back = lambda: left.append([r() is not None for r in made])
    for module in (common, near_dedup):
        monkeypatch.setattr(module, "give_back_memory", give_back, raising=False)
    monkeypatch.setattr(near_dedup, "text_bytes", read)
    texts = pa.array(["a b c", None, "d " * 9])
    signed = near_dedup._sign(iter([batch([pa.array([1, 2, 3]), pa.array([1, 2, 3]), texts], names=["id", "tag", "text"])]))
    for step in (signed, near_dedup._sets(iter([batch([texts], names=["text"])]))):
        made[:], left[:] = [], []
        for _ in step:
            pass
        assert left == [[False] * len(made)] and made
