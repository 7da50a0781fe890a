"""Tokenizer alignment against the libraries themselves, group by group and pair by pair."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quietmark.llm import alignment
from quietmark.llm.alignment import align, links, vocabularies
from quietmark.llm.queries import op11_tokenizer_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
LETTERS = {chr(b if 0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE else 0): b for b in range(256)}
LETTERS.pop("\0")
LETTERS.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in LETTERS.values())})


def spelled_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def groups(text):
    """[([A ids], [B ids])], or nothing."""
    if not text:
        return []
    ids = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelled = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in ids[0]], [spelled_b(i) for i in ids[1]]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return []
    ends = [list(np.cumsum([len(x) for x in s])) for s in spelled]
    out, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        upto = [e.index(cut) + 1 for e in ends]
        out.append(tuple(i[lo:hi] for i, lo, hi in zip(ids, at, upto)))
        at = upto
    return out


def brute(texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)]."""
    found = [groups(t) for t in texts]
    pairs = [[(a, b) for x, y in g for a in x for b in y] for g in found]
    count = collections.Counter(p for own in pairs for p in set(own))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for g, own in zip(found, pairs):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own),
            sum(count[p] for p in own), hashlib.sha256(line.encode()).hexdigest() if line else "",
        ))
    return out


TEXT = st.text(alphabet="ab Zé ñ\n\t\r　 ▁ﬁ,.'!1²中<|>\0\U0001f600", max_size=40) | st.lists(
    st.sampled_from(["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "hello", " ", "  ", "Straße", "\n\n", "=" * 40, "x" * 50, "الع", "don't"]), max_size=8
).map("".join)


@given(TEXT)
@settings(max_examples=600, deadline=None)
def test_ids_and_groups_are_those_of_the_libraries(text):
    out = links([text], vocabularies(A_PATH, B_PATH), keep_groups=True)
    line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups(text))
    assert out["groups"].to_pylist() == [line]


def corpus():
    rng = random.Random(4)
    words = ["the", "Überprüfung", "naïve", "tion", "中文字", "12345", "can't", "\n", "é", "a b", "<|endoftext|>", "zzzyx", "==" * 9, "niñez"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(150)]
    texts += [None, "", " ", "  two  blanks ", "▁", "a▁b", "\0", "x" * 3000, "ab" * 500 + " " + "中" * 400, texts[3], texts[3], "word " * 5000]
    return texts


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "same": F.lit(1)}).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_tokenizer_alignment(spark, str(tmp_path)).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, got)) == [(i, *r) for i, r in enumerate(brute(texts))]


@pytest.mark.parametrize("hot", [0, 7])
def test_rare_pairs_by_join_give_the_same(spark, table_of, hot):
    texts = corpus()
    docs = table_of([(str(i), t, i, "c") for i, t in enumerate(texts)], "name string, body string, row long, cold string")
    got = align(docs, A_PATH, B_PATH, "body", hot=hot)
    assert got.columns == ["name", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {str(i): r for i, r in enumerate(brute(texts))}


def test_small_steps_and_very_large_groups(monkeypatch):
    texts = corpus()
    vocab = vocabularies(A_PATH, B_PATH)
    whole = links(texts, vocab)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 3)
    small = links(texts, vocab)
    assert all(small[c].equals(whole[c]) for c in whole)


def test_empty_table_and_null_ids(spark, table_of):
    empty = table_of([], "doc_id long, text string")
    assert align(empty, A_PATH, B_PATH).collect() == []
    got = align(table_of([(None, "same text"), (None, "same text"), (5, None)]), A_PATH, B_PATH, keep_groups=True).collect()
    assert [r.count_sum for r in got if r.doc_id is None] == [2 * r.n_links for r in got if r.doc_id is None]
    assert [(r.n_a, r.groups) for r in got if r.doc_id == 5] == [(0, "")]
