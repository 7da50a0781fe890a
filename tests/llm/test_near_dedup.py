"""Circulant MinHash, components and the filter, against all pairs."""

import random

import numpy as np
from brute import near_components

from quietmark.llm.common import Stages
from quietmark.llm.components import components
from quietmark.llm.near_dedup import K, drop_near_duplicates, near_duplicates, ranks, signature


def corpus(seed=1):
    """Groups of edited copies at all similarities around the limit, a shared passage, short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage, docs = [word() for _ in range(40)], []
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([12, 60, 200]))]
        for _ in range(12):
            copy = base[:]
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [" ".join([word() for _ in range(20)] + passage) for _ in range(20)]
    docs += ["", "  \n", "one", "ONE", "one two", "a b c d", "A b\tc D", "a b c d e", None]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_equals_all_pairs(table_of):
    docs = corpus()
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(table_of(docs)).collect()}
    assert got == near_components(docs)


def test_chain_over_many_documents(table_of):
    """Neighbours are near, the ends are not: all are one group."""
    words = [f"w{i}" for i in range(400)]
    docs = [(1000 - i, " ".join(words[6 * i : 6 * i + 120])) for i in range(30)]
    got = {r.id: r.component_id for r in near_duplicates(table_of(docs)).collect()}
    assert set(got.values()) == {971} and got == {i: c for i, (_, c) in near_components(docs).items()}


def test_defined_cases(table_of):
    text = "the same ten words stand here in one long row"
    docs = [(5, text), (5, text), (7, text), (None, text), (8, None), (9, ""), (9, "other words that stand alone in this one row")]
    rows = near_duplicates(table_of(docs)).collect()
    assert sorted((r.id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in rows) == [
        (-1, 6, -1, True), (5, 6, 5, True), (5, 6, 5, True), (7, 6, 5, False), (8, 0, 8, True), (9, 0, 9, True), (9, 5, 9, True)
    ]
    left = drop_near_duplicates(table_of(docs))
    assert left.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [
        (-1, text), (5, text), (8, ""), (9, ""), (9, "other words that stand alone in this one row")
    ]


def test_clashing_names_and_empty(table_of):
    schema = "doc_id string, text string, id long, tag string, kept int, cls int, n int"
    rows = [("1", "a b c d e f g", 9, "x", 0, 1, 2), ("2", "a b c d e f g", 9, "y", 0, 1, 2)]
    left = drop_near_duplicates(table_of(rows, schema))
    assert [tuple(r) for r in left.collect()] == [rows[0]]
    assert near_duplicates(table_of([])).count() == 0 and drop_near_duplicates(table_of([])).count() == 0


def test_second_permutation_is_shifted():
    table = ranks()
    assert (table[7, 1:] == table[8, :-1]).all() and table.shape[1] == K
    assert np.unique(table[:, 0]).size == table.shape[0]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    seen = []
    for _ in range(40):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (150, 25, 25))
        seen.append((signature(np.concatenate([both, a])) == signature(np.concatenate([both, b]))).mean())
    assert abs(np.mean(seen) - 0.75) < 0.02 and np.std(seen) < 0.06


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (300, 300)], "a long, b long")
    got = {r.node: r.root for r in components(links, Stages(spark)).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}
    assert components(links.limit(0), Stages(spark)).count() == 0


def test_a_large_group_is_not_paired_with_all_its_hubs(table_of, monkeypatch):
    """Near copies that share many buckets: about a pair a class, not one for each hub of each bucket."""
    from quietmark.llm import near_dedup

    rnd = random.Random(5)
    base, docs = [f"w{i}" for i in range(150)], []
    for i in range(240):
        copy = base[:]
        copy[rnd.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    listed, linked = [], near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, *rest: listed.append(pairs.count()) or linked(pairs, *rest))
    got = near_duplicates(table_of(docs)).collect()
    assert {r.component_id for r in got} == {0} and sum(listed) <= 2 * len(docs)


def edited(rnd, size, most):
    """Copies of one text with up to ``most`` words changed, the rest of them too far from it to be linked."""
    base, docs = [f"w{i}" for i in range(150)], []
    for i in range(size):
        copy = base[:]
        for _ in range(rnd.randint(1, most)):
            copy[rnd.randrange(150)] = f"x{rnd.randrange(40)}"
        docs.append((i, " ".join(copy)))
    return docs


def test_a_group_around_the_limit_lists_few_pairs(table_of, monkeypatch):
    """Half of the group is linked with nothing: exact bounds show it, so that the pairs need not be listed."""
    from quietmark.llm import near_dedup

    docs = edited(random.Random(11), 260, 8)
    listed, linked = [], near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, *rest: listed.append(pairs.count()) or linked(pairs, *rest))
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(table_of(docs)).collect()}
    assert got == near_components(docs)
    assert sum(listed) <= 6 * len(docs)


def test_parities_differ_no_more_than_the_sets(spark):
    from quietmark.llm.near_dedup import _at_least_apart, _parities

    rng = np.random.default_rng(9)
    both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for common, apart in ((150, 50), (150, 0), (4000, 3000), (0, 30)):
        a, b = (np.concatenate([both[:common], rng.integers(0, 1 << 63, apart, dtype=np.uint64)]) for _ in "ab")
        odd, other = _parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).to_pylist()
        seen = spark.createDataFrame([(odd, other)], "x array<long>, y array<long>").select(_at_least_apart("x", "y")).first()[0]
        assert seen <= 2 * apart and (apart > 100 or seen >= 1.8 * apart)
