"""DartMinHash signatures and near-document groups against brute force."""

import random

import numpy as np
import pytest

from tidewire.llm import minhash
from tidewire.llm.components import components, merge_roots

SCHEMA = "doc_id long, text string, key string, bands string, band long, rep long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 1, 1) for i, t in rows], SCHEMA)


def similarity(a, b):
    sets = [minhash.unit_elements(minhash.word_hashes(t)) for t in (a, b)]
    return minhash.similarity(*map(np.sort, sets))


def plain_similarity(a, b):
    from collections import Counter

    def bag(t):
        w = t.lower().split()
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def brute(rows, threshold=0.8):
    """Groups of all pairs, compared through the shingles that they share."""
    from collections import Counter, defaultdict

    ids = [i for i, _ in rows if i is not None]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags, size, where = {}, {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and w:
            k = min(5, len(w))
            bags[i] = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
            size[i] = bags[i].total()
    for i in sorted(bags):
        both = Counter()
        for s, n in bags[i].items():
            for j, m in where[s]:
                both[j] += min(n, m)
            where[s].append((i, n))
        for j, n in both.items():
            if n / (size[i] + size[j] - n) >= threshold:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(rng.randint(8, 160))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    hot = [word() for _ in range(90)]
    for _ in range(90):
        w = list(hot)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((n, " ".join(w)))
        n += 1
    return rows


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "ONE "), (906, "two words"), (907, "two words"), (None, "one"), (908, "spam " * 4000), (909, "spam " * 3900), (910, "spam " * 900), (911, "z" * 60_000), (912, "z" * 60_000)]


def test_similarity_is_the_weighted_jaccard_of_shingles():
    rows = near_copies()
    for (_, a), (_, b) in zip(rows[::7], rows[1::5], strict=False):
        assert similarity(a, b) == pytest.approx(plain_similarity(a, b))
    assert similarity("a b a b a b a b", "a b a b a b") == pytest.approx(plain_similarity("a b a b a b a b", "a b a b a b"))


def jaccard(x, wx, y, wy):
    a, b = dict(zip(x.tolist(), wx, strict=True)), dict(zip(y.tolist(), wy, strict=True))
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


@pytest.mark.parametrize("finest", [1.0, 0.125])
def test_signatures_agree_as_often_as_sets_are_similar(finest):
    rng = np.random.default_rng(2)
    for n, low, high in ((3, 1, 1), (40, 1, 1), (900, 1, 1), (60, 1, 40), (60, 0.05, 3.0), (5, 0.2, 300.0)):
        got = []
        for _ in range(60):
            e = np.unique(rng.integers(0, 1 << 63, n + n // 3, dtype=np.uint64))
            wa, wb = (np.round(rng.uniform(low, high, len(e)), 3) if high > 1 else np.ones(len(e)) for _ in "ab")
            wb = np.where(rng.random(len(e)) < 0.7, wa, wb)
            a, b = slice(0, n), slice(n // 3, None)
            s = minhash.signatures([e[a], e[b]], [wa[a], wb[b]], 160, finest)
            alone = minhash.signatures([e[b]], [wb[b]], 160, finest)
            assert (s[1] == alone[0]).all()  # a signature depends on its own set alone
            got.append((s[0] == s[1]).mean() - jaccard(e[a], wa[a], e[b], wb[b]))
        assert abs(np.mean(got)) < 0.02, (n, low, high)


def test_darts_do_not_grow_with_the_weight():
    thrown = []
    mix, many = minhash.mix, np.arange(1, 300_001, dtype=np.uint64)
    try:
        minhash.mix = lambda h: (thrown.append(h.size), mix(h))[1]
        minhash.signatures([many], [np.ones(len(many))], 160)
        assert sum(thrown) < 7 * len(many)  # about one dart, hashed three times, for an element
        thrown.clear()
        minhash.signatures([many[:1]], [np.array([1e9])], 160)
        assert sum(thrown) < 20_000
    finally:
        minhash.mix = mix
    assert (minhash.signatures([many[:0], many[:2]], [np.zeros(0), np.ones(2)], 160)[0] == 0).all()


def test_shared_counts():
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(9)] for _ in "ab")
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert minhash.shared_counts(a, b, columns=7).tolist() == want


@pytest.mark.parametrize("options", [{}, {"small": 2, "block": 16}])
def test_groups_are_those_of_all_pairs(spark, options):
    rows = near_copies() + ODD
    got = minhash.near_documents(frame(spark, rows), **options).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute(rows)
    for r in got:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_repeated_rows_and_empty_tables(spark):
    assert minhash.near_documents(frame(spark, [])).count() == 0
    got = minhash.near_documents(frame(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (7, "A b c d  e f")])).collect()
    assert sorted(map(tuple, got)) == [(4, 4, False), (4, 4, True), (7, 4, False)]
    assert [tuple(r) for r in minhash.near_documents(frame(spark, [(1, None)])).collect()] == [(1, 1, True)]


def test_texts_of_one_id_keep_their_links(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven eight nine ten eleven twelve"
    for rows in ([(1, a), (1, b), (2, a + " u"), (3, b + " more")], [(1, b), (3, b + " more"), (2, a + " u"), (1, a)]):
        got = sorted(map(tuple, minhash.near_documents(frame(spark, rows)).collect()))
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_recall_of_real_documents(spark):
    """Every link of all pairs is found; links of classes that differ are counted too."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(30)] + [(None, 3), (5, None), (9, 9)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert merge_roots(np.arange(6), np.array([5, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 4, 1]
