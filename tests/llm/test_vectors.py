"""Top-k search and embedding near-duplicates against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import embeddup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, x string, n_links string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], SCHEMA)


def vectors(n=260, d=12, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    x = np.vstack([base, base + 0.12 * rng.normal(size=base.shape), base[: n // 8] * 3, rng.normal(size=(n - 2 * (n // 4) - n // 8, d))]).astype(np.float32)
    return [(int(i) + 1, [float(y) for y in v]) for i, v in enumerate(x)]


ODD = [(1001, None), (1002, []), (1003, [0.0] * 12), (1004, [1.0] * 11 + [NAN]), (1005, [1.0] * 11 + [INF]), (1006, [1.0] * 11 + [None]), (None, [1.0] * 12), (1007, [1.0, 2.0])]


def brute_top(rows, queries, k):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for qi, q in good:
        if queries(qi):
            found = sorted((-int(q @ x), i) for i, x in good if i != qi and len(x) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rows = vectors() + ODD + [(1010, vectors()[4][1])]  # ties: an equal vector of another id
    df = frame(spark, rows)
    for block, qblock in ((8192, 2048), (40, 5)):
        got = topk.top_k(df, df.where("vec_id % 7 = 0"), 5, block=block, query_block=qblock)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 7 == 0, 5)


def test_top_k_stops_early_and_stays_right():
    rng = np.random.default_rng(0)
    x = np.floor(rng.exponential(20, size=(4000, 3)) ** 2)
    near = np.floor(256 * embeddup.unit(rng.normal(size=(3000, 32))))
    near[:60] = near[0] + rng.integers(-2, 3, size=(60, 32))  # near copies: the norm lets their queries stop
    for x, q in ((x, np.floor(256 * np.abs(rng.normal(size=(20, 3))))), (near, near[:20])):
        lists = topk.Lists(np.arange(len(x)), x)
        for i, (ids, scores) in enumerate(lists.best(np.arange(20), q, 5)):
            s = x @ q[i]
            s[i] = -np.inf
            want = np.lexsort((np.arange(len(x)), -s))[:5]
            assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
        assert lists.stopped == 20 and lists.read < 20 * x.size / 2


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6))
def test_no_candidate_beats_its_bound(seed, d):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, size=(60, d)).astype(float)
    w = rng.integers(0, 6, size=(4, d)).astype(float)
    last = rng.integers(-6, 9, size=(4, d)).astype(float)
    norm = float(np.sqrt((x * x).sum(axis=1).max()))
    with np.errstate(all="raise", under="ignore", divide="ignore", invalid="ignore"):
        limit = topk.bounds(w, last, norm)
    for i in range(4):
        under = x[((x <= last[i]) | (w[i] == 0)).all(axis=1)]
        if len(under):
            assert (under @ w[i]).max() <= limit[i] + 1e-6


def test_a_repeated_query_is_one_query(spark):
    rows = vectors(40) + [(7, vectors(40)[6][1]), (14, [1.0] * 12), (90, [0.0] * 12), (70, [0.0] * 12)]
    df = frame(spark, rows)
    got = topk.top_k(df, df.where("vec_id % 7 = 0"), 5, heads=4).collect()
    assert sorted(map(tuple, got)) == sorted(set(brute_top(rows, lambda i: i % 7 == 0, 5)))
    assert sorted(r["rank"] for r in got if r.query_id == 7) == [1, 2, 3, 4, 5]
    assert sorted(r["rank"] for r in got if r.query_id == 14) == sorted([1, 2, 3, 4, 5] * 2)


def test_top_k_edges(spark):
    none = frame(spark, [])
    assert topk.top_k(none, none).count() == 0
    few = frame(spark, [(1, [1.0]), (2, [2.0]), (2, [2.0])])
    assert sorted(map(tuple, topk.top_k(few, few.where("vec_id = 1")).collect())) == [(1, 1, 2, 131072), (1, 2, 2, 131072)]


def brute_links(rows, threshold):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good[k] = (i, x / np.sqrt(x @ x))
    n, parent = dict.fromkeys(good, 0), {i: i for i, _ in good.values()}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = list(good)
    for a in keys:
        for b in keys:
            if a < b and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = find(good[a][0]), find(good[b][0])
                parent[max(x, y)] = min(x, y)
    out = []
    for k, (i, _) in enumerate(rows):
        c = find(i) if k in good else i
        out.append((i if i is not None else -1, n.get(k, 0), c if c is not None else -1, i is not None and c == i))
    return sorted(out)


def test_near_vectors_are_exact(spark):
    rows = vectors(400) + ODD + [(2000 + k, vectors()[7][1]) for k in range(40)] + [(1, vectors()[0][1])]
    for tile, threshold in ((2048, 0.9), (32, 0.9), (32, 0.5)):
        got = embeddup.near_vectors(frame(spark, rows), threshold, tile=tile, sample=100).collect()
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in got) == brute_links(rows, threshold)


def test_near_vectors_edges(spark):
    assert embeddup.near_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in embeddup.near_vectors(frame(spark, [(5, None)])).collect()] == [(5, 0, 5, True)]
    edge = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [1e30, 0.0])])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddup.near_vectors(edge).collect()) == [(1, 1, 1), (2, 0, 2), (3, 0, 3), (4, 1, 1)]


def test_a_pair_stops_when_its_bound_is_too_low():
    rng = np.random.default_rng(1)
    x = embeddup.unit(rng.normal(size=(200, 64)))
    axes = embeddup.principal_axes(x)
    got = [(i, j) for a, b in embeddup.linked(x, x, axes, 0.3) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    i, j = np.nonzero(x @ x.T >= 0.3)
    assert sorted(got) == list(zip(i.tolist(), j.tolist(), strict=True))
