"""Exact top-k search by inner product with the threshold algorithm.

Candidates lie in blocks. A block keeps, for each dimension, its candidates in order of
that component. A query reads the lists from the end that favours it, to depths that
double, scores each candidate when it first meets it, and stops when no candidate it
hasn't met can beat its k-th score, or when it has met all. Queries and candidate
blocks meet in blocks too. They first read only the heads of their lists; the k-th
score of those, over all blocks, then lets blocks without a good candidate stop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(c: Column) -> Column:
    """Whether a vector is there, not empty, and all its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(c) > 0) & F.forall(c, finite), F.lit(False))


def quantised(c: Column, scale: int = 256) -> Column:
    return F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def bounds(weights: np.ndarray, last: np.ndarray, norm: float) -> np.ndarray:
    """For each query, the highest score of a candidate not met yet.

    weights: (queries, dimensions), how much a query makes of each dimension; last: as
    many, the last entry read of each list, turned so that more is better; norm: that of
    the longest candidate. Without the norm the bound is the sum of weight * last; with
    it, the most of sum(weight * y) over y <= last no longer than the norm, which is
    y = min(last, f * weight) for the factor f that makes y so long.
    """
    plain = (weights * last).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(weights > 0, last / weights, np.inf)
    order = np.argsort(ratio, axis=1)
    r, w, c = (np.take_along_axis(x, order, axis=1) for x in (ratio, weights, last))
    used = np.cumsum(np.where(w > 0, c * c, 0.0), axis=1)  # squares of the first dimensions, held at their last entry
    free = np.cumsum((w * w)[:, ::-1], axis=1)[:, ::-1]
    free = np.concatenate([free[:, 1:], np.zeros((len(w), 1))], axis=1)  # squared weights of the others
    held = np.concatenate([np.zeros((len(w), 1)), used], axis=1)
    rest = np.concatenate([(w * w).sum(axis=1, keepdims=True), free], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.sqrt(np.maximum(0.0, norm * norm - held) / rest)
    low = np.concatenate([np.full((len(w), 1), -np.inf), r], axis=1)
    high = np.concatenate([r, np.full((len(w), 1), np.inf)], axis=1)
    fits = (rest > 0) & (factor >= low) & (factor <= high) & (held <= norm * norm)
    at = fits.argmax(axis=1)
    score = np.concatenate([np.zeros((len(w), 1)), np.cumsum(w * c, axis=1)], axis=1) + np.where(rest > 0, factor, 0.0) * rest
    exact = np.where(fits.any(axis=1), np.take_along_axis(score, at[:, None], axis=1)[:, 0], plain)
    return np.minimum(plain, exact)


class Lists:
    """The sorted per-dimension lists of one block of candidates.

    read and stopped count entries read and queries that the bound ended before every
    candidate was met.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(ids)
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(x, self.order, axis=0).astype(np.float64)
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()))
        self.read = self.stopped = 0

    def best(self, own: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray | None = None, deepest: int | None = None, rows: int = 256):
        """For each query, (ids, scores) of its k best, ties to the smaller id.

        bar: a score of each query that k candidates, of any block, are known to reach;
        what can't reach it may be left out. deepest: read no deeper, whatever is found.
        """
        bar = np.full(len(own), -np.inf) if bar is None else bar
        out = []
        for lo in range(0, len(own), rows):
            at = slice(lo, lo + rows)
            out += self._best(own[at], q[at], k, bar[at], self.n if deepest is None else min(deepest, self.n))
        return out

    def _best(self, own: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray, deepest: int):
        up, down, weights = q > 0, q < 0, np.abs(q).astype(np.float64)
        met = np.zeros((len(own), self.n), bool)
        found = [(np.zeros(0, np.int64), np.zeros(0, q.dtype)) for _ in own]

        def meet(i: int, at: np.ndarray):
            met[i, at] = True
            at = at[self.ids[at] != own[i]]
            found[i] = self._first(np.concatenate([found[i][0], at]), np.concatenate([found[i][1], self.x[at] @ q[i]]), k)

        waiting, done, depth = np.flatnonzero(weights.any(axis=1)), 0, min(deepest, 4)
        while waiting.size:
            last = np.where(up[waiting], self.sorted[self.n - depth], -self.sorted[depth - 1])
            limit = bounds(weights[waiting], last, self.norm)
            limit += 1e-9 * (np.abs(limit) + 1)  # far above its rounding
            left = []
            for i, most in zip(waiting, limit, strict=True):
                fresh = np.zeros(self.n, bool)
                fresh[self.order[self.n - depth : self.n - done][:, up[i]]] = True
                fresh[self.order[done:depth][:, down[i]]] = True
                self.read += (depth - done) * int(up[i].sum() + down[i].sum())
                meet(i, np.flatnonzero(fresh & ~met[i]))
                if met[i].all():
                    continue
                if max(bar[i], found[i][1][-1] if len(found[i][0]) == k else -np.inf) > most:
                    self.stopped += 1
                elif depth < deepest:
                    left.append(i)
            waiting, done, depth = np.array(left, dtype=int), depth, min(deepest, 2 * depth)
        for i in np.flatnonzero(~weights.any(axis=1)):  # no list favours anything: all score 0
            meet(i, np.arange(self.n))
        return [(self.ids[at], scores) for at, scores in found]

    def _first(self, at: np.ndarray, scores: np.ndarray, k: int):
        if len(at) > k:
            keep = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[keep], scores[keep]
        first = np.lexsort((self.ids[at], -scores))[:k]
        return at[first], scores[first]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block: int = 8192,
    query_block: int = 2048,
    heads: int = 32,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates.

    Components become floor(scale * x); the score is their integer inner product; ties
    go to the smaller id. Candidates are all rows of ``vectors`` but those with the
    query's own id; with fewer than k all come back. Vectors that are null, empty or
    hold null or non-finite components take no part, nor do null ids; vectors of
    different lengths don't meet. A repeated candidate row comes back as often as it
    occurs; a repeated query row is one query, while different vectors of one id are a
    query each. An empty side gives no rows; other columns aren't carried.
    """
    v = F.col(vector_col)

    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), quantised(v, scale).alias("x"), F.size(v).alias("dim"))

    c, q = ready(vectors), ready(queries).distinct().withColumn("key", F.xxhash64("x"))
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((c, block), (q, query_block)))
    c = c.withColumn("cb", F.pmod(F.xxhash64("id", F.lit("candidate")), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    keys, names = ("cb", "qb", "dim"), ("query_id", "key", "vec_id", "score")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")

    def met(queries_: DataFrame, deepest: int | None) -> DataFrame:
        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            found = ([], [], [], [])
            if left.num_rows and right.num_rows:
                dim = left.column("dim")[0].as_py()
                x, y = (np.asarray(t.column("x").combine_chunks().flatten()).reshape(-1, dim) for t in (left, right))
                if max(abs(int(x.max())), abs(int(x.min()))) * max(abs(int(y.max())), abs(int(y.min()))) * dim < 1 << 53:
                    x, y = x.astype(np.float64), y.astype(np.float64)  # exact, and with BLAS
                own, key = (np.asarray(right.column(n)) for n in ("id", "key"))
                bar = np.array([-np.inf if b is None else float(b) for b in right.column("bar").to_pylist()])
                for i, h, least, (ids, scores) in zip(own, key, bar, Lists(np.asarray(left.column("id")), x).best(own, y, k, bar, deepest), strict=True):
                    on = scores >= least
                    found[0].extend([int(i)] * int(on.sum()))
                    found[1].extend([int(h)] * int(on.sum()))
                    found[2].extend(ids[on].tolist())
                    found[3].extend(int(s) for s in scores[on])
            return pa.table({n: pa.array(a, pa.int64()) for n, a in zip(names, found, strict=True)})

        rows = c.groupBy(*keys).cogroup(queries_.groupBy(*keys)).applyInArrow(search, ", ".join(f"{n} long" for n in names))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # the heads of all lists first: their k-th score is a bar for every block
    bar = met(q.withColumn("bar", F.lit(None).cast("long")), heads).where(F.col("rank") == k)
    bar = bar.select(F.col("query_id").alias("id"), "key", F.col("score").alias("bar"))
    return met(q.join(bar, ["id", "key"], "left"), None).select("query_id", "rank", "vec_id", "score")
