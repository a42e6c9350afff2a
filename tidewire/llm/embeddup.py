"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned to principal axes, so that leading dimensions hold most of their
length. They are dealt into tiles by the side of the leading axes they lie on. For two
tiles, products over the leading dimensions come first; what remains of a pair's
product is at most the product of its suffix norms, and a pair stops as soon as that
can't lift its cosine to the threshold. Equal vectors are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.checkpoints import cut
from tidewire.llm.components import components, merge_roots
from tidewire.llm.topk import usable

#: Rounding of a rotated product is far below this; such pairs are compared again.
SLACK = 1e-9
#: And that of one in single precision.
ROUGH = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square runs over or under
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those of most length first."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1]


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, step: int = 16, rows: int = 256):
    """Index pairs (i, j) of rows of a and b, unit vectors, with cosine >= threshold.

    Yields them for ``rows`` rows of a at a time.
    """
    ra, rb = a @ axes, b @ axes
    d = ra.shape[1]
    cuts = list(range(step, d, step)) + [d]
    left_a, left_b = (np.sqrt(np.maximum(0.0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1])) for r in (ra, rb))
    suffix = lambda s, at: s[:, at] if at < d else np.zeros(len(s))
    # the leading product of every pair is rough, in half the bytes; what may go on is computed in full
    first = cuts[0]
    rough_a, rough_b = ra[:, :first].astype(np.float32), rb[:, :first].astype(np.float32).T
    rest_a, rest_b = (suffix(s, first).astype(np.float32) for s in (left_a, left_b))
    for lo in range(0, len(ra), rows):
        part = ra[lo : lo + rows]
        dense, at = rough_a[lo : lo + rows] @ rough_b, 0
        dense += rest_a[lo : lo + rows, None] * rest_b[None]
        i, j = np.nonzero(dense >= np.float32(threshold - ROUGH))
        if len(i) > dense.size // 8:
            got = (part[:, :first] @ rb[:, :first].T)[i, j]
        else:
            got = np.einsum("nd,nd->n", part[i, :first], rb[j, :first])
        while at + 1 < len(cuts) and len(i):
            s, at = cuts[at], at + 1
            e = cuts[at]
            if len(i) > dense.size // 8:  # most pairs go on: cheaper as a whole
                dense = part[:, :e] @ rb[:, :e].T
                got = dense[i, j]
            else:
                got = got + np.einsum("nd,nd->n", part[i, s:e], rb[j, s:e])
            on = got + suffix(left_a, e)[lo + i] * suffix(left_b, e)[j] >= threshold - SLACK
            i, j, got = i[on], j[on], got[on]
        close = np.flatnonzero(np.abs(got - threshold) <= SLACK)
        if close.size:
            got[close] = np.einsum("nd,nd->n", a[lo + i[close]], b[j[close]])
        on = got >= threshold
        if on.any():
            yield lo + i[on], j[on]


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile: int = 16_384,
    tile_bytes: int = 8 << 20,
    sample: int = 4_096,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two rows link if their cosine, in double precision, reaches the threshold; n_links
    counts the other rows linked directly, component_id is the smallest id reachable,
    itself included, kept marks the row that names its component. Rows that are null,
    empty, zero, hold null or non-finite components, or have a null id link with
    nothing; vectors of different lengths don't meet. Repeated rows count each as a
    row of its own, and other columns aren't carried. The axes are fitted on about
    ``sample`` vectors in all; any axes give the same result. A tile holds at most
    ``tile`` vectors and ``tile_bytes`` of them; where no direction is common to many
    vectors every tile meets every other, so a vector is sent to as many tiles as there are.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("x"))
    valid = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x")) & F.exists("x", lambda e: e != 0))
    classes = cut(valid.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    dims = {r[0]: r[1] for r in classes.groupBy(F.size("x")).count().collect()}
    rate = F.lit(math.ceil(1_000_000 * sample / max(1, sum(dims.values()))))
    drawn = classes.where(F.pmod(F.xxhash64("rep", F.lit("axes")), F.lit(1_000_000)) < rate).select(F.size("x").alias("d"), "x").toArrow()
    drawn_dim = np.asarray(drawn.column("d"))
    axes, middle, bits = {}, {}, {}
    for d, n in dims.items():
        picked = drawn.filter(pa.array(drawn_dim == d)).column("x").combine_chunks().flatten()
        u = unit(np.asarray(picked, np.float64).reshape(-1, d)) if len(picked) else np.eye(1, d)
        axes[d] = principal_axes(u)
        middle[d] = np.median(u @ axes[d], axis=0)
        tiles = max(-(-n // max(1, min(tile, tile_bytes // (8 * d)))), min(8, n // 256))
        bits[d] = min(16, max(0, math.ceil(math.log2(max(1, tiles)))))

    def place(batches):
        for b in batches:
            xs, length = b.column(0), np.asarray(b.column(0).value_lengths())
            cells, lead = np.zeros(len(xs), np.int64), [None] * len(xs)
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                r = unit(np.asarray(xs.take(pa.array(at)).flatten(), np.float64).reshape(-1, d)) @ axes[d]
                side = r[:, : bits[d]] > middle[d][: bits[d]]
                cells[at] = side @ (1 << np.arange(side.shape[1]))
                for i, v in zip(at, r[:, :8].tolist(), strict=True):
                    lead[i] = v
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), xs, pa.array(length, pa.int32()), pa.array(cells), pa.array(lead, pa.list_(pa.float64()))], names=["rep", "copies", "x", "dim", "cell", "lead"])

    placed = classes.select("x", "rep", "copies").mapInArrow(place, "rep long, copies long, x array<double>, dim int, cell long, lead array<double>")
    placed = cut(placed)
    fits = F.greatest(F.lit(1.0), F.least(F.lit(float(tile)), F.lit(float(tile_bytes)) / (8 * F.col("dim"))))
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).select("dim", "cell", F.ceil(F.col("n") / fits).alias("parts"))
    tiled = placed.join(sizes, ["dim", "cell"]).withColumn("tile", F.struct("dim", "cell", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("parts")).alias("part")))
    leads = range(8)
    boxes = tiled.groupBy("tile").agg(
        *[f(F.get("lead", F.lit(i))).alias(f"{n}{i}") for i in leads for n, f in (("lo", F.min), ("hi", F.max))]
    )
    # tiles that can hold a link lie within reach of each other on every leading axis
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    grid = boxes.withColumn("slot", F.explode(F.sequence(F.floor((F.col("lo0") - reach / 2) / reach), F.floor((F.col("hi0") + reach / 2) / reach))))
    a, b = grid.alias("a"), grid.alias("b")
    gaps = [F.greatest(F.lit(0.0), F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}")) for i in leads]
    gap = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps), F.lit(0.0))
    pairs = a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.tile.dim") == F.col("b.tile.dim")) & (F.col("a.tile") <= F.col("b.tile"))).where(gap <= reach * reach)
    pairs = pairs.select(F.col("a.tile").alias("s"), F.col("b.tile").alias("t")).distinct()
    sides = pairs.select("s", "t", F.explode(F.when(F.col("s") == F.col("t"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("tile", F.when(F.col("side") == 0, F.col("s")).otherwise(F.col("t")))
    met = tiled.select("tile", "rep", "copies", "x", "dim").join(sides, "tile").select(F.xxhash64("s", "t").alias("pair"), "side", "rep", "copies", "dim", "x")

    def compare(t: pa.Table) -> pa.Table:
        d = t.column("dim")[0].as_py()
        x = unit(np.asarray(t.column("x").combine_chunks().flatten()).reshape(-1, d))
        side, rep, copies = (np.asarray(t.column(n)) for n in ("side", "rep", "copies"))
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1)
        by = np.argsort(rep, kind="stable")  # so that a root is the smallest rep
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        n, root = np.zeros(len(rep)), np.arange(len(rep))
        for i, j in linked(x[one], x[two if len(two) else one], axes[d], threshold):
            i, j = one[i], (two if len(two) else one)[j]
            if not len(two):
                i, j = i[i < j], j[i < j]
            n += np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
            root = merge_roots(root, place[i], place[j])
        root = rep[by[root[place]]]
        at = np.flatnonzero(n > 0)
        return pa.table({"rep": pa.array(rep[at], pa.int64()), "n": pa.array(n[at].astype(np.int64)), "root": pa.array(root[at], pa.int64())})

    links = cut(met.groupBy("pair").applyInArrow(compare, "rep long, n long, root long"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("x", "rep", "copies").join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = valid.join(named, "x").select("vec_id", "n_links", "component_id")
    odd = rows.where(~(F.col("vec_id").isNotNull() & usable(F.col("x")) & F.coalesce(F.exists("x", lambda e: e != 0), F.lit(False))))
    odd = odd.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionAll(odd).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
