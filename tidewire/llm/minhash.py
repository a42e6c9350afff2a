"""Near-duplicate documents by DartMinHash over word shingles.

A document is a weighted set of five-word shingles, the weight being how often one
occurs. Each element owns a region as wide as its weight; hashed darts fall into it in
order of rank, each aimed at one coordinate of the signature, and a coordinate keeps
its earliest dart. Darts are thrown up to a rank set by the set's total weight, so that
their number doesn't grow with it. Two documents agree on a coordinate with the
probability of their weighted Jaccard similarity. Bands of coordinates propose pairs,
and the similarity of each proposed pair is then computed in full.

Pairs aren't listed within a band's group. Members first meet a leader of their group,
and whoever passes joins the leader's component. Only members of a group that are in
different components after that meet each other: as pairs in a small group, and in a
large one in blocks that a task compares as a whole, giving out no more than a spanning
forest of the links it finds.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.checkpoints import cut
from tidewire.llm.common import keep_cache
from tidewire.llm.components import components, merge_roots

GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


#: Word hashes that a worker keeps.
WORDS_KEPT = 200_000


class _Words(dict):
    """Hashes of words seen by this worker, emptied at a fixed size."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


_HASHES = _Words()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words: what white space separates, in lower case."""
    keep_cache("words", _HASHES.clear)
    if len(_HASHES) >= WORDS_KEPT:
        _HASHES.clear()
    words = text.lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of ``width`` words, sorted, repeats included.

    A text of fewer words is one shingle, one without words has none.
    """
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = (h + words[i : i + n - k + 1]) * (GOLD + np.uint64(2 * i))
        h ^= h >> np.uint64(29)
    return np.sort(mix(h))


def weighted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes -> distinct elements and their weights."""
    if not len(h):
        return h, np.zeros(0)
    at = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    return h[at[:-1]], (at[1:] - at[:-1]).astype(np.float64)


def unit_elements(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of (shingle, occurrence) pairs: a shingle of weight w has w of them.

    The Jaccard similarity of these sets is the weighted one of the shingles.
    """
    h = shingles(words, width)
    at = np.arange(len(h))
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0)) if len(h) else at
    return mix(h + occurrence.astype(np.uint64) * GOLD)


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count of 0, 1, 2, ..."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    logs = k * np.log(mean) - mean - np.cumsum(np.log(np.maximum(k, 1)))
    return np.cumsum(np.exp(logs))


#: Ranks, times the width of a strip, are cut into cells [0, 1/8), [1/8, 1/4), [1/4, 1/2), ... each up to twice the last.
_CELLS = [(0.0, 0.125)] + [(2.0**e, 2.0**e) for e in range(-3, 14)]
_STEPS = [_poisson_steps(width) for _, width in _CELLS]


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int, finest: float = 1.0) -> np.ndarray:
    """(sets, k) DartMinHash values of sets with positive real weights; an empty set has zeros.

    An element's weights are cut into strips [0, f), [f, 2f), [2f, 4f), ... with f =
    ``finest``, and a strip's ranks into cells of like area, in each of which a hash of
    element, strip and cell says how many darts fall, and further hashes where; those at
    places under the element's weight hit it. Any two sets so see the same darts. A set
    goes through the cells up to a rank that its total weight sets, and on only while a
    coordinate is free. Weights far under ``finest`` cost darts that miss.
    """
    sig = np.zeros(len(elements) * k, np.uint64)
    best = np.full(len(elements) * k, np.inf)
    owner = np.repeat(np.arange(len(elements)), [len(e) for e in elements])
    e = np.concatenate(elements) if elements else np.zeros(0, np.uint64)
    w = np.concatenate(weights) if elements else np.zeros(0)
    total = np.bincount(owner, weights=w, minlength=len(elements))
    with np.errstate(divide="ignore"):
        goal = k * np.log(k) / total  # with so many hits expected, most coordinates have one
    low, width, at, levels = 0.0, finest, np.arange(len(e)), []
    while at.size:
        levels.append((mix(e[at] + np.uint64((len(levels) + 1) * int(_M2) % 2**64)), owner[at], low, width, w[at]))
        low, width = low + width, low + width
        at = at[w[at] > low]

    def throw(level, c: int, on: np.ndarray):
        """The darts of a cell of the strips of sets that are on."""
        key, own, low, width, weight = level
        at = np.arange(len(own)) if on.all() else np.flatnonzero(on[own])
        seed = mix(key[at] + np.uint64((c + 1) * int(GOLD) % 2**64))
        u = (seed >> np.uint64(11)) * 2.0**-53
        some = np.flatnonzero(u >= _STEPS[c][0])
        at, seed, n = at[some], seed[some], np.searchsorted(_STEPS[c], u[some], side="right")
        here = np.repeat(np.arange(len(at)), n)
        nth = np.arange(len(here)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(mix(seed[here] ^ _M1) + (nth + 1).astype(np.uint64) * GOLD)
        rank = (_CELLS[c][0] + _CELLS[c][1] * ((dart >> np.uint64(11)) * 2.0**-53)) / width
        here = at[here]
        part = weight[here] < low + width
        if part.any():
            part = np.flatnonzero(part)
            place = low + width * ((mix(dart[part] ^ _M2) >> np.uint64(11)) * 2.0**-53)
            hit = np.ones(len(dart), bool)
            hit[part] = place < weight[here[part]]
            dart, rank, here = dart[hit], rank[hit], here[hit]
        place = own[here] * k + (mix(dart ^ GOLD) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, place, rank)
        first = np.flatnonzero(rank == best[place])
        sig[place[first]] = dart[first]

    open_ = total > 0
    done = np.zeros((len(levels), len(elements)), int)  # cells gone through
    ends = np.array([low + width for low, width in _CELLS])
    while open_.any():
        covered = np.full(len(elements), np.inf)
        for i, level in enumerate(levels):
            until = np.minimum(np.searchsorted(ends, goal * level[3], side="left") + 1, len(_CELLS))
            for c in range(done[i][open_].min(), until[open_].max()):
                on = open_ & (done[i] <= c) & (c < until)
                if on.any():
                    throw(level, c, on)
                    done[i][on] = c + 1
            covered = np.minimum(covered, np.where(done[i] > 0, ends[done[i] - 1] / level[3], 0.0))
        open_ = open_ & (best.reshape(-1, k) > covered[:, None]).any(axis=1) & (done < len(_CELLS)).all(axis=0)
        goal = np.where(open_, covered * 1.001, goal)
    return sig.reshape(len(elements), k)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(len(sig), bands, sig.shape[1] // bands)
    h = np.zeros(rows.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * GOLD
    for i in range(rows.shape[2]):
        h = mix(h ^ rows[:, :, i])
    return h.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _sketch(width: int, bands: int, rows: int):
    names = ["doc_id", "hash", "key", "n", "bands"]

    def run(batches):
        for b in batches:
            keys, counts, found, sets, held = [], [], [], [], 0

            def out():
                nonlocal held
                if sets:
                    elements, weights = zip(*map(weighted, sets), strict=True)
                    keyed = band_keys(signatures(list(elements), list(weights), bands * rows), bands)
                    found.extend(keyed[i].tolist() if len(s) else None for i, s in enumerate(sets))
                sets.clear()
                held = 0

            for text in b.column(2):
                words = word_hashes(text.as_py() or "")
                keys.append(xxhash.xxh128_digest(words.tobytes()) if len(words) else None)
                sets.append(shingles(words, width))
                counts.append(len(sets[-1]))
                held += counts[-1]
                if held >= 200_000 or len(sets) >= 512:
                    out()
            out()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=names)

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) of classes whose similarity reaches the threshold.

    Texts travel, as they pack far better than hashes do; a task keeps the elements of
    the last classes it has seen, and the pairs of a class come together.
    """

    def run(batches):
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def elements(rep: int, text) -> np.ndarray:
            if rep not in held:
                held[rep] = np.sort(unit_elements(word_hashes(text.as_py()), width))
                while len(held) > 64:
                    held.popitem(last=False)
            return held[rep]

        for b in batches:
            a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            on = [similarity(elements(x, b.column(2)[i]), elements(y, b.column(3)[i])) >= threshold for i, (x, y) in enumerate(zip(a_ids, b_ids, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(on, pa.bool_())), b.column(1).filter(pa.array(on, pa.bool_()))], names=["a", "b"])

    side = lambda p: texts.select(F.col("rep").alias(p), F.col("text").alias(f"text_{p}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """(a, b): how many elements each two sets share."""
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    places = []
    for sets in (a, b):
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        on = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        places.append((row[on], at[on]))
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), columns):
        parts = []
        for sets, (row, at) in zip((a, b), places, strict=True):
            on = (at >= lo) & (at < lo + columns)
            m = np.zeros((len(sets), columns), np.float32)
            m[row[on], at[on] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _block_links(rest: DataFrame, info: DataFrame, texts: DataFrame, threshold: float, width: int, block: int) -> DataFrame:
    """(band, rep, group) -> links (a, b) between different components of a band's group.

    info: band, group, own (members of the component there) and total (of the band). A
    component larger than a block has blocks of its own, which don't meet each other.
    The blocks follow from info, which has a row for a component, not for a member.
    """
    large = F.col("own") > block
    dealt = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.ceil(F.col(n) / F.lit(float(block))))
    named = lambda nth: F.struct(F.when(large, F.col("group")).alias("of"), nth.alias("nth"))
    nth = F.explode(F.when(large, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("own") / F.lit(float(block))) - 1)).otherwise(F.array(dealt("group", "total", "group"))))
    blocks = cut(info.withColumn("nth", nth).select("band", named(F.col("nth")).alias("block")).distinct())
    met = blocks.select("band", F.col("block").alias("s")).join(blocks.select("band", F.col("block").alias("t")), "band").where("s <= t").where(F.coalesce(F.col("s.of") != F.col("t.of"), F.lit(True)))
    sides = met.select("band", "s", "t", F.explode(F.when(F.col("s") == F.col("t"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.select("band", F.when(F.col("side") == 0, F.col("s")).otherwise(F.col("t")).alias("block"), F.xxhash64("band", "s", "t").alias("pair"), "side")
    placed = rest.join(info, ["band", "group"]).select("band", "rep", "group", named(F.when(large, dealt("rep", "own", "rep")).otherwise(dealt("group", "total", "group"))).alias("block"))
    rows = placed.join(sides, ["band", "block"]).select("pair", "side", "rep", "group").join(texts, "rep")

    def compare(t: pa.Table) -> pa.Table:
        side, rep, group = (np.asarray(t.column(n)) for n in ("side", "rep", "group"))
        own = [unit_elements(word_hashes(x.as_py()), width) for x in t.column("text")]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        two = two if len(two) else one
        edges = ([], [])
        if len(one):
            shared = shared_counts([own[i] for i in one], [own[i] for i in two])
            n = np.array([len(s) for s in own], np.float64)
            i, j = np.nonzero(shared >= threshold * (n[one][:, None] + n[two][None] - shared))
            i, j = one[i], two[j]
            on = group[i] != group[j]
            i, j = i[on], j[on]
            by = np.argsort(rep, kind="stable")
            place = np.empty_like(by)
            place[by] = np.arange(len(by))
            root = rep[by[merge_roots(np.arange(len(rep)), place[i], place[j])[place]]]
            at = np.flatnonzero(root != rep)
            edges = (root[at], rep[at])
        return pa.table({"a": pa.array(edges[0], pa.int64()), "b": pa.array(edges[1], pa.int64())})

    return rows.groupBy("pair").applyInArrow(compare, "a long, b long")


def near_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    *,
    width: int = 5,
    bands: int = 32,
    rows: int = 5,
    small: int = 64,
    block: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_hash: bool = False,
) -> DataFrame:
    """doc_id, component_id, kept for every row, and text_hash (that of Spark) if asked for.

    Documents with the same words in the same order (but for case and white space) are
    one class; classes link if the weighted Jaccard similarity of their shingles
    reaches the threshold and they agree on a whole band: at 0.8 and 32 bands of 5, all
    but 3 in a million such pairs. Texts are taken whole, however long. component_id is
    the smallest doc_id reachable; kept marks one row of each component, one that bears
    this id, so that of repeated rows one is kept. Texts of one id are told apart: each
    has its own class and component, even where two components share the smallest id.
    Null texts and texts without words link with nothing and are kept, as are rows of a
    null id. An empty table gives no rows; other columns aren't carried. Groups of more
    than ``small`` classes are compared in blocks of ``block``.
    """
    text = F.col(text_col)
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    sketched = rows_in.where(F.col("doc_id").isNotNull()).mapInArrow(_sketch(width, bands, rows), "doc_id long, hash long, key binary, n long, bands array<long>")
    sketched = cut(sketched.withColumn("row", F.monotonically_increasing_id()))
    # a class goes by a number of its own, fixed by the cut, as an id may stand for several texts
    classes = sketched.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("doc_id", "row", "hash")).alias("lead"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select("key", "lead", "n", "bands", F.col("lead.row").alias("rep")))
    entries = classes.select("rep", "n", F.explode("bands").alias("band"))
    # sums by band are cut before they meet the entries, so that a band of many entries can be split in that join
    shared = cut(entries.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("rep"), "rep", "n")).alias("lead")).where("size > 1").select("band", "size", F.col("lead.rep").alias("other"), F.col("lead.n").alias("other_n")))
    entries = cut(entries.join(shared, "band"))
    involved = classes.join(entries.select("rep").distinct(), "rep", "left_semi").select("lead.doc_id", "lead.hash", "rep")
    texts = cut(rows_in.join(involved, ["doc_id", "hash"]).select("rep", "text").dropDuplicates(["rep"]))

    def proposed(met: DataFrame) -> DataFrame:
        """Distinct pairs of those met whose sizes allow the threshold."""
        fit = F.least("n", "other_n") >= F.greatest("n", "other_n") * F.lit(threshold)
        return met.where((F.col("rep") != F.col("other")) & fit).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()

    first = cut(proposed(entries))
    links = cut(_verified(first, texts, threshold, width))
    grouped = cut(entries.select("band", "rep", "n", "size").join(components(links).withColumnRenamed("id", "rep"), "rep", "left").withColumn("group", F.coalesce("component", "rep")).drop("component"))
    own = grouped.groupBy("band", "group").agg(F.count(F.lit(1)).alias("own"))
    totals = own.groupBy("band").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("band", "total")
    info = cut(own.join(totals, "band"))
    rest = cut(grouped.join(info.select("band").distinct(), "band", "left_semi"))
    few = rest.where(F.col("size") <= small)
    other = few.select("band", F.col("rep").alias("other"), F.col("n").alias("other_n"), F.col("group").alias("other_group"))
    last = proposed(few.join(other, "band").where("rep < other and group <> other_group")).join(first, ["a", "b"], "left_anti")
    more = _verified(last, texts, threshold, width).unionAll(_block_links(rest.where(F.col("size") > small).select("band", "rep", "group"), info.where(F.col("total") > small), texts, threshold, width, block))
    joined = components(links.unionAll(more)).withColumnRenamed("id", "rep")
    placed = classes.select("key", "rep", "lead").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = placed.groupBy("component").agg(F.min("lead").alias("head"))
    named = placed.select("key", "component").join(heads, "component").select("key", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head"))
    out = sketched.select("doc_id", "hash", "key", "row").join(named, "key", "left")
    out = out.select("doc_id", "hash", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("head") == F.col("row"), F.lit(True)).alias("kept"))
    none = rows_in.where(F.col("doc_id").isNull()).select("doc_id", "hash", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionAll(none).select("doc_id", "component_id", "kept", *([F.col("hash").alias("text_hash")] if with_hash else []))
