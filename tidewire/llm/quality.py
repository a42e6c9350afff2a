"""Quality classifier by co-training.

Two classifiers see different views of a document: one its text content (its words and
pairs of words, hashed, beside numbers on its shape), one its page metadata (source,
language, declared length). Over some rounds each gives the other the documents it is
sure of as pseudo-labels. Their calibrated log odds are then combined, and every
document is scored over its whole text.
"""

from __future__ import annotations

import math
import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.minhash import GOLD, mix, word_hashes
from tidewire.operators.checkpoints import cut

SHAPE = 14
WORD_BUCKETS = 512
META_BUCKETS = 64
SCALE = 1_000_000
SURE = 8.0  #: calibrated log odds count up to here

_KIND = np.zeros(256, dtype=np.uint8)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 plain punctuation, 7 beyond ASCII
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 7 if _c >= 128 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 5 if _ch == "\n" else 4 if _ch.isspace() else 6 if _ch in ".,;:'\"?-()" else 0


def shape_view(text: str) -> np.ndarray:
    """Numbers on the shape of one whole text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_KIND[raw], minlength=8) / n
    words = text.lower().split()
    count = max(1, len(words))
    ends = sum(w[-1] in "!#$%&*|<>{}=" for w in words) / count
    again = sum(map(str.__eq__, words, words[1:])) / count
    lines = [x for x in text.split("\n") if x]
    return np.array([
        math.log1p(len(raw)) / 10,
        math.log1p(len(words)) / 10,
        *share[[0, 1, 2, 3, 5, 6, 7]] * 5,
        min(3.0, len(raw) / count / 8),
        ends * 3,
        again * 5,
        len(set(words)) / count,
        len(set(lines)) / max(1, len(lines)),
    ])


def content_view(text: str) -> np.ndarray:
    """The words and pairs of neighbouring words of one whole text, by hash bucket, as a vector of length one."""
    words = word_hashes(text)
    pairs = mix(words[1:] * GOLD + words[:-1]) if len(words) > 1 else words[:0]
    n = np.bincount((np.concatenate([mix(words), pairs]) % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
    x = np.log1p(n.astype(np.float32))
    size = np.sqrt(x @ x)
    return x / size if size else x


def text_view(texts: list[str]) -> np.ndarray:
    """(texts, features): the text view, whose size doesn't depend on the texts, in half precision."""
    out = np.zeros((len(texts), SHAPE + WORD_BUCKETS), np.float16)
    for i, t in enumerate(texts):
        out[i, :SHAPE], out[i, SHAPE:] = shape_view(t), content_view(t)
    return out


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Places that are 1 in the metadata view: source, language and length buckets."""
    bucket = lambda kind, value: zlib.crc32(f"{kind}:{value}".encode()) % META_BUCKETS
    size = -1 if n_chars is None else min(META_BUCKETS - 1, max(0, n_chars).bit_length())
    return [bucket("source", source), META_BUCKETS + bucket("lang", lang), 2 * META_BUCKETS + bucket("length", size)]


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25, start: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression; the last weight is the intercept.

    Newton steps, each solved by conjugate gradients, so that no matrix of features by
    features is made; a step that raises the loss is halved.
    """
    penalty = np.full(x.shape[1] + 1, ridge)
    penalty[-1] = 1e-3
    x = x.astype(np.float32) if x.dtype == np.float16 else x
    times = lambda w: (x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1]
    back = lambda r: np.append((r.astype(x.dtype) @ x).astype(np.float64), r.sum())
    loss = lambda w, z: np.logaddexp(0.0, np.where(y > 0, -z, z)).sum() + 0.5 * (penalty * w) @ w
    w = np.zeros(x.shape[1] + 1) if start is None else start.copy()
    z = times(w)
    now = loss(w, z)
    for _ in range(steps):
        p = _sigmoid(z)
        slope, curve = back(p - y) + penalty * w, np.maximum(p * (1 - p), 1e-9)
        step, r = np.zeros_like(w), slope.copy()
        d, size = r.copy(), r @ r
        goal = 1e-8 * size
        for _ in range(60):
            if size <= goal or not size:
                break
            hd = back(curve * times(d)) + penalty * d
            a = size / (d @ hd)
            step, r = step + a * d, r - a * hd
            size, before = r @ r, size
            d = r + size / before * d
        for _ in range(30):
            z = times(w - step)
            then = loss(w - step, z)
            if then <= now:
                break
            step = step / 2
        gain, now, w = now - then, min(now, then), w - step
        if gain <= 1e-7 * (abs(now) + 1e-9) or np.abs(step).max() < 1e-6:
            break
    return w


def _odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32) if x.dtype == np.float16 else x
    return (x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1]


@dataclass
class CoTrained:
    """text and meta score their views; text_cal and meta_cal turn those into calibrated log odds; mix combines them."""

    text: np.ndarray
    meta: np.ndarray
    text_cal: np.ndarray
    meta_cal: np.ndarray
    mix: np.ndarray

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> np.ndarray:
        a = _odds(self.text_cal, _odds(self.text, text_x)[:, None])
        b = _odds(self.meta_cal, _odds(self.meta, meta_x)[:, None])
        return _sigmoid(_odds(self.mix, np.clip(np.column_stack([a, b]), -SURE, SURE)))


def mixed(both: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the calibrated log odds of the views, none below 0: a view that speaks against itself is left out."""
    both = np.clip(both, -SURE, SURE)
    w = logistic(both, y)
    for v in (0, 1):
        if w[v] < 0:
            other = both.copy()
            other[:, v] = 0.0
            w = logistic(other, y)
            w[v] = 0.0
    return np.append(np.maximum(w[:-1], 0.0), w[-1])


def dealt(y: np.ndarray) -> np.ndarray:
    """A part for each row with a label, by turns within its class: 0 trains, 1 calibrates, 2 mixes; -1 has no label.

    Three of five train. A class of one or two rows, too few to deal, is in all parts (3).
    """
    part = np.full(len(y), -1)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        part[at] = np.array([0, 1, 2, 0, 0])[np.arange(len(at)) % 5] if len(at) > 2 else 3
    return part


def cotrain(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, part: np.ndarray, rounds: int = 4, sure: float = 0.97) -> CoTrained | None:
    """y: 0, 1, or -1 for no label. part: see dealt(); each part calibrates or mixes rows it hasn't been fitted on.

    In a round each view gives the other all the unlabelled rows that it is sure of.
    None if a class has no label.
    """
    known = y >= 0
    if len(np.unique(y[known])) < 2:
        return None
    train, test, last = (known & ((part == p) | (part == 3)) for p in (0, 1, 2))
    ys = [np.where(train, y, -1), np.where(train, y, -1)]
    views = [text_x, meta_x]
    fits = [None, None]
    for r in range(rounds + 1):
        for v in (0, 1):
            use = ys[v] >= 0
            fits[v] = logistic(views[v][use], ys[v][use].astype(float), start=fits[v])
        if r == rounds:
            break
        for v in (0, 1):
            p = _sigmoid(_odds(fits[v], views[v]))
            free = (ys[1 - v] < 0) & ~known
            for label, confident in ((1, p), (0, 1 - p)):
                ys[1 - v][free & (confident >= sure)] = label
    odds = [_odds(fits[v], views[v]).astype(np.float64) for v in (0, 1)]
    cals = [logistic(odds[v][test][:, None], y[test].astype(float), ridge=1e-2) for v in (0, 1)]
    both = np.column_stack([_odds(cals[v], odds[v][last][:, None]) for v in (0, 1)])
    return CoTrained(*fits, *cals, mixed(both, y[last].astype(float)))


def _spread(places: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(places), 3 * META_BUCKETS), np.float16)
    for i, at in enumerate(places):
        x[i, at] = 1.0
    return x


def _picked(docs: DataFrame) -> DataFrame:
    def col(name: str, kind: str):
        return F.col(name).cast(kind).alias(name) if name in docs.columns else F.lit(None).cast(kind).alias(name)

    return docs.select(col("doc_id", "long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), col("source", "string"), col("lang", "string"), col("n_chars", "long"))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 16_000, least: int = 2_000, unlabelled: int | None = None, strict: bool = False) -> CoTrained | None:
    """Fit on about ``sample`` documents (all, if fewer) drawn by a hash of the id.

    Half of them have a label: those train, calibrate and mix, see dealt(). However many
    documents have none, labelled ones are drawn at a rate of their own, one for both
    classes, or a higher one for a class that would fall under ``least``; the scores are
    set back by what that adds to the odds. About ``unlabelled`` documents without a
    label (half of ``sample``, if not given) are the pool for pseudo-labels. Only features reach the driver, of one row for an id: of
    repeated ids the first by text. A document with several labels takes their mean,
    rounded; null labels and null ids don't count.

    Where a class has no label there is nothing to learn: the result is None, with a
    warning, or with ``strict`` a ValueError.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = cut(known.groupBy("doc_id").agg((F.round(F.avg("quality")) > 0).cast("int").alias("quality")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    counts = {r[0]: r[1] for r in ids.join(known, "doc_id", "left").groupBy("quality").count().collect()}
    if not counts.get(0) or not counts.get(1):
        if counts and strict:
            raise ValueError("documents of either class must have labels")
        if counts:
            warnings.warn("no documents with labels of both classes: quality is not scored", stacklevel=2)
        return None
    both = sample / 2 / (counts[0] + counts[1])
    rates = {q: min(1.0, max(both, least / counts[q])) for q in (0, 1)}
    pool = min(1.0, (sample / 2 if unlabelled is None else unlabelled) / max(1, counts.get(None, 0)))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(SCALE))
    upto = lambda rate: F.lit(math.ceil(SCALE * rate))
    # about half a sample of ids, so that no text is shuffled to meet its label
    picked = F.broadcast(known.where(place < F.when(F.col("quality") == 1, upto(rates[1])).otherwise(upto(rates[0]))))
    rest = _picked(docs).where(F.col("doc_id").isNotNull() & (place < upto(pool))).join(known.where(place < upto(pool)), "doc_id", "left_anti")
    rows = _picked(docs).join(picked, "doc_id").unionByName(rest.withColumn("quality", F.lit(None).cast("int")))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "source", "lang", "n_chars", "quality")).alias("r")).select("doc_id", "r.*")

    def view(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                cols = part.select(["text", "source", "lang", "n_chars"]).to_pydict()
                text = pa.array([x.tobytes() for x in text_view(cols["text"])], pa.binary())
                meta = [meta_view(*x) for x in zip(cols["source"], cols["lang"], cols["n_chars"], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, pa.array(meta, pa.list_(pa.int32())), part.column("quality")], names=["doc_id", "text", "meta", "quality"])

    got = rows.mapInArrow(view, "doc_id long, text binary, meta array<int>, quality int").toArrow().sort_by("doc_id")
    text = np.frombuffer(b"".join(x.as_py() for x in got.column("text")), np.float16).reshape(got.num_rows, -1)
    y = np.array([-1 if q is None else int(q > 0) for q in got.column("quality").to_pylist()])
    meta = _spread(got.column("meta").to_pylist())
    del got
    pa.default_memory_pool().release_unused()
    model = cotrain(text, meta, y, dealt(y))
    if model is not None:
        model.mix[-1] -= math.log(rates[1] / rates[0])
    return model


def _scores(model: CoTrained, rows: pa.RecordBatch) -> np.ndarray:
    """Of rows with text, source, lang and n_chars, some at a time."""
    out = np.zeros(rows.num_rows)
    for lo in range(0, rows.num_rows, 256):
        cols = rows.slice(lo, 256).select(["text", "source", "lang", "n_chars"]).to_pydict()
        text = text_view([t or "" for t in cols.pop("text")])
        out[lo : lo + 256] = model.score(text, _spread([meta_view(*x) for x in zip(*cols.values(), strict=True)]))
    return out


def score(docs: DataFrame, model: CoTrained | None, *, threshold: float = 0.1) -> DataFrame:
    """One row per input row: doc_id, score (probability of good quality), kept.

    A document goes only where it is likelier bad by more than nine to one, so that an
    odd but clean one stays.

    Without a model (no labels of both classes) nothing is told: scores are null and all
    rows are kept. Null and empty texts are scored like others, long ones over their
    whole; a null id stays null; repeated rows stay; missing metadata columns count as
    null; other columns aren't carried; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            scores = pa.nulls(b.num_rows, pa.float64()) if model is None else pa.array(_scores(model, b), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], names=["doc_id", "score"])

    return _picked(docs).mapInArrow(run, "doc_id long, score double").withColumn("kept", F.coalesce(F.col("score") >= F.lit(threshold), F.lit(True)))


def keep_good(docs: DataFrame, model: CoTrained | None, *, threshold: float = 0.1) -> DataFrame:
    """The rows of docs, all columns, that score() keeps; docs has source, lang and n_chars."""
    if model is None:
        return docs

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(model, b) >= threshold))

    return docs.mapInArrow(run, docs.schema)
