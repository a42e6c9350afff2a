"""Phrases that occur together: count-min sketches find what can be frequent, a second pass counts it.

Every task hashes its n-grams into the rows of one count-min sketch and hands on the
cells it touched; they are added up by block. Counts in the merged sketch are too large
at times and never too small, so an n-gram whose cells all reach the threshold, and whose
parts do, may be frequent, and any other is not. The second pass counts the survivors
exactly by their words. Scores, cuts and subsumption are joins over the frequent phrases.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import plain_binary
from tidewire.operators.checkpoints import cut

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = re.compile(b"[.,;:!?\n-\r]")

#: bytes of lower-cased text: A-Z become a-z, others stay
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: of each byte: 0 in a word, 1 between words, 2 at the end of a piece
_KIND = bytes(2 if c in PIECE_ENDS else 1 if c in b" \t" else 0 for c in range(256))

ROWS = 2
#: a row of the sketch has at least 2 ** _LEAST_BITS cells and at most 2 ** most_bits
_LEAST_BITS, MOST_BITS = 16, 30
#: bytes of text for a cell of a row: a cell gets some eight n-grams then
_BYTES_A_CELL = 16
_CHUNK = 4 << 20
_FLUSH = 8 << 20
#: parts that a language's phrases are ranked in first
_PARTS = 64
#: counts of a cell stop here or at the threshold, and more than that is not asked of it
_MOST_COUNT = 127


#: of the polynomial that hashes a word; words that collide only make the sketch count more
_BASE = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a run of text of one language: ids in order of a table of distinct words, and the piece of each."""

    def __init__(self, text: bytes):
        text = text.translate(_LOWER)
        kind = np.frombuffer(text.translate(_KIND), np.uint8)
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        letters = text.translate(None, b" \t" + PIECE_ENDS)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.table: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from each position on stand in one piece."""
        return self.piece[: len(self.piece) - k + 1] == self.piece[k - 1 :] if len(self.piece) >= k else np.zeros(0, bool)

    def hashes(self, lang: str, most: int) -> list[np.ndarray]:
        """Of phrases of 1 to ``most`` words from each position on, whether in one piece or not."""
        offsets, letters = plain_binary(self.table)
        lengths = np.diff(offsets)
        powers = np.full(int(lengths.max(initial=0)), _BASE, np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        terms = (letters.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(letters)) - np.repeat(offsets[:-1], lengths)]
        known = np.add.reduceat(terms, offsets[:-1]) if len(lengths) else np.zeros(0, np.uint64)
        first = _mix(known ^ np.uint64(zlib.crc32(lang.encode()) << 16))[self.ids]
        out = [first]
        for k in range(2, most + 1):
            before = out[-1][: max(0, len(first) - k + 1)]
            out.append(_mix(before * np.uint64(0xD6E8FEB86659FD93) + first[k - 1 :]))
        return out


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Places in the sketch, its rows one behind the other."""
    odd = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)[row]
    return (_mix(hashes * np.uint64(odd)) >> np.uint64(64 - bits)) + np.uint64(row << bits)


def _runs(langs: list, texts: list, held: dict, chunk: int):
    """(lang, bytes) of runs of about ``chunk`` bytes that end where a piece ends; ``held`` keeps the rest."""
    for lang, text in zip(langs, texts, strict=True):
        parts = held[lang]
        at = 0
        while len(text) - at > chunk and (m := _END.search(text, at + chunk)):
            yield lang, text[at : m.end()]
            at = m.end()
        parts.append(text[at:])
        if sum(map(len, parts)) >= chunk or len(parts) >= 4096:
            yield lang, b"\n".join(parts)
            parts.clear()


def _all_runs(batches, chunk: int):
    """Runs of all of a task's texts, each of one language."""
    held: dict[str, list[bytes]] = defaultdict(list)
    for b in batches:
        yield from _runs(b.column(0).to_pylist(), b.column(1).to_pylist(), held, chunk)
    for lang, parts in held.items():
        if parts:
            yield lang, b"\n".join(parts)


def _packed(cells: list[np.ndarray], block_bits: int, least: int):
    """(block, gaps and counts of its cells) of what a task has gathered; counts stop at the threshold."""
    every = np.concatenate(cells)
    every.sort()
    first = np.flatnonzero(np.diff(every, prepend=every[:1] + every.dtype.type(1)))
    counts = np.minimum(np.diff(first, append=len(every)), least).astype(np.uint8)
    every = every[first]
    block = (every >> every.dtype.type(block_bits)).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    place = (every & every.dtype.type((1 << block_bits) - 1)).astype(np.uint32)
    gaps = np.diff(place, prepend=np.uint32(0))
    gaps[at[:-1]] = place[at[:-1]]
    planes = [(gaps >> np.uint32(8 * i)).astype(np.uint8).tobytes() for i in range((block_bits + 7) // 8)]  # the higher nearly vanish
    planes.append(counts.tobytes())
    small = zstandard.ZstdCompressor(level=1)
    out = [small.compress(b"".join(p[lo:hi] for p in planes)) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[at[:-1]], pa.int64()), pa.array(out, pa.binary())], names=["block", "cells"])


def _sketch(texts: DataFrame, bits: int, most: int, least: int) -> np.ndarray:
    """Packed bits of the cells of the merged sketch that reach the threshold.

    Tasks hand on what they touched, whatever the sketch's size, so what is shuffled
    follows the input. Blocks are added up row by row; a task holds its own blocks only.
    """
    total_bits = bits + (ROWS - 1).bit_length()
    block_bits = max(min(_LEAST_BITS, total_bits - 6), total_bits - 12)
    kind = np.uint32 if total_bits <= 32 else np.uint64
    least = min(least, _MOST_COUNT)

    def touch(batches):
        cells, size = [], 0
        for lang, run in _all_runs(batches, _CHUNK):
            words = Words(run)
            for k, h in enumerate(words.hashes(lang, most), 1):
                h = h[words.whole(k)]
                for row in range(ROWS):
                    cells.append(_cells(h, row, bits).astype(kind))
                size += ROWS * len(h)
            if size >= _FLUSH:
                yield _packed(cells, block_bits, least)
                cells, size = [], 0
        if size:
            yield _packed(cells, block_bits, least)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(open_.decompress(packed), np.uint8)
                planes = raw.reshape((block_bits + 7) // 8 + 1, -1)
                place = np.cumsum(sum(p.astype(np.int64) << (8 * i) for i, p in enumerate(planes[:-1])))
                held = sums.setdefault(block, np.zeros(1 << block_bits, np.uint8))
                held[place] = np.minimum(held[place] + planes[-1], least)
        for block, held in sums.items():
            if (reached := held >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(reached, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros((ROWS << bits) // 8, np.uint8)
    size = (1 << block_bits) // 8
    touched = texts.mapInArrow(touch, "block long, cells binary")
    for r in touched.repartition("block").mapInArrow(merge, "block long, bits binary").toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _survivors(words: Words, lang: str, reached: np.ndarray, bits: int, most: int):
    """(phrases, counts) for each length: distinct phrases of the run that can be frequent."""
    vocabulary = len(words.table)
    may, code = np.ones(len(words.ids) + 1, bool), None
    for k, h in enumerate(words.hashes(lang, most), 1):
        ok = words.whole(k) & may[: len(h)] & may[1 : len(h) + 1]
        for row in range(ROWS):
            at = np.flatnonzero(ok)
            cell = _cells(h[at], row, bits)
            ok[at] = (reached[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(ok)
        # a phrase is told by its first words' number and its last word's
        joint = words.ids[at] if code is None else code[at] * vocabulary + words.ids[at + k - 1]
        seen, where, counts = np.unique(joint, return_index=True, return_counts=True)
        code = np.full(len(h), -1, np.int64)
        code[at] = np.searchsorted(seen, joint)
        may = np.append(ok, False)
        if len(seen):
            rows = at[where]
            parts = [words.table.take(pa.array(words.ids[rows + j])) for j in range(k)]
            yield k, [b" ".join(p) for p in zip(*(x.to_pylist() for x in parts), strict=True)], counts


def phrase_counts(docs: DataFrame, *, most: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """lang, phrase, words, f: exact counts of phrases of 1 to ``most`` words that occur ``least`` times or more.

    A row with words 0 and an empty phrase holds a language's number of words. A row of
    the sketch has a cell for about 16 bytes of text, at most 2 ** most_bits; its bits
    are broadcast (2 ** most_bits / 4 bytes at most). Beyond that size more phrases
    survive the sketch than need be, and are counted: results are the same.
    """
    lang, text = F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(_LEAST_BITS, (size // _BYTES_A_CELL).bit_length()))
    reached = docs.sparkSession.sparkContext.broadcast(_sketch(texts, bits, most, least))

    def count(batches):
        n: dict[str, int] = defaultdict(int)
        for lang, run in _all_runs(batches, _CHUNK):
            words = Words(run)
            n[lang] += len(words.ids)
            for k, phrases, counts in _survivors(words, lang, reached.value, bits, most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).view(pa.string()), pa.array([k] * len(phrases), pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "f"]
                )
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([""] * len(n), pa.string()), pa.array([0] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["lang", "phrase", "words", "f"])

    found = texts.mapInArrow(count, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return found.where((F.col("words") == 0) | (F.col("f") >= least))


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    *,
    most: int = 4,
    least: int = 30,
    subsumed_percent: int = 80,
    first: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts end pieces at ``. , ; : ! ?`` and line ends, and words are
    runs without spaces and tabs. Candidates are phrases of 2 to ``most`` words within a
    piece that occur ``least`` times or more, overlaps included; ``a`` is a candidate's
    count, ``l`` and ``r`` those of its parts at the cut with the lowest score (the
    smallest first part, of equals) and score is floor(2000000 * a / (l + r)). Those that
    lie in a longer candidate with ``subsumed_percent`` of their count or more go. Ties
    in score go to the larger a, then to the phrase first in byte order, so the order is
    total; n is the language's number of words.

    A null text is empty, a null language is ``und``; repeated rows count each time;
    empty texts and an empty table give nothing; texts of any length count whole (a piece
    must fit in a task); extra columns are ignored.
    """
    counts = cut(phrase_counts(docs, most=most, least=least, text_col=text_col, lang_col=lang_col, most_bits=most_bits))
    parts = counts.where("words > 0").select("lang", "phrase", "f")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    word = F.split("phrase", " ")
    piece = lambda start, size: F.concat_ws(" ", F.slice(word, start, size))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), (F.col("words")).alias("words"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    named = lambda side, count: parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
    told = cuts.join(named("left", "l"), ["lang", "left"]).join(named("right", "r"), ["lang", "right"])
    ratio = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = told.groupBy("lang", "phrase", "a").agg(F.min(F.struct(ratio.alias("score"), "k", "l", "r")).alias("best"))

    inner = [(size, start) for size in range(2, most) for start in range(1, most - size + 2)]
    lies = F.filter(F.array(*(F.when(F.col("words") >= start + size - 1, F.when(F.col("words") > size, piece(F.lit(start), F.lit(size)))) for size, start in inner)), lambda p: p.isNotNull()) if inner else None
    if lies is not None:
        longer = candidates.where("words > 2").select("lang", F.explode(lies).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
        lowest = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("within").isNull() | (_exact("within") * 100 < _exact("a") * subsumed_percent))
    order = (F.col("best.score").desc(), F.col("a").desc(), "phrase")
    # a language may hold most phrases: what can't be among its first goes within a part of it
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))).orderBy(*order)
    best = lowest.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
