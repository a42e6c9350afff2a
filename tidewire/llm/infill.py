"""Fill-in-the-middle by succinct rank and select over code point boundaries.

The UTF-8 bytes of a group of texts get one packed bitvector, with a bit for each byte
that starts a code point, and a directory of popcounts: totals before each block of
eight words, and totals before each word within its block. Rank at the ends of a text
gives its number of code points, select on two ranks gives the byte cuts. No text is
decoded, copied by character or indexed twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import byte_slices, plain_binary

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: of 100 texts, those that are reordered at all, and of 100 reordered ones, those suffix first
REORDERED, SUFFIX_FIRST = 90, 20

_WORDS = 8  # words of 64 bits in a block of the directory


class Boundaries:
    """Packed bits of the bytes that start a code point, with a directory for rank and select."""

    def __init__(self, data: np.ndarray):
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        blocks = len(data) // (64 * _WORDS) + 1  # one word at least lies behind the last byte
        packed = np.zeros(blocks * _WORDS * 8, np.uint8)
        packed[: len(bits)] = bits
        self.words = packed.view("<u8")
        each = np.bitwise_count(self.words).reshape(blocks, _WORDS)
        within = np.cumsum(each, axis=1, dtype=np.int64)
        self.blocks = np.concatenate([[0], np.cumsum(within[:, -1])])
        self.within = (within - each).astype(np.uint16).ravel()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each byte position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[at // (64 * _WORDS)] + self.within[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte position of set bit k, counted from 0; k must be below the total."""
        block = np.searchsorted(self.blocks, k, side="right") - 1
        left = k - self.blocks[block]
        first = block * _WORDS
        in_block = self.within[first[:, None] + np.arange(_WORDS)]
        word = first + (in_block <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[word]
        bits, at = self.words[word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << half) - 1)
            here = np.bitwise_count(low)
            above = left >= here
            left = np.where(above, left - here, left)
            bits = np.where(above, bits >> np.uint64(half), low)
            at += half * above
        return word * 64 + at


def _draws(ids: list, seed: int) -> np.ndarray:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id`` as integers, by row."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _rows(ids: pa.Array, texts: pa.Array, seed: int, reordered: int, suffix_first: int) -> pa.RecordBatch:
    offsets, data = plain_binary(texts)
    starts, ends = offsets[:-1], offsets[1:]
    bounds = Boundaries(data)
    before = bounds.rank(offsets)
    n = np.diff(before)
    h = _draws(ids.to_pylist(), seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    marked = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark.encode()).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= reordered)
    spm = h[:, 3] % 100 < suffix_first

    def byte_at(units):
        at = ends.copy()
        inner = units < n
        at[inner] = bounds.select(before[:-1][inner] + units[inner])
        return at

    first, second = byte_at(cuts[:, 0]), byte_at(cuts[:, 1])
    raw = data.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for a, x, y, b, is_plain, is_spm in zip(starts.tolist(), first.tolist(), second.tolist(), ends.tolist(), plain.tolist(), spm.tolist(), strict=True):
        if is_plain:
            out.append(raw[a:b])
        elif is_spm:
            out.append(b"".join((s, raw[y:b], p, raw[a:x], m, raw[x:y])))
        else:
            out.append(b"".join((p, raw[a:x], s, raw[y:b], m, raw[x:y])))
    forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    output = pa.array(out, pa.binary()).view(pa.string())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain), output],
        names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(
    docs: DataFrame,
    *,
    seed: int = 1,
    reordered: int = REORDERED,
    suffix_first: int = SUFFIX_FIRST,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per input row: id, n (code points), form, prefix_chars, middle_chars, output.

    Cuts and form follow from the seed and the id alone, so a lost task gives the same
    rows again. A null text is empty; an empty text, one that holds a marker, and ten of
    a hundred others stay plain, with null prefix_chars and middle_chars. Texts of any
    length are cut whole; a null id draws as an empty one; repeated rows stay repeated;
    other columns aren't carried, and an empty table gives no rows. Nothing is shuffled.
    """

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for lo, hi in byte_slices(texts, group_bytes):
                yield _rows(b.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo), seed, reordered, suffix_first)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    out = picked.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that was cut, from its output and form alone.

    A reordered text holds no marker of its own, and a marker can't arise across a seam,
    so each marker is found where it was put.
    """

    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(opening) + 1, 2**31 - 1)
        rest = F.substring_index(body, between, -1)
        return F.substring_index(body, between, 1), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def infill_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`fill_in_middle` with digests of the output and of the text rebuilt from it."""
    done = fill_in_middle(docs, id_col=id_col, text_col=text_col)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
