"""Packing: documents into fixed-length training sequences of balanced attention cost.

A document's cost is linear in its tokens plus quadratic, as attention is. In each
window of documents the longest go first, each to the cheapest open sequence that
still has room; a document longer than a sequence fills whole ones, and what fits in
no open sequence is cut. An input partition is padded by less than one sequence in all.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bytebpe import Encoder

class Packer:
    """Packs the documents of one input partition.

    ``flush`` yields sequences, each a list of pieces (document, start, length, ids).
    """

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.pieces: list[tuple[tuple, int, np.ndarray]] = []
        self.held = 0

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, doc: tuple, ids: np.ndarray):
        """Yield the whole sequences that a document fills; keep the rest for flush()."""
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield [(doc, start, ids[start : start + self.capacity])]
        if whole < len(ids):
            self.pieces.append((doc, whole, ids[whole:].copy()))
            self.held += len(ids) - whole

    def flush(self, last: bool):
        n = -(-self.held // self.capacity) if last else self.held // self.capacity
        if not n:
            return
        room, bins = [self.capacity] * n, [[] for _ in range(n)]
        cheap = [(0.0, i) for i in range(n)]
        roomy = [(-self.capacity, i) for i in range(n)]
        left = []
        for piece in sorted(self.pieces, key=lambda p: -len(p[2])):
            size = len(piece[2])
            while roomy and -roomy[0][0] != room[roomy[0][1]]:
                heapq.heapreplace(roomy, (-room[roomy[0][1]], roomy[0][1]))
            if -roomy[0][0] < size:
                left.append(piece)
                continue
            passed = []
            while room[cheap[0][1]] < size:
                passed.append(heapq.heappop(cheap))
            spent, i = heapq.heappop(cheap)
            bins[i].append(piece)
            room[i] -= size
            passed.append((spent + self.cost(size), i))
            for x in passed:
                if room[x[1]]:
                    heapq.heappush(cheap, x)
            if not cheap:
                cheap = [(float("inf"), i)]
        # the rest is cut, each cut going to the sequence that is cheapest then
        spare = [(spent, i) for spent, i in cheap if room[i]]
        heapq.heapify(spare)
        kept = []
        for doc, start, ids in left:
            while len(ids) and spare:
                spent, i = spare[0]
                take = min(room[i], len(ids))
                bins[i].append((doc, start, ids[:take]))
                room[i] -= take
                start, ids = start + take, ids[take:]
                if room[i]:
                    heapq.heapreplace(spare, (spent + self.cost(take), i))
                else:
                    heapq.heappop(spare)
            if len(ids):
                kept.append((doc, start, ids))
        # outside the last window a sequence that isn't full goes back
        for i, pieces in enumerate(bins):
            if room[i] and not last:
                kept += pieces
            else:
                yield pieces
        self.pieces = kept
        self.held = sum(len(p[2]) for p in kept)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    window_tokens: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    Per piece: id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens (with ``end_id``), sequence_id, offset, and ids with ``with_ids``.
    Each token, the end id included, is in exactly one piece; a sequence's pieces lie
    without gaps from 0. A null text counts as empty and gives the end id alone; a null
    id stays null; repeated rows are packed as often as they occur; an empty table gives
    no pieces; other columns aren't carried. A text of any length or make is encoded
    whole, by the tokenizers library where the faster engine refuses it. Sequence ids
    hold the number of the input partition, so a task that runs again gives the same rows.
    """
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        encode, packer = Encoder.of(tokenizer).ids, Packer(capacity, linear, quadratic)
        base, done, rows = TaskContext.get().partitionId() << 40, 0, []

        def put(pieces):
            nonlocal done
            at = 0
            for (doc, total), start, ids in pieces:
                ids = np.ascontiguousarray(ids, dtype="<u4")
                rows.append((doc, start, len(ids), zlib.crc32(ids), total, base + done, at, *([ids.tolist()] if with_ids else [])))
                at += len(ids)
            done += 1

        def out():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[7:]]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), end])
                for pieces in packer.add((doc, len(ids)), ids):
                    put(pieces)
                if packer.held >= window_tokens:
                    for pieces in packer.flush(last=False):
                        put(pieces)
                if len(rows) >= 4096:
                    yield out()
        for pieces in packer.flush(last=True):
            put(pieces)
        if rows:
            yield out()

    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return picked.mapInArrow(run, schema)
