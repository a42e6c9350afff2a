"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model holds a whitespace marker after another character, a
piece can't cross the start of a marked word. Each distinct marked word is then
segmented once, kept in a table, and a text's ids are the table's entries joined by
position. The table lives in the Python worker and is emptied at a fixed size, so its
memory doesn't grow with the data.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import keep_cache

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class PieceTable:
    """The distinct-chunk table of one model in one worker."""

    _held: dict[str, PieceTable] = {}

    def __init__(self, path: str, most: int = 400_000, longest: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.longest = most, longest
        self.table: dict[str, tuple[int, str, str]] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        plain = self.sp.encode("a  b \n\t", out_type=str)
        #: chunks are whole only if no piece crosses a marker, and the model neither
        #: rewrites text nor drops spaces before segmenting it
        self.chunked = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.decode(self.sp.encode("a  b \n\tﬁ")) == "a  b \n\tﬁ" and plain[0] == MARK + "a"
        self.anchor = self.sp.encode("a")

    @classmethod
    def of(cls, path: str) -> PieceTable:
        keep_cache("pieces", cls._held.clear)
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _entries(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal, text with its leading spaces) of each chunk."""
        out = []
        for c, ids in zip(chunks, self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1), strict=True):
            if not ids:  # the library gives an empty text no ids
                ids = [self.sp.piece_to_id(c)] if c == MARK else []
            out.append((len(ids), ",".join(map(str, ids)), self.sp.decode(self.anchor + ids)[1:]))
        return out

    def rows(self, texts: list[str]):
        """For each text, its entries by position."""
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.table) > self.most:
            self.table.clear()
        new = [c for c in {c for chunks in cut for c in chunks} if c not in self.table]
        found = dict(zip(new, self._entries(new), strict=True))
        self.table.update((c, e) for c, e in found.items() if len(c) <= self.longest)
        for chunks in cut:
            yield [self.table.get(c) or found[c] for c in chunks]

    def lengths(self, texts: list[str]) -> list[int]:
        if not self.chunked:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        return [sum(e[0] for e in row) for row in self.rows(texts)]

    def encode(self, text: str) -> list[int]:
        if not self.chunked:
            return self.sp.encode(text)
        return [int(i) for row in self.rows([text]) for e in row if e[1] for i in e[1].split(",")]

    def digests(self, texts: list[str]):
        """(number of ids, ids joined by commas, decoded text) of each text."""
        if not self.chunked:
            for ids in self.sp.encode(texts, num_threads=1):
                yield len(ids), ",".join(map(str, ids)), self.sp.decode(ids)
            return
        for row in self.rows(texts):
            decoded = "".join(e[2] for e in row)
            # the space that encoding puts before a text goes again in decoding
            yield sum(e[0] for e in row), ",".join(e[1] for e in row if e[1]), decoded[1:] if decoded.startswith(" ") else decoded


def _groups(texts: list[str], most: int = 4 << 20):
    """Slices of about equal size, so that a batch of long texts isn't held at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids array<int> and decoded string.

    Ids are the sentencepiece library's for the whole text, without begin or end ids;
    decoded is its decode(ids). Texts are encoded whole, however long. A null text
    counts as empty (no ids, empty string); a null id stays null; repeated rows stay
    repeated; other columns aren't carried; an empty table gives no rows.
    """

    def run(batches):
        table = PieceTable.of(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                ids, decoded = [], []
                for _, joined, text in table.digests(texts[lo:hi]):
                    ids.append([int(i) for i in joined.split(",")] if joined else [])
                    decoded.append(text)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_pieces`, with n_tokens and SHA-256 digests in place of the arrays."""

    def run(batches):
        table = PieceTable.of(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                n, ids, decoded = [], [], []
                for count, joined, text in table.digests(texts[lo:hi]):
                    n.append(count)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
