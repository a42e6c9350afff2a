"""Token counts: whole texts encoded in batches, lengths only.

Texts go to an Arrow function. Inside it a long text is split at boundaries where no
token of the vocabulary can span, the parts are dealt into batches of about equal
UTF-8 bytes, each batch is encoded with the library's ids and only lengths are kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bytebpe import Encoder

#: A place before a space that ends one word and starts the next: byte-level word
#: patterns put a single space at the front of the word that follows it.
_SAFE = re.compile(r"(?<=\S)(?= [^\s])")


def split_safely(text: str, most: int) -> list[str]:
    """Parts of about ``most`` characters whose tokens together are the text's tokens."""
    if len(text) <= most:
        return [text]
    parts, start = [], 0
    while len(text) - start > most:
        m = _SAFE.search(text, start + most - 1)
        if m is None or m.start() >= len(text):
            break
        parts.append(text[start : m.start()])
        start = m.start()
    parts.append(text[start:])
    return parts


def _lengths_json(path: str, texts: list[str], batch_bytes: int, part_chars: int) -> list[int]:
    encoder = Encoder.of(path)
    counts = [0] * len(texts)
    batch, held, size = [], [], 0

    def done():
        nonlocal size
        for j, n in zip(held, encoder.lengths(batch), strict=True):
            counts[j] += n
        batch.clear()
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in split_safely(text, part_chars) if encoder.splittable else [text]:
            n = len(part) if part.isascii() else len(part.encode())
            if batch and size + n > batch_bytes:
                done()
            batch.append(part)
            held.append(i)
            size += n
    if batch:
        done()
    return counts


def _lengths_model(path: str, texts: list[str]) -> list[int]:
    from tidewire.llm.sentencepieces import PieceTable

    return PieceTable.of(path).lengths(texts)


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    *,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 20,
    part_chars: int = 1 << 16,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``tokenizer`` is a path to a ``.json`` (tokenizers) or ``.model`` (sentencepiece)
    file. Counts are those of the library's own encoding of the whole text, without
    begin, end or other added tokens; special strings inside a text are handled as the
    library does by default. A text of any length or make is counted whole: what has no
    safe boundary (long white space, letters without spaces) stays one part. A null text counts as empty (0 bytes, 0 tokens); a null
    id stays null; repeated rows stay repeated; an empty table gives an empty result;
    other columns of the input are not carried.
    """
    is_json = tokenizer.endswith(".json")

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            if is_json:
                counts = _lengths_json(tokenizer, texts, batch_bytes, part_chars)
            else:
                counts = _lengths_model(tokenizer, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = picked.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
