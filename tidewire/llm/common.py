"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWNER: list = ["", None]


def keep_cache(name: str, drop) -> None:
    """Let the operator ``name`` keep a cache in this Python worker; drop the one kept before.

    Workers outlive tasks, and so do their caches. With one at a time, a worker that
    takes part in all stages of a pipeline holds no more than the largest.
    """
    if _OWNER[0] != name:
        if _OWNER[1] is not None:
            _OWNER[1]()
        _OWNER[:] = [name, drop]


def plain_binary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an Arrow array of binary or string without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def byte_slices(texts: pa.Array, most: int):
    """(from, to) of runs of rows that hold about ``most`` bytes each, so that long texts aren't worked on at once."""
    if len(texts):
        ends = plain_binary(texts)[0][1:]
        start = 0
        while start < len(texts):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield start, stop
            start = stop
