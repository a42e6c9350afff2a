"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session may
    leave it unset, as in tests, and gets a temporary folder: executors elsewhere
    wouldn't see it, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidewire-checkpoint-"))
    return df.checkpoint()
