"""Versioned state: snapshots, caches, journals and report files.

A snapshot is a folder of its own, written in full before a pointer names it, so that a
reader never sees half of one and a failed job leaves the last one in place. All reads
and writes go through Spark and Hadoop's file systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.operators.ordered import first_by


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a snapshot, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Write the next version, or the one given; it counts once its success marker is there."""
    if version is None:
        found = versions(df.sparkSession, path)
        version = (found[-1] if found else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def read_snapshot(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The newest complete version, or an empty table; columns it lacks come as null."""
    found = versions(spark, path)
    if not found or (version is not None and version not in found):
        return spark.createDataFrame([], schema)
    return _shaped(spark, f"{path}/v={version or found[-1]}", schema)


def _shaped(spark: SparkSession, folder: str, schema) -> DataFrame:
    df = spark.read.parquet(folder)
    fields = schema.fields if hasattr(schema, "fields") else spark.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def merge(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes in place of its own, and new ones added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def prune_cache(cache: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The newest entries of each bucket up to its limit; buckets without one stay whole."""
    limits = limits or fixed.CACHE_LIMITS
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    kept = first_by(cache, ["bucket"], [F.desc("cached_at"), F.asc("key")], max(limits.values()), rank="__r")
    limited = kept.where(F.col("__r") <= F.element_at(most, F.col("bucket"))).drop("__r")
    return limited.unionByName(cache.where(~F.coalesce(F.col("bucket").isin(*limits), F.lit(False))))


def get_live(cache: DataFrame, keys: DataFrame, reference) -> DataFrame:
    """keys (bucket, key) with their value and outcome: hit, expired or miss."""
    newest = first_by(cache, ["bucket", "key"], [F.desc("cached_at")])
    j = keys.join(newest, ["bucket", "key"], "left")
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(reference).cast("timestamp"))
    outcome = F.when(F.col("cached_at").isNull(), "miss").when(live, "hit").otherwise("expired")
    return j.select("bucket", "key", F.when(outcome == "hit", F.col("value")).alias("value"), outcome.alias("outcome"))


def append_journal(df: DataFrame, path: str) -> None:
    df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)).write.mode("append").parquet(path)


def replay_journal(spark: SparkSession, path: str, order: str) -> DataFrame:
    """Each observation once, at its first place; an absent journal is an error left to the caller."""
    return first_by(spark.read.parquet(path), ["fingerprint"], [F.asc(order)])


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


MANIFEST = "path string, number int"


def commit_all(updates: dict[str, DataFrame], checks: list[DataFrame], manifest: str) -> int:
    """Publish all tables or none; returns the number of the commit.

    Every check must be empty. The tables are then written to folders that nothing
    names, and one manifest, itself a snapshot, names them all at once: a failure before
    that leaves readers with the last commit, and the next try writes over what is left.
    """
    for c in checks:
        bad = c.limit(1).collect()
        if bad:
            raise ValueError(f"nothing was written: {bad[0].asDict()}")
    spark = next(iter(updates.values())).sparkSession
    found = versions(spark, manifest)
    number = (found[-1] if found else 0) + 1
    named = {r.path: r.number for r in read_snapshot(spark, manifest, MANIFEST).collect()}
    for path, df in updates.items():
        df.write.mode("overwrite").parquet(f"{path}/c={number}")
        named[path] = number
    return write_snapshot(spark.createDataFrame(sorted(named.items()), MANIFEST).coalesce(1), manifest, number)


def read_committed(spark: SparkSession, path: str, schema, manifest: str) -> DataFrame:
    """A table as the last commit left it, or an empty one; columns it lacks come as null."""
    numbers = [r.number for r in read_snapshot(spark, manifest, MANIFEST).where(F.col("path") == path).collect()]
    return _shaped(spark, f"{path}/c={numbers[0]}", schema) if numbers else spark.createDataFrame([], schema)
