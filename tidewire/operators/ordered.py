"""Operators on ordered rows: first by key, greedy folds, compaction and change logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.checkpoints import cut
from tidewire.operators.graph import components


def first_by(df: DataFrame, keys, order, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in a total order; Spark prunes them before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_seen(df: DataFrame, group: str, order: str, keys: list[str], most: int = 50_000) -> DataFrame:
    """Rows none of whose keys a kept earlier row of the group has; empty keys don't count.

    This is the greedy rule, in which a dropped row's keys are not seen, so that two
    ranks can't stand in for it. Two rounds over the whole table come first: a row that
    comes first for each of its keys is kept, whatever shares a key with a kept row goes,
    and the rest plays again. They end what hangs on a key of many rows. Of what is left,
    rows that share keys directly or through others form parts; those of at most ``most``
    rows are folded in tasks, one by one, and larger ones go on in rounds. No larger
    group is gathered in a task, and a key of many rows is reduced before it is
    shuffled. Rows of equal order go by their other columns.
    """
    cols = df.columns
    at = F.struct(order, *[c for c in cols if c != order])
    bare = F.lit(True)
    for k in keys:
        bare = bare & (F.coalesce(F.col(k), F.lit("")) == "")
    kept = [df.where(bare).select(at.alias("__at"))]
    df = df.where(~bare).fillna("", keys)
    left, rounds = cut(df.withColumn("__at", at).groupBy(group, *keys).agg(F.min("__at").alias("__at"))), 0
    while not left.isEmpty():
        if rounds == 2:
            folded, left = _fold_parts(left, group, keys, most)
            kept.append(folded)
            rounds += 1
            continue
        chosen, left = _first_round(left, group, keys)
        kept.append(chosen)
        rounds += 1
    out = kept[0]
    for more in kept[1:]:
        out = out.unionAll(more)
    return out.select("__at.*").select(*cols)


def _first_round(left: DataFrame, group: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What comes first for each of its keys, and what shares none with it."""
    marked = left
    for k in keys:
        first = left.where(F.col(k) != "").groupBy(group, k).agg(F.min("__at").alias(f"__first_{k}"))
        marked = marked.join(first, [group, k], "left")
    is_first = F.lit(True)
    for k in keys:
        is_first = is_first & F.coalesce(F.col("__at") == F.col(f"__first_{k}"), F.lit(True))
    now = cut(marked.withColumn("__on", is_first).select(group, *keys, "__at", "__on"))
    chosen, rest = now.where("__on"), now.where("not __on").drop("__on")
    for k in keys:
        rest = rest.join(chosen.where(F.col(k) != "").select(group, k).distinct(), [group, k], "left_anti")
    return chosen.select("__at"), cut(rest.select(group, *keys, "__at"))


def _fold_parts(left: DataFrame, group: str, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """What the greedy rule keeps of parts of at most ``most`` rows, and the rows of larger ones.

    Parts are found by hashes of rows and keys. Equal hashes only put two parts into one;
    the fold compares the keys.
    """
    named = lambda k: F.when(F.col(k) != "", F.xxhash64(group, F.lit(k), k))
    left = left.withColumn("__row", F.xxhash64(group, *keys))
    edges = left.select(F.col("__row").alias("a"), F.explode(F.array_compact(F.array(*[named(k) for k in keys]))).alias("b"))
    parts = cut(components(edges)).withColumnRenamed("id", "__row").withColumnRenamed("component", "__part")
    placed = cut(left.join(parts, "__row", "left").withColumn("__part", F.coalesce("__part", "__row")).drop("__row"))
    large = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("__part")
    small = cut(placed.join(large, "__part", "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy("__at"))))

    def fold(rows):
        seen, on = set(), []
        for r in rows.sort_values("__n").itertuples(index=False, name=None):
            own = {(r[2], i, k) for i, k in enumerate(r[3:]) if k}
            if not own & seen:
                seen |= own
                on.append(r[:2])
        return pd.DataFrame(on, columns=["__part", "__n"])

    on = small.select("__part", "__n", F.col(group).cast("string").alias("__group"), *keys).groupBy("__part").applyInPandas(fold, "__part long, __n int")
    return small.join(on, ["__part", "__n"]).select("__at"), cut(placed.join(large, "__part").select(group, *keys, "__at"))


def change_log(df: DataFrame, key: str, order, state: str) -> DataFrame:
    """Rows where the state differs from the one before, with ``previous``."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))


def compact(df: DataFrame, key: str, payload: str, order: str, most: int) -> DataFrame:
    """The newest ``most`` distinct payloads of a key, each at its newest place."""
    newest = df.groupBy(key, payload).agg(F.max(order).alias(order))
    return first_by(newest, [key], [F.desc(order)], most)


def numbered(df: DataFrame, order, start, name: str = "number") -> DataFrame:
    """Numbers that go on from ``start``, in order.

    They are dealt by partition after a range sort, so no task sees all rows: each
    gets the count of the partitions before it, which are few numbers. The sorted rows
    are cut, so that both readings of them see the same partitions.
    """
    ranged = cut(df.sort(*order)).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", "first", before.alias("before"))
    return ranged.join(offsets, "__p").withColumn(name, F.col("before") + F.col("__i") - F.col("first") + F.lit(start)).drop("__p", "__i", "first", "before")


def sequential_ids(df: DataFrame, order, start, form: str = "story_%06d") -> DataFrame:
    """As :func:`numbered`, written as ids."""
    return numbered(df, order, start, "__n").withColumn("story_id", F.format_string(form, F.col("__n").cast("long"))).drop("__n")
