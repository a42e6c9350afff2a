"""Joins on containment of one text in another, through the rarest piece of the shorter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.checkpoints import cut


def _pieces(c: Column, size: Column) -> Column:
    """All distinct substrings of a length."""
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: c.substr(i, size)))).otherwise(F.array().cast("array<string>"))


def contained(inner: DataFrame, outer: DataFrame, size: int = 6) -> DataFrame:
    """(s) and (o), distinct texts -> pairs (s, o) where o holds s.

    A text in another has all its pieces in it, so the one that fewest of the others
    hold finds them; nothing is compared with all. Texts shorter than a piece are looked
    up as pieces of their own length, for the few lengths that occur.
    """
    short = [r[0] for r in inner.where(F.length("s") < size).select(F.length("s")).distinct().collect()]  # fewer than size numbers
    held = cut(outer.select("o", F.explode(_pieces(F.col("o"), F.lit(size))).alias("piece")))
    counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asked = inner.where(F.length("s") >= size).select("s", F.explode(_pieces(F.col("s"), F.lit(size))).alias("piece"))
    known = asked.join(counts, "piece", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest"))
    found = known.where("rarest.n > 0").select("s", F.col("rarest.piece").alias("piece")).join(held, "piece").where(F.contains("o", "s")).select("s", "o")
    for k in short:
        own = outer.select("o", F.explode(_pieces(F.col("o"), F.lit(k))).alias("s"))
        found = found.unionByName(own.join(inner.where(F.length("s") == k), "s").select("s", "o"))
    return found


def first_title(headlines: DataFrame, entries: DataFrame, most: int = 50) -> DataFrame:
    """(id, headline) -> id, entry_id: the first entry (entry_id, title) whose title holds the headline, or lies in it.

    Both in lower case, their first ``most`` characters. Equal texts are looked up once,
    and of equal titles only the first entry counts. Empty and null ones match nothing;
    a headline without an entry comes back with null.
    """
    start = lambda c: F.lower(F.left(c, F.lit(most)))
    heads = headlines.select("id", start(F.col("headline")).alias("h"))
    bank = cut(entries.select("entry_id", start(F.col("title")).alias("t")).where("t <> ''").groupBy("t").agg(F.min("entry_id").alias("entry_id")))
    asked = cut(heads.where("h <> ''").select("h").distinct())
    within = contained(asked.select(F.col("h").alias("s")), bank.select(F.col("t").alias("o"))).select(F.col("s").alias("h"), F.col("o").alias("t"))
    around = contained(bank.select(F.col("t").alias("s")), asked.select(F.col("h").alias("o"))).select(F.col("o").alias("h"), F.col("s").alias("t"))
    best = within.unionByName(around).join(bank, "t").groupBy("h").agg(F.min("entry_id").alias("entry_id"))
    return heads.join(best, "h", "left").select("id", "entry_id")
