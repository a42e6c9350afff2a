"""Structured Streaming over the batch functions: the same rules, fed by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import identity, ordered
from tidewire.sources import state

STORIES = "story_id long, event_key string, title_key string, url string"
RESOLVED = "article_id long, tier int, story_id long, event_key string, title_key string, url string"


def on_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows with a time; later ones than the watermark allows are dropped by what follows."""
    return stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay)


def new_urls(stream: DataFrame, ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """The first row of each identity URL within the watermark."""
    keyed = on_time(stream, ts, delay).withColumn("identity_url", urls.identity_url(F.col("url"))).where("identity_url <> ''")
    return keyed.dropDuplicatesWithinWatermark(["identity_url"])


def counts(stream: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows by window and key, closed by the watermark."""
    return on_time(stream, ts, delay).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def keys(articles: DataFrame) -> DataFrame:
    """What the resolver asks of an article: id, event key, title key, URL."""
    return articles.select("article_id", "event_key", text.headline_key(F.col("headline")).alias("title_key"), urls.identity_url(F.col("url")).alias("url"))


def resolve_into(path: str):
    """A foreachBatch function: resolve a batch against the last snapshot, then write the next.

    Within a batch, articles that share an event key without a story found the same new
    one. The snapshot bears the batch's number, and is what makes the batch done: one
    that failed midway runs again over the snapshot before it and writes the same, one
    that is done changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{path}/resolved/batch={number}"
        versions = state.versions(spark, f"{path}/stories")
        if number + 1 in versions:
            return
        before = [v for v in versions if v <= number]
        stories = state.read_snapshot(spark, f"{path}/stories", STORIES, before[-1] if before else 0)
        arrived = keys(batch).dropDuplicates(["article_id"])
        found = identity.cascade(arrived, stories).join(arrived, "article_id")
        group = F.coalesce(F.when(F.col("event_key") != "", F.col("event_key")), F.concat(F.lit("#"), F.col("article_id").cast("string")))
        last = stories.agg(F.coalesce(F.max("story_id"), F.lit(0)).alias("n")).first()["n"]
        fresh = found.where("story_id is null").withColumn("g", group)
        first = fresh.groupBy("g").agg(F.min("article_id").alias("a"))
        ids = ordered.numbered(first, ["a"], last + 1, "story_id").select("g", F.col("story_id").cast("long").alias("story_id"))
        new = fresh.drop("story_id").join(ids, "g").select("article_id", "tier", "story_id", "event_key", "title_key", "url")
        out = found.where("story_id is not null").select(*new.columns).unionByName(new)
        out.write.mode("overwrite").parquet(done)
        written = spark.read.schema(RESOLVED).parquet(done)
        state.write_snapshot(stories.unionByName(written.select("story_id", "event_key", "title_key", "url")).distinct(), f"{path}/stories", number + 1)

    return run

