"""Articles that arrive in micro-batches: stories, timelines, canonical titles and decisions, committed together.

State lies in deltas: folders of rows by bucket, one for each batch and table. A batch
reads the buckets its keys fall in and writes a delta of its own; deltas are merged like
the digits of a counter, so that few lie open and a row is rewritten seldom. One
manifest names what counts. A batch that failed midway finds the state as it was, writes
its folders again, and a batch that is done changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import graph, identity, ordered
from tidewire.operators.checkpoints import cut
from tidewire.sources import state

TABLES = {
    "keys": "kind int, key string, story_id long",
    "timeline": "story_id long, article_id long, event_key string, title string, url string",
    "canonical": "story_id long, batch long, article_id long, title string, custom int, priority int, trust int",
    "decisions": "article_id long, tier int, story_id long",
}
#: Columns whose hash is a row's bucket.
BUCKETED = {"keys": ("kind", "key"), "timeline": ("story_id",), "canonical": ("story_id",), "decisions": ("article_id",)}
MANIFEST = "name string, delta long, last_id long"
BASE = 4  # deltas of a size that are merged into one


def bucket_of(table: str, buckets: int):
    return F.pmod(F.xxhash64(*BUCKETED[table]), F.lit(buckets)).cast("int")


class Store:
    """The tables of one registry under a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._depth, self._pending = 0, {}

    def _manifest(self, version: int | None = None) -> list:
        return state.read_snapshot(self.spark, f"{self.path}/commits", MANIFEST, version).collect()

    def committed(self) -> int:
        """The number of the last batch that counts, or -1."""
        found = state.versions(self.spark, f"{self.path}/commits")
        return found[-1] - 1 if found else -1

    def last_id(self) -> int:
        return max([r.last_id for r in self._manifest()], default=0)

    def deltas(self, table: str) -> list[int]:
        return sorted(r.delta for r in self._manifest() if r.name == table)

    def read(self, table: str, of: DataFrame | None = None) -> DataFrame:
        """A table as last committed; with ``of``, rows that hold the bucketed columns, only the buckets these fall in."""
        found = self.deltas(table)
        if not found:
            return self.spark.createDataFrame([], TABLES[table])
        df = self.spark.read.schema(f"{TABLES[table]}, bucket int").option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/delta={d}" for d in found])
        if of is not None:
            met = [r[0] for r in of.select(bucket_of(table, self.buckets)).distinct().collect()]  # at most as many as there are buckets
            df = df.where(F.col("bucket").isin(met))
        return df.select(*[c.split(" ")[0] for c in TABLES[table].split(", ")])

    def save(self, table: str, rows: DataFrame) -> None:
        """Rows to be added; they are written when the outermost transaction ends."""
        if not self._depth:
            raise ValueError("rows are saved within a transaction")
        held = self._pending.get(table)
        self._pending[table] = rows if held is None else held.unionByName(rows)

    @contextmanager
    def transaction(self, number: int, last_id: Callable[[], int] | None = None, write: Callable = None):
        """All that is saved within counts at once, under the batch's number, or not at all.

        A transaction within another joins it. One that fails, or whose batch has been
        committed before, leaves everything as it was.
        """
        self._depth += 1
        try:
            yield self
        except BaseException:
            if self._depth == 1:
                self._pending = {}
            raise
        finally:
            self._depth -= 1
        if self._depth == 0:
            pending, self._pending = self._pending, {}
            self._commit(number, pending, last_id() if last_id else self.last_id(), write or self._write)

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def _commit(self, number: int, pending: dict[str, DataFrame], last_id: int, write: Callable) -> None:
        if number <= self.committed():
            return
        named = {t: self.deltas(t) for t in TABLES}
        span = 1
        while (number + 1) % (span * BASE) == 0:
            span *= BASE
        for table, rows in pending.items():
            own = [d for d in named[table] if d > number - span]  # what this number's digits carry over
            if own:
                old = self.spark.read.schema(f"{TABLES[table]}, bucket int").option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/delta={d}" for d in own])
                rows = old.select(rows.columns).unionByName(rows)
            write(rows.withColumn("bucket", bucket_of(table, self.buckets)).repartition("bucket"), f"{self.path}/{table}/delta={number}")
            named[table] = [d for d in named[table] if d not in own] + [number]
        lines = [(t, d, last_id) for t, ds in named.items() for d in ds]
        state.write_snapshot(self.spark.createDataFrame(lines, MANIFEST).coalesce(1), f"{self.path}/commits", number + 1)


def _keyed(batch: DataFrame) -> DataFrame:
    """Articles with their keys: kind 1 event key, 2 exact title of four words or more, 3 identity URL."""
    title, url = text.headline_key(F.col("headline")), urls.identity_url(F.col("url"))
    event = F.when(~identity.broad_key(F.col("event_key")), F.nullif(F.col("event_key"), F.lit("")))
    keys = F.array_compact(F.array(*[
        F.when(k.isNotNull(), F.struct(F.lit(n).alias("kind"), k.alias("key")))
        for n, k in ((1, event), (2, F.when(F.size(F.split(title, " ")) >= 4, title)), (3, F.nullif(url, F.lit(""))))
    ]))
    return batch.select("article_id", "event_key", F.col("headline").alias("title"), url.alias("url"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("custom", "priority", "trust")], keys.alias("keys"))


def _fold(articles: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The rule on articles that share keys, one by one: the first tier with one story, else a new one (minus the article's id)."""
    owners: dict = {}
    for k in known.itertuples():
        owners.setdefault((k.kind, k.key), set()).add(k.story_id)
    out = []
    for a in articles.sort_values("article_id").itertuples():
        own = sorted((k["kind"], k["key"]) for k in a.keys)
        tier, story = next(((k[0], next(iter(owners[k]))) for k in own if len(owners.get(k, ())) == 1), (9, -a.article_id - 1))
        for k in own:
            owners.setdefault(k, set()).add(story)
        out.append((a.article_id, tier, story))
    return pd.DataFrame(out, columns=["article_id", "tier", "story_id"])


def resolve_arrivals(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """(article_id, tier, story_id) as if articles had come one by one, in order of their ids; new stories are negative.

    Articles of a batch that share no key, directly or through others, can't meet, so
    each such part is settled on its own, with what is known of its keys. A part is at
    most a micro-batch, whose size the trigger bounds.
    """
    keys = arrived.select("article_id", F.explode("keys").alias("k")).select("article_id", "k.kind", "k.key")
    first = keys.groupBy("kind", "key").agg(F.min("article_id").alias("a"))
    parts = graph.components(keys.join(first, ["kind", "key"]).select("a", F.col("article_id").alias("b")))
    placed = cut(arrived.select("article_id", "keys").join(parts.withColumnRenamed("id", "article_id"), "article_id", "left").select("article_id", "keys", F.coalesce("component", "article_id").alias("part")))
    asked = placed.select("part", F.explode("keys").alias("k")).select("part", "k.kind", "k.key").distinct()
    held = cut(asked.join(known, ["kind", "key"]).select(F.col("part").alias("of"), "kind", "key", "story_id").distinct())
    return placed.groupBy("part").cogroup(held.groupBy("of")).applyInPandas(lambda a, k: _fold(a, k), "article_id long, tier int, story_id long")


def arrive(path: str, buckets: int = 64, write: Callable | None = None):
    """A foreachBatch function for articles: article_id, headline, event_key, url, custom, priority, trust.

    Each goes to the story of its event key, exact title or URL, the first that gives
    exactly one, or founds one; ids are dealt in order of the founders, so batches of
    any size make the same stories. Timelines get each entry once; a story's canonical
    title is its best candidate's so far. An article that was settled before, or that
    comes twice in a batch, counts once; null ids not at all.
    """

    def run(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path, buckets)
        if number <= store.committed():
            return
        named = batch.where("article_id is not null").dropDuplicates(["article_id"])
        arrived = cut(_keyed(named.join(store.read("decisions", named).select("article_id"), "article_id", "left_anti")))
        asked = arrived.select(F.explode("keys").alias("k")).select("k.kind", "k.key").distinct()
        settled = cut(resolve_arrivals(arrived, store.read("keys", asked)))
        start = store.last_id()
        new = settled.where("tier = 9").select("article_id", F.col("story_id").alias("was"))
        named = cut(ordered.numbered(new, ["article_id"], start + 1, "n").select("was", F.col("n").cast("long").alias("now")))
        decided = cut(settled.join(named, settled["story_id"] == named["was"], "left").select("article_id", "tier", F.coalesce("now", "story_id").alias("story_id")))
        whole = cut(arrived.join(decided, "article_id"))
        with store.transaction(number, lambda: start + named.count(), write):
            fresh = whole.select(F.explode("keys").alias("k"), "story_id").select("k.kind", "k.key", "story_id").distinct()
            store.save("keys", fresh.join(store.read("keys", fresh), ["kind", "key", "story_id"], "left_anti").select("kind", "key", "story_id"))
            with store.transaction(number):
                entries = whole.select("story_id", "article_id", "event_key", "title", "url")
                seen = store.read("timeline", entries).select("story_id", "article_id").distinct()
                store.save("timeline", entries.join(seen, ["story_id", "article_id"], "left_anti").select(entries.columns))
            rank = F.struct("custom", "priority", "trust", F.length("title"), -F.col("article_id"))
            names = ["article_id", "title", "custom", "priority", "trust"]
            old = canonical_titles(store, whole).select("story_id", *names)
            best = whole.select("story_id", *names).unionByName(old).groupBy("story_id").agg(F.max_by(F.struct(*names), rank).alias("b")).select("story_id", "b.*")
            better = best.join(old.select("story_id", F.col("article_id").alias("had")), "story_id", "left").where("had is null or had <> article_id")
            store.save("canonical", better.select("story_id", F.lit(number).cast("long").alias("batch"), *names))
            store.save("decisions", decided)

    return run


def canonical_titles(store: Store, of: DataFrame | None = None) -> DataFrame:
    """Each story's canonical title as of the last commit."""
    return ordered.first_by(store.read("canonical", of), ["story_id"], [F.desc("batch")])
