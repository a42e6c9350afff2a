"""Streams whose state lives on: a cache with ends, and arrivals that commit together."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewire.streaming import arrivals, cache

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_cache_entries_end_and_come_back(spark, tmp_path):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []

    def feed(n, rows):
        """One micro-batch, by a query that starts anew each time."""
        data = [(b, k, op, v, f"2026-01-01 {at}", ttl, why) for b, k, op, v, at, ttl, why in rows]
        spark.createDataFrame(data, "bucket string, key string, op string, value string, at string, ttl_seconds long, reason string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(cache.OPERATIONS).parquet(f"{tmp_path}/in")
        before = len(got)
        q = cache.cached(stream).writeStream.option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.bucket, r.key, r.outcome, r.value, r.reason) for r in got[before:]}

    try:
        assert feed(0, [("b", "x", "put", "1", "10:00:00", 60, None), ("b", "y", "put", "2", "10:00:00", None, None), ("b", "x", "get", None, "10:00:30", None, None), ("b", "z", "get", None, "10:00:30", None, None), ("b", "q", "other", None, "10:00:30", None, None)]) == {
            ("b", "q", "ignored", None, None), ("b", "x", "hit", "1", None), ("b", "x", "stored", "1", None), ("b", "y", "stored", "2", None), ("b", "z", "miss", None, None),
        }
        # time goes on in another key: x ends by itself after a restart, y stays
        assert ("b", "x", "expired", None, "ttl") in feed(1, [("b", "w", "put", "9", "10:05:00", 600, None)]) | feed(2, [("b", "w", "get", None, "10:06:00", None, None)])
        assert feed(3, [("b", "x", "get", None, "10:07:00", None, None), ("b", "y", "get", None, "10:07:00", None, None), ("b", "x", "put", "3", "10:07:01", 30, None), ("b", "x", "get", None, "10:07:20", None, None), ("b", "x", "get", None, "10:07:31", None, None)]) == {
            ("b", "x", "expired", None, None), ("b", "x", "hit", "3", None), ("b", "x", "miss", None, None), ("b", "x", "stored", "3", None), ("b", "y", "hit", "2", None),
        }
        assert feed(4, [("b", "y", "delete", None, "10:08:00", None, "stale"), ("b", "y", "delete", None, "10:08:01", None, None), ("b", "y", "get", None, "10:08:02", None, None)]) == {
            ("b", "y", "deleted", None, "stale"), ("b", "y", "miss", None, "invalid"), ("b", "y", "miss", None, None),
        }
    finally:
        spark.conf.unset(PROVIDER)


SCHEMA = "article_id long, headline string, event_key string, url string, custom int, priority int, trust int"


def made(n=60):
    rng = random.Random(5)
    titles = [f"storm number {k} hits the {w} coast" for k in range(5) for w in ("east", "west")] + ["too short"]
    return [(i, rng.choice(titles), rng.choice([None, "", f"k{rng.randrange(12)}", "fire-town"]), rng.choice([None, "", f"https://x.org/news/story-{rng.randrange(15)}"]), int(i == 40), rng.randrange(3), 0) for i in range(n)]


def plain(rows):
    """One article after the other: (decisions, titles by story)."""
    owners, story, last, best = defaultdict(set), {}, 0, {}
    for a, title, event, url, *rank in sorted(rows):
        keys = [(1, event)] if event and event != "fire-town" else []
        keys += [(2, title)] if len(title.split()) >= 4 else []
        keys += [(3, url)] if url else []
        found = next(((k[0], next(iter(owners[k]))) for k in keys if len(owners[k]) == 1), None)
        if found is None:
            last += 1
            found = (9, last)
        for k in keys:
            owners[k].add(found[1])
        story[a] = found
        best[found[1]] = max(best.get(found[1], ()), (*rank, len(title), -a, title))
    return story, {s: b[-1] for s, b in best.items()}


def state_of(spark, path):
    store = arrivals.Store(spark, path, 8)
    rows = lambda t: sorted((tuple(r) for r in store.read(t).collect()), key=str)
    return {r.article_id: (r.tier, r.story_id) for r in store.read("decisions").collect()}, {r.story_id: r.title for r in arrivals.canonical_titles(store).collect()}, rows("keys"), rows("timeline")


def test_batches_of_any_size_make_the_same_stories(spark, tmp_path):
    rows = made()
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA).coalesce(1)
    story, titles = plain(rows)
    arrivals.arrive(f"{tmp_path}/one", 8)(frame(rows + [rows[3], (None, "no id at all here", None, None, 0, 0, 0)]), 0)
    written = []
    steps = [rows[:1], rows[1:2], rows[2:25], rows[25:26], rows[26:]]
    count = lambda df, folder: written.append((folder, df.count())) or df.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    for n, part in enumerate(steps):
        arrivals.arrive(f"{tmp_path}/many", 8, count)(frame(part), n)
    one, many = state_of(spark, f"{tmp_path}/one"), state_of(spark, f"{tmp_path}/many")
    assert one == many and one[:2] == (story, titles)
    # what a batch writes follows the batch: one article makes few rows, but where the counter carries over (batch 3)
    assert all(n <= 3 for folder, n in written if folder.endswith(("delta=0", "delta=1")))
    assert sum(n for folder, n in written if folder.endswith("delta=4")) <= 6 * len(steps[4])
    # a batch that is done changes nothing, and rows that come again find their story
    arrivals.arrive(f"{tmp_path}/many", 8)(frame(made(10)), 4)
    assert state_of(spark, f"{tmp_path}/many") == many
    arrivals.arrive(f"{tmp_path}/many", 8)(frame(rows[:2]), 5)
    assert state_of(spark, f"{tmp_path}/many") == many


def test_a_failure_between_writes_leaves_the_state(spark, tmp_path):
    rows = made(24)
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA).coalesce(1)
    path = f"{tmp_path}/s"
    arrivals.arrive(path, 8)(frame(rows[:12]), 0)
    before = state_of(spark, path)
    for stop in (1, 3):
        done = []

        def write(df, folder, stop=stop, done=done):
            if len(done) == stop:
                raise OSError("the disk is gone")
            done.append(folder)
            df.write.mode("overwrite").partitionBy("bucket").parquet(folder)

        with pytest.raises(OSError):
            arrivals.arrive(path, 8, write)(frame(rows[12:]), 1)
        assert state_of(spark, path) == before
    arrivals.arrive(path, 8)(frame(rows[12:]), 1)
    story, titles = plain(rows)
    assert state_of(spark, path)[:2] == (story, titles)


def test_transactions_nest(spark, tmp_path):
    store = arrivals.Store(spark, str(tmp_path), 4)
    rows = spark.createDataFrame([(1, 9, 1)], arrivals.TABLES["decisions"])
    with store.transaction(0):
        with store.transaction(0):
            store.save("decisions", rows)
        assert store.committed() == -1
    assert store.committed() == 0 and store.read("decisions").count() == 1
    with pytest.raises(RuntimeError), store.transaction(1):
        store.save("decisions", rows)
        raise RuntimeError
    with pytest.raises(ValueError, match="transaction"):
        store.save("decisions", rows)
    assert store.committed() == 0 and store.read("decisions").count() == 1
