"""Operators on small tables: order, idempotence, state and streams."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import fixed, scorer, text
from tidewire.operators import fronts, graph, identity, ordered, pairs, ranking
from tidewire.sources import feeds, state
from tidewire.streaming import stories


def test_first_seen_keeps_what_a_fold_keeps(spark):
    rng = random.Random(0)
    rows = [(k % 3, k, rng.choice(["", "a", "b", "c", "d", "e"]), rng.choice(["", "x", "y", "z", "w"])) for k in range(90)]
    want, seen = set(), {}
    for g, k, a, b in sorted(rows, key=lambda r: r[1]):
        s, t = seen.setdefault(g, (set(), set()))
        if (a and a in s) or (b and b in t):
            continue
        s.add(a)
        t.add(b)
        want.add(k)
    for r in (rows, rows[::-1], rng.sample(rows, 90)):
        got = ordered.first_seen(spark.createDataFrame(r, "g long, k long, a string, b string"), "g", "k", ["a", "b"]).collect()
        assert {x.k for x in got} == want


def test_numbers_go_on_without_gaps(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    got = {r.v: r.story_id for r in ordered.sequential_ids(df, ["v"], 5).collect()}
    assert got == {v: f"story_{v + 5:06d}" for v in range(1000)}


def test_components_and_aliases(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (None, 4)], "a long, b long")
    assert {r.id: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    aliases = spark.createDataFrame([(1, 2), (2, 3), (3, 10), (4, 5), (5, 4), (6, 6), (7, 99), (10, 11), (20, 10)], "alias long, target long")
    active = spark.createDataFrame([(11,), (20,)], "id long")
    assert sorted(map(tuple, graph.flatten_aliases(aliases, active).collect())) == [(1, 11), (2, 11), (3, 11), (10, 11)]
    lineage = spark.createDataFrame([(1, 50), (3, 50), (7, 51)], "id long, root long")
    assert {r.id: r.component for r in graph.lineage_safe(e, lineage).collect()} == {1: 1, 2: 1, 7: 7, 8: 7}


def test_similar_sets_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    sets = {i: rng.sample("abcdefghijklmnop", rng.randint(0, 9)) for i in range(60)}
    df = spark.createDataFrame([(i, t) for i, t in sets.items()], "id long, tokens array<string>")
    got = {(r.left_id, r.right_id, r.shared) for r in pairs.similar_sets(df, 3).collect()}
    assert got == {(i, j, len(set(sets[i]) & set(sets[j]))) for i in sets for j in sets if i < j and len(set(sets[i]) & set(sets[j])) >= 3}


def test_repair_is_idempotent(spark):
    rows = [(1, ["storm hits the coast"], ["u1"], 0, 1), (2, ["storm hits the coast"], ["http://x.org/a"], 1, 0), (3, ["other title entirely"], ["http://x.org/a"], 0, 5), (4, ["alone in the world"], [], 0, 0)]
    schema = "story_id long, titles array<string>, urls array<string>, custom int, priority int"
    none = spark.createDataFrame([(9, 3), (8, 77)], "alias long, target long")
    fixed_, flat = identity.repair(spark.createDataFrame(rows, schema), none)
    got = {r.story_id: r for r in fixed_.collect()}
    assert set(got) == {2, 4} and got[2].titles == ["other title entirely", "storm hits the coast"] and got[2].custom == 1 and got[2].priority == 5
    assert sorted(map(tuple, flat.collect())) == [(1, 2), (3, 2), (9, 2)]
    again, flat2 = identity.repair(fixed_, flat)
    assert sorted(map(str, again.collect())) == sorted(map(str, fixed_.collect())) and sorted(flat2.collect()) == sorted(flat.collect())


def test_cascade_takes_no_ambiguous_owner(spark):
    s = spark.createDataFrame([(1, "e1", "a b c d", "u1"), (2, "e1", "e f g h", "u2"), (3, "e3", "short", "u2")], stories.STORIES)
    a = spark.createDataFrame([(10, "e1", "a b c d", ""), (11, "e3", "zz", "u1"), (12, "", "short", "u2"), (13, "", "", "u1")], "article_id long, event_key string, title_key string, url string")
    assert {r.article_id: (r.tier, r.story_id) for r in identity.cascade(a, s).collect()} == {10: (2, 1), 11: (1, 3), 12: (9, None), 13: (3, 1)}


def resolved_by_hand(article, stories):
    """The reference's rules over all stories."""
    tok = lambda v: {x for x in re.findall("[a-z0-9]+", v.lower()) if len(x) >= 3 and x not in fixed.RESOLVER_STOP}
    over = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0

    def category(types, title):
        blob = " ".join(types) + " " + title.lower()
        for name, ws in (("crime", ("crash", "arrest", "shoot")), ("government", ("meeting", "budget", "council")), ("sports", ("baseball", "game")), ("weather", ("storm", "flood")), ("business", ("company", "store"))):
            if any(w in blob for w in ws):
                return name
        return "general"

    best, top = None, 0.0
    kinds = ("facts", "locations", "agencies", "types", "entities")
    for s in stories:
        if s["status"] == "archived":
            continue
        a, b = ({k: {v.lower() for v in x[k]} for k in kinds} for x in (article, s))
        if any(a[k] and b[k] and not a[k] & b[k] for k in ("locations", "agencies")):
            continue
        c, d = category(article["types"], article["title"]), category(s["types"], s["title"])
        if "general" not in (c, d) and c != d:
            continue
        n = {k: over(a[k], b[k]) for k in kinds}
        title = over(tok(article["title"]), tok(s["title"]) | set(s["title_tokens"]))
        event = over(tok(article["event_key"].replace("-", " ")), {t for e in s["events"] for t in tok(e.replace("-", " "))})
        anchors = sum(n[k] > 0 for k in kinds[1:])
        ok = {
            "crime": anchors >= 2 and (n["facts"] > 0 or n["entities"] > 0 or event >= 0.55), "government": (n["agencies"] > 0 or n["entities"] > 0) and (n["facts"] > 0 or title >= 0.45),
            "sports": (n["entities"] > 0 or title >= 0.55) and (n["facts"] > 0 or event >= 0.55), "weather": n["types"] > 0 and (n["locations"] > 0 or n["entities"] > 0),
            "business": n["entities"] > 0 and (n["locations"] > 0 or title >= 0.5), "general": anchors >= 2 and n["facts"] > 0,
        }[c]
        score = 0.88 * (0.25 * n["facts"] + 0.18 * n["locations"] + 0.18 * n["agencies"] + 0.14 * n["types"] + 0.25 * n["entities"]) + 0.07 * title + 0.05 * event
        if ok and round(score, 6) > top:
            best, top = s["id"], round(score, 6)
    return best, top


@pytest.mark.parametrize("least", [0.3, 0.6, 0.78])
def test_resolver_takes_the_reference_evidence(spark, least):
    rng = random.Random(7)
    pool = {"facts": ["3 people killed", "34-year-old"], "locations": ["Ohio", "texas"], "agencies": ["FBI", "EPA"], "types": ["traffic crash", "election", "fire"], "entities": ["John Roe", "Acme Works", "Main Hall"]}
    titles = ["storm hits coast", "company opens store", "council budget meeting", "baseball game won", "crash on road", "bread prize won"]

    def one(i):
        x = {k: rng.sample(v, rng.choice([0, 1, 1, 1, 2])) for k, v in pool.items()}
        key = rng.choice(["fire-ohio", "election-texas", "traffic-crash-x9"])
        return {"id": i, "title": rng.choice(titles), "event_key": key, "events": [key], "title_tokens": rng.choice([[], ["bread"]]), "status": rng.choice(["active", "active", "archived", None]), **x}

    both = [one(i) for i in range(160)]
    schema = "id long, title string, event_key string, events array<string>, title_tokens array<string>, status string, facts array<string>, locations array<string>, agencies array<string>, types array<string>, entities array<string>"
    a, s = (spark.createDataFrame(x, schema) for x in (both[:80], both[80:]))
    got = {r.article_id: (r.story_id, r.score) for r in identity.resolve(a, s, least=least).collect()}
    want = {x["id"]: resolved_by_hand(x, both[80:]) for x in both[:80]}
    want = {i: v for i, v in want.items() if v[1] >= least}
    assert want and got.keys() == want.keys()
    assert all(got[i] == (want[i][0], pytest.approx(want[i][1], abs=2e-6)) for i in want)


def test_agencies_and_names_are_found(spark):
    df = spark.createDataFrame([("EPA and the Justice Department sue Acme Steel Works of Ohio; fed up",)], "t string")
    r = df.select(text.agencies_in(F.col("t")).alias("a"), text.proper_names(F.col("t")).alias("n")).first()
    assert r.a == ["U.S. Department of Justice", "EPA"] and "Acme Steel Works of Ohio" in r.n


def test_deck_spreads_sections(spark):
    rows = [(i, f"h{i}", "us" if i < 8 else f"c{i}", 90 - i if i < 8 else 70, 1.0, i) for i in range(14)]
    df = spark.createDataFrame(rows, "article_id long, headline string, category_key string, score int, age double, position int")
    got = sorted(ranking.greedy_deck(df, 8).collect(), key=lambda r: r.deck_position)
    assert [r.article_id for r in got][:3] == [0, 1, 2] and sum(r.article_id < 8 for r in got) < 8
    assert [r.penalty for r in got][:3] == [0.0, 0.0, 6.0]
    assert ranking.greedy_deck(df.limit(0)).count() == 0


def deck_by_hand(cards, limit):
    """The reference's selection over all cards."""
    chosen, left = [], sorted(cards, key=lambda r: (-r["score"], r["age"], r["position"], r["headline"].lower(), r["article_id"]))
    for place in range(1, min(limit, len(left)) + 1):
        best = next((r for r in left if r["position_locked"] and r["position"] == place), None)
        if best is None:
            scored = []
            for r in left:
                if not r["position_locked"]:
                    n = sum(x["category_key"] == r["category_key"] for x in chosen)
                    cost = 0.0 if n < 2 else 6.0 * (n - 1) if n < 4 else min(24.0, 18.0 + (n - 4) * 3.0)
                    if len(set(r["regions"])) == 1:
                        cost += min(8.0, max(0, sum(r["regions"][0] in x["regions"] for x in chosen) - 3) * 2.0)
                    scored.append((cost - r["score"], -r["score"], r["age"], r["position"], r["headline"].lower(), r["article_id"], r))
            if not scored:
                break
            best = min(scored, key=lambda x: x[:-1])[-1]
        chosen.append(best)
        left.remove(best)
    deck = [r for r in chosen if not r["pin_position"]]
    for r in sorted((r for r in chosen if r["pin_position"]), key=lambda r: r["pin_position"]):
        deck.insert(min(max(1, r["pin_position"]) - 1, len(deck)), r)
    return [r["article_id"] for r in deck]


def test_deck_keeps_regions_locks_and_pins(spark):
    schema = "article_id long, headline string, category_key string, score int, age double, position int, regions array<string>, position_locked boolean, pin_position int"
    # one category and state: the 13th card, of another state, comes in by the region's penalty
    same = [(i, f"h{i}", f"c{i % 2}", 90, 1.0, i + 1, ["ohio"], False, None) for i in range(26)] + [(90, "z", "c0", 88, 9.0, 90, ["iowa"], False, None)]
    rng, runs = random.Random(3), [same]
    for _ in range(3):
        runs.append([(i, f"h{i}", rng.choice("abc"), rng.randint(70, 90), float(rng.randint(1, 5)), i + 1, rng.sample(["ohio", "iowa", "utah"], rng.choice([0, 1, 1, 1, 2])), rng.random() < 0.1, rng.choice([None] * 8 + [1, 4])) for i in range(80)])
    for rows in runs:
        df = spark.createDataFrame(rows, schema)
        got = [r.article_id for r in sorted(ranking.greedy_deck(df, 12).collect(), key=lambda r: r.deck_position)]
        assert got == deck_by_hand([r.asDict() for r in df.collect()], 12)
    assert 90 in [r.article_id for r in ranking.greedy_deck(spark.createDataFrame(same, schema), 12).collect()]


def test_backfill_skips_likeness(spark):
    t = lambda s: s.split()
    rows = [("us", 1, 1, t("storm hits gulf coast town"), "u"), ("us", 2, 2, t("storm hits gulf coast city"), ""), ("us", 3, 3, t("bank cuts rates"), ""), ("us", 4, 4, t("bank fails"), "u")]
    got = fronts.backfill(spark.createDataFrame(rows, "section string, pos long, article_id long, tokens array<string>, url string"), 6).collect()
    assert sorted((r.article_id, r.slot, r.urgency) for r in got) == [(1, 1, 7), (3, 2, 7)]


def test_snapshots_count_when_complete(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "id long, v string, extra int"
    assert state.read_snapshot(spark, path, schema).count() == 0
    assert state.write_snapshot(spark.createDataFrame([(1, "a")], "id long, v string"), path) == 1
    base = state.read_snapshot(spark, path, schema)
    assert base.collect() == [(1, "a", None)]
    assert state.write_snapshot(state.merge(base, spark.createDataFrame([(1, "b", 2), (3, "c", 4)], schema), "id"), path) == 2
    assert sorted(map(tuple, state.read_snapshot(spark, path, schema).collect())) == [(1, "b", 2), (3, "c", 4)]
    os.remove(os.path.join(path, "v=2", "_SUCCESS"))
    assert state.read_snapshot(spark, path, schema).collect() == [(1, "a", None)]
    bad = spark.createDataFrame([(1,)], "why long")
    two, manifest = str(tmp_path / "t"), str(tmp_path / "m")
    with pytest.raises(ValueError):
        state.commit_all({path: base, two: base}, [bad], manifest)
    broken = base.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        state.commit_all({path: base, two: broken}, [bad.limit(0)], manifest)  # the first table is written, none is named
    assert state.read_committed(spark, path, schema, manifest).count() == state.read_committed(spark, two, schema, manifest).count() == 0
    assert state.commit_all({path: base, two: base}, [bad.limit(0)], manifest) == 1
    with pytest.raises(Exception, match="lost"):
        state.commit_all({path: base.limit(0), two: broken}, [], manifest)
    assert state.read_committed(spark, path, schema, manifest).collect() == state.read_committed(spark, two, schema, manifest).collect() == [(1, "a", None)]
    assert state.commit_all({path: base.limit(0)}, [], manifest) == 2
    assert state.read_committed(spark, path, schema, manifest).count() == 0 and state.read_committed(spark, two, schema, manifest).count() == 1


def test_a_cluster_names_its_checkpoint_folder(spark):
    from types import SimpleNamespace

    from tidewire.operators import checkpoints

    bare = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://x:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        checkpoints.cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=bare)))


def test_cache_and_journal(spark, tmp_path):
    rows = [("b", f"k{i}", f"2026-01-0{i + 1} 00:00:00", "2026-01-05 12:00:00" if i % 2 else None, f"v{i}") for i in range(8)]
    cache = spark.createDataFrame(rows, "bucket string, key string, cached_at string, expires_at string, value string").withColumns({c: F.col(c).cast("timestamp") for c in ("cached_at", "expires_at")})
    assert {r.key for r in state.prune_cache(cache, {"b": 3}).collect()} == {"k5", "k6", "k7"}
    assert state.prune_cache(cache, {"z": 3}).count() == 8
    unnamed = cache.limit(2).withColumn("bucket", F.lit(None).cast("string"))
    assert state.prune_cache(cache.unionByName(unnamed), {"b": 3}).count() == 5
    keys = spark.createDataFrame([("b", "k0"), ("b", "k1"), ("b", "nope")], "bucket string, key string")
    assert {r.key: (r.outcome, r.value) for r in state.get_live(cache, keys, "2026-01-09").collect()} == {"k0": ("hit", "v0"), "k1": ("expired", None), "nope": ("miss", None)}
    path = str(tmp_path / "j")
    for n in (1, 2):
        state.append_journal(spark.createDataFrame([(n, "x"), (9, "y")], "at long, what string"), path)
    assert sorted(r.at for r in state.replay_journal(spark, path, "at").collect()) == [1, 2, 9]


def test_feeds(spark, tmp_path):
    good = '<rss><channel><item><title>A &amp; B</title><link>https://x.org/n/1</link><description>&lt;p&gt;short&lt;/p&gt;</description><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><enclosure url="https://x.org/i.jpg" width="640"/></item><item><title>No link</title><description>d</description></item></channel></rss>'
    (tmp_path / "a.xml").write_text(good)
    (tmp_path / "b.xml").write_text("<rss><channel><item><title>broken")
    e = feeds.entries(feeds.read_feeds(spark, str(tmp_path)))
    (row,) = feeds.complete(e).collect()
    assert (row.title, row.link, row.body, row.domain, row.image_url) == ("A & B", "https://x.org/n/1", "short", "x.org", "https://x.org/i.jpg")
    assert row.article_id.startswith("rss-") and str(row.published) == "2026-01-05 10:00:00"
    assert [r.missing for r in feeds.rejects(e).collect()] == ["link"]


def test_feeds_keep_what_is_whole(spark, tmp_path):
    item = "<item><title>T{}</title><link>https://x.org/n/{}</link><description>d</description></item>"
    # the cut falls within the third entry, or within a letter of two bytes
    head = "<rss><channel>" + item.format(0, 0) + item.format(1, 1)
    (tmp_path / "a.xml").write_text(head + "<item><title>" + "é" * feeds.FEED_BYTES + "</title></item>" + item.format(3, 3) + "</channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel>" + item.format(0, 0) + "<item><title>bad & <b></title></item>" + '<item\nrdf:about="u">' + "<title>third</title></item >" + "</channel></rss>")
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text("<itemize><title>no entry</title></itemize>")
    got = [(r.feed[-5:], r.pos, r.title) for r in feeds.read_feeds(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a.xml", 0, "T0"), ("a.xml", 1, "T1"), ("b.xml", 0, "T0"), ("b.xml", 2, "third")]


def test_scorer_answers_are_checked(spark):
    rows = spark.createDataFrame([(1, "senate vote"), (2, "nothing"), (3, "x")], "id long, text string")
    wild = lambda r: r.select("id", F.when(F.col("id") == 3, F.lit("made-up")).otherwise(scorer.keyword_label(F.col("text"))).alias("label")).where("id <> 2")
    assert {r.id: r.label for r in scorer.classify(rows, wild, ["politics"]).collect()} == {1: "politics", 2: "hold", 3: "hold"}
    assert {r.label for r in scorer.classify(rows, scorer.keyword_scorer, ["politics"]).collect()} == {"politics", "none"}


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "stories")
    schema = "article_id long, ts timestamp, event_key string, headline string, url string, event_type string"
    ts = lambda d: F.lit(f"2026-01-{d:02d}").cast("timestamp")

    def land(n, rows):
        spark.createDataFrame(rows, "article_id long, day int, event_key string, headline string, url string").select("article_id", F.make_timestamp(F.lit(2026), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("ts"), "event_key", "headline", "url", F.lit("e").alias("event_type")).coalesce(1).write.mode("append").parquet(f"{source}/n={n}")

    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    land(1, [(1, 1, "k1", "Storm hits the coast", "https://x.org/a/1"), (2, 1, "k1", "Other words here now", "https://x.org/a/2"), (3, 1, "", "Lonely", "")])

    def go():
        q = stream().writeStream.foreachBatch(stories.resolve_into(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    land(2, [(4, 2, "", "Storm hits the coast", ""), (5, 2, "", "Fresh", "https://x.org/a/2#x"), (6, 2, "k9", "New", "")])
    go()
    got = {r.article_id: r.story_id for r in spark.read.parquet(f"{out}/resolved").collect()}
    assert got[1] == got[2] == got[4] == got[5] and len({got[1], got[3], got[6]}) == 3
    stories.resolve_into(out)(spark.read.schema(schema).parquet(f"{source}/n=1"), 0)  # a batch that runs again
    assert {r.article_id: r.story_id for r in spark.read.parquet(f"{out}/resolved").collect()} == got

    land(3, [(7, 3, "", "x", "https://x.org/a/1?utm_source=z"), (8, 20, "", "x", "https://x.org/z/1")])
    q = stories.new_urls(stream()).writeStream.format("memory").queryName("urls").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.identity_url for r in spark.table("urls").collect()) == ["https://x.org/a/1", "https://x.org/a/2", "https://x.org/z/1"]
    q = stories.counts(stream()).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "e")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {str(r.start)[:10]: r.n for r in spark.table("days").collect()}["2026-01-01"] == 3


def test_a_batch_that_failed_midway_keeps_its_stories(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "stories")
    batch = spark.createDataFrame([(1, "k1", "Storm hits the coast", "https://x.org/a/1")], "article_id long, event_key string, headline string, url string")
    whole = state.write_snapshot
    monkeypatch.setattr(state, "write_snapshot", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stories.resolve_into(out)(batch, 0)
    monkeypatch.setattr(state, "write_snapshot", whole)
    for _ in range(2):
        stories.resolve_into(out)(batch, 0)
    later = batch.withColumn("article_id", F.lit(2).cast("long"))
    stories.resolve_into(out)(later, 1)
    got = {r.article_id: r.story_id for r in spark.read.parquet(f"{out}/resolved").collect()}
    assert got[1] == got[2] and state.read_snapshot(spark, f"{out}/stories", stories.STORIES).count() == 1
