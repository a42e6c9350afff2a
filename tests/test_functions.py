"""Functions on hand-made values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewire.functions import pages, scorer, text, times, urls
from tidewire.operators import fronts, gate, identity, ranking


@pytest.fixture
def one(spark):
    def run(value, fn):
        return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y

    return run


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (text.title_tokens, "The Senate votes on a new bill after the Senate debate", ["senate", "votes", "bill", "debate"]),
        (text.headline_tokens, "Two killed as crashes close St. Johns road, 3-4 hurt", ["two", "death", "crash", "close", "st", "johns", "road", "3", "4", "hurt"]),
        (text.timeline_tokens, "Counties passing rates", ["county", "pass", "rate"]),
        (text.signature_tokens, "Court (rules) on the new Tariffs.", ["court", "rules", "tariffs"]),
        (text.source_title_tokens, "Storm hits coast - Daily Planet News", ["storm", "hits", "coast"]),
        (text.slug, " A Storm's End! ", "a-storm-s-end"),
        (text.headline_key, "Mets  win -- 4:3", "mets win 4 3"),
        (text.word_count, "it’s a well-known café — 3.5", 6),
        (text.percent_claims, "up 4.50% and 10 %, 4.5%", ["1", "4.5"]),
        (text.money_claims, "$2.5 billion, 3m, $1,200 and $75 million", [1200, 3_000_000, 75_000_000, 2_500_000_000]),
        (text.measure_claims, "Proposition 12 and House Bill HB-7", ["house bill hb-7", "proposition 12"]),
        (text.states_in, "From New York to West Virginia", ["new york", "virginia", "west virginia"]),
        (text.fatality_count, "death toll rises; 3 people killed, death toll of 12", 12),
        (text.event_types, "Judge blocks law after shooting", ["court ruling", "shooting"]),
        (text.quantified_facts, "Three people were killed and a 40-year-old arrested", ["3 people killed", "40-year-old"]),
        (text.relevance_scope, "Software award in Ohio", "us_state_regional"),
        (text.relevance_scope, "War games", "global_major_only"),
        (text.relevance_scope, "Congress meets", "us_national"),
        (text.relevance_scope, "Canada sanctions ship", "global_major"),
        (text.title_tokens, None, []),
        (text.word_count, None, 0),
        (urls.domain, "https://WWW.Example.com:8080/x", "example.com"),
        (urls.cache_url, "HTTP://Ex.com//a//b/?utm_source=x&b=2&a&ref=y#top", "http://ex.com/a/b/?b=2&a="),
        (urls.identity_url, "https://Ex.com:443/a//b/?z=1&utm_id=4&b=2#x", "https://ex.com/a/b?b=2&utm_id=4&z=1"),
        (urls.identity_url, "https://ex.com/feed/item", ""),
        (urls.identity_url, "https://ex.com/news/story-1?oc=5&x=1", "https://ex.com/news/story-1?x=1"),
        (urls.identity_url, "https://ex.com/news/story-1?x=1&output=amp", "https://ex.com/news/story-1?x=1"),
        (urls.identity_url, "https://ex.com/news/story-1?utm_id=9&UTM_Source=a&utm_term=b&utm_medium=c&utm_campaign=d&utm_content=e", "https://ex.com/news/story-1?utm_id=9"),
        (urls.identity_url, "https://ex.com/news/story-1?fbclid=1&gclid=2&mc_cid=3&mc_eid=4&ocid=5", "https://ex.com/news/story-1?ocid=5"),
        (urls.cache_url, "https://ex.com/a?oc=5&ocid=1&output=2&utm_id=3&ref=4", "https://ex.com/a?oc=5&output=2"),
        (urls.ranking_url, "https://ex.com/a?oc=5&ocid=1&output=2&utm_id=3&ref=4", "https://ex.com/a?ocid=1&output=2&ref=4"),
        (urls.identity_url, "https://ex.com/one", ""),
        (urls.identity_url, "ftp://ex.com/a/b", ""),
        (urls.archive_url, " HTTPS://Ex.com/A/?q=1 ", "https://ex.com/a/"),
        (urls.cache_url, None, ""),
        (pages.title, "<html><title> A &amp; B </title>", "A & B"),
        (pages.body, "<p>x</p><script>var t='</p>';</script><p>y &lt;z&gt;</p>", "x y <z>"),
        (identity.event_family, "Road rage arrest", "road_rage"),
        (scorer.keyword_label, "Senate race tightens", "politics"),
        (gate.tolerant_json, 'Sure: ```json {"a": 1} ``` ok', '{"a": 1}'),
    ],
)
def test_value(one, fn, value, want):
    assert one(value, fn) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2026-01-05T10:00:00Z", "2026-01-05 10:00:00"), ("Mon, 5 Jan 2026 12:00:00 +0200", "2026-01-05 10:00:00"), ("Mon, 05 Jan 2026 10:00:00 GMT", "2026-01-05 10:00:00"), ("2026-01-05", "2026-01-05 00:00:00"), ("11:00", None), ("", None), (None, None), ("2026-13-45", None)],
)
def test_times(one, raw, want):
    assert one(raw, lambda c: F.date_format(times.parsed(c), "yyyy-MM-dd HH:mm:ss")) == want


@pytest.mark.parametrize("n", [2, 7, 97])
def test_hash_mod_is_the_number_modulo_n(one, n):
    for t in ("", "a", "headline"):
        assert one(t, lambda c: text.hash_mod(F.sha2(c, 256), n)) == int(hashlib.sha256(t.encode()).hexdigest(), 16) % n


def test_tiers_rank_consequence_over_commentary(spark):
    rows = [("us", "Congress passes budget bill", 5), ("us", "Congress might pass a budget, analysis", 1), ("sports", "Congress passes budget bill", 0), ("us", "NBA playoff game tonight", 0), ("us", "Supreme Court rules out a quick hearing", 2), ("us", "Federal court ruled on maps", 5), ("world", "Missile strikes hit port", 4), ("business", "Tesla wins as White House approves export license", 3)]
    got = spark.createDataFrame(rows, "c string, h string, want int").select(fronts.tier(F.col("c"), F.col("h"))["tier"].alias("t"), "want", "h").collect()
    assert [(r.h, r.t) for r in got] == [(r.h, r.want) for r in got]


def test_scores(spark):
    r = spark.range(1).select(
        ranking.editorial_score(F.lit(90), F.lit(100), F.lit(80), F.lit(2.0)).alias("a"), ranking.editorial_score(F.lit(90), F.lit(100), F.lit(80), F.lit(None).cast("double")).alias("b"),
        ranking.freshness_score(F.lit(30.0)).alias("c"), ranking.eligibility(F.lit("Road closed"), F.lit(30.0), F.lit(3), F.lit("us")).alias("d"), ranking.eligibility(F.lit("x"), F.lit(50.0), F.lit(8), F.lit("us")).alias("e"),
        ranking.lifecycle(F.lit(800.0), F.lit("found safe"), F.lit("breaking"), F.lit(2)).alias("f"), ranking.lifecycle(F.lit(3.0), F.lit("x"), F.lit("breaking"), F.lit(1)).alias("g"),
    ).first()
    assert tuple(r) == (98, 78, 50.0, "expired_transient_story", "high_urgency_extended_window", "archived", "breaking")


def test_a_missing_or_broken_response_holds(spark):
    rows = [(None, ["a"]), ("not json", ["a"]), ('{"same_real_world_event": false, "confidence": 0.9}', []), ('{"same_real_world_event": true, "selected_candidate_slug": "a", "confidence": 0.9}', ["a"]), ('{"same_real_world_event": true, "selected_candidate_slug": "b", "confidence": 0.99}', ["a"])]
    got = gate.validated(spark.createDataFrame(rows, "response string, slugs array<string>"), "response", "slugs").collect()
    assert [r.action for r in got] == ["hold", "hold", "new_story", "duplicate_use_existing_canonical", "hold"]


def test_actions(spark):
    t, f = F.lit(True), F.lit(False)
    r = spark.range(1).select(*[gate.editorial_action(*a).alias(str(i)) for i, a in enumerate([(f, t, t, t, F.lit("update")), (t, f, f, f, F.lit("update")), (t, t, t, f, F.lit("no_change")), (t, t, f, f, F.lit("no_change")), (t, t, f, f, F.lit("correction"))])]).first()
    assert tuple(r) == ("hold_for_review", "publish_new", "replace_canonical", "ignore", "update_existing")
