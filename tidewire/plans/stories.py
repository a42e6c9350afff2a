"""Queries over events and articles as stories: state, decisions, ranking and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators import gate, graph, ordered, ranking
from tidewire.operators.pairs import distinct_sets, joined_sets
from tidewire.plans import articles as articles_plan
from tidewire.sources.views import ARTICLES_SQL, REFERENCE, articles, table

#: The reference time of queries over events.
EVENTS_REFERENCE = "2024-01-31 00:00:00"


# -- canonical articles, timelines and state ---------------------------------------------


def canonical_per_event(spark, sf_dir):
    """The canonical row of each event (custom first, then earliest, then largest id) and how many support it."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("event_key"), (F.col("value") > 40).alias("is_custom"))
    rank = F.struct(F.col("is_custom").cast("int"), -F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))
    return e.groupBy("event_key").agg(F.max_by("event_id", rank).alias("canonical_id"), F.max("is_custom").alias("is_custom"), (F.count(F.lit(1)) - 1).alias("n_supporting"))


CANONICAL_SQL = """WITH e AS (SELECT event_id, ts, event_type || '-' || user_id AS event_key, value > 40 AS is_custom FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY is_custom DESC, ts, event_id DESC) AS rn, count(*) OVER (PARTITION BY event_key) AS n FROM e)
SELECT event_key, event_id AS canonical_id, is_custom, n - 1 AS n_supporting FROM r WHERE rn = 1"""


def lifecycle_changes(spark, sf_dir):
    """Where the kind of a user's events changes, with the kind before."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("state"))
    return ordered.change_log(e, "user_id", ["ts", "event_id"], "state").select("event_id", "user_id", "previous", "state")


CHANGES_SQL = """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, user_id, previous, event_type AS state FROM e WHERE previous <> event_type"""


def milestones_seen(spark, sf_dir):
    """For each event of a user, how many kinds the user's earlier events had and whether this one is new."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.collect_set("event_type").over(before)
    return e.select("event_id", F.size(known).cast("long").alias("n_known"), (~F.array_contains(known, F.col("event_type"))).alias("is_new"))


MILESTONES_SQL = """WITH e AS (SELECT event_id, event_type, list_distinct(coalesce(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS k FROM events)
SELECT event_id, len(k) AS n_known, NOT list_contains(k, event_type) AS is_new FROM e"""


def timeline_greedy(spark, sf_dir):
    """Timelines in which an article and an event key occur once each, first come first kept."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("story_id"), F.struct("ts", "event_id").alias("at"), F.col("event_id"), F.concat(F.lit("a"), (F.col("event_id") % 17).cast("string")).alias("article_id"), F.concat(F.lit("k"), F.floor(F.col("value")).cast("string")).alias("event_key"))
    kept = ordered.first_seen(e.select("story_id", "event_id", F.date_format("at.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("order_key"), "article_id", "event_key"), "story_id", "order_key", ["article_id", "event_key"])
    return kept.select("story_id", "event_id", "article_id", "event_key")


def live_cache(spark, sf_dir):
    """The newest entry of each bucket and key that hasn't expired; time to live is an hour for each unit of value."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value", "props")
    newest = ordered.first_by(e, ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")])
    expires = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("value") * 3600 * 1e6).cast("long"))
    return newest.where(expires > F.lit(EVENTS_REFERENCE).cast("timestamp")).select(F.col("event_type").alias("bucket"), F.col("user_id").alias("key"), F.col("props").alias("value"))


LIVE_CACHE_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_type AS bucket, user_id AS key, props AS value FROM r
WHERE rn = 1 AND epoch_us(ts) + CAST(trunc(value * 3600 * 1e6) AS BIGINT) > epoch_us(TIMESTAMP '{EVENTS_REFERENCE}')"""


def cache_prune(spark, sf_dir):
    """The newest entries of each bucket, up to its limit: 140 for errors, 300 else."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    limit = F.when(F.col("event_type") == "error", fixed.CACHE_LIMITS["categories"]).otherwise(fixed.CACHE_LIMITS["material_updates"])
    top = ordered.first_by(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], fixed.CACHE_LIMITS["material_updates"], rank="rank")
    return top.where(F.col("rank") <= limit).select("event_id", F.col("event_type").alias("bucket"), F.col("rank").cast("int").alias("rank"))


PRUNE_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events)
SELECT event_id, event_type AS bucket, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE WHEN event_type = 'error' THEN 140 ELSE 300 END"""


def history_compaction(spark, sf_dir):
    """The 8 newest distinct payloads of each user, each at its newest place."""
    e = table(spark, sf_dir, "events").select("user_id", "props", F.col("event_id").alias("pos"))
    return ordered.compact(e, "user_id", "props", "pos", 8).select("user_id", "props", "pos")


COMPACTION_SQL = """WITH d AS (SELECT user_id, props, max(event_id) AS pos FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS rn FROM d) SELECT user_id, props, pos FROM r WHERE rn <= 8"""


def journal_replay(spark, sf_dir):
    """The journal without repeated observations, by fingerprint, each at its first place."""
    e = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), "props"), 256).alias("fingerprint"))
    return e.groupBy("fingerprint").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("observations"))


JOURNAL_SQL = "SELECT sha256(event_type || '|' || user_id || '|' || props) AS fingerprint, min(event_id) AS first_event, count(*) AS observations FROM events GROUP BY 1"

#: Prices in dollars per million tokens: input, output. A model without one isn't priced.
PRICES = {"view": (2.0, 10.0), "click": (3.0, 15.0), "purchase": (5.0, 25.0)}


def usage_report(spark, sf_dir):
    """Requests, tokens and cost in total, by model and by call site."""
    price = F.create_map(*[x for k, (a, b) in PRICES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("i"), F.lit(b).alias("o")))])
    e = table(spark, sf_dir, "events")
    tokens = F.get_json_object("props", "$.k").cast("long")
    p = F.element_at(price, F.col("event_type"))
    e = e.select(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("string").alias("callsite"), (tokens * 100).alias("tin"), tokens.alias("tout"), p.alias("p"))
    cost = F.bround(F.bround(F.col("tin") * F.col("p.i") / 1e6, 6) + F.bround(F.col("tout") * F.col("p.o") / 1e6, 6), 6)
    e = e.withColumn("cost", cost)
    out = e.groupingSets([[], ["model"], ["callsite"]], "model", "callsite").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("requests"), F.sum("tin").alias("input_tokens"), F.sum("tout").alias("output_tokens"), F.bround(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced")
    )
    return out.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, F.concat(F.lit("model:"), "model")).otherwise(F.concat(F.lit("callsite:"), "callsite")).alias("scope"), "requests", "input_tokens", "output_tokens", "cost", "unpriced")


_PRICES_SQL = "(VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in PRICES.items()) + ") AS p(m, i, o)"
USAGE_SQL = f"""WITH e AS (SELECT event_type AS model, CAST(user_id % 5 AS VARCHAR) AS callsite, CAST(props ->> '$.k' AS BIGINT) AS t FROM events),
c AS (SELECT e.*, round_even(round_even(t * 100 * i / 1e6, 6) + round_even(t * o / 1e6, 6), 6) AS cost FROM e LEFT JOIN {_PRICES_SQL} ON p.m = e.model)
SELECT CASE WHEN grouping(model) = 1 AND grouping(callsite) = 1 THEN 'total' WHEN grouping(model) = 0 THEN 'model:' || model ELSE 'callsite:' || callsite END AS scope,
  count(*) AS requests, CAST(sum(t * 100) AS BIGINT) AS input_tokens, CAST(sum(t) AS BIGINT) AS output_tokens, round_even(coalesce(sum(cost), 0), 4) AS cost, count(*) FILTER (cost IS NULL) AS unpriced
FROM c GROUP BY GROUPING SETS ((), (model), (callsite))"""


# -- decisions ---------------------------------------------------------------------------


def gate_validation(spark, sf_dir):
    """Model responses made from events, validated: action, status, errors."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    yes = lambda c: F.when(c, "true").otherwise("false")
    response = F.concat(
        F.when(k % 5 == 0, "Here it is: ```json ").otherwise(""), F.lit('{"selected_candidate_slug": "s'), (k % 4).cast("string"), F.lit('", "same_real_world_event": '), yes(k % 3 == 0),
        F.lit(', "material_new_update": '), yes(k % 2 == 0), F.lit(', "independently_newsworthy_followup": '), yes(k % 7 == 0), F.lit(', "confidence": '), F.format_string("%.2f", (k % 50 + 50) / 100),
        F.lit(', "recommended_action": "'), F.element_at(F.array(*[F.lit(x) for x in (gate.UPDATE, gate.DUPLICATE, gate.NEW, gate.HOLD, "", "merge")]), k % 6 + 1), F.lit('", "novel_facts": ['), F.when(k % 4 == 0, '"a"').otherwise(""), F.lit("]}"), F.when(k % 5 == 0, " ``` done").otherwise(""),
    )
    slugs = F.array(F.lit("s0"), F.lit("s1"), F.lit("s2"))
    return gate.validated(e.select("event_id", response.alias("response"), slugs.alias("slugs")), "response", "slugs").drop("response", "slugs")


GATE_SQL = f"""WITH e AS (SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events),
d AS (SELECT event_id, k % 4 < 3 AS known, k % 3 = 0 AS same, k % 2 = 0 AS mat0, k % 7 = 0 AS follow, CAST(printf('%.2f', (k % 50 + 50) / 100) AS DOUBLE) AS conf, k % 4 = 0 AS facts,
  ['{gate.UPDATE}', '{gate.DUPLICATE}', '{gate.NEW}', '{gate.HOLD}', '', 'merge'][k % 6 + 1] AS asked FROM e),
q AS (SELECT *, CASE WHEN asked <> '' THEN asked WHEN same AND known THEN CASE WHEN mat0 THEN '{gate.UPDATE}' ELSE '{gate.DUPLICATE}' END WHEN NOT same AND conf >= 0.65 THEN '{gate.NEW}' ELSE '' END AS req FROM d),
m AS (SELECT *, same AND known AND req = '{gate.UPDATE}' AND NOT mat0 AND facts AS lifted FROM q), n AS (SELECT *, mat0 OR lifted AS mat FROM m),
x AS (SELECT *, list_filter([CASE WHEN req NOT IN ('{gate.DUPLICATE}', '{gate.UPDATE}', '{gate.NEW}', '{gate.HOLD}') THEN 'unknown_recommended_action' END,
  CASE WHEN same AND req = '{gate.UPDATE}' AND NOT mat THEN 'update_action_without_material_evidence' END, CASE WHEN same AND NOT known THEN 'same_event_without_valid_candidate' END,
  CASE WHEN NOT same AND req IN ('{gate.DUPLICATE}', '{gate.UPDATE}') THEN 'same_event_action_without_same_event' END, CASE WHEN same AND conf < 0.82 THEN 'same_event_confidence_below_threshold' END], lambda v: v IS NOT NULL) AS er FROM n)
SELECT event_id, CASE WHEN len(er) > 0 THEN '{gate.HOLD}' WHEN same AND follow AND req = '{gate.NEW}' AND mat THEN '{gate.NEW}' WHEN same THEN CASE WHEN mat THEN '{gate.UPDATE}' ELSE '{gate.DUPLICATE}' END
  WHEN req = '{gate.HOLD}' OR conf < 0.65 THEN '{gate.HOLD}' ELSE '{gate.NEW}' END AS action, CASE WHEN len(er) = 0 THEN 'validated' ELSE 'invalid_model_response' END AS status, conf AS confidence,
  array_to_string(er, ',') AS errors, lifted OR (asked = '' AND req <> '') AS repaired FROM x"""


def decisions(spark, sf_dir):
    """Update class and editorial action of each article against the one ten before it."""
    a = articles(spark, sf_dir)
    t = a.select("article_id", text.event_types(F.col("headline")).alias("facts"), "urgency", (F.col("article_id") % 9 == 0).alias("custom"))
    old = t.select((F.col("article_id") + 10).alias("article_id"), F.col("facts").alias("known"), F.col("custom").alias("old_custom"), F.col("urgency").alias("old_urgency"))
    j = t.join(old, "article_id", "left")
    fresh = F.array_except("facts", F.coalesce("known", F.array().cast("array<string>")))
    cls = gate.update_class(F.col("article_id") % 23 == 0, F.col("urgency") >= 10, fresh, F.coalesce(F.col("old_urgency") % 2 != F.col("urgency") % 2, F.lit(True)))
    exists = F.col("known").isNotNull()
    return j.select("article_id", cls.alias("update_class"), gate.editorial_action(F.col("article_id") % 29 != 0, exists, F.col("custom"), F.coalesce("old_custom", F.lit(False)), cls).alias("action"), F.array_join(fresh, ",").alias("new_facts"))


DECISIONS_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id, urgency, article_id % 9 = 0 AS custom, list_filter([{articles_plan._TYPES.replace('low', 'lower(headline)')}], lambda x: x IS NOT NULL) AS facts FROM articles),
j AS (SELECT n.*, o.facts AS known, o.custom AS oc, o.urgency AS ou, list_filter(n.facts, lambda x: NOT list_contains(coalesce(o.facts, []), x)) AS fresh FROM t n LEFT JOIN t o ON o.article_id + 10 = n.article_id),
c AS (SELECT *, CASE WHEN article_id % 23 = 0 THEN 'correction' WHEN urgency >= 10 THEN 'major_update' WHEN len(fresh) > 0 OR coalesce(ou % 2 <> urgency % 2, true) THEN 'update' ELSE 'no_change' END AS u FROM j)
SELECT article_id, u AS update_class, CASE WHEN article_id % 29 = 0 THEN 'hold_for_review' WHEN known IS NULL THEN 'publish_new' WHEN custom AND NOT coalesce(oc, false) THEN 'replace_canonical' WHEN u = 'no_change' THEN 'ignore' ELSE 'update_existing' END AS action, array_to_string(fresh, ',') AS new_facts FROM c"""


# -- ranking -----------------------------------------------------------------------------


def _cards(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("scope", text.relevance_scope(F.col("headline")))
    scope = F.col("scope")
    trust = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 80).otherwise(40)).alias("trust")).withColumnRenamed("doc_id", "article_id")
    t = a.join(trust, "article_id", "left").select(
        "article_id", "headline", "category_key", "urgency", F.coalesce("trust", F.lit(50)).alias("trust"), F.when(F.col("article_id") % 13 != 0, ranking.age_hours(F.col("published_at"), REFERENCE)).alias("age"),
        text.importance_score(text.importance_reasons(F.col("headline"), text.scope_name(scope), F.lit(1), F.lit(0))).alias("importance"), text.scope_score(scope).alias("proximity"),
    )
    c = F.col
    return t.select("*", ranking.deck_score(c("importance"), c("age"), c("urgency"), ranking.category_relevance(c("category_key")), c("trust")).alias("score"), ranking.eligibility(c("headline"), c("age"), c("urgency"), c("category_key")).alias("reason"), F.row_number().over(Window.partitionBy("category_key").orderBy("article_id")).alias("position"))


def card_scores(spark, sf_dir):
    """Editorial score, deck score, eligibility and lifecycle state of every article."""
    c = F.col
    t = _cards(spark, sf_dir)
    return t.select("article_id", ranking.editorial_score(c("importance"), c("proximity"), c("trust"), c("age")).alias("editorial_score"), c("score").alias("deck_score"), "reason", c("reason").isin(*ranking.ELIGIBLE).alias("eligible"), ranking.lifecycle(c("age"), c("headline"), text.importance_level(c("importance")), (c("article_id") % 3).cast("int")).alias("state"))


_LEVEL = "CASE WHEN importance >= 80 THEN 'breaking' WHEN importance >= 55 THEN 'high' WHEN importance >= 25 THEN 'normal' ELSE 'low' END"
_CATS = "CASE category_key " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CATEGORY_RELEVANCE.items()) + f" ELSE {fixed.OTHER_RELEVANCE} END"
_IMPORTANCE_BODY = articles_plan.IMPORTANCE_SQL.split(f"WITH {ARTICLES_SQL}, ", 1)[1]
CARDS_SQL = f"""{ARTICLES_SQL}, imp AS (WITH {_IMPORTANCE_BODY}),
scp AS (SELECT article_id, {articles_plan._SCOPE_POINTS} AS proximity FROM {articles_plan._SCOPE_SQL}),
tr AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 80 ELSE 40 END) AS trust FROM labels GROUP BY 1),
c0 AS (SELECT a.article_id, a.headline, a.category_key, a.urgency, coalesce(tr.trust, 50) AS trust, imp.score AS importance, scp.proximity,
  CASE WHEN a.article_id % 13 <> 0 THEN greatest(0, (epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(a.published_at)) / 3.6e9) END AS age
  FROM articles a JOIN imp USING (article_id) JOIN scp USING (article_id) LEFT JOIN tr ON tr.doc_id = a.article_id),
c1 AS (SELECT *, CASE WHEN age IS NULL THEN 20.0 ELSE round_even(greatest(0, 100 * (1 - least(age, 60) / 60)), 2) END AS fresh,
  CASE WHEN age IS NULL THEN 0.80 WHEN age <= 6 THEN 1.0 WHEN age <= 24 THEN 0.95 WHEN age <= 72 THEN 0.85 WHEN age <= 168 THEN 0.70 ELSE 0.55 END AS mult FROM c0),
cards AS (SELECT *, greatest(0, least(100, CAST(round_even(CAST(0.34 AS DOUBLE) * importance + CAST(0.24 AS DOUBLE) * fresh + CAST(0.22 AS DOUBLE) * (urgency * 10) + CAST(0.12 AS DOUBLE) * {_CATS} + CAST(0.08 AS DOUBLE) * trust, 0) AS INTEGER))) AS score,
  CASE WHEN age IS NULL AND urgency >= 8 THEN 'undated_high_urgency' WHEN age IS NULL THEN 'undated' WHEN age > 60 THEN 'older_than_60_hours'
    WHEN {articles_plan._any('lower(headline)', fixed.TRANSIENT)} AND age > 24 THEN 'expired_transient_story' WHEN category_key = 'sports' AND age > 24 AND urgency < 9 THEN 'routine_sports_older_than_24_hours'
    WHEN age > 48 AND urgency < 8 THEN 'older_than_48_hours_not_urgent_enough' WHEN age > 48 THEN 'high_urgency_extended_window' ELSE 'fresh_window' END AS reason FROM c1)"""
SCORES_SQL = f"""WITH {CARDS_SQL} SELECT article_id,
  greatest(0, least(100, CAST(round_even(importance * round_even(CAST(proximity AS DOUBLE) / 100, 4) * CAST(mult AS DOUBLE) * round_even(CAST(0.85 AS DOUBLE) + CAST(trust AS DOUBLE) / 100 * CAST(0.30 AS DOUBLE), 4), 0) AS INTEGER))) AS editorial_score,
  score AS deck_score, reason, reason IN ('undated_high_urgency', 'high_urgency_extended_window', 'fresh_window') AS eligible,
  CASE WHEN age >= 720 THEN 'archived' WHEN {articles_plan._any('lower(headline)', fixed.RESOLUTION)} THEN 'resolved' WHEN {_LEVEL} = 'breaking' AND (age IS NULL OR age <= 12) THEN 'breaking'
    WHEN article_id % 3 >= 2 AND (age IS NULL OR age <= 72) THEN 'developing' WHEN article_id % 3 >= 2 AND age <= 168 THEN 'ongoing' WHEN article_id % 3 >= 2 THEN 'active'
    WHEN age IS NULL OR age <= 48 THEN 'active' WHEN age <= 168 THEN 'ongoing' ELSE 'active' END AS state FROM cards"""


def top_stories(spark, sf_dir):
    """The 20 best stories by editorial score, importance and id, and whether they are breaking."""
    c = F.col
    t = _cards(spark, sf_dir).select("article_id", "importance", ranking.editorial_score(c("importance"), c("proximity"), c("trust"), c("age")).alias("editorial_score"))
    return t.orderBy(F.desc("editorial_score"), F.desc("importance"), "article_id").limit(20).withColumn("breaking", text.importance_level(c("importance")) == "breaking")


TOP_STORIES_SQL = f"WITH sc AS ({SCORES_SQL}), im AS ({articles_plan.IMPORTANCE_SQL}) SELECT article_id, im.score AS importance, editorial_score, im.score >= 80 AS breaking FROM sc JOIN im USING (article_id) ORDER BY editorial_score DESC, importance DESC, article_id LIMIT 20"


def deck(spark, sf_dir):
    """The greedy diversified deck over eligible cards, by category and state; the tables hold no locks or pins."""
    t = _cards(spark, sf_dir).where(F.col("reason").isin(*ranking.ELIGIBLE)).select("article_id", "headline", "category_key", "score", F.coalesce("age", F.lit(999999.0)).alias("age"), "position", text.states_in(F.col("headline")).alias("regions"))
    return ranking.greedy_deck(t)


def deck_moves(spark, sf_dir):
    """Cards whose place by score differs from their place in their section, the largest moves first."""
    t = _cards(spark, sf_dir).where(F.col("reason").isin(*ranking.ELIGIBLE))
    new = F.row_number().over(Window.partitionBy("category_key").orderBy(F.desc("score"), "article_id"))
    old = F.row_number().over(Window.partitionBy("category_key").orderBy("article_id"))
    m = t.select("article_id", "category_key", "score", old.alias("from_position"), new.alias("to_position")).where("from_position <> to_position")
    action = F.when((F.col("to_position") <= 12) & (F.col("from_position") > 12), "promote").when((F.col("to_position") > 12) & (F.col("from_position") <= 12), "demote").otherwise("reorder")
    return m.where("least(from_position, to_position) <= 12").withColumn("action", action)


MOVES_SQL = f"""WITH {CARDS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY score DESC, article_id) AS t, row_number() OVER (PARTITION BY category_key ORDER BY article_id) AS f FROM cards WHERE reason IN ('undated_high_urgency', 'high_urgency_extended_window', 'fresh_window'))
SELECT article_id, category_key, score, CAST(f AS INTEGER) AS from_position, CAST(t AS INTEGER) AS to_position, CASE WHEN t <= 12 AND f > 12 THEN 'promote' WHEN t > 12 AND f <= 12 THEN 'demote' ELSE 'reorder' END AS action FROM e WHERE f <> t AND least(f, t) <= 12"""


def hero_recommendation(spark, sf_dir):
    """For each section, the best eligible card against the current one: a change needs 8 points more."""
    t = _cards(spark, sf_dir).where(F.col("reason").isin(*ranking.ELIGIBLE)).select("article_id", "category_key", "score")
    best = t.groupBy("category_key").agg(F.max_by(F.struct("article_id", "score"), F.struct("score", -F.col("article_id"))).alias("b"), F.min_by(F.struct("article_id", "score"), "article_id").alias("c"))
    change = F.col("b.score") >= F.col("c.score") + 8
    return best.select("category_key", F.col("c.article_id").alias("current_id"), F.when(change, F.col("b.article_id")).otherwise(F.col("c.article_id")).alias("recommended_id"), change.alias("change"))


HERO_SQL = f"""WITH {CARDS_SQL}, e AS (SELECT * FROM cards WHERE reason IN ('undated_high_urgency', 'high_urgency_extended_window', 'fresh_window')),
b AS (SELECT category_key, article_id, score FROM (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY score DESC, article_id) AS rn FROM e) WHERE rn = 1),
c AS (SELECT category_key, article_id, score FROM (SELECT *, row_number() OVER (PARTITION BY category_key ORDER BY article_id) AS rn FROM e) WHERE rn = 1)
SELECT category_key, c.article_id AS current_id, CASE WHEN b.score >= c.score + 8 THEN b.article_id ELSE c.article_id END AS recommended_id, b.score >= c.score + 8 AS change FROM b JOIN c USING (category_key)"""


def placement_dedup(spark, sf_dir):
    """One placement for each section and story: protected first, then heroes, then urgency, then slot."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", (F.col("o_orderstatus") == "P").alias("protected"), (F.col("o_orderkey") % 7 == 0).alias("hero"), (F.floor(F.col("o_totalprice") / 50000) % 11).cast("int").alias("urgency"))
    best = ordered.first_by(o, ["o_orderpriority", "o_custkey"], [F.desc("protected"), F.desc("hero"), F.desc("urgency"), F.asc("o_orderkey")])
    return best.select(F.col("o_orderpriority").alias("section"), F.col("o_custkey").alias("story"), F.col("o_orderkey").alias("placement"), "urgency")


PLACEMENT_SQL = """WITH o AS (SELECT o_orderpriority AS section, o_custkey AS story, o_orderkey AS placement, CAST(floor(o_totalprice / 50000) % 11 AS INTEGER) AS urgency,
  row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderkey % 7 = 0 DESC, CAST(floor(o_totalprice / 50000) % 11 AS INTEGER) DESC, o_orderkey) AS rn FROM orders)
SELECT section, story, placement, urgency FROM o WHERE rn = 1"""


def archive_recovery(spark, sf_dir):
    """For each section the newest qualifying order as hero and the next eight as cards."""
    o = table(spark, sf_dir, "orders").where((F.col("o_totalprice") >= 80000) & (F.col("o_orderdate") <= F.lit("1999-06-30").cast("timestamp"))).select("o_orderkey", "o_orderpriority", "o_orderdate")
    top = ordered.first_by(o, ["o_orderpriority"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 9, rank="rank")
    return top.select(F.col("o_orderpriority").alias("section"), F.when(F.col("rank") == 1, "hero").otherwise("card").alias("role"), F.col("rank").cast("int").alias("rank"), F.col("o_orderkey").alias("article"))


RECOVERY_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_totalprice >= 80000 AND o_orderdate <= TIMESTAMP '1999-06-30')
SELECT o_orderpriority AS section, CASE WHEN rank = 1 THEN 'hero' ELSE 'card' END AS role, CAST(rank AS INTEGER) AS rank, o_orderkey AS article FROM r WHERE rank <= 9"""


def depth_backfill(spark, sf_dir):
    """Fillers for customers with fewer than eight orders: suppliers' lines of other customers' nation, none twice."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    have = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    gap = c.join(have, "c_custkey", "left").select("c_custkey", "c_nationkey", (8 - F.coalesce("n", F.lit(0))).alias("gap")).where("gap > 0")
    pool = o.join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").where("o_totalprice < 60000").select("c_nationkey", "o_custkey", "o_orderkey", "o_orderdate")
    # a customer takes eight at most, and has fewer than eight orders to leave out
    best = ordered.first_by(pool, ["c_nationkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 15, rank="r")
    met = gap.join(best, "c_nationkey").where("o_custkey <> c_custkey")
    filled = met.withColumn("slot", F.row_number().over(Window.partitionBy("c_custkey").orderBy("r"))).where("slot <= gap")
    return filled.select("c_custkey", F.col("slot").cast("int").alias("slot"), "o_orderkey")


BACKFILL_SQL = """WITH h AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
g AS (SELECT c_custkey, c_nationkey, 8 - coalesce(n, 0) AS gap FROM customer LEFT JOIN h ON o_custkey = c_custkey WHERE 8 - coalesce(n, 0) > 0),
p AS (SELECT c_nationkey, o_custkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice < 60000),
m AS (SELECT g.c_custkey, g.gap, p.o_orderkey, row_number() OVER (PARTITION BY g.c_custkey ORDER BY r) AS slot FROM g JOIN p USING (c_nationkey) WHERE o_custkey <> g.c_custkey)
SELECT c_custkey, CAST(slot AS INTEGER) AS slot, o_orderkey FROM m WHERE slot <= gap"""


# -- graphs ------------------------------------------------------------------------------


def story_components(spark, sf_dir):
    """Stories: articles joined by equal title sets or by headlines that share 8 tokens at a Jaccard of .8."""
    a = articles(spark, sf_dir).select(F.col("article_id").alias("id"), text.title_tokens(F.col("headline")).alias("tokens"))
    classes = distinct_sets(a).select(F.array_min("ids").alias("id"), "tokens", "ids")
    same = classes.select(F.col("id").alias("a"), F.explode("ids").alias("b"))
    # such a Jaccard is .8 of the larger set and .8 / 1.8 of both sizes together
    near = joined_sets(classes.select("id", "tokens"), 8, 1.6 / 1.8, "jaccard >= 0.8", wide=0.8)
    found = graph.components(same.unionAll(near))
    return a.select("id").join(found, "id", "left").select(F.col("id").alias("article_id"), F.coalesce("component", "id").alias("story_root"))


COMPONENTS_SQL = f"""WITH RECURSIVE {ARTICLES_SQL}, t AS (SELECT article_id AS id, list_sort(list_distinct({articles_plan._TITLE('headline')})) AS t FROM articles),
e AS (SELECT l.id AS a, r.id AS b FROM t l JOIN t r ON l.id <> r.id AND (l.t = r.t OR (len(list_intersect(l.t, r.t)) >= 8 AND len(list_intersect(l.t, r.t)) / (len(l.t) + len(r.t) - len(list_intersect(l.t, r.t))) >= 0.8))),
w(a, b) AS (SELECT id, id FROM t UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT a AS article_id, min(b) AS story_root FROM w GROUP BY a"""


def story_merge(spark, sf_dir):
    """Each component's story: size, sources, categories, the best title and the highest urgency."""
    a = articles(spark, sf_dir).join(story_components(spark, sf_dir), "article_id")
    rank = F.struct("urgency", F.length("headline"), -F.col("article_id"))
    return a.groupBy("story_root").agg(F.count(F.lit(1)).alias("n_articles"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set("category_key")), ",").alias("categories"), F.max_by("article_id", rank).alias("title_from"), F.max("urgency").alias("urgency"))


MERGE_SQL = f"""WITH s AS ({COMPONENTS_SQL}), {ARTICLES_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY story_root ORDER BY urgency DESC, length(headline) DESC, article_id) AS rn FROM articles JOIN s USING (article_id))
SELECT story_root, count(*) AS n_articles, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(list_sort(list_distinct(list(category_key))), ',') AS categories,
  max(article_id) FILTER (rn = 1) AS title_from, max(urgency) AS urgency FROM a GROUP BY story_root"""


def alias_flatten(spark, sf_dir):
    """Alias chains flattened to active stories: ids that divide by 64 are active, the rest point at their half."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alias"))
    chains = ids.where("alias % 64 <> 0").select("alias", F.when(F.col("alias") % 2 == 0, F.floor(F.col("alias") / 2)).otherwise(F.col("alias") - 1).cast("long").alias("target"))
    return graph.flatten_aliases(chains, ids.where("alias % 64 = 0").select(F.col("alias").alias("id")))


ALIAS_SQL = """WITH RECURSIVE c AS (SELECT o_orderkey AS alias, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 ELSE o_orderkey - 1 END AS target FROM orders WHERE o_orderkey % 64 <> 0),
w(alias, target) AS (SELECT alias, target FROM c UNION SELECT w.alias, c.target FROM w JOIN c ON w.target = c.alias)
SELECT alias, target FROM w WHERE target IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 64 = 0)"""


def new_story_ids(spark, sf_dir):
    """New ids for story roots, going on from 1000, in the order of their roots."""
    roots = story_components(spark, sf_dir).select("story_root").distinct()
    return ordered.sequential_ids(roots, ["story_root"], 1000).select("story_root", "story_id")


NEW_IDS_SQL = f"WITH s AS ({COMPONENTS_SQL}), r AS (SELECT DISTINCT story_root FROM s) SELECT story_root, printf('story_%06d', 999 + row_number() OVER (ORDER BY story_root)) AS story_id FROM r"


# -- sets and reports --------------------------------------------------------------------


def source_union(spark, sf_dir):
    """Distinct (source, headline key) over two sections, with the section that had it first."""
    a = articles(spark, sf_dir).select("article_id", "source", text.headline_key(F.col("source_title")).alias("title_key"), "category_key")
    both = a.where("category_key = 'us'").unionByName(a.where("category_key = 'world'"))
    return ordered.first_by(both, ["source", "title_key"], [F.asc("article_id")]).select("source", "title_key", F.col("category_key").alias("first_section"))


UNION_SQL = f"""WITH {ARTICLES_SQL}, b AS (SELECT *, trim(regexp_replace(lower(source_title), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM articles WHERE category_key IN ('us', 'world')),
r AS (SELECT *, row_number() OVER (PARTITION BY source, title_key ORDER BY article_id) AS rn FROM b) SELECT source, title_key, category_key AS first_section FROM r WHERE rn = 1"""


def uncommitted_targets(spark, sf_dir):
    """Update targets that were selected and not committed."""
    li = table(spark, sf_dir, "lineitem")
    selected, committed = li.where("l_returnflag = 'R'").select("l_partkey"), li.where("l_linestatus = 'F' and l_quantity < 30").select("l_partkey")
    return selected.subtract(committed)


SUBTRACT_SQL = "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 30"


def integrity_duplicates(spark, sf_dir):
    """Texts that more than one document has, with how many and the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"))
    return d.groupBy(F.col("k").alias("text_md5")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


DUPLICATES_SQL = "SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def section_report(spark, sf_dir):
    """For each month and kind of event: events, users, mean value and the largest value's event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.bround(F.avg("value"), 2).alias("mean_value"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("top_event"))


REPORT_SQL = """WITH r AS (SELECT *, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m'), event_type ORDER BY value DESC, event_id) AS rn FROM events)
SELECT month, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round_even(avg(value), 2) AS mean_value, max(event_id) FILTER (rn = 1) AS top_event FROM r GROUP BY ALL"""

QUERIES = {
    "canonical_per_event": (canonical_per_event, CANONICAL_SQL),
    "lifecycle_changes": (lifecycle_changes, CHANGES_SQL),
    "milestones_seen": (milestones_seen, MILESTONES_SQL),
    "timeline_greedy": (timeline_greedy, None),
    "live_cache": (live_cache, LIVE_CACHE_SQL),
    "cache_prune": (cache_prune, PRUNE_SQL),
    "history_compaction": (history_compaction, COMPACTION_SQL),
    "journal_replay": (journal_replay, JOURNAL_SQL),
    "usage_report": (usage_report, USAGE_SQL),
    "gate_validation": (gate_validation, GATE_SQL),
    "decisions": (decisions, DECISIONS_SQL),
    "card_scores": (card_scores, SCORES_SQL),
    "top_stories": (top_stories, TOP_STORIES_SQL),
    "deck": (deck, None),
    "deck_moves": (deck_moves, MOVES_SQL),
    "hero_recommendation": (hero_recommendation, HERO_SQL),
    "placement_dedup": (placement_dedup, PLACEMENT_SQL),
    "archive_recovery": (archive_recovery, RECOVERY_SQL),
    "depth_backfill": (depth_backfill, BACKFILL_SQL),
    "story_components": (story_components, COMPONENTS_SQL),
    "story_merge": (story_merge, MERGE_SQL),
    "alias_flatten": (alias_flatten, ALIAS_SQL),
    "new_story_ids": (new_story_ids, NEW_IDS_SQL),
    "source_union": (source_union, UNION_SQL),
    "uncommitted_targets": (uncommitted_targets, SUBTRACT_SQL),
    "integrity_duplicates": (integrity_duplicates, DUPLICATES_SQL),
    "section_report": (section_report, REPORT_SQL),
}
