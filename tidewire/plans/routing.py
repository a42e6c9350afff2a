"""Queries on routing: routes, deferrals, reuse, heroes, tombstones, pair identity, urgency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators import ordered, ranking, routing
from tidewire.plans import articles as ap
from tidewire.plans import stories as sp
from tidewire.sources.views import ARTICLES_SQL, REFERENCE, _quoted, articles, table


def production_routes(spark, sf_dir):
    """The route of each article's action, and how many take it in its class."""
    d = sp.decisions(spark, sf_dir).withColumn("route", routing.route(F.col("action")))
    return d.groupBy("action", "route", "update_class").agg(F.count(F.lit(1)).alias("n"))


_ROUTES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.ROUTES.items()) + "}"
ROUTES_SQL = f"WITH d AS ({sp.DECISIONS_SQL}) SELECT action, {_ROUTES}[action] AS route, update_class, count(*) AS n FROM d GROUP BY ALL"


def deferred_updates(spark, sf_dir):
    """Articles that fail as cards, and whether the failure could be repaired in a protected update."""
    q = ap.quality_reasons(spark, sf_dir)
    # a generator, so that a filter on the reasons doesn't have them computed twice
    failed = q.select("article_id", F.explode(F.filter(F.array("reasons"), lambda r: r != "")).alias("reasons"))
    return failed.select("article_id", routing.deferrable(F.split("reasons", ","), F.col("article_id") % 3 == 0).alias("deferred"))


DEFERRED_SQL = f"""WITH q AS ({ap.QUALITY_SQL}) SELECT article_id, article_id % 3 = 0 AND len(list_filter(string_split(reasons, ','), lambda r: NOT (list_contains({_quoted(fixed.REPAIRABLE)}, r) OR starts_with(r, 'body_under_')))) = 0 AS deferred FROM q WHERE NOT ok"""


def reuse_checks(spark, sf_dir):
    """Whether each article may reuse the canonical one twenty before it, or its neighbour."""
    a = articles(spark, sf_dir).select("article_id", "headline", "source_title", F.concat(F.lit("https://x.org/n/"), (F.col("article_id") % 90).cast("string"), F.lit("/?q=1")).alias("url"))
    old = a.select((F.col("article_id") + 30).alias("article_id"), F.col("source_title").alias("old_headline"), F.concat(F.lit("https://x.org/n/"), (F.col("article_id") % 100).cast("string")).alias("old_url"))
    j = a.join(old, "article_id")
    return j.select("article_id", routing.corroborated(F.col("url"), F.col("old_url"), F.col("headline"), F.col("old_headline")).alias("reusable"))


_COR = lambda c: f"list_distinct(list_filter({ap._words(c)}, lambda x: length(x) >= 4 AND NOT list_contains({_quoted(fixed.CORROBORATION_STOP)}, x)))"
REUSE_SQL = f"""WITH {ARTICLES_SQL}, j AS (SELECT a.article_id, a.article_id % 90 AS u, o.article_id % 100 AS v, {_COR('a.headline')} AS s, {_COR('o.source_title')} AS t FROM articles a JOIN articles o ON a.article_id = o.article_id + 30)
SELECT article_id, u = v OR ({ap._SHARED('s', 't')} >= 3 AND {ap._SHARED('s', 't')} / least(len(s), len(t)) >= 0.5 AND len(list_filter(list_intersect(s, t), lambda x: NOT list_contains({_quoted(fixed.COURT_FRAME)}, x))) > 0) AS reusable FROM j"""


def hero_uniqueness(spark, sf_dir):
    """The newest article of each source in a section leads it: which other section already leads with the same story."""
    newest = ordered.first_by(articles(spark, sf_dir), ["source", "category_key"], [F.desc("published_at"), F.desc("article_id")])
    h = newest.select("article_id", F.col("category_key").alias("section"), F.when(F.col("article_id") % 2 == 0, F.floor(F.col("article_id") / 40)).alias("story_id"), F.col("source_title").alias("headline"))
    return routing.unique_heroes(h, "article_id").select("article_id", "section", "taken_by")


UNIQUE_SQL = f"""WITH {ARTICLES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY source, category_key ORDER BY published_at DESC, article_id DESC) AS rn FROM articles), h AS (SELECT article_id, category_key AS section, CASE WHEN article_id % 2 = 0 THEN CAST(article_id // 40 AS VARCHAR) ELSE 'title:' || trim(regexp_replace(lower(source_title), '[^a-z0-9]+', ' ', 'g')) END AS i FROM w WHERE rn = 1),
f AS (SELECT *, first_value(section) OVER (PARTITION BY i ORDER BY article_id) AS f FROM h) SELECT article_id, section, CASE WHEN f <> section THEN f END AS taken_by FROM f"""


def quarantine_tombstones(spark, sf_dir):
    """What is kept of each user's story: counts, a digest, and titles from both ends."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("story_id")).agg(F.array_sort(F.collect_set("props")).alias("titles"))
    t = routing.tombstones(e)
    return t.select("story_id", "n_titles", "digest", F.array_join("kept", "|").alias("kept"))


TOMB_SQL = """WITH s AS (SELECT user_id AS story_id, list_sort(list_distinct(list(props))) AS t FROM events GROUP BY 1)
SELECT story_id, len(t) AS n_titles, sha256(array_to_string(t, chr(10))) AS digest, array_to_string(CASE WHEN len(t) <= 4 THEN t ELSE list_concat(t[1:2], t[-2:]) END, '|') AS kept FROM s"""


def pair_identities(spark, sf_dir):
    """Whether each article and the one twenty after it tell of the same event."""
    a = articles(spark, sf_dir)
    pair_tokens = F.array_distinct(F.filter(text.words(F.col("headline")), lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.PAIR_STOP)))
    t = a.select("article_id", pair_tokens.alias("t"), text.states_in(F.col("headline")).alias("s"), F.get(text.event_types(F.col("headline")), F.lit(0)).alias("k"), "source")
    o = t.select((F.col("article_id") - 20).alias("article_id"), *[F.col(c).alias(f"o{c}") for c in ("t", "s", "k", "source")])
    j = t.join(o, "article_id")
    place = F.coalesce(F.get("s", F.lit(0)) == F.get("os", F.lit(0)), F.lit(False))
    p = routing.pair_identity(F.col("article_id") % 31 == 0, F.size(F.array_intersect("s", "os")), place, F.col("source") == F.col("osource"), F.coalesce(F.col("k") == F.col("ok"), F.lit(False)), text.jaccard(F.col("t"), F.col("ot")))
    return j.select("article_id", p.alias("p")).select("article_id", "p.confidence", "p.same")


_PT = f"list_distinct(list_filter({ap._words('headline')}, lambda x: length(x) >= 3 AND NOT list_contains({_quoted(fixed.PAIR_STOP)}, x)))"
PAIRS_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id AS id, {_PT} AS t, list_filter({_quoted(fixed.STATES)}, lambda s: regexp_matches(lower({ap._SPACE('headline')}), '\\b' || replace(s, '.', '\\.') || '\\b')) AS s,
  (list_filter([{ap._TYPES.replace('low', 'lower(headline)')}], lambda x: x IS NOT NULL))[1] AS k, source FROM articles),
j AS (SELECT a.id, a.id % 31 = 0 AS e, {ap._SHARED('a.s', 'b.s')} AS n, coalesce(a.s[1] = b.s[1], false) AS l, a.source = b.source AS c, coalesce(a.k = b.k, false) AS y, {ap._SHARED('a.t', 'b.t')} / (len(a.t) + len(b.t) - {ap._SHARED('a.t', 'b.t')}) AS m FROM t a JOIN t b ON b.id = a.id + 20),
s AS (SELECT *, CAST(least(99.0, least(50.0, 25.0 * n) + CASE WHEN l THEN 25 ELSE 0 END + CASE WHEN c THEN 10 ELSE 0 END + CASE WHEN y THEN 20 ELSE 0 END + CASE WHEN m >= 0.60 THEN 25 WHEN m >= 0.35 THEN 12 ELSE 0 END) AS DOUBLE) AS sc FROM j)
SELECT id AS article_id, CASE WHEN e THEN CAST(100 AS DOUBLE) ELSE sc END AS confidence, e OR (sc >= 70 AND ((n > 0 AND (l OR y)) OR (l AND y AND m >= 0.35))) AS same FROM s"""


def urgency_caps(spark, sf_dir):
    """Urgency of every article after its age is counted in."""
    a = articles(spark, sf_dir)
    age = F.when(F.col("article_id") % 13 != 0, ranking.age_hours(F.col("published_at"), REFERENCE))
    return a.select("article_id", routing.capped_urgency(F.col("urgency"), F.col("headline"), age).alias("urgency"))


CAPS_SQL = f"""WITH {ARTICLES_SQL}, a AS (SELECT *, CASE WHEN article_id % 13 <> 0 THEN greatest(0, (epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(published_at)) / 3.6e9) END AS age FROM articles)
SELECT article_id, CAST(CASE WHEN age IS NULL OR {ap._any('lower(headline)', fixed.FRESH_WORDS)} THEN urgency ELSE least(urgency, CASE WHEN age > 48 THEN 4 WHEN age > 36 THEN 5 WHEN age > 24 THEN 7 WHEN age > 12 THEN 8 ELSE 10 END) END AS INTEGER) AS urgency FROM a"""

def rejection_reasons(spark, sf_dir):
    """Which of the reasons made of headlines rule a source out."""
    a = articles(spark, sf_dir)
    words = text.strings(["Duplicate of the lead", "weak angle", "Off category", "needs work", "too thin", "promotional"])
    reason = F.concat_ws(": ", F.get(words, (F.col("article_id") % 6).cast("int")), "source_title")
    return a.select("article_id", routing.hard_rejected(reason).alias("rejected"))


REJECTION_SQL = f"""WITH {ARTICLES_SQL}, r AS (SELECT article_id, lower(list_extract(['Duplicate of the lead', 'weak angle', 'Off category', 'needs work', 'too thin', 'promotional'], CAST(article_id % 6 AS INTEGER) + 1) || ': ' || source_title) AS r FROM articles)
SELECT article_id, {ap._any('r', fixed.HARD_REJECTIONS)} AS rejected FROM r"""


def registry_health(spark, sf_dir):
    """Counters of a registry made of articles, and whether it may be published from."""
    a = articles(spark, sf_dir)
    key = F.when(F.col("article_id") % 9 == 0, F.concat(F.lit("named-person-death:p"), F.col("article_id").cast("string"))).otherwise(F.concat(F.lit("e"), (F.col("article_id") % 400).cast("string")))
    s = a.groupBy(F.expr("article_id div 4").alias("story_id")).agg(F.collect_set(key).alias("event_keys"), F.collect_list("source_title").alias("titles"))
    return routing.health(s)


HEALTH_SQL = f"""WITH {ARTICLES_SQL}, a AS (SELECT article_id // 4 AS s, CASE WHEN article_id % 9 = 0 THEN 'named-person-death:p' || article_id ELSE 'e' || (article_id % 400) END AS k, article_id % 9 = 0 AS d, source_title AS t FROM articles),
g AS (SELECT s, count(DISTINCT k) FILTER (d) AS d, bool_or(regexp_matches(lower(t), '{fixed.DEATH_PATTERN}')) AS spoken FROM a GROUP BY 1), k AS (SELECT count(*) FILTER (n > 1) AS shared FROM (SELECT k, count(DISTINCT s) AS n FROM a GROUP BY 1))
SELECT count(*) AS stories, 0 AS untitled, CAST(sum(CASE WHEN spoken THEN 0 ELSE d END) AS BIGINT) AS unsupported_keys, (SELECT shared FROM k) AS shared_keys,
  CASE WHEN sum(CASE WHEN spoken THEN 0 ELSE d END) + (SELECT shared FROM k) = 0 THEN 'clean' ELSE 'blocked' END AS status FROM g"""

QUERIES = {
    "rejection_reasons": (rejection_reasons, REJECTION_SQL),
    "registry_health": (registry_health, HEALTH_SQL),
    "production_routes": (production_routes, ROUTES_SQL),
    "deferred_updates": (deferred_updates, DEFERRED_SQL),
    "reuse_checks": (reuse_checks, REUSE_SQL),
    "hero_uniqueness": (hero_uniqueness, UNIQUE_SQL),
    "quarantine_tombstones": (quarantine_tombstones, TOMB_SQL),
    "pair_identities": (pair_identities, PAIRS_SQL),
    "urgency_caps": (urgency_caps, CAPS_SQL),
}
