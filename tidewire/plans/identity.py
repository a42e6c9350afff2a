"""Queries on story identity, the front page, images, updates and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import fixed, pages, text, times, urls
from tidewire.operators import fronts, identity, ordered, ranking
from tidewire.plans import articles as ap
from tidewire.plans import pages as pp
from tidewire.plans.stories import CARDS_SQL, _cards
from tidewire.sources.views import ARTICLES_SQL, _quoted, articles, table, web_pages


def front_page(spark, sf_dir):
    """The 20 leading candidates of the front page: significance, urgency, relevance, importance, freshness."""
    c = F.col
    t = _cards(spark, sf_dir).where("age is not null")
    age = c("age")
    fresh = age <= F.when(c("urgency") >= 8, fixed.EXTENDED_HOURS).otherwise(fixed.FRESH_HOURS)
    t = t.where(fresh).withColumn("t", fronts.tier(c("category_key"), c("headline"))).where("t.tier > 0")
    national = text.relevance_scope(c("headline")) == "us_national"
    score = fronts.front_score(c("t.tier"), c("urgency"), c("proximity"), c("importance"), age, national)
    out = t.select("article_id", c("t.tier").alias("tier"), c("t.reason").alias("reason"), score.alias("score"), F.bround(age, 2).alias("age_hours"), F.lower("headline").alias("h"))
    return out.orderBy(F.desc("score"), F.desc("tier"), "age_hours", "h", "article_id").limit(20).drop("h")


def _tier_sql() -> str:
    m = lambda k, low="low": f"regexp_matches({low}, '{fixed.TIER[k].replace(chr(39), chr(39) * 2)}')"
    ruled = "regexp_replace(low, '\\b(rules?|ruled)\\s+out\\b', 'x', 'g')"
    court = f"regexp_matches({ruled}, '\\b(?:supreme court|federal court|appeals court)\\b.{{0,90}}\\b(?:rules?|ruled)\\b|\\b(?:rules?|ruled)\\b.{{0,75}}\\b(?:supreme court|federal court|appeals court)\\b')"
    sure, gov = f"NOT {m('analysis')}", f"({m('government')} OR {m('government_reverse')} OR {court})"
    cases = [
        ("category_key IN ('sports', 'entertainment')", 0, "category_never_auto_hero"), (f"{m('sports')} OR {m('entertainment')}", 0, "sports_entertainment_content_outside_its_category"),
        (f"{gov} AND {sure} AND category_key IN ('tech', 'business') AND {m('one_firm')} AND NOT {m('broad')}", 3, "targeted_federal_entity_action"), (f"{gov} AND {sure}", 5, "concrete_federal_action"),
        (f"{m('foreign_crisis')} AND {sure}", 4, "major_foreign_government_crisis"), (f"{m('war')} AND {sure} AND {m('us_forces')}", 5, "major_international_development"),
        (f"{m('war')} AND {sure}", 4, "major_international_development"), (f"{m('economy')} AND {sure}", 4, "macroeconomic_development"),
        (f"{m('security')} AND {sure} AND {m('wide')}", 4, "security_emergency"), (f"{m('security')} AND {sure}", 3, "security_emergency"),
        (f"{m('election')} AND {sure}", 3, "significant_electoral_development"), (m("analysis"), 1, "analysis_or_speculation"),
        (f"category_key = 'politics' AND {m('politics')}", 3, "political_development"), ("category_key = 'world'", 2, "international_development_without_broad_consequence"),
        ("category_key = 'us'", 2, "domestic_development"), ("true", 1, "limited_national_reach"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {{'t': {n}, 'r': '{r}'}}" for c, n, r in cases) + " END"


FRONT_SQL = f"""WITH {CARDS_SQL}, sco AS (SELECT article_id, s FROM {ap._SCOPE_SQL}),
f AS (SELECT c.*, s, lower(headline) AS low FROM cards c JOIN sco USING (article_id) WHERE age IS NOT NULL AND age <= CASE WHEN urgency >= 8 THEN 60 ELSE 48 END),
g AS (SELECT *, {_tier_sql()} AS tr FROM f),
h AS (SELECT article_id, tr.t AS tier, tr.r AS reason, low, round_even(age, 2) AS age_hours, round_even(CAST(36 AS DOUBLE) * tr.t + CAST(4 AS DOUBLE) * urgency + CAST(0.15 AS DOUBLE) * proximity + CAST(0.15 AS DOUBLE) * importance
  + greatest(CAST(-45 AS DOUBLE), CAST(44 AS DOUBLE) - age * CAST(2.5 AS DOUBLE)) + CASE WHEN s = 'us_national' THEN round_even(CAST(22 AS DOUBLE) * greatest(0, 1 - age / 12), 2) ELSE 0 END, 2) AS score FROM g WHERE tr.t > 0)
SELECT article_id, tier, reason, score, age_hours FROM h ORDER BY score DESC, tier DESC, age_hours, low, article_id LIMIT 20"""


def image_checks(spark, sf_dir):
    """Why an image can't be used, for images named after pages and sized after parts."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    names = text.strings(["photo", "site-logo", "img/1x1", "logo/main", "og-image.png", "hero-shot"])
    host = urls.domain(F.col("url"))
    image = F.concat(F.lit("https://"), F.when(F.col("page_id") % 4 == 0, F.lit("cdn.img.net")).otherwise(host), F.lit("/"), F.get(names, (F.col("page_id") % 6).cast("int")), F.lit("-"), F.col("page_id").cast("string"), F.lit(".jpg"))
    alt = F.when(F.col("page_id") % 11 == 0, "Station logo").otherwise("A street")
    w, h = (F.col("page_id") * 37 % 900 + 20).cast("double"), (F.col("page_id") * 53 % 700 + 30).cast("double")
    return p.select("page_id", fronts.image_rejection(image, F.col("url"), alt, w, h).alias("reason")).withColumn("usable", F.col("reason") == "")


IMAGES_SQL = f"""WITH d AS (SELECT page_id, {pp._DOMAIN} AS dom FROM pages),
i AS (SELECT page_id, dom, CASE WHEN page_id % 4 = 0 THEN 'cdn.img.net' ELSE dom END AS ih, list_extract(['photo', 'site-logo', 'img/1x1', 'logo/main', 'og-image.png', 'hero-shot'], CAST(page_id % 6 AS INTEGER) + 1) AS nm,
  CASE WHEN page_id % 11 = 0 THEN 'station logo' ELSE 'a street' END AS alt, page_id * 37 % 900 + 20 AS w, page_id * 53 % 700 + 30 AS h FROM d),
u AS (SELECT *, 'https://' || ih || '/' || nm || '-' || page_id || '.jpg' AS img FROM i),
r AS (SELECT page_id, CASE WHEN length(img) < 15 THEN 'missing_or_short' WHEN {ap._any('img', fixed.PLACEHOLDERS)} THEN 'placeholder_or_logo_url'
  WHEN {ap._any('alt', fixed.LOGO_WORDS)} THEN 'logo_alt_text' WHEN least(w, h) <= 80 THEN 'tiny_dimensions' WHEN greatest(w / h, h / w) >= 6 THEN 'extreme_aspect_ratio'
  WHEN ih = dom AND regexp_matches('/' || nm || '-' || page_id || '.jpg', '{fixed.BRAND_PATH}') THEN 'publisher_brand_asset' ELSE '' END AS reason FROM u)
SELECT page_id, reason, reason = '' AS usable FROM r"""


def timeline_coherence(spark, sf_dir):
    """Entries of a story that continue none before them and conflict with one."""
    a = articles(spark, sf_dir)
    e = a.select(F.floor(F.col("article_id") / 6).alias("story_id"), F.col("article_id").alias("entry_id"), F.col("source_title").alias("title"), F.concat(F.lit("k"), (F.col("article_id") % 50).cast("string")).alias("event_key"))
    return identity.timeline_pairs(e)


_KEY = lambda c: f"array_to_string({ap._words(c)}, ' ')"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches({_KEY('source_title')}, '{p}') THEN '{n}'" for n, p in fixed.FAMILIES) + " ELSE 'unknown' END"
COHERENCE_SQL = f"""WITH {ARTICLES_SQL}, e AS (SELECT article_id // 6 AS story_id, article_id AS entry_id, article_id % 50 AS k, {_KEY('source_title')} AS t, list_distinct({ap._TIMELINE('source_title')}) AS tok, {_FAMILY} AS fam FROM articles),
p AS (SELECT b.story_id, b.entry_id, a.k = b.k OR a.t = b.t AS same, a.fam AS af, b.fam AS bf, {ap._SHARED('a.tok', 'b.tok')} AS sh, {ap._SHARED('a.tok', 'b.tok')} / least(len(a.tok), len(b.tok)) AS ov FROM e a JOIN e b ON a.story_id = b.story_id AND a.entry_id < b.entry_id),
g AS (SELECT story_id, entry_id, bool_or(same OR (sh >= 2 AND ov >= 0.30) OR ov >= 0.50) AS continues, bool_or(af <> 'unknown' AND bf <> 'unknown' AND af <> bf AND ov < 0.20 AND sh < 2) AS conflicts FROM p GROUP BY ALL)
SELECT *, NOT continues AND conflicts AS reject FROM g"""


def update_composition(spark, sf_dir):
    """Why each article can't replace the one before it: the update's headline, teaser and body against both."""
    # of the bodies only openings and tokens travel to the join
    a = articles(spark, sf_dir)
    old = a.select((F.col("article_id") + 1).alias("article_id"), F.col("headline").alias("old_headline"), F.substring("body", 1, 900).alias("old_start"), fronts.update_tokens(F.concat_ws(" ", "headline", "body")).alias("old_tokens"))
    j = a.select("article_id", "headline", "source_title", F.substring("body", 1, 900).alias("start")).join(old, "article_id")
    news = F.concat_ws(" ", "headline", "source_title")
    body = F.concat_ws("\n\n", F.concat_ws(" ", "headline", "old_headline", F.substring("start", 1, 150)), "old_start", "start")
    errors = fronts.composition_errors(F.col("headline"), news, body, F.col("old_headline"), F.lit(None).cast("string"), news, F.col("old_tokens"))
    return j.select("article_id", errors.alias("e")).select("article_id", F.when(F.size("e") == 0, "validated").otherwise("invalid_composition").alias("status"), F.array_join("e", ",").alias("errors"))


def _update_tokens(c: str) -> str:
    canon = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.UPDATE_CANON.items()) + "}"
    return f"list_distinct(list_transform(list_filter({ap._words(c)}, lambda x: length(x) >= 3 AND NOT list_contains({_quoted(fixed.UPDATE_STOP)}, x)), lambda x: coalesce({canon}[x], x)))"


_N = lambda c: f"len(list_filter(string_split({ap._SPACE(c)}, ' '), lambda w: w <> ''))"
COMPOSITION_SQL = f"""WITH {ARTICLES_SQL}, j AS (SELECT a.article_id, a.headline, a.headline || ' ' || a.source_title AS news, o.headline AS oh, o.body AS ob,
  a.headline || ' ' || o.headline || ' ' || substr(a.body, 1, 150) || chr(10) || chr(10) || substr(o.body, 1, 900) || chr(10) || chr(10) || substr(a.body, 1, 900) AS body FROM articles a JOIN articles o ON a.article_id = o.article_id + 1),
q AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(body), '\\n\\s*\\n+'), lambda p: {ap._SPACE('p')}), lambda p: p <> '') AS parts FROM j),
t AS (SELECT *, parts[1] AS lead, len(regexp_extract_all(body, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS words, {_update_tokens('oh')} AS tho, {_update_tokens("(oh || ' ' || ob)")} AS told, {_update_tokens('news')} AS tnew, {_update_tokens('parts[1]')} AS tl, {_update_tokens('body')} AS tb, {_update_tokens('headline')} AS th FROM q),
f AS (SELECT *, list_filter(tnew, lambda x: NOT list_contains(told, x)) AS fresh, list_filter(tnew, lambda x: NOT list_contains(tho, x)) AS freshh FROM t),
e AS (SELECT article_id, list_filter([CASE WHEN {_N('headline')} < 5 THEN 'headline_missing_or_too_short' END, CASE WHEN length({ap._SPACE('headline')}) > 180 THEN 'headline_too_long' END, CASE WHEN {_N('news')} < 12 THEN 'teaser_missing_or_too_short' END,
  CASE WHEN len(parts) < 3 THEN 'insufficient_paragraphs' END, CASE WHEN words < 170 THEN 'body_too_short' END, CASE WHEN words > 700 THEN 'body_too_long' END, CASE WHEN {_N('lead')} < 24 THEN 'lead_too_short' END,
  CASE WHEN lower({ap._SPACE('headline')}) = lower({ap._SPACE('oh')}) THEN 'headline_not_refreshed_for_material_update' END, CASE WHEN len(freshh) > 0 AND {ap._SHARED('th', 'freshh')} = 0 THEN 'headline_missing_material_development' END,
  CASE WHEN len(tho) > 0 AND {ap._SHARED('tho', 'tl')} < least(2, len(tho)) THEN 'lead_missing_original_event_context' END, CASE WHEN len(fresh) > 0 AND {ap._SHARED('fresh', 'tl')} = 0 THEN 'lead_missing_new_development' END,
  CASE WHEN len(fresh) = 0 AND {ap._SHARED('tnew', 'tl')} < least(2, len(tnew)) THEN 'lead_missing_incoming_context' END, CASE WHEN {ap._SHARED('told', 'tb')} < least(5, len(told)) THEN 'body_missing_canonical_context' END,
  CASE WHEN {ap._SHARED('tnew', 'tb')} < least(5, len(tnew)) THEN 'body_missing_incoming_update' END], lambda x: x IS NOT NULL) AS e FROM f)
SELECT article_id, CASE WHEN len(e) = 0 THEN 'validated' ELSE 'invalid_composition' END AS status, array_to_string(e, ',') AS errors FROM e"""


def headline_ingestion(spark, sf_dir):
    """Of each source's 35 first entries, those with a new headline key, the 18 newest."""
    a = articles(spark, sf_dir).select("article_id", "source", "published_at", text.headline_key(F.col("source_title")).alias("title_key"))
    head = ordered.first_by(a, ["source"], [F.asc("article_id")], 35)
    new = ordered.first_by(head, ["source", "title_key"], [F.asc("article_id")])
    top = ordered.first_by(new, ["source"], [F.desc("published_at"), F.asc("article_id")], 18, rank="rank")
    return top.select("source", F.col("rank").cast("int").alias("rank"), "article_id", "title_key")


INGESTION_SQL = f"""WITH {ARTICLES_SQL}, a AS (SELECT *, trim(regexp_replace(lower(source_title), '[^a-z0-9]+', ' ', 'g')) AS title_key, row_number() OVER (PARTITION BY source ORDER BY article_id) AS n FROM articles),
h AS (SELECT *, row_number() OVER (PARTITION BY source, title_key ORDER BY article_id) AS k FROM a WHERE n <= 35),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, article_id) AS rank FROM h WHERE k = 1)
SELECT source, CAST(rank AS INTEGER) AS rank, article_id, title_key FROM r WHERE rank <= 18"""


def section_fit(spark, sf_dir):
    """Fresh articles of each section that fit it, the first 18, and why others are left out."""
    a = articles(spark, sf_dir)
    age = ranking.age_hours(F.col("published_at"), "2026-01-08 00:00:00")
    fit = F.when(F.col("article_id") % 5 == 0, F.lit("none")).when(F.col("article_id") % 5 == 1, F.lit("sports")).otherwise(F.col("category_key"))
    reason = F.when(age > F.when(F.col("category_key") == "sports", 60.0).otherwise(72.0), "stale").when(fit == "none", "no_category").when(fit != F.col("category_key"), "other_category").otherwise("")
    t = a.select("article_id", "category_key", reason.alias("reason"))
    ok = ordered.first_by(t.where("reason = ''"), ["category_key"], [F.asc("article_id")], 18)
    return ok.unionByName(t.where("reason <> ''"))


FIT_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id, category_key, CASE WHEN greatest(0, (epoch_us(TIMESTAMP '2026-01-08') - epoch_us(published_at)) / 3.6e9) > CASE WHEN category_key = 'sports' THEN 60 ELSE 72 END THEN 'stale'
  WHEN article_id % 5 = 0 THEN 'no_category' WHEN article_id % 5 = 1 AND category_key <> 'sports' THEN 'other_category' ELSE '' END AS reason FROM articles),
r AS (SELECT *, row_number() OVER (PARTITION BY category_key, reason ORDER BY article_id) AS n FROM t) SELECT article_id, category_key, reason FROM r WHERE reason <> '' OR n <= 18"""


def _registry(spark, sf_dir):
    """Stories and articles with event keys, title keys and URLs: even articles are stories, odd ones arrive."""
    p = web_pages(spark, sf_dir).select((F.col("page_id") % 60).alias("page_id"), "identity_url").groupBy("page_id").agg(F.min("identity_url").alias("url"))
    a = articles(spark, sf_dir).withColumn("page_id", F.col("article_id") % 71).join(p, "page_id", "left")
    return a.select(
        "article_id", F.concat(F.lit("e"), F.when(F.col("article_id") % 7 == 0, F.lit("")).otherwise((F.col("article_id") % 97).cast("string"))).alias("event_key"),
        text.headline_key(F.col("headline")).alias("title_key"), F.coalesce("url", F.lit("")).alias("url"), "headline", "category_key",
    ).withColumn("event_key", F.when(F.col("event_key") == "e", "").otherwise(F.col("event_key")))


def resolve_cascade(spark, sf_dir):
    """The story of each arriving article: event key, then title, then URL, each only where it has one owner."""
    r = _registry(spark, sf_dir)
    stories = r.where("article_id % 2 = 0").withColumn("story_id", F.floor(F.col("article_id") / 20))
    return identity.cascade(r.where("article_id % 2 = 1").select("article_id", "event_key", "title_key", "url"), stories.select("story_id", "event_key", "title_key", "url"))


CASCADE_SQL = f"""WITH {pp._IDENTITY_SQL}, pg AS (SELECT page_id % 60 AS page_id, min(identity_url) AS url FROM identity GROUP BY 1), {ARTICLES_SQL},
r AS (SELECT article_id, CASE WHEN article_id % 7 = 0 THEN '' ELSE 'e' || (article_id % 97) END AS event_key, trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g')) AS title_key, coalesce(pg.url, '') AS url FROM articles LEFT JOIN pg ON pg.page_id = article_id % 71),
st AS (SELECT article_id // 20 AS story_id, * FROM r WHERE article_id % 2 = 0), k AS (
  SELECT 1 AS tier, event_key AS k, min(story_id) AS story_id FROM st WHERE event_key <> '' GROUP BY event_key HAVING count(DISTINCT story_id) = 1
  UNION ALL SELECT 2, title_key, min(story_id) FROM st WHERE title_key <> '' GROUP BY title_key HAVING count(DISTINCT story_id) = 1
  UNION ALL SELECT 3, url, min(story_id) FROM st WHERE url <> '' GROUP BY url HAVING count(DISTINCT story_id) = 1),
m AS (SELECT article_id, tier, story_id, row_number() OVER (PARTITION BY article_id ORDER BY tier) AS n FROM r JOIN k ON (tier = 1 AND k = event_key) OR (tier = 2 AND k = title_key AND len(string_split(title_key, ' ')) >= 4) OR (tier = 3 AND k = url) WHERE article_id % 2 = 1)
SELECT r.article_id, coalesce(m.tier, 9) AS tier, m.story_id FROM r LEFT JOIN m ON m.article_id = r.article_id AND m.n = 1 WHERE r.article_id % 2 = 1"""


def structured_resolution(spark, sf_dir):
    """The story of each arriving article by facts, places, agencies, kinds of event, proper names and event keys.

    Headlines alone seldom name all kinds of evidence, so the threshold is under the resolver's own.
    """
    h = F.col("headline")
    a = articles(spark, sf_dir).join(ap.facts_and_keys(spark, sf_dir).select("article_id", "event_key"), "article_id")
    t = a.select(F.col("article_id").alias("id"), h.alias("title"), "event_key", F.array("event_key").alias("events"), text.quantified_facts(h).alias("facts"), text.states_in(h).alias("locations"), text.agencies_in(h).alias("agencies"), text.event_types(h).alias("types"), text.proper_names(h).alias("entities"))
    return identity.resolve(t.where("id / 20 % 2 >= 1"), t.where("id / 20 % 2 < 1"), least=0.6)


def registry_repair(spark, sf_dir):
    """Stories merged until no title or URL is shared, with what each took in."""
    r = _registry(spark, sf_dir)
    stories = r.select(F.col("article_id").alias("story_id"), F.array("title_key").alias("titles"), F.array_compact(F.array(F.when(F.col("url") != "", F.concat("url", F.lit("#"), (F.col("article_id") % 40).cast("string"))))).alias("urls"), (F.col("article_id") % 11 == 0).cast("int").alias("custom"), (F.col("article_id") % 5).cast("int").alias("priority"))
    aliases = r.select((-F.col("article_id") - 1).alias("alias"), F.col("article_id").alias("target"))
    fixed_, flat = identity.repair(stories, aliases)
    taken = flat.groupBy(F.col("target").alias("story_id")).agg(F.count(F.lit(1)).alias("n_aliases"))
    return fixed_.join(taken, "story_id", "left").select("story_id", F.size("titles").cast("long").alias("n_titles"), F.size("urls").cast("long").alias("n_urls"), "custom", "priority", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))


REPAIR_SQL = f"""WITH RECURSIVE {pp._IDENTITY_SQL}, pg AS (SELECT page_id % 60 AS page_id, min(identity_url) AS url FROM identity GROUP BY 1), {ARTICLES_SQL},
r AS (SELECT article_id AS id, trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g')) AS t, coalesce(pg.url, '') || '#' || (article_id % 40) AS u, coalesce(pg.url, '') <> '' AS hu, CAST(article_id % 11 = 0 AS INTEGER) AS cu, article_id % 5 AS pr FROM articles LEFT JOIN pg ON pg.page_id = article_id % 71),
e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id <> b.id AND (a.t = b.t OR (a.hu AND b.hu AND a.u = b.u))),
w(a, b) AS (SELECT id, id FROM r UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a), c AS (SELECT a AS id, min(b) AS root FROM w GROUP BY a),
m AS (SELECT root, r.*, row_number() OVER (PARTITION BY root ORDER BY cu DESC, pr DESC, r.id) AS rn FROM r JOIN c USING (id))
SELECT max(id) FILTER (rn = 1) AS story_id, count(DISTINCT t) AS n_titles, count(DISTINCT u) FILTER (hu) AS n_urls, CAST(sum(cu) AS INTEGER) AS custom, CAST(max(pr) AS INTEGER) AS priority, 2 * count(*) - 1 AS n_aliases FROM m GROUP BY root"""


def timestamps(spark, sf_dir):
    """Timestamps written in several formats read back, and which of three stamps counts."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 2, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0200'"))
        .when(k == 3, F.date_format("ts", "yyyy-MM-dd")).when(k == 4, F.date_format("ts", "HH:mm")).otherwise("soon")
    )
    at = times.parsed(raw)
    best = times.effective([("published", at), ("date", F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts")))])
    return e.select("event_id", best.alias("b")).select("event_id", F.date_format("b.at", "yyyy-MM-dd HH:mm:ss").alias("at"), "b.basis")


TIMES_SQL = """WITH e AS (SELECT event_id, date_trunc('second', ts) AS t, event_id % 6 AS k, date_trunc('day', ts) AS d FROM events),
p AS (SELECT *, CASE WHEN k IN (0, 1) THEN t WHEN k = 2 THEN t - INTERVAL 2 HOUR WHEN k = 3 THEN d END AS stamp FROM e)
SELECT event_id, strftime(coalesce(stamp, CASE WHEN event_id % 2 = 0 THEN d END), '%Y-%m-%d %H:%M:%S') AS "at", CASE WHEN stamp IS NOT NULL THEN 'published' WHEN event_id % 2 = 0 THEN 'date' ELSE 'missing' END AS basis FROM p"""


def section_backfill(spark, sf_dir):
    """Six safe cards for each section in source order, none like one already chosen."""
    a = articles(spark, sf_dir).where(text.word_count(F.col("body")) >= fixed.SOURCE_WORDS)
    tokens = F.array_distinct(F.filter(text.words(F.col("source_title")), lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.BACKFILL_STOP)))
    return fronts.backfill(a.select(F.col("category_key").alias("section"), F.col("article_id").alias("pos"), "article_id", tokens.alias("tokens"), F.lit("").alias("url")), 6)


def quality_counts(spark, sf_dir):
    """Run report: how many articles each quality reason rejects, by section."""
    q = ap.quality_reasons(spark, sf_dir).join(articles(spark, sf_dir).select("article_id", "category_key"), "article_id")
    return q.select("category_key", F.explode(F.split("reasons", ",")).alias("reason")).where("reason <> ''").groupBy("category_key", "reason").agg(F.count(F.lit(1)).alias("n"))


COUNTS_SQL = f"WITH q AS ({ap.QUALITY_SQL}), {ARTICLES_SQL}, x AS (SELECT category_key, unnest(string_split(reasons, ',')) AS reason FROM q JOIN articles USING (article_id)) SELECT category_key, reason, count(*) AS n FROM x WHERE reason <> '' GROUP BY ALL"


def page_sources(spark, sf_dir):
    """Pages as source rows: type, quality, and whether they could lead."""
    w = web_pages(spark, sf_dir)
    kind = urls.source_type(F.col("domain"))
    q = pages.quality(F.col("n_words"), kind == "discovery_only")
    return w.select("page_id", kind.alias("source_type"), q.alias("source_quality"), (q.isin("full", "summary") & (F.col("n_words") >= fixed.SOURCE_WORDS)).alias("hero_eligible"))


SOURCES_SQL = f"WITH {pp._WEB_SQL} SELECT page_id, CASE WHEN domain <> '' THEN 'full_source' ELSE 'unknown' END AS source_type, {pp._QUALITY} AS source_quality, n_words >= 80 AS hero_eligible FROM w"

def _cards_and_stories(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("title", F.concat_ws(" ", "source_title", (F.col("article_id") % 7).cast("string")))
    a = a.withColumn("slug", F.concat(F.lit("s"), (F.col("article_id") % 83).cast("string"))).withColumn("url", F.concat(F.when(F.col("article_id") % 2 == 0, F.lit("https://x.org/live/")).otherwise(F.lit("https://x.org/news/")), (F.col("article_id") % 61).cast("string")))
    stories = a.where("article_id % 2 = 0").select(F.expr("article_id div 2").alias("story_id"), "slug", "url", "title")
    cards = a.where("article_id % 2 = 1").select("article_id", F.when(F.col("article_id") % 8 != 1, F.expr("(article_id - 1) div 2")).alias("story_id"), F.when(F.col("article_id") % 10 == 1, F.lit("")).otherwise(F.col("slug")).alias("slug"), F.when(F.col("article_id") % 6 == 1, F.lit("")).otherwise(F.col("url")).alias("url"), "title")
    return cards, stories


_CS_SQL = f"""{ARTICLES_SQL}, x AS (SELECT article_id AS id, source_title || ' ' || (article_id % 7) AS title, 's' || (article_id % 83) AS slug, CASE WHEN article_id % 2 = 0 THEN 'https://x.org/live/' ELSE 'https://x.org/news/' END || (article_id % 61) AS url FROM articles),
k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS tkey FROM x),
st AS (SELECT id // 2 AS story_id, slug, url, title, tkey FROM k WHERE id % 2 = 0),
cd AS (SELECT id AS article_id, CASE WHEN id % 8 <> 1 THEN (id - 1) // 2 END AS story_id, CASE WHEN id % 10 = 1 THEN '' ELSE slug END AS slug, CASE WHEN id % 6 = 1 THEN '' ELSE url END AS url, title, tkey FROM k WHERE id % 2 = 1)"""


def ranking_identity(spark, sf_dir):
    """The story each card belongs to, on what evidence, and how far that is trusted."""
    return identity.corroborated_identity(*_cards_and_stories(spark, sf_dir))


IDENTITY_SQL = f"""WITH {_CS_SQL}, o AS (SELECT c.*, (SELECT min(story_id) FROM st WHERE st.slug = c.slug) AS bs, (SELECT min(story_id) FROM st WHERE st.url = c.url) AS bu, (SELECT min(story_id) FROM st WHERE st.tkey = c.tkey) AS bt,
  s.story_id IS NOT NULL AS kn, list_distinct({ap._TITLE('c.title')}) AS a, list_distinct({ap._TITLE("coalesce(s.title, '')")}) AS b FROM cd c LEFT JOIN st s ON s.story_id = c.story_id),
e AS (SELECT *, {ap._SHARED('a', 'b')} AS n FROM o), b AS (SELECT *, CASE WHEN kn AND bs = story_id THEN 'persistent_story_id+canonical_slug' WHEN kn AND bu = story_id THEN 'persistent_story_id+source_url' WHEN kn AND bt = story_id THEN 'persistent_story_id+exact_title'
  WHEN kn AND n >= 4 AND (n / least(len(a), len(b)) >= 0.70 OR n / (len(a) + len(b) - n) >= 0.55) THEN 'persistent_story_id+strong_title_overlap' WHEN bs IS NOT NULL THEN 'canonical_slug' WHEN bu IS NOT NULL THEN 'source_url' WHEN bt IS NOT NULL THEN 'title'
  WHEN story_id IS NOT NULL THEN 'uncorroborated_persistent_story_id' ELSE 'unmatched' END AS basis FROM e)
SELECT article_id, CASE WHEN starts_with(basis, 'persistent') THEN story_id WHEN basis = 'canonical_slug' THEN bs WHEN basis = 'source_url' THEN bu WHEN basis = 'title' THEN bt END AS story_id, basis,
  CASE basis WHEN 'persistent_story_id+strong_title_overlap' THEN 'medium' WHEN 'uncorroborated_persistent_story_id' THEN 'low' WHEN 'unmatched' THEN 'unmatched' ELSE 'high' END AS confidence, story_id IS NOT NULL AND NOT starts_with(basis, 'persistent') AS conflict FROM b"""


def source_matches(spark, sf_dir):
    """The one story with each card's URL; rolling addresses need agreeing titles too."""
    cards, stories = _cards_and_stories(spark, sf_dir)
    return identity.source_match(cards.select("article_id", "url", "title"), stories.select("story_id", "url", "title"))


_STOK = lambda c: f"list_distinct({ap._keep(ap._words(c), 3, fixed.SOURCE_TITLE_NOISE, True)})"
_SHEAD = ap._SOURCE_HEAD.replace("headline", "title")
MATCHES_SQL = f"""WITH {_CS_SQL}, ct AS (SELECT article_id, url, tkey, {_STOK(_SHEAD)} AS t FROM cd), sm AS (SELECT story_id, url, tkey, {_STOK(_SHEAD)} AS t FROM st),
m AS (SELECT c.article_id, s.story_id, bool_or(NOT contains(c.url, '/live/') OR c.tkey = s.tkey OR ({ap._SHARED('c.t', 's.t')} >= 2 AND {ap._SHARED('c.t', 's.t')} / least(len(c.t), len(s.t)) >= 0.35)) AS ok FROM ct c JOIN sm s ON c.url = s.url AND c.url <> '' GROUP BY ALL),
f AS (SELECT article_id, count(*) FILTER (ok) AS n, min(story_id) FILTER (ok) AS o FROM m GROUP BY 1)
SELECT cd.article_id, CASE WHEN url = '' THEN 'not_an_identity' WHEN n IS NULL THEN 'no_story' WHEN n = 0 THEN 'rolling_without_continuity' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, CASE WHEN n = 1 THEN o END AS story_id FROM cd LEFT JOIN f USING (article_id)"""

QUERIES = {
    "ranking_identity": (ranking_identity, IDENTITY_SQL),
    "source_matches": (source_matches, MATCHES_SQL),
    "front_page": (front_page, FRONT_SQL),
    "image_checks": (image_checks, IMAGES_SQL),
    "timeline_coherence": (timeline_coherence, COHERENCE_SQL),
    "update_composition": (update_composition, COMPOSITION_SQL),
    "headline_ingestion": (headline_ingestion, INGESTION_SQL),
    "section_fit": (section_fit, FIT_SQL),
    "resolve_cascade": (resolve_cascade, CASCADE_SQL),
    "structured_resolution": (structured_resolution, None),
    "registry_repair": (registry_repair, REPAIR_SQL),
    "timestamps": (timestamps, TIMES_SQL),
    "section_backfill": (section_backfill, None),
    "quality_counts": (quality_counts, COUNTS_SQL),
    "page_sources": (page_sources, SOURCES_SQL),
}
