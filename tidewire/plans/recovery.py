"""Queries on authority, exclusions and recovered heroes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators import ranking, recovery
from tidewire.plans import articles as ap
from tidewire.plans import incidents as ip
from tidewire.sources.views import ARTICLES_SQL, REFERENCE, _quoted, articles


def identity_authority(spark, sf_dir):
    """What the keys of each report prove, and whether it may be written to the page of its neighbour."""
    r = ip.reports(spark, sf_dir)
    n = F.col("id") % 7
    keys = F.when(n == 0, F.array(F.lit("source:https://x.org/a"))).when(n == 1, F.array(F.lit("story:story_1"), F.concat(F.lit("weather:"), "event_key"))).when(n == 2, F.array(F.concat(F.lit("incident:missing-person:"), F.lower(F.get("entities", F.lit(0)))))).when(n == 3, F.array(F.lit("incident:mass-animal-hoarding:ohio"))).when(n == 4, F.array(F.lit("story:story_1"))).when(n == 5, F.array(F.col("event_key"))).otherwise(F.array().cast("array<string>"))
    d = recovery.key_authority(keys)
    return r.select("id", d.alias("d")).select("id", "d.outcome", "d.tier", "d.authorized", "d.proof", recovery.authorizes(F.col("d"), F.lit("page-1"), F.concat(F.lit("page-"), (F.col("id") % 2).cast("string"))).alias("writable"))


AUTHORITY_SQL = f"""WITH {ip.REPORTS_SQL}, a AS (SELECT id, CASE id % 7 WHEN 0 THEN 'exact_source_url' WHEN 1 THEN 'exact_weather_event_key' WHEN 2 THEN 'exact_structured_incident_key' WHEN 3 THEN 'broad_structured_incident_key' WHEN 4 THEN 'uncorroborated_persistent_story_id' WHEN 5 THEN 'untrusted_identity_key' ELSE 'none' END AS proof FROM reports)
SELECT id, CASE WHEN id % 7 < 3 THEN 'same_event_verified' WHEN id % 7 < 6 THEN 'possible_relationship' ELSE 'new_story' END AS outcome, CASE WHEN id % 7 < 3 THEN 'exact_identity' WHEN id % 7 < 6 THEN 'candidate_only' ELSE 'insufficient_evidence' END AS tier, id % 7 < 3 AS authorized, proof, id % 7 < 3 AND id % 2 = 1 AS writable FROM a"""


def pair_authorities(spark, sf_dir):
    """How far each report and the one eight before it, of the same kind, prove one event."""
    r = ip.reports(spark, sf_dir)
    names = ("title", "event_key", "facts", "locations", "agencies", "entities", "kind", "group")
    a, b = (r.select((F.col("id") + shift).alias("id"), *[F.col(c).alias(f"{p}_{c}") for c in names]) for p, shift in (("a", 0), ("b", 8)))
    both = lambda c: F.size(F.array_intersect(f"a_{c}", f"b_{c}"))
    words = F.size(F.array_intersect(text.title_tokens(F.col("a_title")), text.title_tokens(F.col("b_title"))))
    place, k = both("locations") > 0, F.col("a_kind")
    d = recovery.pair_authority(
        conflict=F.col("id") % 13 == 0, anchor=(k == 1) & (F.col("a_group") == F.col("b_group")), event_key=F.col("a_event_key") == F.col("b_event_key"), people=F.when(k < 2, both("entities")).otherwise(0), places=F.when(k == 2, both("locations")).otherwise(0),
        agencies=both("agencies"), subjects=F.when(k == 7, both("facts")).otherwise(0), topics=words, facts=words + both("facts"), locality=place, family=F.col("a_kind") == F.col("b_kind"), policy=k == 7, safe=F.col("id") % 17 != 0, near=words >= 4,
    )
    return a.join(b, "id").select("id", d.alias("d")).select("id", "d.*")


_TT = lambda c: f"list_distinct({ap._TITLE(c)})"
PAIRS_SQL = f"""WITH {ip.REPORTS_SQL}, j AS (SELECT a.id, a.kind AS k, a.grp = b.grp AS g, a.event_key = b.event_key AS ek, (a.who = b.who)::INT AS w, (a.place = b.place)::INT AS p, (a.agency = b.agency)::INT AS o, (a.fact = b.fact)::INT AS f, len(list_intersect({_TT('a.title')}, {_TT('b.title')})) AS n FROM reports a JOIN reports b ON a.id = b.id + 8),
x AS (SELECT id, id % 13 = 0 AS conflict, k = 1 AND g AS anchor, ek, CASE WHEN k < 2 THEN w ELSE 0 END AS people, CASE WHEN k = 2 THEN p ELSE 0 END AS places, o, CASE WHEN k = 7 THEN f ELSE 0 END AS subj, n AS topics, n + f AS facts, p = 1 AS loc, k = 7 AS policy, id % 17 <> 0 AS safe FROM j),
y AS (SELECT *, people > 0 OR places > 0 OR (policy AND o > 0 AND subj > 0 AND loc) AS hard FROM x),
d AS (SELECT id, CASE WHEN conflict THEN 'conflict' WHEN anchor AND safe AND hard THEN 'exact_structured_incident_anchor' WHEN ek AND safe AND hard THEN 'exact_known_event_key' WHEN safe AND loc AND people > 0 AND places > 0 THEN 'participant_plus_precise_location' WHEN safe AND loc AND people > 0 AND facts >= 5 THEN 'participant_plus_distinctive_incident_facts'
  WHEN safe AND loc AND places > 0 AND facts >= 5 AND topics >= 2 THEN 'precise_location_plus_distinctive_facts' WHEN safe AND policy AND loc AND o > 0 AND subj > 0 AND facts >= 4 THEN 'governing_body_plus_policy_subject' WHEN anchor OR ek OR people > 0 OR places > 0 OR (loc AND (o > 0 OR subj > 0)) OR topics >= 2 THEN 'candidate_similarity' ELSE 'none' END AS proof FROM y)
SELECT id, CASE WHEN proof IN ('conflict', 'none') THEN 'new_story' WHEN proof = 'candidate_similarity' THEN 'possible_relationship' ELSE 'same_event_verified' END AS outcome, CASE proof WHEN 'conflict' THEN 'conflict' WHEN 'none' THEN 'insufficient_evidence' WHEN 'candidate_similarity' THEN 'candidate_only' WHEN 'exact_structured_incident_anchor' THEN 'exact_identity' WHEN 'exact_known_event_key' THEN 'exact_identity' ELSE 'hard_composite_identity' END AS tier, proof NOT IN ('conflict', 'none', 'candidate_similarity') AS authorized, proof FROM d"""


def exclusions(spark, sf_dir):
    """Why each article is left out of looking back and of ranking, and whether its story may lend its identity."""
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    title = F.when(n % 9 == 0, F.concat(F.lit("Opinion: "), "source_title")).when(n % 10 == 3, F.lit("Storm news update")).otherwise(F.col("source_title"))
    why = recovery.retrospective_exclusions(title, F.col("source"), F.when(n % 6 == 1, "https://www.facebook.com/p/1").otherwise("https://news.org/a"))
    rank = recovery.ranking_exclusion(F.when(n % 4 == 0, n % 8 != 0), F.when(n % 5 == 0, F.get(text.strings(["recent_unresolved", "resolved", ""]), (n % 3).cast("int"))), n % 11 == 0, F.when(n % 2 == 0, n))
    events = F.array(F.when(n % 12 == 0, "fire-main").otherwise(F.concat(F.lit("fire-"), F.substring(F.md5(n.cast("string")), 1, 10))))
    safe = recovery.safe_duplicate(events, n % 25 == 0, F.array(F.get(text.strings(["same_event", "Follow_Up", "related"]), (n % 3).cast("int"))))
    return a.select("article_id", F.array_join(why, ",").alias("retrospective"), rank.alias("ranking"), safe.alias("safe_duplicate"))


EXCLUSIONS_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id AS n, lower(CASE WHEN article_id % 9 = 0 THEN 'Opinion: ' || source_title WHEN article_id % 10 = 3 THEN 'Storm news update' ELSE source_title END) AS low, list_extract(['recent_unresolved', 'resolved', ''], CAST(article_id % 3 AS INTEGER) + 1) AS st FROM articles)
SELECT n AS article_id, array_to_string(list_filter([CASE WHEN n % 6 = 1 THEN 'social_source' END, CASE WHEN len(list_distinct(list_filter({ap._words('low')}, lambda x: length(x) >= 3 AND NOT list_contains({_quoted(fixed.RETROSPECTIVE_STOP)}, x)))) < 5 THEN 'insufficient_title_detail' END, CASE WHEN n % 9 = 0 THEN 'low_value_title' END], lambda x: x IS NOT NULL), ',') AS retrospective,
  CASE WHEN n % 8 = 0 OR (n % 5 = 0 AND st = 'recent_unresolved') OR (n % 11 = 0 AND n % 2 = 1) THEN CASE WHEN n % 5 = 0 AND st <> '' THEN st ELSE 'archive_unresolved' END END AS ranking,
  n % 12 <> 0 AND n % 25 <> 0 AND n % 3 = 0 AS safe_duplicate FROM t"""


def stale_heroes(spark, sf_dir):
    """Places of each section and day after a stale hero has changed with its first fresh card."""
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    words = text.strings(["the vote took place on monday", "announced today", "plans for spring", "it was last week", "court on wednesday, then", "talks go on"])
    stale = recovery.is_stale(F.concat_ws(" ", "source_title", F.get(words, (n * 7 % 6).cast("int"))), F.when(n % 4 != 0, F.col("published_at")), REFERENCE)
    sections = a.select("article_id", F.concat_ws("-", "category_key", F.floor(n / 70).cast("string")).alias("section"), F.floor(n % 70 / 7).alias("pos"), stale.alias("stale"))
    return recovery.swap_stale_heroes(sections)


_FRESH = ap._any("txt", fixed.FRESH_PHRASES)
STALE_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id, category_key || '-' || (article_id // 70) AS section, article_id % 70 // 7 AS pos, lower(source_title) || ' ' || list_extract(['the vote took place on monday', 'announced today', 'plans for spring', 'it was last week', 'court on wednesday, then', 'talks go on'], CAST(article_id * 7 % 6 AS INTEGER) + 1) AS txt, CASE WHEN article_id % 4 <> 0 THEN published_at END AS pub FROM articles),
s AS (SELECT *, NOT {_FRESH} AND ({ap._any('txt', fixed.STALE_PHRASES)} OR regexp_matches(txt, '(?: |^)(?:wednesday|tuesday|monday|sunday) | (?:wednesday|tuesday|monday|sunday)[,.]') OR coalesce(pub <= TIMESTAMP '{REFERENCE}' - INTERVAL 24 HOUR, false)) AS stale FROM t),
w AS (SELECT *, min(pos) FILTER (NOT stale AND pos > 0) OVER (PARTITION BY section) AS f, bool_or(pos = 0 AND stale) OVER (PARTITION BY section) AS h FROM s)
SELECT article_id, section, pos, stale, CASE WHEN h AND f IS NOT NULL AND pos = 0 THEN f WHEN h AND f IS NOT NULL AND pos = f THEN 0 ELSE pos END AS new_pos FROM w"""


def chosen_heroes(spark, sf_dir):
    """The leading article of each day: a hero, or a card before it that can be told in full."""
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    rank = F.struct(-F.col("urgency"), n)
    return recovery.choose_hero(a.select("article_id", F.to_date("published_at").alias("edition"), rank.alias("rank"), F.when(n % 9 == 0, "hero").otherwise("card").alias("role"), (n % 5 == 0).alias("full"))).select(F.date_format("edition", "yyyy-MM-dd").alias("edition"), "article_id", "role", "failures")


CHOSEN_SQL = f"""WITH {ARTICLES_SQL}, c AS (SELECT article_id, strftime(published_at, '%Y-%m-%d') AS edition, CASE WHEN article_id % 9 = 0 THEN 'hero' ELSE 'card' END AS role, article_id % 5 = 0 AS ok, row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY urgency DESC, article_id) AS rk FROM articles),
f AS (SELECT a.*, (SELECT count(*) FROM c b WHERE b.edition = a.edition AND b.rk < a.rk AND b.role = 'card' AND NOT b.ok) AS failures FROM c a),
r AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY rk) AS rn FROM f WHERE role = 'hero' OR (ok AND failures < 3)) SELECT edition, article_id, role, CAST(least(3, failures) AS INTEGER) AS failures FROM r WHERE rn = 1"""


def recovered_heroes(spark, sf_dir):
    """What takes the place of each section's hero: the newest sound article of its archive that no other section leads with."""
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    section = F.concat_ws("-", "source", "category_key")
    archive = a.select(n.cast("string").alias("slug"), section.alias("section"), F.col("source_title").alias("title"), F.floor(n / 9).alias("story_id"), F.col("published_at").alias("published"), ranking.age_hours(F.col("published_at"), REFERENCE).alias("age"), (text.word_count(F.col("body")) >= fixed.SOURCE_WORDS).alias("valid"), (n % 3 != 0).alias("corroborated"), (n % 7 == 0).alias("errors"))
    wanted = archive.groupBy("section").agg(F.max_by("slug", F.struct("published", "slug")).alias("rejected")).withColumn("lead", F.col("section").startswith("src0-"))
    occupied = a.where("source = 'src1'").select(F.floor(n / 9).alias("story_id"), F.concat(F.col("source_title"), F.lit("!"), n.cast("string")).alias("title"))
    return recovery.recover_heroes(wanted, archive, occupied)


RECOVERED_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id AS n, CAST(article_id AS VARCHAR) AS slug, source || '-' || category_key AS section, article_id // 9 AS sid, published_at AS pub, greatest(0, (epoch_us(TIMESTAMP '{REFERENCE}') - epoch_us(published_at)) / 3.6e9) AS age, {ap._WORDS_N('body')} >= {fixed.SOURCE_WORDS} AS valid FROM articles),
w AS (SELECT section, arg_max(slug, (pub, slug)) AS rejected, starts_with(section, 'src0-') AS ld FROM t GROUP BY section),
k AS (SELECT t.*, row_number() OVER (PARTITION BY section ORDER BY pub DESC, slug) AS rk FROM t JOIN w USING (section) WHERE valid AND slug <> rejected AND age <= CASE WHEN ld THEN 72 ELSE 48 END),
o AS (SELECT DISTINCT article_id // 9 AS sid FROM articles WHERE source = 'src1'), f AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY pub DESC, slug) AS rn FROM k WHERE rk <= 10 AND n % 3 <> 0 AND n % 7 <> 0 AND sid NOT IN (SELECT sid FROM o)) SELECT section, slug FROM f WHERE rn = 1"""


def collisions(spark, sf_dir):
    """What becomes of each article bound to the wrong story: kept, given an identity of its own, or recovered."""
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    url = lambda c: F.concat(F.lit("https://X.org/n/"), c.cast("string"), F.lit("/?q=1"))
    hero = a.where("article_id % 2 = 1").select(
        n.alias("hero_id"), url(n).alias("url"), "headline", F.get(text.strings(["full", "summary", "brief"]), (n % 3).cast("int")).alias("quality"), text.word_count(F.col("body")).alias("n_words"), (n % 10 == 7).alias("errors"), (n % 15 == 1).alias("protected"),
        url(F.when(n % 9 == 0, n).otherwise(n - 1)).alias("old_url"), F.when(n % 4 == 1, "new").otherwise("same").alias("verdict"), ((n % 20 + 80) / 100).alias("confidence"),
    )
    archive = a.where("article_id % 2 = 0").select(F.concat(F.lit("https://x.org/n/"), (n + F.when(n % 16 == 0, 1).otherwise(0)).cast("string"), F.lit("/?q=2")).alias("url"), F.format_string("story_%06d", n).alias("story_id"))
    return recovery.collision(hero, archive)


COLLISIONS_SQL = f"""WITH {ARTICLES_SQL}, h AS (SELECT article_id AS n, lower(headline) AS hl, {ap._WORDS_N('body')} AS words FROM articles WHERE article_id % 2 = 1),
x AS (SELECT n, CASE WHEN n % 15 = 1 THEN 'keep' WHEN n % 9 <> 0 AND (n - 1) % 16 <> 0 AND n % 3 < 2 AND words >= {fixed.SOURCE_WORDS} AND n % 10 <> 7 AND n % 4 = 1 AND n % 20 >= 2 THEN 'publish_independent' ELSE 'recover' END AS action, sha256('https://x.org/n/' || n || '/' || chr(10) || hl) AS d FROM h)
SELECT n AS hero_id, action, CASE WHEN action = 'publish_independent' THEN 'story_' || (CAST('0x' || substr(d, 1, 14) AS BIGINT) + 10000000000000000) END AS story_id, CASE WHEN action = 'publish_independent' THEN 'independent-' || substr(d, 1, 16) END AS event_key FROM x"""

QUERIES = {
    "identity_authority": (identity_authority, AUTHORITY_SQL),
    "pair_authorities": (pair_authorities, PAIRS_SQL),
    "exclusions": (exclusions, EXCLUSIONS_SQL),
    "stale_heroes": (stale_heroes, STALE_SQL),
    "chosen_heroes": (chosen_heroes, CHOSEN_SQL),
    "recovered_heroes": (recovered_heroes, RECOVERED_SQL),
    "collisions": (collisions, COLLISIONS_SQL),
}
