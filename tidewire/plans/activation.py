"""Queries on activation, assignment plans, lookups and small accessors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators import activation, substrings
from tidewire.plans import articles as ap
from tidewire.plans import incidents as ip
from tidewire.sources.views import ARTICLES_SQL, _quoted, articles, table


def _decided(spark, sf_dir):
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    traces = F.get(F.array(*[F.array(F.lit(t)) for t in (fixed.EXACT_SOURCE, fixed.EXACT_TITLE, "Location match: true")]), (n % 3).cast("int"))
    r = activation.recommend(F.when(n % 2 == 0, "skip").otherwise("generate_new"), F.when(n % 5 != 0, "same_event").otherwise("follow_up"), F.when(n % 7 != 0, 1.0).otherwise(0.9), n.cast("string"), (n - n % 4).cast("string"), n % 11 == 0, n % 22 == 0, traces)
    return a.withColumns({"r": r, "url": F.concat(F.lit("https://x.org/n/"), (n % 120).cast("string"))})


def activation_recommendations(spark, sf_dir):
    """What each decision would do to the live page, and on what evidence."""
    return _decided(spark, sf_dir).select("article_id", "r.action", "r.evidence")


_ACTION = """CASE WHEN n % 2 = 1 OR n % 5 = 0 OR n % 7 = 0 OR n % 4 = 0 THEN 'none' WHEN n % 11 = 0 AND n % 22 <> 0 THEN 'protect_custom_canonical' WHEN n % 3 < 2 THEN 'suppress_duplicate' ELSE 'none' END"""
RECOMMEND_SQL = f"WITH t AS (SELECT doc_id AS n FROM documents) SELECT n AS article_id, {_ACTION} AS action, CASE {_ACTION} WHEN 'none' THEN '' WHEN 'protect_custom_canonical' THEN 'custom_canonical_protection' ELSE CASE n % 3 WHEN 0 THEN 'exact_safe_source_article_identity' ELSE 'exact_normalized_title_identity' END END AS evidence FROM t"


def activated_placements(spark, sf_dir):
    """Where each placed article stands after the recommended duplicates are gone."""
    d = _decided(spark, sf_dir)
    recs = d.select("url", F.concat_ws(" ", "source_title", F.col("article_id").cast("string")).alias("title"), (F.col("r.action") == "suppress_duplicate").alias("enforceable"))
    n = F.col("article_id")
    places = d.select(F.concat_ws("-", "category_key", F.floor(n / 84).cast("string")).alias("section"), F.floor(n % 84 / 7).alias("pos"), n.alias("item_id"), F.concat(F.lit("https://x.org/n/"), ((n + 1) % 130).cast("string")).alias("url"), F.concat_ws(" ", "source_title", (n + 40).cast("string")).alias("title"), (n % 13 == 0).alias("custom"))
    return activation.activate(places, recs, mode="enforce", most=10_000_000)


_TID = lambda c: f"array_to_string({ap._words(c)}, ' ')"
ACTIVATE_SQL = f"""WITH {ARTICLES_SQL}, a AS (SELECT article_id AS n, source_title AS st, category_key FROM articles), rec AS (SELECT 'https://x.org/n/' || (n % 120) AS u, {_TID("st || ' ' || n")} AS t FROM a WHERE {_ACTION} = 'suppress_duplicate'),
p AS (SELECT category_key || '-' || (n // 84) AS section, n % 84 // 7 AS pos, n AS item_id, n % 13 <> 0 AND ('https://x.org/n/' || ((n + 1) % 130) IN (SELECT u FROM rec) OR {_TID("st || ' ' || (n + 40)")} IN (SELECT t FROM rec)) AS hit FROM a),
w AS (SELECT *, bool_or(pos = 0 AND hit) OVER (PARTITION BY section) AS heroless, min(pos) FILTER (pos > 0) OVER (PARTITION BY section) AS nxt FROM p),
x AS (SELECT *, CASE WHEN heroless AND pos = nxt THEN 'promoted' WHEN hit THEN 'removed' ELSE 'kept' END AS action FROM w)
SELECT section, pos, item_id, action, CAST(CASE WHEN action = 'promoted' THEN 0 WHEN action = 'kept' THEN CASE WHEN pos = 0 THEN 0 ELSE count(*) FILTER (action = 'kept' AND pos > 0) OVER (PARTITION BY section ORDER BY pos ROWS UNBOUNDED PRECEDING) END END AS INTEGER) AS new_pos FROM x"""


def placement_counts(spark, sf_dir):
    """Placements before and after, what went and what rose, by section: the run's match metrics."""
    p = activated_placements(spark, sf_dir)
    return p.groupBy("section").agg(F.count(F.lit(1)).alias("before"), F.count("new_pos").alias("after"), F.count_if(F.col("action") == "removed").alias("removed"), F.count_if(F.col("action") == "promoted").alias("promoted"))


PLACEMENTS_SQL = f"WITH p AS ({ACTIVATE_SQL}) SELECT section, count(*) AS before, count(new_pos) AS after, count(*) FILTER (action = 'removed') AS removed, count(*) FILTER (action = 'promoted') AS promoted FROM p GROUP BY 1"


def assignment_plans(spark, sf_dir):
    """Orders as plans, their lines as picks of parts: which stand, at what place, and with which source."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    raw = F.when(F.col("l_partkey") % 13 == 0, "").when(F.col("l_partkey") % 11 == 0, "x1").otherwise(((F.col("l_partkey") % 9) - 1).cast("string"))
    picks = li.select(F.col("l_orderkey").alias("plan"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), raw.alias("source_index"), (F.col("l_suppkey") % 4 != 0).alias("fits"))
    picks = picks.groupBy("plan", "pos").agg(F.min(F.struct("source_index", "fits")).alias("p")).select("plan", "pos", "p.*")
    plans = o.select(F.col("o_orderkey").alias("plan"), F.lit(6).alias("sources"), F.lit(3).alias("max_cards"))
    done = activation.normalised_plan(picks, plans, need_fit=True)
    names = plans.select("plan", F.posexplode(F.sequence(F.lit(1), F.lit(6))).alias("pos", "s")).select("plan", "pos", F.concat_ws("-", "plan", "s").alias("source_id"))
    return activation.at_index(done, names)


PLANS_SQL = """WITH p AS (SELECT l_orderkey AS plan, CAST(l_linenumber - 1 AS INTEGER) AS pos, min((CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 11 = 0 THEN 'x1' ELSE CAST(l_partkey % 9 - 1 AS VARCHAR) END, l_suppkey % 4 <> 0)) AS s FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
q AS (SELECT plan, pos, s[1] AS raw, s[2] AS fits FROM p), i AS (SELECT *, CASE WHEN TRY_CAST(raw AS INTEGER) > 0 THEN TRY_CAST(raw AS INTEGER) END AS idx FROM q),
v AS (SELECT *, CASE WHEN idx IS NULL OR idx > 6 THEN CASE WHEN raw = '' THEN 'missing' ELSE 'invalid' END WHEN NOT fits THEN 'rejected' ELSE 'ok' END AS v1 FROM i),
d AS (SELECT *, CASE WHEN v1 = 'ok' AND row_number() OVER (PARTITION BY plan, v1, idx ORDER BY pos) > 1 THEN 'duplicate' ELSE v1 END AS v2 FROM v),
n AS (SELECT *, count(*) FILTER (v2 = 'ok' AND pos > 0) OVER (PARTITION BY plan ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM d),
f AS (SELECT *, CASE WHEN v2 = 'ok' AND pos > 0 AND nth > 3 THEN 'left' ELSE v2 END AS verdict FROM n)
SELECT plan, idx AS index, pos, verdict, CAST(CASE WHEN verdict = 'ok' THEN CASE WHEN pos = 0 THEN 0 ELSE nth END END AS INTEGER) AS place, CASE WHEN idx BETWEEN 1 AND 6 THEN plan || '-' || idx END AS source_id FROM f"""


def classified_sources(spark, sf_dir):
    """Each article as a source with the categories its link and title were given."""
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    source = a.select("article_id", F.concat(F.lit("l"), (n % 50).cast("string")).alias("link"), F.upper("source_title").alias("title"))
    classes = a.where("article_id % 3 = 0").select(F.concat(F.lit("l"), (n % 50).cast("string")).alias("link"), F.concat("source_title", F.lit("!")).alias("title"), F.array("category_key", F.lit("us")).alias("categories"))
    return activation.classified(source, classes).select("article_id", F.array_join(F.coalesce("categories", F.array(F.lit("unclassified"))), ",").alias("categories"))


CLASSIFIED_SQL = f"""WITH {ARTICLES_SQL}, k AS (SELECT 'l' || (article_id % 50) AS link, {_TID('source_title')} AS t, category_key || ',us' AS c, array_to_string(list_sort([category_key, 'us']), ',') AS o FROM articles WHERE article_id % 3 = 0), f AS (SELECT link, t, min((o, c))[2] AS c FROM k GROUP BY ALL)
SELECT article_id, coalesce(f.c, 'unclassified') AS categories FROM articles a LEFT JOIN f ON f.link = 'l' || (a.article_id % 50) AND f.t = {_TID('a.source_title')}"""


def content_matches(spark, sf_dir):
    """The five articles of one source whose headlines share most words with each of another's, from two on."""
    bank = articles(spark, sf_dir).where("source = 'src1'").select(F.col("article_id").alias("entry_id"), F.col("headline").alias("title"))
    probes = articles(spark, sf_dir).where("source = 'src2'").select(F.col("article_id").alias("id"), F.col("headline").alias("title"))
    return activation.content_lookup(probes, bank).select("id", "rank", "entry_id", "shared")


_CW = lambda c: f"list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g')), ' +'), lambda x: x <> '' AND NOT list_contains({_quoted(fixed.CONTENT_STOP)}, x)))"
CONTENT_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id AS id, source, {_CW('headline')} AS t FROM articles), p AS (SELECT a.id, b.id AS entry_id, CAST({ap._SHARED('a.t', 'b.t')} AS INTEGER) AS shared FROM t a JOIN t b ON a.source = 'src2' AND b.source = 'src1'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, entry_id) AS rank FROM p WHERE shared >= 2) SELECT id, CAST(rank AS INTEGER) AS rank, entry_id, shared FROM r WHERE rank <= 5"""


def image_titles(spark, sf_dir):
    """The first entry whose title lies in each text's opening: titles are the third to sixth words of texts."""
    whole = text.collapse(F.col("body"))
    a = articles(spark, sf_dir).select("article_id", whole.alias("whole"))
    caption = F.array_join(F.slice(F.split("whole", " "), 3, 4), " ")
    return substrings.first_title(a.select(F.col("article_id").alias("id"), F.col("whole").alias("headline")), a.select(F.col("article_id").alias("entry_id"), caption.alias("title")))


IMAGE_TITLES_SQL = f"""WITH {ARTICLES_SQL}, w AS (SELECT article_id, {ap._SPACE('body')} AS whole FROM articles),
h AS (SELECT article_id AS id, lower(left(whole, 50)) AS h, lower(left(array_to_string(string_split(whole, ' ')[3:6], ' '), 50)) AS t FROM w),
m AS (SELECT a.h, min(b.id) AS entry_id FROM (SELECT DISTINCT h FROM h WHERE h <> '') a JOIN h b ON b.t <> '' AND (contains(a.h, b.t) OR contains(b.t, a.h)) GROUP BY a.h)
SELECT id, entry_id FROM h LEFT JOIN m USING (h)"""


def archive_cleanup(spark, sf_dir):
    """The archive row that each report is a duplicate of, itself if it is none."""
    r = ip.reports(spark, sf_dir)
    return activation.kept_of_duplicates(r.select(F.col("id").alias("pos"), text.signature_tokens(F.col("title")).alias("tokens")))


CLEANUP_SQL = f"""WITH RECURSIVE {ip.REPORTS_SQL}, t AS (SELECT row_number() OVER (ORDER BY id) AS k, id, list_distinct({ap._SIGNATURE('title')}) AS t FROM reports),
w(k, kept, pos, kept_pos) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, t VARCHAR[])[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL SELECT t.k, CASE WHEN len(m) = 0 THEN list_append(w.kept, {{'i': t.id, 't': t.t}}) ELSE w.kept END, t.id, CASE WHEN len(m) = 0 THEN t.id ELSE list_max(list_transform(m, lambda x: x.i)) END
  FROM w JOIN t ON t.k = w.k + 1, LATERAL (SELECT CASE WHEN len(t.t) < 3 THEN CAST([] AS STRUCT(i BIGINT, t VARCHAR[])[]) ELSE list_filter(w.kept, lambda x: len(list_intersect(x.t, t.t)) >= 4) END AS m))
SELECT pos, kept_pos FROM w WHERE pos IS NOT NULL"""


def small_values(spark, sf_dir):
    """Publisher, day gap, priority and hour of each article."""
    a = articles(spark, sf_dir)
    n = F.col("article_id")
    source = F.get(text.strings(["", "Reuters World", "The Hill", "blog"]), (n % 4).cast("int"))
    url = F.get(text.strings(["https://bbc.co.uk/news", "https://x.org", "https://www.espn.com/a"]), (n % 3).cast("int"))
    return a.select("article_id", activation.publisher(source, url, F.concat(F.col("source_title"), F.lit(" - NPR"))).alias("publisher"), activation.day_gap(F.col("published_at"), F.lit("2026-01-04 13:00:00").cast("timestamp")).alias("days"), activation.priority(n % 130, n % 97).alias("priority"), activation.display_hour(F.col("published_at")).alias("hour"))


SMALL_SQL = f"""WITH {ARTICLES_SQL} SELECT article_id, CASE WHEN article_id % 4 = 1 THEN 'Reuters' WHEN article_id % 3 = 0 THEN 'BBC' ELSE 'NPR' END AS publisher, CAST(abs(date_diff('day', CAST(published_at AS DATE), DATE '2026-01-04')) AS INTEGER) AS days,
  CAST(round_even(least(100, article_id % 130) * (article_id % 97) / 100, 0) AS INTEGER) AS priority, CAST((hour(published_at - INTERVAL 5 HOUR) + 11) % 12 + 1 AS VARCHAR) || ':00 ' || CASE WHEN hour(published_at - INTERVAL 5 HOUR) < 12 THEN 'AM' ELSE 'PM' END || ' ET' AS hour FROM articles"""


def event_stories(spark, sf_dir):
    """One story for each event key of the reports."""
    return activation.events_to_stories(ip.reports(spark, sf_dir).select("event_key", F.col("id").alias("entry_id"), "title"))


EVENTS_SQL = f"WITH {ip.REPORTS_SQL} SELECT event_key, arg_min(title, id) AS title, count(*) AS entries, max(id) AS last_id, count(*) = 1 AS created FROM reports GROUP BY 1"

QUERIES = {
    "activation_recommendations": (activation_recommendations, RECOMMEND_SQL),
    "activated_placements": (activated_placements, ACTIVATE_SQL),
    "placement_counts": (placement_counts, PLACEMENTS_SQL),
    "assignment_plans": (assignment_plans, PLANS_SQL),
    "classified_sources": (classified_sources, CLASSIFIED_SQL),
    "content_matches": (content_matches, CONTENT_SQL),
    "image_titles": (image_titles, IMAGE_TITLES_SQL),
    "archive_cleanup": (archive_cleanup, CLEANUP_SQL),
    "small_values": (small_values, SMALL_SQL),
    "event_stories": (event_stories, EVENTS_SQL),
}
