"""Queries over a registry that was dealt by a weak rule, and its repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators import graph, identity, repair
from tidewire.operators.checkpoints import cut
from tidewire.plans import articles as ap
from tidewire.plans import identity as ip
from tidewire.sources.views import ARTICLES_SQL, articles


def registry_entries(spark, sf_dir):
    """Articles as entries of stories told by source and first letter alone, so that stories mix what is apart and part what is one.

    An entry's anchor is its text's opening, its event key the family of its headline with
    its text's end: copies agree in both, near copies in one. Short texts only have a
    class of events.
    """
    a = articles(spark, sf_dir).withColumn("whole", text.collapse(F.col("body")))
    family = F.regexp_replace(identity.event_family(F.col("headline")), "_", "-")
    end = F.substring(F.md5(F.right("whole", F.lit(60))), 1, 10)
    key = (
        F.when(F.length("whole") < 200, F.when(family == "unknown", "unknown-event").otherwise(family))
        .when(family == "death", F.concat(F.lit("named-person-death:"), end)).otherwise(F.concat(family, F.lit("-"), end))
    )
    told = a.select(
        F.col("article_id").alias("entry_id"), F.concat_ws("|", "source", F.lower(F.left("whole", F.lit(1)))).alias("lot"), F.col("headline").alias("title"), key.alias("event_key"),
        F.lower(F.regexp_extract("body", "https?://[a-zA-Z0-9./_-]+", 0)).alias("url"), F.substring(F.md5(F.left("whole", F.lit(60))), 1, 16).alias("anchor"), "source",
        F.lit(0).alias("custom"), F.least(F.lit(9), F.floor(F.length("whole") / 500)).cast("int").alias("priority"), F.size(text.words(F.col("headline"))).alias("trust"),
    )
    told = cut(told)  # made from whole texts, and read by every pass
    lots = told.groupBy("lot").agg(F.min("entry_id").alias("story_id"))
    return told.join(lots, "lot").select("entry_id", "story_id", "title", "event_key", "url", "anchor", "source", *repair.RANK)


_FAMILY = ip._FAMILY.replace("source_title", "headline")
ENTRIES_SQL = f"""{ARTICLES_SQL}, whole AS (SELECT *, {ap._SPACE('body')} AS whole, replace({_FAMILY}, '_', '-') AS fam FROM articles),
lots AS (
  SELECT article_id AS entry_id, source || '|' || lower(left(whole, 1)) AS lot, headline AS title, fam,
    CASE WHEN length(whole) < 200 THEN CASE fam WHEN 'unknown' THEN 'unknown-event' ELSE fam END WHEN fam = 'death' THEN 'named-person-death:' || md5(right(whole, 60))[1:10] ELSE fam || '-' || md5(right(whole, 60))[1:10] END AS event_key,
    lower(regexp_extract(body, 'https?://[a-zA-Z0-9./_-]+', 0)) AS url, md5(left(whole, 60))[1:16] AS anchor, source,
    0 AS custom, CAST(least(9, length(whole) // 500) AS INTEGER) AS priority, len({ap._words('headline')}) AS trust
  FROM whole
), entries AS (SELECT *, min(entry_id) OVER (PARTITION BY lot) AS story_id FROM lots)"""


def entry_moves(spark, sf_dir):
    """Entries that leave for the story that owns their opening."""
    return repair.moves(registry_entries(spark, sf_dir)).select("entry_id", "story_id", "owner")


MOVES_SQL = f"""WITH {ENTRIES_SQL}, tot AS (SELECT story_id, count(*) AS total, max(row(custom, priority, trust)) AS best FROM entries GROUP BY 1),
held AS (SELECT anchor, story_id, count(*) AS n FROM entries GROUP BY ALL), several AS (SELECT anchor FROM held GROUP BY 1 HAVING count(*) > 1),
owners AS (SELECT anchor, story_id AS owner FROM held JOIN several USING (anchor) JOIN tot USING (story_id) QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY n / total DESC, n DESC, best DESC, story_id) = 1)
SELECT entry_id, story_id, owner FROM entries JOIN owners USING (anchor) WHERE story_id <> owner"""


def repair_passes(spark, sf_dir):
    """The registry after all passes: what each story owns and how many ids lead to it."""
    done = repair.repair_passes(repair.Registry.of(registry_entries(spark, sf_dir)))
    taken = done.aliases.groupBy(F.col("target").alias("story_id")).agg(F.count(F.lit(1)).alias("n_aliases"))
    rows = repair.story_rows(done.entries).join(taken, "story_id", "left")
    return rows.select("story_id", "n_entries", F.size("titles").cast("long").alias("n_titles"), F.size("event_keys").cast("long").alias("n_events"), "canonical_title", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))


def lineage_components(spark, sf_dir):
    """Stories that may be one, where stories that were split from one another may not."""
    apart = repair.split(repair.Registry.of(repair.prune(registry_entries(spark, sf_dir))))
    edges = repair.links(apart.entries, cut(repair.key_rows(apart.entries)), 1)
    return graph.lineage_safe(edges, apart.roots)


def run_containment(spark, sf_dir):
    """What is mended after a run that brought the shortest fifth of each source's texts."""
    e = cut(registry_entries(spark, sf_dir))
    touched = e.where("priority = 0").select("story_id").distinct()
    _, outcome = repair.contain_run(e, e.select("event_key", "story_id").distinct(), touched)
    return outcome.select("story_id", F.array_join("reasons", ",").alias("reasons"), "index_keys")


_BROAD = "regexp_matches(event_key, '^(?:fire|traffic-crash|missing-person)(?:-[a-z-]+)?$|^unknown-event$')"
CONTAINMENT_SQL = f"""WITH RECURSIVE {ENTRIES_SQL}, broad AS (SELECT DISTINCT story_id FROM entries WHERE {_BROAD}),
asked AS (SELECT story_id FROM entries WHERE priority = 0 UNION SELECT story_id FROM broad),
own AS (SELECT * FROM entries JOIN asked USING (story_id)),
spoken AS (SELECT story_id, bool_or(regexp_matches(lower(title), '{fixed.DEATH_PATTERN}')) AS spoken FROM own GROUP BY 1),
e AS (SELECT * REPLACE (CASE WHEN NOT spoken AND starts_with(event_key, 'named-person-death:') THEN NULL ELSE event_key END AS event_key), event_key AS was, array_to_string({ap._words('title')}, ' ') AS t, list_distinct({ap._TIMELINE('title')}) AS tok, {_FAMILY.replace('headline', 'title')} AS f FROM own JOIN spoken USING (story_id)),
p AS (SELECT a.story_id, a.entry_id AS x, b.entry_id AS y, coalesce(a.event_key = b.event_key, false) OR a.t = b.t AS same, a.f AS af, b.f AS bf, {ap._SHARED('a.tok', 'b.tok')} AS sh, {ap._SHARED('a.tok', 'b.tok')} / least(len(a.tok), len(b.tok)) AS ov FROM e a JOIN e b ON a.story_id = b.story_id AND a.entry_id <> b.entry_id),
w(a, b) AS (SELECT entry_id, entry_id FROM e UNION SELECT w.a, p.y FROM w JOIN p ON w.b = p.x AND (same OR (sh >= 2 AND ov >= 0.30) OR ov >= 0.50)), c AS (SELECT a AS entry_id, min(b) AS part FROM w GROUP BY a),
bad AS (SELECT DISTINCT story_id FROM p WHERE af <> 'unknown' AND bf <> 'unknown' AND af <> bf AND ov < 0.20 AND sh < 2),
sizes AS (SELECT story_id, part, count(*) AS n, count(DISTINCT source) AS sources FROM e JOIN c USING (entry_id) JOIN bad USING (story_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, sources DESC, part) AS rk, count(*) OVER (PARTITION BY story_id) AS parts FROM sizes),
new AS (SELECT story_id, part, row_number() OVER (ORDER BY story_id, part) + (SELECT max(story_id) FROM e) AS new_id FROM k WHERE rk > 1),
d AS (SELECT coalesce(new_id, e.story_id) AS story_id, event_key, url, title FROM e JOIN c USING (entry_id) LEFT JOIN new ON new.story_id = e.story_id AND new.part = c.part),
g AS (SELECT story_id, bool_or({_BROAD}) AS b, count(DISTINCT title) AS titles, count(DISTINCT row(event_key, url, title)) FILTER (event_key IS NOT NULL) AS told, count(DISTINCT event_key) FILTER (NOT {_BROAD}) AS keys FROM d GROUP BY 1),
said AS (
  SELECT story_id, 0 AS n, 'broad_event_mapping_revoked' AS why FROM broad UNION ALL SELECT DISTINCT story_id, 1, 'unsupported_structured_event_key_revoked' FROM e WHERE was IS NOT NULL AND event_key IS NULL
  UNION ALL SELECT DISTINCT story_id, 2, 'timeline_coherence_repaired_split' FROM k WHERE parts > 1
  UNION ALL SELECT story_id, 3, 'legacy_unsuffixed_generic_event_key' FROM g WHERE b UNION ALL SELECT story_id, 4, 'impossible_title_fanout' FROM g WHERE titles >= 8 AND titles > 4 * greatest(1, told)
), aside AS (SELECT DISTINCT story_id FROM said WHERE n >= 3)
SELECT s.story_id, string_agg(why, ',' ORDER BY n) AS reasons, coalesce(max(keys) FILTER (s.story_id NOT IN (SELECT story_id FROM aside)), 0) AS index_keys
FROM said s LEFT JOIN g USING (story_id) GROUP BY s.story_id"""

QUERIES = {
    "entry_moves": (entry_moves, MOVES_SQL),
    "repair_passes": (repair_passes, None),
    "lineage_components": (lineage_components, None),
    "run_containment": (run_containment, CONTAINMENT_SQL),
}
