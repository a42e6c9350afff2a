"""Queries over articles: tokens, claims, quality, relevance, importance and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators import pairs
from tidewire.sources.views import ARTICLES_SQL, _quoted, articles

# -- SQL building blocks, written for DuckDB ---------------------------------------------


def _words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _sorted(tokens: str) -> str:
    return f"array_to_string(list_sort(list_distinct({tokens})), ' ')"


def _keep(tokens: str, least: int, stop, digits: bool = False) -> str:
    ok = f"(length(x) >= {least} OR regexp_full_match(x, '[0-9]+'))" if digits else f"length(x) >= {least}"
    return f"list_filter({tokens}, lambda x: {ok} AND NOT list_contains({_quoted(stop)}, x))"


_CANON_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.HEADLINE_CANON.items()) + "}"


def _canon(c: str) -> str:
    raw = f"list_filter({_words(f'replace(lower({c}), {chr(39)}st.{chr(39)}, {chr(39)}st{chr(39)})')}, lambda x: NOT list_contains({_quoted(fixed.HEADLINE_STOP)}, x))"
    return f"list_transform({raw}, lambda x: coalesce({_CANON_MAP}[x], x))"


_TITLE = lambda c: _keep(_words(c), 3, fixed.TITLE_STOP)
_HEAD = lambda c: f"list_filter({_canon(c)}, lambda x: length(x) >= 2 OR regexp_full_match(x, '[0-9]+'))"
_CONTENT = lambda c: _keep(_canon(f"substr({c}, 1, 12000)"), 3, fixed.CONTEXT_TOKENS, True)
_STEM = """CASE WHEN ends_with(x, 'ies') AND length(x) > 6 THEN left(x, length(x) - 3) || 'y'
  WHEN ends_with(x, 'ing') AND length(x) > 6 THEN left(x, length(x) - 3) WHEN ends_with(x, 'ed') AND length(x) > 5 THEN left(x, length(x) - 2)
  WHEN ends_with(x, 'es') AND length(x) > 5 THEN left(x, length(x) - 2) WHEN ends_with(x, 's') AND length(x) > 4 THEN left(x, length(x) - 1) ELSE x END"""
_TIMELINE = lambda c: f"list_transform({_keep(_words(c), 2, fixed.TIMELINE_STOP)}, lambda x: {_STEM})"
_SIGNATURE = lambda c: f"list_transform(list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda x: length(x) > 3 AND NOT list_contains({_quoted(fixed.ARCHIVE_STOP)}, lower(x))), lambda x: trim(lower(x), '.,;:()'))"
_FOCUS = lambda c: _keep(_words(c), 4, fixed.FOCUS_STOP)
_RESOLVER = lambda c: _keep(_words(c), 3, fixed.RESOLVER_STOP)
_SPLIT_TITLE = r"regexp_split_to_array(trim(headline), '\s+(?:-|–|—|\|)\s+')"
_SOURCE_HEAD = f"CASE WHEN len({_SPLIT_TITLE}) > 1 AND len(regexp_extract_all(({_SPLIT_TITLE})[-1], '[a-z0-9]+')) <= 6 THEN array_to_string(({_SPLIT_TITLE})[:-2], ' ') ELSE trim(headline) END"
_SHARED = lambda a, b: f"len(list_intersect({a}, {b}))"
_SPACE = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_WORDS_N = lambda c: f"len(regexp_extract_all({c}, '[\\p{{L}}\\p{{M}}\\p{{N}}_’''-]*[\\p{{L}}\\p{{M}}\\p{{N}}_][\\p{{L}}\\p{{M}}\\p{{N}}_’''-]*'))"


def _any(c: str, phrases) -> str:
    return f"len(list_filter({_quoted(phrases)}, lambda p: contains({c}, p))) > 0"


# -- tokens ------------------------------------------------------------------------------


def title_token_sets(spark, sf_dir):
    """What each tokenizer keeps of every headline, sorted."""
    a = articles(spark, sf_dir)
    h = F.col("headline")
    kept = {"title": text.title_tokens, "headline": text.headline_tokens, "timeline": text.timeline_tokens, "signature": text.signature_tokens, "source_title": text.source_title_tokens, "focus": text.focus_tokens, "resolver": text.resolver_tokens}
    return a.select("article_id", *[F.array_join(F.array_sort(F.array_distinct(f(h))), " ").alias(n) for n, f in kept.items()])


TITLE_TOKENS_SQL = f"""WITH {ARTICLES_SQL} SELECT article_id, {_sorted(_TITLE('headline'))} AS title, {_sorted(_HEAD('headline'))} AS headline,
  {_sorted(_TIMELINE('headline'))} AS timeline, {_sorted(_SIGNATURE('headline'))} AS signature,
  {_sorted(_keep(_words(_SOURCE_HEAD), 3, fixed.SOURCE_TITLE_NOISE, True))} AS source_title,
  {_sorted(_FOCUS('headline'))} AS focus, {_sorted(_RESOLVER('headline'))} AS resolver FROM articles"""


def content_token_counts(spark, sf_dir):
    """Number and digest of the distinct content tokens of every article."""
    t = text.content_tokens(F.concat_ws(" ", "headline", "source_title", "body"))
    return articles(spark, sf_dir).select("article_id", t.alias("t")).select("article_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("tokens_sha256"))


CONTENT_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id, list_distinct({_CONTENT("(headline || ' ' || source_title || ' ' || body)")}) AS t FROM articles)
SELECT article_id, len(t) AS n_tokens, sha256(array_to_string(list_sort(t), ' ')) AS tokens_sha256 FROM t"""


# -- claims and quality ------------------------------------------------------------------


def claims(spark, sf_dir):
    """Money, percentages, named measures and states claimed in every headline."""
    h = F.col("headline")
    return articles(spark, sf_dir).select(
        "article_id", F.array_join(F.transform(text.money_claims(h), lambda x: x.cast("string")), ",").alias("money"), F.array_join(text.percent_claims(h), ",").alias("percent"),
        F.array_join(text.measure_claims(h), ",").alias("measures"), F.array_join(F.array_sort(text.states_in(h)), ",").alias("states"),
    )


def _money_sql(c: str) -> str:
    low = f"regexp_replace(lower({c}), '[-_]', ' ', 'g')"
    mult = "MAP {'billion': 1e9, 'b': 1e9, 'million': 1e6, 'm': 1e6, 'thousand': 1e3, 'k': 1e3}"
    unit = "(?:billion|million|thousand|[bmk])"
    scaled = f"list_transform(list_filter(regexp_extract_all(' ' || {low}, '[^a-z0-9]\\$?\\s*\\d+(?:\\.\\d+)?\\s*{unit}\\b'), lambda x: true), lambda x: CAST(round_even(CAST(regexp_extract(x, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) * {mult}[regexp_extract(x, '([a-z]+)$', 1)], 0) AS BIGINT))"
    plain = f"list_transform(list_filter(regexp_extract_all(' ' || {low}, '[^a-z0-9]\\$\\s*\\d[\\d,]*(?:\\.\\d+)?(?:\\s*{unit}\\b)?'), lambda x: NOT regexp_matches(x, '[a-z]$')), lambda x: CAST(round_even(CAST(replace(regexp_extract(x, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', '') AS DOUBLE), 0) AS BIGINT))"
    return f"list_sort(list_distinct(list_concat({scaled}, {plain})))"


def _states_sql(c: str) -> str:
    return f"list_sort(list_filter({_quoted(fixed.STATES)}, lambda s: regexp_matches(lower({_SPACE(c)}), '\\b' || replace(s, '.', '\\.') || '\\b')))"


def _percent_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '\\b(\\d+(?:\\.\\d+)?)\\s*%', 1), lambda x: rtrim(rtrim(x, '0'), '.'))))"


def _measures_sql(c: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(lower({c}), '{fixed.MEASURES}'), lambda x: {_SPACE('x')})))"


CLAIMS_SQL = f"""WITH {ARTICLES_SQL} SELECT article_id, array_to_string({_money_sql('headline')}, ',') AS money, array_to_string({_percent_sql('headline')}, ',') AS percent,
  array_to_string({_measures_sql('headline')}, ',') AS measures, array_to_string({_states_sql('headline')}, ',') AS states FROM articles"""


def quality_reasons(spark, sf_dir):
    """Why an article fails as a card: lengths, refusal, structure, and headline claims its lead lacks."""
    a = articles(spark, sf_dir).select("article_id", "headline", "body", text.first_paragraph(F.col("body")).alias("lead"), text.words_upto(F.col("body"), fixed.CARD_MOST_WORDS).alias("n"))
    lead, n, h = F.col("lead"), F.col("n"), F.col("headline")
    # a lead is searched only where the headline claims something
    lost = lambda f: text.bind(f(h), lambda own: F.when(F.size(own) > 0, F.size(F.array_except(own, f(lead))) > 0).otherwise(False))
    checks = [
        (n < fixed.CARD_WORDS, f"body_under_{fixed.CARD_WORDS}_words"),
        (n > fixed.CARD_MOST_WORDS, f"card_body_over_{fixed.CARD_MOST_WORDS}_words"),
        (n < fixed.SOURCE_WORDS, f"source_under_{fixed.SOURCE_WORDS}_words"),
        (text.bind(F.lower("body"), text.refuses), "ai_refusal_or_task_dialogue_in_article"),
        (text.paragraph_count(F.col("body")) < 2, "card_requires_two_paragraph_summary"),
        (text.word_count(h) < 4, "weak_or_missing_headline"),
        (text.words_upto(lead, 19) < 20, "lead_too_thin"),
        (lost(text.money_claims), "headline_money_claim_missing_from_lead"),
        (lost(text.percent_claims), "headline_percentage_claim_missing_from_lead"),
        (lost(text.states_in), "headline_jurisdiction_missing_from_lead"),
        (lost(text.measure_claims), "headline_named_measure_missing_from_lead"),
    ]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks])))
    return a.select("article_id", reasons.alias("r")).select("article_id", (F.size("r") == 0).alias("ok"), F.array_join("r", ",").alias("reasons"))


_LOST = lambda f: f"len(list_filter({f('headline')}, lambda q: NOT list_contains({f('lead')}, q))) > 0"
QUALITY_SQL = f"""WITH {ARTICLES_SQL}, l AS (SELECT *, regexp_split_to_array(trim(body), '\\n\\s*\\n')[1] AS lead, {_WORDS_N('body')} AS n FROM articles),
r AS (SELECT article_id, list_sort(list_filter([
  CASE WHEN n < 60 THEN 'body_under_60_words' END, CASE WHEN n > 140 THEN 'card_body_over_140_words' END, CASE WHEN n < 80 THEN 'source_under_80_words' END,
  CASE WHEN regexp_matches(lower(body), '{fixed.REFUSAL}') THEN 'ai_refusal_or_task_dialogue_in_article' END,
  CASE WHEN len(list_filter(regexp_split_to_array(body, '\\n\\s*\\n'), lambda p: {_WORDS_N('p')} >= 8)) < 2 THEN 'card_requires_two_paragraph_summary' END,
  CASE WHEN {_WORDS_N('headline')} < 4 THEN 'weak_or_missing_headline' END, CASE WHEN {_WORDS_N('lead')} < 20 THEN 'lead_too_thin' END,
  CASE WHEN {_LOST(_money_sql)} THEN 'headline_money_claim_missing_from_lead' END, CASE WHEN {_LOST(_percent_sql)} THEN 'headline_percentage_claim_missing_from_lead' END,
  CASE WHEN {_LOST(_states_sql)} THEN 'headline_jurisdiction_missing_from_lead' END, CASE WHEN {_LOST(_measures_sql)} THEN 'headline_named_measure_missing_from_lead' END
], lambda x: x IS NOT NULL)) AS r FROM l)
SELECT article_id, len(r) = 0 AS ok, array_to_string(r, ',') AS reasons FROM r"""


def focus_drift(spark, sf_dir):
    """Whether an article's headline and lead drift from its source's title and opening."""
    a = articles(spark, sf_dir)
    st, gh = text.focus_tokens(F.col("source_title")), text.focus_tokens(F.col("headline"))
    sl = text.focus_tokens(text.opening(F.col("body")))
    gl = text.focus_tokens(text.opening(text.first_paragraph(F.col("body"))))
    t = a.select("article_id", st.alias("st"), gh.alias("gh"), sl.alias("sl"), gl.alias("gl"), text.word_count(F.col("body")).alias("n"))
    part = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))
    need = (F.size("st") >= 5) & (F.size("sl") >= 8) & (F.col("n") >= 35)
    drift = (part("gh", "st") < 0.38) & (F.size(F.array_intersect("gh", "st")) <= 3) & (part("gl", "sl") < 0.30)
    return t.select("article_id", need.alias("required"), (need & drift).alias("drifted"), F.bround(part("gh", "st"), 3).alias("title_overlap"), F.bround(part("gl", "sl"), 3).alias("lead_overlap"))


def _opening_sql(c: str) -> str:
    sentences = f"list_filter(string_split(regexp_replace({_SPACE(c)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
    return f"array_to_string(list_slice(string_split(array_to_string(list_slice({sentences}, 1, 2), ' '), ' '), 1, 80), ' ')"


_PART_SQL = lambda a, b: f"{_SHARED(a, b)} / greatest(1, least(len({a}), len({b})))"
FOCUS_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id, list_distinct({_FOCUS('source_title')}) AS st, list_distinct({_FOCUS('headline')}) AS gh,
  list_distinct({_FOCUS(_opening_sql('body'))}) AS sl, list_distinct({_FOCUS(_opening_sql("regexp_split_to_array(trim(body), '\\n\\s*\\n')[1]"))}) AS gl, {_WORDS_N('body')} AS n FROM articles),
p AS (SELECT *, len(st) >= 5 AND len(sl) >= 8 AND n >= 35 AS need, {_PART_SQL('gh', 'st')} AS a, {_PART_SQL('gl', 'sl')} AS b, {_SHARED('gh', 'st')} AS s FROM t)
SELECT article_id, need AS required, need AND a < 0.38 AND s <= 3 AND b < 0.30 AS drifted, round_even(a, 3) AS title_overlap, round_even(b, 3) AS lead_overlap FROM p"""


# -- relevance, importance and facts -----------------------------------------------------


def relevance(spark, sf_dir):
    """National scope and score of every headline."""
    s = articles(spark, sf_dir).select("article_id", text.relevance_scope(F.col("headline")).alias("s"))
    return s.select("article_id", text.scope_name(F.col("s")).alias("scope"), text.scope_score(F.col("s")).alias("score"))


_SCOPE_SQL = f"""(SELECT article_id, CASE WHEN {_any('low', fixed.FEDERAL_SIGNALS)} THEN 'us_national' WHEN len(st) >= 2 THEN 'us_multistate' WHEN len(st) = 1 THEN 'us_state_regional'
  WHEN frn AND mjr THEN 'global_major' WHEN frn THEN 'international' WHEN mjr THEN 'global_major_only' ELSE 'unknown' END AS s
FROM (SELECT article_id, ' ' || lower({_SPACE('headline')}) || ' ' AS low, {_states_sql('headline')} AS st,
  regexp_matches(' ' || lower({_SPACE('headline')}) || ' ', '\\b(?:{"|".join(fixed.FOREIGN_SIGNALS)})\\b') AS frn,
  {_any(f"lower({_SPACE('headline')})", fixed.GLOBAL_SIGNALS)} AS mjr FROM articles))"""
_SCOPE_POINTS = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in (fixed.SCOPE_SCORE | {"global_major_only": 85}).items()) + " END"
RELEVANCE_SQL = f"WITH {ARTICLES_SQL} SELECT article_id, CASE WHEN s = 'global_major_only' THEN 'global_major' ELSE s END AS scope, {_SCOPE_POINTS} AS score FROM {_SCOPE_SQL}"


def importance(spark, sf_dir):
    """Importance score, level and reason codes of every headline."""
    a = articles(spark, sf_dir).withColumn("scope", text.scope_name(text.relevance_scope(F.col("headline"))))
    r = a.select("article_id", text.importance_reasons(F.col("headline"), F.col("scope"), F.lit(1), F.lit(0)).alias("r"))
    r = r.withColumn("score", text.importance_score(F.col("r")))
    return r.select("article_id", "score", text.importance_level(F.col("score")).alias("level"), F.array_join(F.transform("r", lambda x: x["code"]), ",").alias("reasons"))


_RULES = ", ".join(f"CASE WHEN {_any('low', p)} THEN {{'c': '{c}', 'p': {n}}} END" for c, n, p in fixed.IMPORTANCE)
_DEAD = "coalesce(list_max(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(low, '{p}', 1)" for p in fixed.FATALITY_PATTERNS) + "), lambda x: CAST(x AS INTEGER))), 0)"
IMPORTANCE_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT a.article_id, lower(headline) AS low, s FROM articles a JOIN {_SCOPE_SQL} USING (article_id)),
r AS (SELECT article_id, list_filter([{_RULES},
  CASE WHEN {_DEAD} >= 50 THEN {{'c': 'mass_casualty', 'p': 45}} WHEN {_DEAD} >= 10 THEN {{'c': 'multi_fatality', 'p': 30}} WHEN {_DEAD} >= 2 THEN {{'c': 'multiple_deaths', 'p': 18}}
    WHEN regexp_matches(low, '{fixed.DEATH_PATTERN}') THEN {{'c': 'single_death', 'p': 6}} END,
  CASE WHEN s = 'us_national' THEN {{'c': 'national_scope', 'p': 15}} WHEN s = 'us_multistate' THEN {{'c': 'multistate_scope', 'p': 10}} WHEN s IN ('global_major', 'global_major_only') THEN {{'c': 'global_scope', 'p': 10}} END
], lambda x: x IS NOT NULL) AS r FROM t), p AS (SELECT article_id, r, CAST(least(100, greatest(0, coalesce(list_sum(list_transform(r, lambda x: x.p)), 0))) AS INTEGER) AS score FROM r)
SELECT article_id, score, CASE WHEN score >= 80 THEN 'breaking' WHEN score >= 55 THEN 'high' WHEN score >= 25 THEN 'normal' ELSE 'low' END AS level, array_to_string(list_transform(r, lambda x: x.c), ',') AS reasons FROM p"""


def facts_and_keys(spark, sf_dir):
    """Event types, quantified facts and the event key of every headline."""
    h = F.col("headline")
    t = articles(spark, sf_dir).select("article_id", text.event_types(h).alias("types"), text.quantified_facts(h).alias("facts"), text.states_in(h).alias("states"))
    suffix = text.digest(F.col("article_id").cast("string"), 10)
    kind = text.slug(F.get("types", F.lit(0)))
    key = F.concat_ws("-", kind, F.coalesce(text.slug(F.get("states", F.lit(0))), suffix), F.when(kind.isin(*fixed.SPARSE_EVENTS), suffix))
    return t.select("article_id", F.array_join("types", ",").alias("event_types"), F.array_join("facts", ",").alias("facts"), F.when(F.size("types") == 0, F.concat(F.lit("unknown-event-"), suffix)).otherwise(F.when(F.size("states") == 0, F.concat_ws("-", kind, suffix, F.when(kind.isin(*fixed.SPARSE_EVENTS), suffix))).otherwise(key)).alias("event_key"))


_SLUG = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"
_NUMBERS = "|".join(fixed.NUMBER_WORDS)
_TYPES = ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END" for n, p in fixed.EVENT_PATTERNS)
FACTS_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id, lower(headline) AS low, list_filter({_quoted(fixed.STATES)}, lambda s: regexp_matches(lower({_SPACE('headline')}), '\\b' || replace(s, '.', '\\.') || '\\b')) AS st FROM articles),
f AS (SELECT article_id, st, substr(sha256(CAST(article_id AS VARCHAR)), 1, 10) AS sfx, list_filter([{_TYPES}], lambda x: x IS NOT NULL) AS ty,
  list_concat(list_transform(regexp_extract_all(low, '\\b(?:\\d{{1,5}}|{_NUMBERS})\\s+(?:people\\s+)?(?:were\\s+)?(?:killed|dead|injured|arrested)\\b'),
    lambda m: coalesce(CAST(nullif(list_position({_quoted(fixed.NUMBER_WORDS)}, regexp_extract(m, '^(\\S+)', 1)), 0) AS VARCHAR), regexp_extract(m, '^(\\S+)', 1)) || ' people ' || regexp_extract(m, '(\\S+)$', 1)),
    list_transform(regexp_extract_all(low, '\\b(\\d{{1,3}})[- ]year[- ]old\\b', 1), lambda m: m || '-year-old')) AS fa FROM t)
SELECT article_id, array_to_string(ty, ',') AS event_types, array_to_string(fa, ',') AS facts,
  CASE WHEN len(ty) = 0 THEN 'unknown-event-' || sfx ELSE {_SLUG('ty[1]')} || '-' || CASE WHEN len(st) = 0 THEN sfx ELSE {_SLUG('st[1]')} END ||
    CASE WHEN {_SLUG('ty[1]')} IN ('traffic-crash', 'fire', 'missing-person') THEN '-' || sfx ELSE '' END END AS event_key FROM f"""


def article_ids(spark, sf_dir):
    """Stable article ids, headline keys, slugs and the image rotation slot of every article."""
    a = articles(spark, sf_dir)
    raw = F.lower(F.concat_ws("|", "source", "headline", F.col("article_id").cast("string")))
    full = F.sha2("headline", 256)
    return a.select("article_id", F.concat(F.lit("rss-"), text.digest(raw, 20)).alias("entry_id"), text.headline_key(F.col("headline")).alias("headline_key"), text.slug(F.col("headline")).alias("slug"), text.hash_mod(full, 7).alias("slot"))


IDS_SQL = f"""WITH {ARTICLES_SQL}, h AS (SELECT *, sha256(headline) AS d FROM articles)
SELECT article_id, 'rss-' || substr(sha256(lower(source || '|' || headline || '|' || article_id)), 1, 20) AS entry_id,
  trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g')) AS headline_key, {_SLUG('headline')} AS slug,
  CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(8), lambda i: CAST(CAST('0x' || substr(d, CAST(i * 8 + 1 AS INTEGER), 8) AS BIGINT) AS HUGEINT))), lambda t, x: (t * 4294967296 + x) % 7) AS BIGINT) AS slot FROM h"""


# -- pairs -------------------------------------------------------------------------------


def overlapping_titles(spark, sf_dir):
    """The articles whose headlines overlap each one's strongly: 4 shared tokens, and .70 of the smaller or .55 of both.

    One row for an article: its set of tokens (by the first article that has it), the
    sets and articles linked to it, and the nearest set. Jaccard of .55 is a containment
    of .70 at least, as what is shared is .55 / 1.55 of both sizes together.
    """
    a = articles(spark, sf_dir).select(F.col("article_id").alias("id"), text.title_tokens(F.col("headline")).alias("tokens"))
    return pairs.linked_sets(a, 4, 0.70, "containment >= 0.70 or jaccard >= 0.55").select(F.col("id").alias("article_id"), "set_id", "n_sets", "n_ids", "nearest")


OVERLAP_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id AS id, list_sort(list_distinct({_TITLE('headline')})) AS t FROM articles),
s AS (SELECT t, min(id) AS set_id, count(*) AS own FROM t GROUP BY t),
p AS (SELECT l.set_id, r.set_id AS other, r.own AS n, {_SHARED('l.t', 'r.t')} AS shared, len(l.t) AS a, len(r.t) AS b FROM s l JOIN s r ON l.set_id <> r.set_id),
k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(shared / (a + b - shared), 9) DESC, other) AS rn FROM p WHERE shared >= 4 AND (shared / least(a, b) >= 0.70 OR shared / (a + b - shared) >= 0.55)),
g AS (SELECT set_id, count(*) AS n_sets, sum(n) AS n, max(other) FILTER (rn = 1) AS nearest FROM k GROUP BY 1)
SELECT t.id AS article_id, s.set_id, coalesce(g.n_sets, 0) AS n_sets, CAST(coalesce(g.n, 0) + s.own - 1 AS BIGINT) AS n_ids, g.nearest FROM t JOIN s USING (t) LEFT JOIN g ON g.set_id = s.set_id"""


def recent_candidates(spark, sf_dir):
    """The 4 best earlier articles, within 7 days and from .5 on, for each article: blended headline overlap, then day gap, then id."""
    a = articles(spark, sf_dir).select(F.col("article_id").alias("id"), text.title_tokens(F.col("headline")).alias("tokens"), F.to_date("published_at").alias("day"))
    return pairs.top_candidates(a, window_days=7, least_shared=5, least_score=0.5, k=4)


CANDIDATES_SQL = f"""WITH {ARTICLES_SQL}, t AS (SELECT article_id AS id, list_distinct({_TITLE('headline')}) AS t, CAST(published_at AS DATE) AS day FROM articles),
p AS (SELECT l.id AS probe_id, r.id AS candidate_id, abs(date_diff('day', l.day, r.day)) AS gap, {_SHARED('l.t', 'r.t')} AS shared, len(l.t) AS a, len(r.t) AS b
  FROM t l JOIN t r ON r.id < l.id AND abs(date_diff('day', l.day, r.day)) <= 7),
s AS (SELECT *, round_even(0.72 * (shared / least(a, b)) + 0.28 * (shared / (a + b - shared)), 4) AS score FROM p WHERE shared >= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, gap, candidate_id DESC) AS rank FROM s WHERE score >= 0.5)
SELECT probe_id, CAST(rank AS INTEGER) AS rank, candidate_id, score, CAST(gap AS INTEGER) AS day_gap FROM k WHERE rank <= 4"""


def archive_lookup(spark, sf_dir):
    """The archived article each probe belongs to: by source address, story id, then headline signature; the first in archive order."""
    n = F.col("article_id")
    url = F.concat(F.lit("https://News.org/stories/"), F.when(n % 3 == 0, F.concat(F.lit("g"), F.floor(n / 14).cast("string"))).otherwise(n.cast("string")), F.when(n % 2 == 0, "/").otherwise("?from=feed"))
    a = articles(spark, sf_dir).withColumn("url", F.when(n % 5 != 0, url))
    archive = a.where("article_id % 2 = 0").select("url", F.col("article_id").alias("pos"), F.floor(F.col("article_id") / 10).alias("story_id"), text.signature_tokens(F.col("headline")).alias("tokens"))
    probes = a.where("article_id % 2 = 1").select("article_id", "url", F.floor(F.col("article_id") / 15).alias("story_id"), text.signature_tokens(F.concat_ws(" ", "headline", "source_title")).alias("tokens"))
    return pairs.archive_match(probes, archive)


ARCHIVE_SQL = f"""WITH {ARTICLES_SQL}, s AS (SELECT article_id, list_distinct({_SIGNATURE('headline')}) AS t, list_distinct({_SIGNATURE("(headline || ' ' || source_title)")}) AS u FROM articles),
m AS (SELECT p.article_id, a.article_id AS pos, CASE WHEN p.article_id % 5 <> 0 AND a.article_id % 5 <> 0 AND p.article_id % 3 = 0 AND a.article_id % 3 = 0 AND p.article_id // 14 = a.article_id // 14 THEN 1 WHEN p.article_id // 15 = a.article_id // 10 THEN 2
    WHEN len(p.u) >= 3 AND {_SHARED('p.u', 'a.t')} >= 4 AND len(list_filter(list_intersect(p.u, a.t), lambda x: NOT list_contains({_quoted(fixed.LEGAL_FRAME)}, x))) >= 2 THEN 3 END AS tier
  FROM s p JOIN s a ON p.article_id % 2 = 1 AND a.article_id % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY tier, pos) AS rn FROM m WHERE tier IS NOT NULL)
SELECT article_id, tier, pos AS archive_id FROM b WHERE rn = 1"""


def headline_similarity(spark, sf_dir):
    """Blended set and sequence similarity of each article's headline and its source's title."""
    return pairs.headline_similarity(articles(spark, sf_dir).select("article_id", "headline", "source_title"))


QUERIES = {
    "title_token_sets": (title_token_sets, TITLE_TOKENS_SQL),
    "content_token_counts": (content_token_counts, CONTENT_SQL),
    "claims": (claims, CLAIMS_SQL),
    "quality_reasons": (quality_reasons, QUALITY_SQL),
    "focus_drift": (focus_drift, FOCUS_SQL),
    "relevance": (relevance, RELEVANCE_SQL),
    "importance": (importance, IMPORTANCE_SQL),
    "facts_and_keys": (facts_and_keys, FACTS_SQL),
    "article_ids": (article_ids, IDS_SQL),
    "overlapping_titles": (overlapping_titles, OVERLAP_SQL),
    "recent_candidates": (recent_candidates, CANDIDATES_SQL),
    "archive_lookup": (archive_lookup, ARCHIVE_SQL),
    "headline_similarity": (headline_similarity, None),
}
