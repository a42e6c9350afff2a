"""Queries over raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import fixed, pages, text, urls
from tidewire.operators import ordered
from tidewire.sources.views import _quoted, table, web_pages

# -- SQL building blocks, written for DuckDB ---------------------------------------------

_PART = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(n: int, c: str = "url") -> str:
    return f"regexp_extract(trim({c}), '{_PART}', {n})"


_DOMAIN = f"regexp_replace(regexp_replace(lower({_part(2)}), ':.*$', ''), '^www\\.', '')"
_IDENTITY_SQL = f"""u AS (
  SELECT *, lower({_part(1)}) AS sch, lower({_part(2)}) AS hst,
    regexp_replace(CASE WHEN {_part(3)} = '' THEN '/' ELSE {_part(3)} END, '/{{2,}}', '/', 'g') AS pth, {_part(4)} AS qry
  FROM pages
), s AS (
  SELECT *, list_filter(string_split(lower(pth), '/'), lambda x: x <> '') AS seg,
    hst = 'news.google.com' AND starts_with(lower(pth), '/rss/articles/') AS art,
    list_sort(list_filter(string_split(qry, '&'), lambda x: x <> '' AND NOT list_contains({_quoted(fixed.IDENTITY_TRACKING)}, lower(regexp_extract(x, '^([^=]*)', 1))))) AS kv,
    regexp_replace(hst, CASE WHEN sch = 'http' THEN ':80$' ELSE ':443$' END, '') AS loc
  FROM u
), identity AS (
  SELECT page_id, url, html, CASE WHEN sch NOT IN ('http', 'https') OR hst = '' OR (hst = 'news.google.com' AND NOT art)
      OR (NOT art AND (regexp_matches(lower(pth), '\\.(?:rss|xml|atom)/?$') OR len(list_intersect(seg, ['feed', 'feeds', 'rss'])) > 0 OR len(seg) < 2)) THEN ''
    ELSE sch || '://' || loc || CASE WHEN rtrim(pth, '/') = '' THEN '/' ELSE rtrim(pth, '/') END ||
      CASE WHEN len(kv) > 0 AND NOT art THEN '?' || array_to_string(list_transform(kv, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END
    END AS identity_url
  FROM s
)"""


def _plain(expr: str) -> str:
    for name, value in pages.ENTITIES.items():
        expr = f"replace({expr}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


_TITLE = _plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_BODY = _plain("regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<title.*?</title>', ' ', 'g'), '<[^>]+>', ' ', 'g')")
_WEB_SQL = f"""{_IDENTITY_SQL}, web AS (
  SELECT page_id, url, {_DOMAIN} AS domain, identity_url, {_TITLE} AS title, {_BODY} AS body FROM identity
), w AS (SELECT *, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END AS n_words FROM web)"""
_QUALITY = "CASE WHEN n_words >= 140 THEN 'full' WHEN n_words >= 80 THEN 'summary' WHEN n_words >= 40 THEN 'brief' ELSE 'thin' END"


# -- queries ---------------------------------------------------------------------------


def page_quality_by_domain(spark, sf_dir):
    """One page for each identity URL (the longest), then counts and mean words by domain and quality, the 20 largest."""
    p = web_pages(spark, sf_dir).select("page_id", "domain", "identity_url", "n_words").where("identity_url <> ''")
    best = ordered.first_by(p, ["identity_url"], [F.desc("n_words"), F.asc("page_id")])
    q = best.withColumn("quality", pages.quality(F.col("n_words"), F.lit(False)))
    out = q.groupBy("domain", "quality").agg(F.count(F.lit(1)).alias("n_pages"), F.bround(F.avg("n_words"), 2).alias("mean_words"))
    return out.orderBy(F.desc("n_pages"), "domain", "quality").limit(20)


PAGE_QUALITY_SQL = f"""WITH {_WEB_SQL}, b AS (
  SELECT *, row_number() OVER (PARTITION BY identity_url ORDER BY n_words DESC, page_id) AS rn FROM w WHERE identity_url <> ''
)
SELECT domain, {_QUALITY} AS quality, count(*) AS n_pages, round_even(avg(n_words), 2) AS mean_words
FROM b WHERE rn = 1 GROUP BY ALL ORDER BY n_pages DESC, domain, quality LIMIT 20"""


def url_forms(spark, sf_dir):
    """The normal form of each caller for every page's URL."""
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", urls.cache_url(u).alias("cache_url"), urls.ranking_url(u).alias("ranking_url"), urls.archive_url(u).alias("archive_url"), urls.identity_url(u).alias("identity_url"), urls.domain(u).alias("domain"))


def _form(drop: str, path: str) -> str:
    kv = f"list_filter(string_split({_part(4)}, '&'), lambda x: x <> '' AND NOT (starts_with(lower(regexp_extract(x, '^([^=]*)', 1)), 'utm_') OR list_contains({drop}, lower(regexp_extract(x, '^([^=]*)', 1)))))"
    built = f"array_to_string(list_transform({kv}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&')"
    return f"CASE WHEN {_part(1)} = '' THEN trim(url) ELSE lower({_part(1)}) || '://' || lower({_part(2)}) || {path} || CASE WHEN len({kv}) > 0 THEN '?' || {built} ELSE '' END END"


URL_FORMS_SQL = f"""WITH {_IDENTITY_SQL}
SELECT page_id,
  {_form(_quoted(fixed.CACHE_TRACKING), f"regexp_replace(CASE WHEN {_part(3)} = '' THEN '/' ELSE {_part(3)} END, '/{{2,}}', '/', 'g')")} AS cache_url,
  {_form(_quoted(fixed.RANKING_TRACKING), f"rtrim({_part(3)}, '/')")} AS ranking_url,
  regexp_replace(rtrim(lower(trim(url)), '/'), '[?#].*$', '') AS archive_url,
  identity_url, {_DOMAIN} AS domain
FROM identity"""


def domain_rollup(spark, sf_dir):
    """Pages, distinct identity URLs and source type by domain."""
    p = table(spark, sf_dir, "pages").select(urls.domain(F.col("url")).alias("domain"), urls.identity_url(F.col("url")).alias("identity_url"))
    out = p.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct(F.when(F.col("identity_url") != "", F.col("identity_url"))).alias("n_articles"))
    return out.withColumn("source_type", urls.source_type(F.col("domain")))


DOMAIN_ROLLUP_SQL = f"""WITH {_IDENTITY_SQL}, d AS (SELECT {_DOMAIN} AS domain, nullif(identity_url, '') AS i FROM identity)
SELECT domain, count(*) AS n_pages, count(DISTINCT i) AS n_articles,
  CASE WHEN domain = 'news.google.com' OR ends_with(domain, '.news.google.com') THEN 'aggregator'
    WHEN len(list_filter({_quoted(fixed.DISCOVERY_DOMAINS)}, lambda x: domain = x OR ends_with(domain, '.' || x))) > 0 THEN 'discovery_only'
    WHEN domain <> '' THEN 'full_source' ELSE 'unknown' END AS source_type
FROM d GROUP BY domain"""


def page_text(spark, sf_dir):
    """Title, word count and digest of the body of every page."""
    return web_pages(spark, sf_dir).select("page_id", "title", F.col("n_words").cast("long").alias("n_words"), F.sha2("body", 256).alias("body_sha256"))


PAGE_TEXT_SQL = f"WITH {_WEB_SQL} SELECT page_id, title, CAST(n_words AS BIGINT) AS n_words, sha256(body) AS body_sha256 FROM w"


def article_texts(spark, sf_dir):
    """Which rule gives a page's article text, with its words and digest."""
    t = table(spark, sf_dir, "pages").select("page_id", pages.article_text(F.col("html")).alias("t")).select("page_id", "t.rule", "t.text")
    return t.select("page_id", "rule", pages.space_words(F.col("text")).cast("long").alias("n_words"), F.sha2("text", 256).alias("text_sha256"))


def _cleaned(expr: str) -> str:
    visible = _plain(f"regexp_replace(regexp_replace({expr}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")
    parts = f"string_split(regexp_replace({visible}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))"
    kept = f"list_filter({parts}, lambda s: len(list_filter(string_split(s, ' '), lambda w: w <> '')) >= 5 AND len(list_filter({_quoted(fixed.PAGE_JUNK)}, lambda j: contains(lower(s), j))) = 0)"
    return f"array_to_string(list_slice(list_filter(string_split(array_to_string({kept}, ' '), ' '), lambda w: w <> ''), 1, {fixed.ARTICLE_MOST_WORDS}), ' ')"


_LD = fixed.LD_JSON.replace("'", "''")
ARTICLE_TEXTS_SQL = f"""WITH b AS (SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '{_LD}', 1), lambda x: json_extract_string(try_cast(x AS JSON), '$.articleBody')), lambda x: x <> '') AS bodies,
  CASE WHEN regexp_matches(html, '{fixed.ARTICLE}') THEN regexp_extract(html, '{fixed.ARTICLE}', 1) ELSE html END AS scope FROM pages),
c AS (SELECT page_id, list_filter(list_transform(bodies, lambda x: {_cleaned('x')}), lambda x: len(string_split(x, ' ')) >= {fixed.FULL_SOURCE_WORDS}) AS told, {_cleaned(f"array_to_string(regexp_extract_all(scope, '{fixed.PARAGRAPH}', 1), ' ')")} AS blocks FROM b),
t AS (SELECT page_id, CASE WHEN len(told) > 0 THEN 'json_ld' WHEN blocks <> '' AND len(string_split(blocks, ' ')) >= {fixed.SOURCE_WORDS} THEN 'paragraphs' ELSE 'none' END AS rule, told, blocks FROM c),
x AS (SELECT page_id, rule, CASE rule WHEN 'json_ld' THEN told[1] WHEN 'paragraphs' THEN blocks ELSE '' END AS text FROM t)
SELECT page_id, rule, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS BIGINT) AS n_words, sha256(text) AS text_sha256 FROM x"""


def depth_gate(spark, sf_dir):
    """Pages in and out of the depth gate (full or summary, 80 words) by domain, with a histogram of what fails."""
    w = web_pages(spark, sf_dir).select("domain", "n_words").withColumn("quality", pages.quality(F.col("n_words"), F.lit(False)))
    ready = F.col("quality").isin("full", "summary") & (F.col("n_words") >= fixed.SOURCE_WORDS)
    by = w.groupBy("domain", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(ready).alias("ok"))
    out = by.groupBy("domain").agg(F.sum("n").alias("candidates"), F.sum("ok").alias("ready"), F.array_sort(F.collect_list(F.when(F.col("ok") < F.col("n"), F.concat_ws("=", "quality", (F.col("n") - F.col("ok")).cast("string"))))).alias("r"))
    return out.select("domain", "candidates", "ready", F.array_join("r", ",").alias("rejected"))


DEPTH_GATE_SQL = f"""WITH {_WEB_SQL}, q AS (SELECT domain, {_QUALITY} AS quality, n_words FROM w),
g AS (SELECT domain, quality, count(*) AS n, count(*) FILTER (quality IN ('full', 'summary') AND n_words >= 80) AS ok FROM q GROUP BY ALL)
SELECT domain, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(ok) AS BIGINT) AS ready,
  coalesce(string_agg(quality || '=' || (n - ok), ',' ORDER BY quality || '=' || (n - ok)) FILTER (ok < n), '') AS rejected
FROM g GROUP BY domain"""


def unique_owner_index(spark, sf_dir):
    """Identity URLs that exactly one page owns, as (key, page)."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.identity_url(F.col("url")).alias("k")).where("k <> ''")
    return p.groupBy(F.col("k").alias("identity_url")).agg(F.min("page_id").alias("page_id"), F.countDistinct("page_id").alias("owners")).where("owners = 1").drop("owners")


UNIQUE_OWNER_SQL = f"WITH {_IDENTITY_SQL} SELECT identity_url, min(page_id) AS page_id FROM identity WHERE identity_url <> '' GROUP BY 1 HAVING count(DISTINCT page_id) = 1"

#: A policy in the shape of the source policy: domain suffix, class, trust. Longest suffix wins.
POLICY = [("example.com", "publisher", 60), ("cheap-pills.example.com", "listing", 0), ("example.org", "government", 80), ("m.theron.example.com", "aggregator", 40), ("ththan.example.net", "wire", 85)]


def source_profile(spark, sf_dir):
    """Each page's source profile: the policy of the longest domain suffix, else the default."""
    policy = spark.createDataFrame(POLICY, "suffix string, source_class string, trust int")
    p = table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))
    # every suffix of a domain is a key, so that this is an equality join
    labels = F.split("domain", r"\.")
    each = p.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = each.join(F.broadcast(policy), "suffix")  # the policy is a short fixed table
    best = hit.groupBy("page_id").agg(F.max_by(F.struct("source_class", "trust"), F.length("suffix")).alias("b"))
    return p.join(best, "page_id", "left").select("page_id", F.coalesce("b.source_class", F.lit("unknown")).alias("source_class"), F.coalesce("b.trust", F.lit(50)).alias("trust"))


_POLICY_SQL = "(VALUES " + ", ".join(f"('{s}', '{c}', {t})" for s, c, t in POLICY) + ") AS p(suffix, source_class, trust)"
SOURCE_PROFILE_SQL = f"""WITH d AS (SELECT page_id, {_DOMAIN} AS domain FROM pages),
h AS (SELECT d.page_id, p.source_class, p.trust, row_number() OVER (PARTITION BY d.page_id ORDER BY length(p.suffix) DESC) AS rn
  FROM d LEFT JOIN {_POLICY_SQL} ON d.domain = p.suffix OR ends_with(d.domain, '.' || p.suffix))
SELECT page_id, coalesce(source_class, 'unknown') AS source_class, CAST(coalesce(trust, 50) AS INTEGER) AS trust FROM h WHERE rn = 1"""

BLOCKED_PATHS = ["/search", "/tag/", "/archive", "/fr/"]
LISTING_TITLES = ["for sale", "open house", "hean"]


def eligibility_gate(spark, sf_dir):
    """The first rule that decides a page: source class, blocked path, listing title, then class again."""
    w = web_pages(spark, sf_dir).select("page_id", "url", "title").join(source_profile(spark, sf_dir), "page_id")
    path, low = F.lower(urls.part(F.col("url"), 3)), F.lower("title")
    out = F.when(F.col("source_class") == "listing", "listing")
    for p in BLOCKED_PATHS:
        out = out.when(F.contains(path, F.lit(p)), "search_page" if "search" in p else "archive_page" if "archive" in p else "category_page" if "tag" in p else "listing")
    out = out.when(text.contains_any(low, LISTING_TITLES), "listing").when(F.col("source_class") == "aggregator", "low_value").when(F.col("source_class") == "government", "press_release").otherwise("publishable")
    return w.select("page_id", out.alias("status")).withColumn("eligible", F.col("status").isin("publishable", "low_value", "press_release"))


ELIGIBILITY_SQL = f"""WITH {_WEB_SQL}, prof AS ({SOURCE_PROFILE_SQL}), e AS (
  SELECT page_id, CASE WHEN source_class = 'listing' THEN 'listing'
    WHEN contains(lower({_part(3)}), '/search') THEN 'search_page' WHEN contains(lower({_part(3)}), '/tag/') THEN 'category_page'
    WHEN contains(lower({_part(3)}), '/archive') THEN 'archive_page' WHEN contains(lower({_part(3)}), '/fr/') THEN 'listing'
    WHEN contains(lower(title), 'for sale') OR contains(lower(title), 'open house') OR contains(lower(title), 'hean') THEN 'listing'
    WHEN source_class = 'aggregator' THEN 'low_value' WHEN source_class = 'government' THEN 'press_release' ELSE 'publishable' END AS status
  FROM w JOIN prof USING (page_id))
SELECT page_id, status, status IN ('publishable', 'low_value', 'press_release') AS eligible FROM e"""


def first_seen_pages(spark, sf_dir):
    """Pages that repeat neither a title key nor an identity URL of an earlier kept page of their domain."""
    w = web_pages(spark, sf_dir).select("page_id", "domain", text.headline_key(F.col("title")).alias("title_key"), "identity_url")
    return ordered.first_seen(w, "domain", "page_id", ["title_key", "identity_url"])


def feed_sitemap(spark, sf_dir):
    """The ten newest pages of each domain in sitemap form."""
    p = web_pages(spark, sf_dir).where("identity_url <> ''").select("page_id", "domain", "identity_url")
    top = ordered.first_by(p, ["domain"], [F.desc("page_id")], 10, rank="rank")
    return top.select("domain", F.col("rank").cast("int").alias("rank"), F.format_string("<url><loc>%s</loc></url>", "identity_url").alias("line"))


SITEMAP_SQL = f"""WITH {_IDENTITY_SQL}, r AS (SELECT {_DOMAIN} AS domain, identity_url, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY page_id DESC) AS rank FROM identity WHERE identity_url <> '')
SELECT domain, CAST(rank AS INTEGER) AS rank, '<url><loc>' || identity_url || '</loc></url>' AS line FROM r WHERE rank <= 10"""

QUERIES = {
    "page_quality_by_domain": (page_quality_by_domain, PAGE_QUALITY_SQL),
    "url_forms": (url_forms, URL_FORMS_SQL),
    "domain_rollup": (domain_rollup, DOMAIN_ROLLUP_SQL),
    "page_text": (page_text, PAGE_TEXT_SQL),
    "article_texts": (article_texts, ARTICLE_TEXTS_SQL),
    "depth_gate": (depth_gate, DEPTH_GATE_SQL),
    "unique_owner_index": (unique_owner_index, UNIQUE_OWNER_SQL),
    "source_profile": (source_profile, SOURCE_PROFILE_SQL),
    "eligibility_gate": (eligibility_gate, ELIGIBILITY_SQL),
    "first_seen_pages": (first_seen_pages, None),
    "feed_sitemap": (feed_sitemap, SITEMAP_SQL),
}
