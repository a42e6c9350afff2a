"""URL functions: each caller's own normal form, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions.text import text

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(c: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where there is none."""
    return F.regexp_extract(F.trim(text(c)), _PARTS, n)


def domain(c: Column) -> Column:
    host = F.regexp_replace(F.lower(part(c, 2)), ":.*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def _pairs(query: Column, drop) -> Column:
    return F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~drop(F.lower(F.regexp_extract(kv, "^([^=]*)", 1))))


def _built(scheme: Column, host: Column, path: Column, pairs: Column) -> Column:
    # a key without "=" is written with one, as form encoding does
    kv = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kv) > 0, F.concat(F.lit("?"), F.array_join(kv, "&"))).otherwise(F.lit("")))


def cache_url(c: Column) -> Column:
    """Tracking keys and fragment dropped, slashes collapsed, scheme and host in lower case."""
    pairs = _pairs(part(c, 4), lambda k: k.startswith("utm_") | k.isin(*fixed.CACHE_TRACKING))
    path = F.regexp_replace(F.when(part(c, 3) == "", "/").otherwise(part(c, 3)), "/{2,}", "/")
    return F.when(part(c, 1) == "", F.trim(text(c))).otherwise(_built(F.lower(part(c, 1)), F.lower(part(c, 2)), path, pairs))


def ranking_url(c: Column) -> Column:
    pairs = _pairs(part(c, 4), lambda k: k.startswith("utm_") | k.isin(*fixed.RANKING_TRACKING))
    path = F.regexp_replace(part(c, 3), "/+$", "")
    return F.when(part(c, 1) == "", F.trim(text(c))).otherwise(_built(F.lower(part(c, 1)), F.lower(part(c, 2)), path, pairs))


def archive_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(c))), "/+$", ""), "[?#].*$", "")


def identity_url(c: Column) -> Column:
    """A stable article URL, or empty for feeds, home pages and other shared containers."""
    scheme, host = F.lower(part(c, 1)), F.lower(part(c, 2))
    path = F.regexp_replace(F.when(part(c, 3) == "", "/").otherwise(part(c, 3)), "/{2,}", "/")
    low = F.lower(path)
    segments = F.filter(F.split(low, "/"), lambda s: s != "")
    article = (host == fixed.AGGREGATOR) & low.startswith("/rss/articles/")
    shared = low.rlike(fixed.FEED_FILE) | F.arrays_overlap(segments, F.array(*[F.lit(s) for s in fixed.FEED_SEGMENTS])) | (F.size(segments) < 2)
    bad = ~scheme.isin("http", "https") | (host == "") | ((host == fixed.AGGREGATOR) & ~article) | (~article & shared)
    netloc = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    pairs = F.when(article, F.array().cast("array<string>")).otherwise(F.array_sort(_pairs(part(c, 4), lambda k: k.isin(*fixed.IDENTITY_TRACKING))))
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.when(bad, "").otherwise(_built(scheme, netloc, F.when(trimmed == "", "/").otherwise(trimmed), pairs))


def source_type(dom: Column) -> Column:
    inside = F.lit(False)
    for d in fixed.DISCOVERY_DOMAINS:
        inside = inside | (dom == d) | dom.endswith("." + d)
    return F.when((dom == fixed.AGGREGATOR) | dom.endswith("." + fixed.AGGREGATOR), "aggregator").when(inside, "discovery_only").when(dom != "", "full_source").otherwise("unknown")


def bare(c: Column) -> Column:
    """An address without closing slashes, query and fragment, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "/+$", ""), "[?#].*$", "")
