"""Routing: production routes, deferred repairs, corroborated reuse, unique heroes, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed, text


def route(action: Column) -> Column:
    """The production route of an editorial action; what has none is null, never a guess."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in fixed.ROUTES.items() for x in kv]), action)


def deferrable(reasons: Column, authority: Column) -> Column:
    """Whether a failed protected update can be repaired later: all its reasons can, and its authority holds."""
    one = lambda r: r.isin(*fixed.REPAIRABLE) | r.startswith("body_under_")
    return authority & (F.size(reasons) > 0) & F.forall(reasons, one)


def corroborated(url: Column, old_url: Column, headline: Column, old_headline: Column) -> Column:
    """Whether an article may reuse a canonical one: the same URL, or headlines that share more than a court's frame."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(text.text(c), "[#?].*$", ""), "/+$", "")
    tokens = lambda c: F.array_distinct(F.filter(text.words(c), lambda t: (F.length(t) >= 4) & ~t.isin(*fixed.CORROBORATION_STOP)))
    a, b = tokens(headline), tokens(old_headline)
    shared = F.array_intersect(a, b)
    same = (bare(url) != "") & (bare(url) == bare(old_url))
    return same | ((F.size(shared) >= 3) & (text.overlap(a, b) >= 0.5) & (F.size(F.array_except(shared, text.strings(fixed.COURT_FRAME))) > 0))


def unique_heroes(heroes: DataFrame, order: str) -> DataFrame:
    """(section, story_id, headline) -> with the section that already leads with the same story, else null."""
    ident = F.coalesce(F.col("story_id").cast("string"), F.concat(F.lit("title:"), text.headline_key(F.col("headline"))))
    first = F.first("section").over(Window.partitionBy("ident").orderBy(order))
    return heroes.withColumn("ident", ident).withColumn("taken_by", F.when(first != F.col("section"), first)).drop("ident")


def tombstones(stories: DataFrame, sample: int = 4) -> DataFrame:
    """(story_id, titles) -> what is kept of a quarantined story: counts, a digest and titles from both ends."""
    n, half = F.size("titles"), sample // 2
    head = F.slice("titles", F.lit(1), F.least(F.lit(half), n))
    tail = F.slice("titles", F.greatest(n - (sample - half), F.least(F.lit(half), n)) + 1, F.lit(sample))
    return stories.select("story_id", n.cast("long").alias("n_titles"), F.sha2(F.array_join("titles", "\n"), 256).alias("digest"), F.array_distinct(F.concat(head, tail)).alias("kept"))


def pair_identity(key_equal: Column, entities: Column, location: Column, county: Column, kind: Column, similarity: Column) -> Column:
    """struct<confidence, same>: points for shared evidence, and a hard or contextual signal besides."""
    score = F.least(
        F.lit(99.0),
        F.least(F.lit(50.0), 25.0 * entities) + F.when(location, 25.0).otherwise(0.0) + F.when(county, 10.0).otherwise(0.0) + F.when(kind, 20.0).otherwise(0.0)
        + F.when(similarity >= 0.60, 25.0).when(similarity >= 0.35, 12.0).otherwise(0.0),
    )
    signal = ((entities > 0) & (location | kind)) | (location & kind & (similarity >= 0.35))
    return F.struct(F.when(key_equal, 100.0).otherwise(score).alias("confidence"), (key_equal | ((score >= 70.0) & signal)).alias("same"))


def capped_urgency(urgency: Column, headline: Column, age: Column) -> Column:
    """Urgency that falls with age, but for headlines that say something happened now."""
    cap = F.when(age > 48, 4).when(age > 36, 5).when(age > 24, 7).when(age > 12, 8).otherwise(10)
    return F.when(age.isNull() | text.contains_any(F.lower(headline), fixed.FRESH_WORDS), urgency).otherwise(F.least(urgency, cap))


def hard_rejected(reason: Column) -> Column:
    """Whether an editor's reason to reject a source rules it out for backfill too."""
    return text.contains_any(F.lower(text.text(reason)), fixed.HARD_REJECTIONS)


def supported_keys(keys: Column, titles: Column) -> Column:
    """Event keys without deaths of named people that no title speaks of."""
    spoken = F.exists(titles, lambda t: F.lower(t).rlike(fixed.DEATH_PATTERN))
    return F.filter(keys, lambda k: spoken | ~F.lower(k).startswith("named-person-death:"))


def health(stories: DataFrame) -> DataFrame:
    """One row on a registry (story_id, event_keys, titles): counters, and clean only if all are 0."""
    keys = stories.select("story_id", F.explode("event_keys").alias("k"))
    shared = keys.groupBy("k").agg(F.countDistinct("story_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_keys"))
    own = stories.agg(F.count(F.lit(1)).alias("stories"), F.count_if(F.size("titles") == 0).alias("untitled"), F.sum(F.size("event_keys") - F.size(supported_keys(F.col("event_keys"), F.col("titles")))).alias("unsupported_keys"))
    return own.withColumn("shared_keys", shared.scalar()).withColumn("status", F.when((F.col("untitled") + F.col("unsupported_keys") + F.col("shared_keys")) == 0, "clean").otherwise("blocked"))
