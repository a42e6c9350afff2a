"""What may be published under which identity: authority, exclusions, and heroes that are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed, incidents, text, urls
from tidewire.operators import identity
from tidewire.operators.ordered import first_by

# -- authority ---------------------------------------------------------------------------


def _decision(outcome: str, tier: str, proof: str) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), F.lit(tier).alias("tier"), F.lit(outcome == fixed.VERIFIED).alias("authorized"), F.lit(proof).alias("proof"))


def key_authority(keys: Column) -> Column:
    """struct<outcome, tier, authorized, proof> of the keys that two articles share.

    Sources, custom and weather events, and incidents of one subject are proof. Broad
    incidents and a story id alone are only a reason to look.
    """
    known = F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    some = lambda prefix: F.exists(known, lambda k: k.startswith(prefix))
    out = F.when(F.lit(False), _decision(fixed.NEW, fixed.THIN_TIER, "none"))
    for prefix, proof in fixed.EXACT_KEYS:
        out = out.when(some(prefix), _decision(fixed.VERIFIED, fixed.EXACT_TIER, proof))
    one = F.exists(known, lambda k: k.startswith("incident:") & incidents.authoritative(F.lower(F.substring(k, F.lit(10), F.length(k)))))
    return (
        out.when(one, _decision(fixed.VERIFIED, fixed.EXACT_TIER, "exact_structured_incident_key"))
        .when(some("incident:"), _decision(fixed.POSSIBLE, fixed.CANDIDATE_TIER, "broad_structured_incident_key"))
        .when(some("story:"), _decision(fixed.POSSIBLE, fixed.CANDIDATE_TIER, "uncorroborated_persistent_story_id"))
        .when(F.size(known) > 0, _decision(fixed.POSSIBLE, fixed.CANDIDATE_TIER, "untrusted_identity_key"))
        .otherwise(_decision(fixed.NEW, fixed.THIN_TIER, "none"))
    )


def pair_authority(
    *, conflict: Column, anchor: Column, event_key: Column, people: Column, places: Column, agencies: Column, subjects: Column, topics: Column, facts: Column,
    locality: Column, family: Column, policy: Column, safe: Column, near: Column,
) -> Column:
    """struct<outcome, tier, authorized, proof> of two articles of different sources.

    people to facts count what they share, the rest are conditions. Likeness alone is
    never proof: that takes an exact key with a person or place beside it, or a person,
    place or policy subject with enough facts.
    """
    who, where, office, about = people > 0, places > 0, agencies > 0, subjects > 0
    hard = who | where | (policy & office & about & locality)
    here = safe & family & locality
    verified = lambda tier, proof: _decision(fixed.VERIFIED, tier, proof)
    hint = anchor | event_key | who | where | (locality & family & (office | about)) | near | (topics >= 2)
    return (
        F.when(conflict, _decision(fixed.NEW, fixed.CONFLICT_TIER, "conflict"))
        .when(anchor & safe & hard, verified(fixed.EXACT_TIER, "exact_structured_incident_anchor"))
        .when(event_key & safe & hard, verified(fixed.EXACT_TIER, "exact_known_event_key"))
        .when(here & who & where, verified(fixed.HARD_TIER, "participant_plus_precise_location"))
        .when(here & who & (facts >= 5), verified(fixed.HARD_TIER, "participant_plus_distinctive_incident_facts"))
        .when(here & where & (facts >= 5) & (topics >= 2), verified(fixed.HARD_TIER, "precise_location_plus_distinctive_facts"))
        .when(safe & policy & locality & office & about & (facts >= 4), verified(fixed.HARD_TIER, "governing_body_plus_policy_subject"))
        .when(hint, _decision(fixed.POSSIBLE, fixed.CANDIDATE_TIER, "candidate_similarity"))
        .otherwise(_decision(fixed.NEW, fixed.THIN_TIER, "none"))
    )


def authorizes(decision: Column, slug: Column, target: Column) -> Column:
    """Whether a decision lets an article be written to a target page."""
    return F.coalesce(decision["authorized"] & (decision["outcome"] == fixed.VERIFIED) & (F.trim(slug) == F.trim(target)) & (decision["proof"] != ""), F.lit(False))


# -- exclusions --------------------------------------------------------------------------


def safe_duplicate(events: Column, quarantined: Column, relations: Column) -> Column:
    """Whether a story may lend its identity to a duplicate: not set aside, no class of events, no follow-ups."""
    follows = F.exists(relations, lambda r: F.lower(F.trim(r)).isin(*fixed.FOLLOWING))
    return ~quarantined & ~F.exists(events, identity.class_key) & ~follows


def retrospective_exclusions(title: Column, source: Column, url: Column) -> Column:
    """Why an entry takes no part in looking back, in order."""
    low = F.lower(text.collapse(title))
    blob = F.concat_ws(" ", low, F.lower(text.collapse(source)), F.lower(text.collapse(url)))
    told = F.array_distinct(F.filter(text.words(low), lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.RETROSPECTIVE_STOP)))
    reasons = [("social_source", text.contains_any(blob, fixed.SOCIAL_MARKERS)), ("insufficient_title_detail", F.size(told) < 5), ("low_value_title", low.rlike(fixed.LOW_VALUE_TITLE))]
    return F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in reasons]))


def ranking_exclusion(eligible: Column, status: Column, archive_only: Column, story_id: Column) -> Column:
    """The status for which a card is not ranked, or null: not eligible, unresolved, or archived without a story."""
    lost = F.coalesce(archive_only, F.lit(False)) & story_id.isNull()
    out = (F.coalesce(eligible, F.lit(True)) == F.lit(False)) | F.coalesce(status.isin(*fixed.UNRESOLVED), F.lit(False)) | lost
    return F.when(out, F.when(F.trim(text.text(status)) != "", status).otherwise("archive_unresolved"))


# -- heroes ------------------------------------------------------------------------------


def is_stale(content: Column, published: Column, reference) -> Column:
    """Whether a story tells of days past: words of now win, then weekdays and phrases of then, then its age."""
    low, now = F.lower(text.text(content)), F.lit(reference).cast("timestamp")
    days = F.concat_ws("|", *[F.lower(F.date_format(F.date_sub(now, n), "EEEE")) for n in range(1, 5)])
    named = F.regexp_like(low, F.concat(F.lit("(?: |^)(?:"), days, F.lit(") |(?: )(?:"), days, F.lit(")[,.]")))
    old = F.coalesce((F.unix_micros(now) - F.unix_micros(published)) / 3.6e9 >= 24, F.lit(False))
    return ~text.contains_any(low, fixed.FRESH_PHRASES) & (named | text.contains_any(low, fixed.STALE_PHRASES) | old)


def swap_stale_heroes(places: DataFrame) -> DataFrame:
    """(section, pos, stale), pos 0 being the hero -> with new_pos: a stale hero changes places with the first card that isn't."""
    w = Window.partitionBy("section")
    first = F.min(F.when(~F.col("stale") & (F.col("pos") > 0), F.col("pos"))).over(w)
    swap = F.max((F.col("pos") == 0) & F.col("stale")).over(w) & first.isNotNull()
    out = places.withColumns({"first": first, "swap": swap})
    return out.withColumn("new_pos", F.when(F.col("swap") & (F.col("pos") == 0), F.col("first")).when(F.col("swap") & (F.col("pos") == F.col("first")), 0).otherwise(F.col("pos"))).drop("first", "swap")


def choose_hero(candidates: DataFrame, tries: int = fixed.EXPANSIONS) -> DataFrame:
    """(edition, rank, role, full) -> the leading row of each edition, and how many cards failed before it.

    The first hero leads, unless a card before it can be told in full; after ``tries``
    cards that can't no other card is asked.
    """
    failed = F.count_if((F.col("role") == "card") & ~F.col("full")).over(Window.partitionBy("edition").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    able = candidates.withColumn("failures", failed).where((F.col("role") == "hero") | (F.col("full") & (F.col("failures") < tries)))
    return first_by(able, ["edition"], [F.asc("rank")]).withColumn("failures", F.least("failures", F.lit(tries)).cast("int"))


def recover_heroes(wanted: DataFrame, archive: DataFrame, occupied: DataFrame, tries: int = fixed.RECOVERY_TRIES) -> DataFrame:
    """(section, lead, rejected) -> section, slug: the newest archived article of a section that can take its hero's place.

    archive: slug, section, title, story_id, published, age (hours), valid, corroborated,
    errors; occupied: story_id, title of the other sections' heroes. Of the ``tries``
    newest valid ones, but the rejected, the first counts that is corroborated, new
    enough (a lead 72 hours, others 48), free of errors, and no other section's hero.
    """
    most = F.when(F.col("lead"), fixed.LEAD_RECOVERY_HOURS).otherwise(fixed.RECOVERY_HOURS)
    able = archive.where("valid").join(wanted, "section").where(~F.coalesce(F.col("slug") == F.col("rejected"), F.lit(False)))
    asked = first_by(able.where(F.col("age") <= most), ["section"], [F.desc("published"), F.asc("slug")], tries)
    ids = occupied.where("story_id is not null").select("story_id").distinct()
    keyed = lambda df: df.withColumn("title_key", text.headline_key(F.col("title")))
    titles = keyed(occupied).select("title_key").distinct()
    free = keyed(asked.where(F.col("corroborated") & ~F.col("errors") & (F.col("age") >= -1))).join(ids, "story_id", "left_anti").join(titles, "title_key", "left_anti")
    return first_by(free, ["section"], [F.desc("published"), F.asc("slug")]).select("section", "slug")


def independent_id(url: Column, headline: Column) -> Column:
    """struct<story_id, event_key> of a story that is proved to be new, fixed by its address and headline, far from the ids dealt in order."""
    digest = F.sha2(F.concat(urls.bare(url), F.lit("\n"), F.lower(text.text(headline))), 256)
    number = F.conv(F.substring(digest, 1, 14), 16, 10).cast("long") + 10_000_000_000_000_000
    return F.struct(F.concat(F.lit("story_"), number.cast("string")).alias("story_id"), F.concat(F.lit("independent-"), F.substring(digest, 1, 16)).alias("event_key"))


def collision(hero: DataFrame, archive: DataFrame) -> DataFrame:
    """hero_id, url, headline, quality, n_words, errors, protected, old_url, verdict, confidence -> action, story_id, event_key.

    A hero bound to the wrong story gets an identity of its own only if it isn't a
    protected update, has an address that neither the old story nor the archive (url,
    story_id) has, is sound, and was found to be another event with .82 at least.
    Otherwise it is recovered from the archive, or kept if protected.
    """
    u, old = urls.bare(F.col("url")), urls.bare(F.col("old_url"))
    known = archive.select(urls.bare(F.col("url")).alias("u")).where("u <> ''").distinct().withColumn("taken", F.lit(True))
    ids = archive.select(F.col("story_id").alias("new_id")).distinct().withColumn("held", F.lit(True))
    t = hero.withColumns({"u": u, "ident": independent_id(F.col("url"), F.col("headline"))}).withColumn("new_id", F.col("ident.story_id"))
    t = t.join(known, "u", "left").join(ids, "new_id", "left")
    sound = F.col("quality").isin("full", "summary") & (F.col("n_words") >= fixed.SOURCE_WORDS) & ~F.col("errors")
    new = (F.col("u") != "") & (F.col("u") != old) & F.col("taken").isNull() & F.col("held").isNull() & sound & (F.col("verdict") == "new") & (F.col("confidence") >= 0.82)
    action = F.when(F.col("protected"), "keep").when(new, "publish_independent").otherwise("recover")
    fresh = F.col("action") == "publish_independent"
    return t.withColumn("action", action).select("hero_id", "action", F.when(fresh, F.col("ident.story_id")).alias("story_id"), F.when(fresh, F.col("ident.event_key")).alias("event_key"))
