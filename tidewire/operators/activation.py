"""Guarded suppression of duplicates on live pages, assignment plans, lookups and small accessors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed, text, urls
from tidewire.operators import pairs, surface
from tidewire.operators.checkpoints import cut
from tidewire.operators.ordered import first_by

# -- activation --------------------------------------------------------------------------


def recommend(route: Column, relationship: Column, confidence: Column, incoming: Column, target: Column, canonical_custom: Column, incoming_custom: Column, trace: Column, least: float = 1.0) -> Column:
    """struct<action, evidence> for a decision: duplicates of proven identity are suppressed, custom pages protected, all else left."""
    act = lambda action, evidence: F.struct(F.lit(action).alias("action"), F.lit(evidence).alias("evidence"))
    same = (route == "skip") & (relationship == "same_event") & (confidence >= least) & (F.trim(text.text(incoming)) != "") & (F.trim(text.text(target)) != "") & (incoming != target)
    traced = lambda line: F.array_contains(trace, line)
    return (
        F.when(~F.coalesce(same, F.lit(False)), act("none", "")).when(canonical_custom & ~incoming_custom, act("protect_custom_canonical", "custom_canonical_protection"))
        .when(traced(fixed.EXACT_SOURCE), act("suppress_duplicate", "exact_safe_source_article_identity")).when(traced(fixed.EXACT_TITLE), act("suppress_duplicate", "exact_normalized_title_identity"))
        .otherwise(act("none", ""))
    )


def title_identity(c: Column) -> Column:
    return text.headline_key(surface.without_publisher(c))


def activate(placements: DataFrame, recommendations: DataFrame, *, mode: str, most: int) -> DataFrame:
    """placements (section, pos, item_id, url, title, custom), pos 0 the hero -> with action and new_pos (null: removed).

    A recommendation (url, title, enforceable) matches an item by source address or
    title, never a custom one. A removed hero's place goes to the section's first card,
    before cards are removed, so that this card stays. Outside mode "enforce" nothing
    moves; with more than ``most`` enforceable recommendations, or where more than
    ``most`` placements would go, everything is rolled back to where it stood.
    """
    on = recommendations.where("enforceable")
    by = lambda df, c, name: df.where(F.col(c) != "").select(c).distinct().withColumn(name, F.lit(True))
    keyed = lambda df: df.withColumns({"u": F.coalesce(urls.identity_url(F.col("url")), F.lit("")), "t": title_identity(F.col("title"))})
    rec = keyed(on).select("u", "t")
    j = keyed(placements).join(by(rec, "u", "by_url"), "u", "left").join(by(rec, "t", "by_title"), "t", "left")
    hit = F.lit(mode == "enforce") & ~F.col("custom") & (F.coalesce("by_url", F.lit(False)) | F.coalesce("by_title", F.lit(False)))
    w = Window.partitionBy("section")
    out = j.withColumn("hit", hit).withColumns({"heroless": F.max((F.col("pos") == 0) & F.col("hit")).over(w), "next": F.min(F.when(F.col("pos") > 0, F.col("pos"))).over(w)})
    raised = F.col("heroless") & (F.col("pos") == F.col("next"))
    action = F.when(raised, "promoted").when(F.col("hit"), "removed").otherwise("kept")
    out = out.withColumn("action", action)
    order = Window.partitionBy("section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col("action") == "kept", F.when(F.col("pos") == 0, 0).otherwise(F.count_if((F.col("action") == "kept") & (F.col("pos") > 0)).over(order))).when(F.col("action") == "promoted", 0)
    moved = cut(out.select("section", "pos", "item_id", "action", place.cast("int").alias("new_pos")))
    gone, asked = moved.agg(F.count_if(F.col("action") == "removed")).scalar(), on.agg(F.count(F.lit(1))).scalar()
    back = (gone > most) | (asked > most)
    return moved.select("section", "pos", "item_id", F.when(back, "kept").otherwise(F.col("action")).alias("action"), F.when(back, F.col("pos").cast("int")).otherwise(F.col("new_pos")).alias("new_pos"))


def mode_for(requested: str, healthy: bool, regressed: bool) -> tuple[str, list[str]]:
    """The mode a run may have and why not the one asked for: enforcing needs a clean registry and no regression; off stays off."""
    if requested not in ("off", "shadow", "enforce"):
        return "off", [f"unknown mode {requested}"]
    why = [w for bad, w in ((not healthy, "registry is not clean"), (regressed, "the last run regressed")) if bad and requested == "enforce"]
    return ("shadow" if why else requested), why


# -- plans, lookups ----------------------------------------------------------------------


def normalised_plan(picks: DataFrame, most: DataFrame, need_fit: bool = False) -> DataFrame:
    """picks (plan, pos, source_index string, fits) and plans (plan, sources, max_cards) -> each pick's verdict and place.

    pos 0 is the hero. Indexes that are none, or beyond the sources, are invalid; where
    fit is needed, one that isn't accepted is rejected; a later pick of a source is a
    duplicate; cards after ``max_cards`` are left. place numbers what stays, in order.
    """
    index = F.expr("try_cast(trim(source_index) AS int)")
    j = picks.join(most, "plan").withColumn("index", F.when(index > 0, index))
    valid = F.col("index").isNotNull() & (F.col("index") <= F.col("sources"))
    fit = F.coalesce(F.col("fits"), F.lit(False)) if need_fit else F.lit(True)
    j = j.withColumn("verdict", F.when(~valid, F.when(F.coalesce(F.trim("source_index"), F.lit("")) == "", "missing").otherwise("invalid")).when(~fit, "rejected").otherwise("ok"))
    first = F.row_number().over(Window.partitionBy("plan", "verdict", "index").orderBy("pos"))
    j = j.withColumn("verdict", F.when((F.col("verdict") == "ok") & (first > 1), "duplicate").otherwise(F.col("verdict")))
    nth = F.count_if((F.col("verdict") == "ok") & (F.col("pos") > 0)).over(Window.partitionBy("plan").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("nth", nth).withColumn("verdict", F.when((F.col("verdict") == "ok") & (F.col("pos") > 0) & (F.col("nth") > F.col("max_cards")), "left").otherwise(F.col("verdict")))
    return j.select("plan", "pos", "index", "verdict", F.when(F.col("verdict") == "ok", F.when(F.col("pos") == 0, 0).otherwise(F.col("nth"))).cast("int").alias("place"))


def at_index(picks: DataFrame, sources: DataFrame) -> DataFrame:
    """picks (plan, index from 1) with the source that stands there; sources: plan, source_id in order of pos."""
    numbered = sources.withColumn("index", F.row_number().over(Window.partitionBy("plan").orderBy("pos")))
    return picks.join(numbered.select("plan", "index", "source_id"), ["plan", "index"], "left")


def classified(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """sources (link, title) with the categories of the story that has their link and title; unclassified ones have none."""
    keyed = lambda df: df.withColumn("title_key", text.headline_key(F.col("title")))
    known = first_by(keyed(classes).withColumn("o", F.array_join(F.array_sort("categories"), ",")), ["link", "title_key"], [F.asc("o")]).select("link", "title_key", "categories")
    return keyed(sources).join(known, ["link", "title_key"], "left").drop("title_key")


def content_lookup(probes: DataFrame, bank: DataFrame, most: int = 5, few: int = 512, common: int | None = None) -> DataFrame:
    """probes (id, title) -> the ``most`` entries of the bank (entry_id, title) that share two words at least, by how many, then bank order.

    Equal word sets are one. Sets that share only words that many hold are met by kinds
    (the same such words), of which the first entries are enough; others meet one by one
    where they share as much as the last that a set is sure of.
    """
    tokens = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(text.text(c)), "[^a-z0-9 ]", " ")), " +"), lambda t: (t != "") & ~t.isin(*fixed.CONTENT_STOP))))
    keyed = lambda df, key: df.select(key, tokens(F.col("title")).alias("tokens")).where(F.size("tokens") >= 2)
    order = [F.desc("shared"), F.asc("entry_id")]
    asked = cut(keyed(probes, "id"))
    sets = cut(asked.groupBy("tokens").agg(F.min("id").alias("set_id")))
    held = first_by(keyed(bank, "entry_id"), ["tokens"], [F.asc("entry_id")], most).groupBy("tokens").agg(F.array_sort(F.collect_list("entry_id")).alias("firsts"))
    held = cut(held.select(F.col("firsts")[0].alias("id"), "tokens", "firsts"))
    a, b = pairs.numbered(sets.select(F.col("set_id").alias("id"), "tokens"), held.select("id", "tokens"), few=few, common=common)
    a, b, near = pairs.meet_heavy(a, b.join(held.select("id", "firsts"), "id"), 2)
    known = first_by(b.where(F.col("kind").isNotNull()).select(F.col("kind").alias("r_kind"), F.explode("firsts").alias("entry_id")), ["r_kind"], [F.asc("entry_id")], most)
    alone = cut(first_by(near.join(known, "r_kind").select("l_kind", "entry_id", F.col("n").alias("shared")), ["l_kind"], order, most))
    floor = alone.groupBy(F.col("l_kind").alias("kind")).agg(F.when(F.count(F.lit(1)) == most, F.min("shared")).alias("floor"))
    a = cut(a.join(floor, "kind", "left").select("id", "nos", "kind", F.coalesce("floor", F.lit(2)).alias("floor")))
    met = pairs.meet_numbered(a.drop("kind"), b.select("id", "nos", "firsts"), 2).where("n >= l_floor").select(F.col("l_id").alias("set_id"), F.explode("r_firsts").alias("entry_id"), F.col("n").alias("shared"))
    # an entry may come by its common words too, where it shares more
    every = met.unionAll(a.join(alone, F.col("kind") == F.col("l_kind")).select(F.col("id").alias("set_id"), "entry_id", "shared"))
    best = first_by(every.groupBy("set_id", "entry_id").agg(F.max("shared").alias("shared")), ["set_id"], order, most, rank="rank")
    return asked.join(sets, "tokens").join(best, "set_id").select("id", "entry_id", "shared", "rank")


def kept_of_duplicates(rows: DataFrame, least: int = 4, few: int = 3, at_once: int = 4096) -> DataFrame:
    """(pos, tokens) -> pos, kept_pos: itself if kept, else the last row kept before it that shares ``least`` tokens.

    Rows go in order, and one of fewer than ``few`` tokens is always kept. Of equal
    rows the first settles the fate of all. The first ``at_once`` rows are settled among
    themselves, then what shares enough with those kept goes, and what is left plays
    again, as many at once as are kept, if that is more: all rows meet kept ones only.
    """
    always = F.size("tokens") < few
    keyed = rows.select("pos", F.array_sort("tokens").alias("tokens"))
    sets = cut(keyed.where(F.size("tokens") >= least).groupBy("tokens", F.when(always, F.col("pos")).alias("own")).agg(F.min("pos").alias("pos")).select("pos", "tokens"))
    left, kept, n_kept, n = sets, None, 0, sets.count()
    while n:
        upto = left.agg(F.percentile_approx("pos", min(1.0, max(at_once, n_kept) / n))).collect()[0][0]
        new = _kept_in_order(cut(left.where(F.col("pos") <= upto)), least, few)
        kept = new if kept is None else cut(kept.unionAll(new))
        rest = left.where(F.col("pos") > upto)
        left = cut(rest.join(_sharing(rest.where(~always), new, least).select("pos").distinct(), "pos", "left_anti"))
        n_kept, n = kept.count(), left.count()
    if kept is None:
        return rows.select("pos", F.col("pos").alias("kept_pos"))
    shared = _sharing(sets.where(~always), kept, least).groupBy("pos").agg(F.collect_list("kept").alias("kept"))
    known = sets.join(shared, "pos").select("tokens", "kept")
    last = F.array_max(F.filter("kept", lambda k: k < F.col("pos")))
    return keyed.join(known, "tokens", "left").select("pos", F.coalesce(F.when(~always, last), F.col("pos")).alias("kept_pos"))


def _sharing(sets: DataFrame, kept: DataFrame, least: int) -> DataFrame:
    """Pairs (pos, kept) of sets and kept ones that share ``least`` tokens."""
    named = lambda df: df.select(F.col("pos").alias("id"), "tokens")
    met = pairs.meet(*pairs.two_sided(named(sets), named(kept), least))
    return met.where(F.size(F.array_intersect("l_tokens", "r_tokens")) >= least).select(F.col("l_id").alias("pos"), F.col("r_id").alias("kept"))


def _kept_in_order(sets: DataFrame, least: int, few: int) -> DataFrame:
    """Which of some sets (pos, tokens) are kept.

    A row's fate hangs only on the earlier rows it shares tokens with, so it is settled
    in rounds: as soon as one of those is kept it goes, and if all of them went it stays.
    """
    links = pairs.similar_sets(sets.select(F.col("pos").alias("id"), "tokens"), least).select(F.col("left_id").alias("before"), F.col("right_id").alias("pos"))
    links = cut(links.join(sets.where(F.size("tokens") < few).select("pos"), "pos", "left_anti"))
    settled = cut(sets.select("pos").join(links.select("pos").distinct(), "pos", "left_anti").withColumn("kept", F.lit(True)))
    while True:
        open_ = links.join(settled.select("pos"), "pos", "left_anti")
        seen = open_.join(settled.withColumnRenamed("pos", "before"), "before", "left")
        told = seen.groupBy("pos").agg(F.max(F.coalesce("kept", F.lit(False))).alias("gone"), F.count_if(F.col("kept").isNull()).alias("waiting"))
        new = cut(told.where("gone or waiting = 0").select("pos", (~F.col("gone")).alias("kept")))
        if new.isEmpty():
            break
        settled = cut(settled.unionAll(new))
    return cut(sets.join(settled.where("kept").select("pos"), "pos").select("pos", "tokens"))


# -- small ones --------------------------------------------------------------------------


def publisher(source_title: Column, source_url: Column, title: Column) -> Column:
    """The trusted publisher that an entry names in its source, its address or after the last dash of its title."""
    tail = F.when(F.contains(text.text(title), F.lit(" - ")), F.regexp_extract(title, "^.* - (.*)$", 1))
    blob = F.lower(F.concat_ws(" ", source_title, source_url, tail))
    out = F.when(F.lit(False), "")
    for name, domains in fixed.TRUSTED_PUBLISHERS.items():
        out = out.when(text.contains_any(blob, [name.lower(), *domains]), name)
    return out.otherwise("")


def day_gap(a: Column, b: Column) -> Column:
    """Days between the dates of two times."""
    return F.abs(F.datediff(F.to_date(a), F.to_date(b)))


def priority(importance: Column, proximity: Column) -> Column:
    """Importance by nearness, both from 0 to 100."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c.cast("int")))
    return F.bround(clamp(importance) * clamp(proximity) / 100, 0).cast("int")


def block_text(blocks: Column) -> Column:
    """The texts of a response's blocks (array of structs with text), one a line; blocks without text don't count."""
    texts = F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: F.trim(text.text(t)) != "")
    return F.trim(F.array_join(texts, "\n"))


def display_hour(at: Column, zone: str = "America/New_York") -> Column:
    """The full hour of a UTC time on the clock of a zone."""
    return F.concat(F.date_format(F.from_utc_timestamp(at, zone), "h':00 'a"), F.lit(" ET"))


def events_to_stories(entries: DataFrame) -> DataFrame:
    """(event_key, entry_id, title) -> one story for each event key: its first title, entries in order and whether it is new with the last one."""
    return entries.groupBy("event_key").agg(F.min_by("title", "entry_id").alias("title"), F.count(F.lit(1)).alias("entries"), F.max("entry_id").alias("last_id")).withColumn("created", F.col("entries") == 1)
