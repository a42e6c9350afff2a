"""Repair of a registry: entries that move to their incident's owner, merges that respect splits, passes to a fixpoint.

A registry is a table of entries (entry_id, story_id, title, event_key, url, anchor,
source, custom, priority, trust): what a story is, its entries say. Merging stories,
moving entries and splitting a story all deal entries to other owners, so that none is
ever lost or made, and a story's row is rebuilt from what it owns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed, incidents, text
from tidewire.operators import graph, identity, surface
from tidewire.operators.checkpoints import cut
from tidewire.operators.ordered import numbered
from tidewire.operators.pairs import meet, ranked

#: What makes a candidate title the better one, first to last.
RANK = ("custom", "priority", "trust")
#: Rounds after which a registry that still changes is an error.
MOST_ROUNDS = 16


def entry_anchor(title: Column, subjects: Column) -> Column:
    """The named death an entry tells of: its title's, or where that speaks of a death without a name the story's only one.

    A title that says nothing of a death has none, whatever its story knows, so that an
    unrelated entry can be told from the others.
    """
    own = incidents.death_subject(title)
    only = F.when(F.size(subjects) == 1, F.get(subjects, F.lit(0)))
    found = F.when(own != "", own).otherwise(only)
    return F.when(text.text(title).rlike(fixed.DEATH_CONTEXT) & found.isNotNull(), F.concat(F.lit("named-person-death:"), found))


def with_anchors(entries: DataFrame) -> DataFrame:
    """entries with ``anchor``; a story's subjects are those its titles name."""
    named = entries.select("story_id", incidents.death_subject(F.col("title")).alias("who")).where("who <> ''")
    subjects = named.groupBy("story_id").agg(F.collect_set("who").alias("subjects"))
    told = entries.drop("anchor").join(subjects, "story_id", "left")
    return told.withColumn("anchor", entry_anchor(F.col("title"), F.coalesce("subjects", F.array().cast("array<string>")))).drop("subjects")


def story_rows(entries: DataFrame) -> DataFrame:
    """A row for each story that owns entries: n_entries, titles, events, urls, sources and anchors as sorted sets, and its canonical title."""
    held = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(f"{c}s")
    best = F.max_by("title", F.struct(*RANK, F.length("title"), "title"))
    return entries.groupBy("story_id").agg(F.count(F.lit(1)).alias("n_entries"), held("title"), held("event_key"), held("url"), held("source"), held("anchor"), best.alias("canonical_title"))


# -- entries that move to the owner of their anchor ---------------------------------------


def moves(entries: DataFrame) -> DataFrame:
    """(entry_id, story_id, anchor, owner) of entries whose anchor is another story's.

    Of the stories that hold an anchor its owner is the one of whose entries most carry
    it; then the one with more such entries, the better candidate title, the lower id.
    Stories are judged as they stand before anything moves, so the outcome doesn't hang
    on the order of anchors, and moving again moves nothing: an anchor has one owner then.
    Counts are added up before they meet; entries without an anchor aren't touched.
    """
    anchored = entries.where("anchor <> ''")
    totals = entries.groupBy("story_id").agg(F.count(F.lit(1)).alias("total"), F.max(F.struct(*RANK)).alias("best"))
    held = anchored.groupBy("anchor", "story_id").agg(F.count(F.lit(1)).alias("n"))
    several = held.groupBy("anchor").agg(F.count(F.lit(1)).alias("stories")).where("stories > 1").select("anchor")
    judged = held.join(several, "anchor").join(totals, "story_id")
    rank = F.struct(F.col("n") / F.col("total"), F.col("n"), "best", -F.col("story_id"))
    owners = judged.groupBy("anchor").agg(F.max_by("story_id", rank).alias("owner"))
    return anchored.select("entry_id", "story_id", "anchor").join(owners, "anchor").where("story_id <> owner")


def move_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries under their anchors' owners, and (alias, target) of stories left with none.

    A story that keeps other entries stays, freed of what wasn't its own. One left
    without any becomes an alias of the owner of the last anchor that left it; owners keep
    their own entries, so a target always stands. Null and empty anchors don't move.
    """
    told = cut(moves(entries))
    stay = entries.join(told.select("entry_id"), "entry_id", "left_anti")
    gone = entries.drop("story_id").join(told.select("entry_id", F.col("owner").alias("story_id")), "entry_id").select(entries.columns)
    emptied = told.groupBy(F.col("story_id").alias("alias")).agg(F.max_by("owner", "anchor").alias("target"))
    return stay.unionByName(gone), emptied.join(stay.select(F.col("story_id").alias("alias")).distinct(), "alias", "left_anti")


# -- merges ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Registry:
    """entries, roots (story_id, root) of earlier splits, aliases (alias, target) and set_aside (story_id, reasons)."""

    entries: DataFrame
    roots: DataFrame
    aliases: DataFrame
    set_aside: DataFrame

    @staticmethod
    def of(entries: DataFrame, roots: DataFrame | None = None, aliases: DataFrame | None = None) -> Registry:
        empty = lambda schema: entries.sparkSession.createDataFrame([], schema)
        return Registry(
            entries,
            empty("story_id long, root long") if roots is None else roots,
            empty("alias long, target long") if aliases is None else aliases,
            empty("story_id long, reasons array<string>"),
        )


def key_rows(entries: DataFrame) -> DataFrame:
    """(layer, key, story_id): titles of four words or more, and event keys that name one event (layer 1), identity URLs (layer 2)."""
    title = text.headline_key(surface.without_publisher(F.col("title")))
    pairs = F.array(
        F.struct(F.lit(1).alias("layer"), F.lit(0).alias("kind"), F.when(F.size(F.split(title, " ")) >= 4, title).alias("key")),
        F.struct(F.lit(1).alias("layer"), F.lit(1).alias("kind"), F.when(~identity.broad_key(F.col("event_key")), F.nullif(F.col("event_key"), F.lit(""))).alias("key")),
        F.struct(F.lit(2).alias("layer"), F.lit(2).alias("kind"), F.nullif(F.col("url"), F.lit("")).alias("key")),
    )
    return entries.select("story_id", F.explode(pairs).alias("k")).where("k.key is not null").select("k.layer", "k.kind", "k.key", "story_id").distinct()


def _rolling_links(entries: DataFrame, urls: DataFrame) -> DataFrame:
    """Pairs of stories with a rolling URL and a title of each that agree: equal, or two tokens and .35 of the smaller shared."""
    rows = entries.join(urls, entries["url"] == urls["key"], "left_semi").select("url", "story_id", text.headline_key(F.col("title")).alias("key"), F.array_sort(text.source_title_tokens(F.col("title"))).alias("tokens")).distinct()
    first = Window.partitionBy("url", "key")
    equal = rows.where("key <> ''").select("url", "story_id", F.min("story_id").over(first).alias("a")).where("a < story_id").select("url", "a", F.col("story_id").alias("b"))
    sets = ranked(rows.select(F.struct("url", "story_id", "key").alias("id"), "tokens").distinct(), 2).withColumn("url", F.col("id.url"))
    met = meet(sets, sets, ["url"], F.col("l_id.story_id") < F.col("r_id.story_id"))
    shared = F.size(F.array_intersect("l_tokens", "r_tokens"))
    close = met.where((shared >= 2) & (text.overlap(F.col("l_tokens"), F.col("r_tokens")) >= 0.35)).select("url", F.col("l_id.story_id").alias("a"), F.col("r_id.story_id").alias("b"))
    return equal.unionAll(close).distinct()


def links(entries: DataFrame, keys: DataFrame, layer: int) -> DataFrame:
    """Edges (a, b, at) between stories that share a key of a layer, in the order in which they count.

    Every story of a key is linked with its first one, so a key of many stories makes as
    many edges, not their square. An address that rolls links only stories whose titles
    agree.
    """
    own = keys.where(F.col("layer") == layer)
    # a key's first story, found without gathering the key's rows in a task
    first = own.groupBy("kind", "key").agg(F.min("story_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rolling = (F.col("kind") == 2) & F.arrays_overlap(text.words(F.regexp_replace("key", r"^\w+://[^/]*", "")), text.strings(fixed.ROLLING_PATHS))
    plain = own.join(first.where(~rolling), ["kind", "key"]).where("a < story_id").select("kind", "key", "a", F.col("story_id").alias("b"))
    if layer == 2:
        close = _rolling_links(entries, first.where(rolling).select("key"))
        plain = plain.unionAll(close.select(F.lit(2).alias("kind"), F.col("url").alias("key"), "a", "b"))
    return plain.groupBy("a", "b").agg(F.min(F.struct("kind", "a", "key", "b")).alias("at"))


def _merge(state: Registry, edges: DataFrame) -> tuple[Registry, DataFrame | None]:
    """The registry with linked stories merged into each component's best, and what was merged, or None."""
    found = graph.lineage_safe(edges, state.roots)
    merged = cut(found.withColumnRenamed("id", "story_id"))
    if merged.isEmpty():
        return state, None
    best = state.entries.join(merged, "story_id").groupBy("component", "story_id").agg(F.max(F.struct(*RANK)).alias("best"))
    primary = best.groupBy("component").agg(F.max_by("story_id", F.struct("best", -F.col("story_id"))).alias("target"))
    told = cut(merged.join(primary, "component").where("story_id <> target").select(F.col("story_id").alias("alias"), "target"))

    def dealt(df: DataFrame) -> DataFrame:
        named = df.join(told, df["story_id"] == told["alias"], "left").withColumn("story_id", F.coalesce("target", "story_id"))
        return named.select(df.columns)

    return replace(state, entries=cut(dealt(state.entries)), roots=cut(dealt(state.roots).distinct()), aliases=cut(state.aliases.unionAll(told))), told


# -- passes over one story at a time --------------------------------------------------------


def prune(entries: DataFrame) -> DataFrame:
    """Entries with ``event_key`` revoked where it names a death that no title of the story speaks of."""
    death = F.lower(F.coalesce("event_key", F.lit(""))).startswith("named-person-death:")
    speaks = F.lower(F.coalesce("title", F.lit(""))).rlike(fixed.DEATH_PATTERN)
    told = entries.groupBy("story_id").agg(F.max(death).alias("__claims"), F.max(speaks).alias("__spoken")).where("__claims and not __spoken").select("story_id", F.lit(True).alias("__revoke"))
    out = entries.join(told, "story_id", "left")
    return out.withColumn("event_key", F.when(F.col("__revoke") & death, F.lit(None)).otherwise(F.col("event_key"))).select(entries.columns)


def reasons(entries: DataFrame) -> DataFrame:
    """(story_id, reasons) of stories to be set aside."""
    s = entries.groupBy("story_id").agg(F.collect_set("event_key").alias("keys"), F.countDistinct("title").alias("titles"), F.countDistinct("event_key", "url", "title").alias("told"))
    return s.select("story_id", surface.quarantine_reasons(F.col("keys"), F.col("titles"), F.col("told")).alias("reasons")).where("size(reasons) > 0")


def split(state: Registry) -> Registry:
    """Stories whose entries conflict come apart; the largest part keeps the id, others get new ones.

    Of equal parts the one with more sources, then the earlier first entry, stays. All
    parts carry the old id as a root, so that no later merge joins them again.
    """
    entries = state.entries
    parts = identity.timeline_parts(entries.select("story_id", "entry_id", "title", "event_key")).where("torn")
    placed = cut(parts.join(entries.select("entry_id", "source"), "entry_id").select("story_id", "entry_id", "part", "source"))
    sizes = placed.groupBy("story_id", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    stays = sizes.groupBy("story_id").agg(F.max_by("part", F.struct("n", "sources", -F.col("part"))).alias("stays"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    leaving = sizes.join(stays, "story_id").where("part <> stays").select("story_id", "part")
    above = F.greatest(F.coalesce(entries.agg(F.max("story_id")).scalar(), F.lit(0)), F.coalesce(state.aliases.agg(F.max("alias")).scalar(), F.lit(0)))
    new = cut(numbered(leaving, ["story_id", "part"], 1, "__n").withColumn("new_id", F.col("__n").cast("long") + above).select("story_id", "part", "new_id"))
    if new.isEmpty():
        return state
    owner = placed.join(new, ["story_id", "part"]).select("entry_id", "new_id")
    torn = new.select("story_id", "new_id")
    roots = torn.select(F.col("new_id").alias("story_id"), F.col("story_id").alias("root")).unionAll(torn.select("story_id", F.col("story_id").alias("root")).distinct())
    inherited = state.roots.join(torn, "story_id").select(F.col("new_id").alias("story_id"), "root")
    dealt = entries.join(owner, "entry_id", "left").withColumn("story_id", F.coalesce("new_id", "story_id")).select(entries.columns)
    return replace(state, entries=cut(dealt), roots=cut(state.roots.unionAll(roots).unionAll(inherited).distinct()))


# -- the passes together -------------------------------------------------------------------


def _touching(keys: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of the keys that merged stories hold: theirs and those of the stories they may now meet."""
    held = keys.join(told.select(F.col("target").alias("story_id")).distinct(), "story_id", "left_semi").select("layer", "kind", "key").distinct()
    return keys.join(held, ["layer", "kind", "key"], "left_semi")


def repair_passes(state: Registry, read: list[int] | None = None) -> Registry:
    """All passes in order: prune, set aside, merge by title and event, merge by URL, move, split, merge to a fixpoint.

    The last step repeats both merges until neither finds anything. From its second
    round on only the stories that were merged last, and those that share a key with
    them, are read from the index of keys; ``read`` gets the number of rows of each
    round. A repaired registry comes back as it is. One that doesn't settle in
    MOST_ROUNDS rounds is an error, as nothing may be published from it.
    """
    state = replace(state, entries=cut(prune(state.entries)))
    aside = cut(reasons(state.entries))
    state = replace(state, entries=cut(state.entries.join(aside, "story_id", "left_anti").select(state.entries.columns)), set_aside=state.set_aside.unionAll(aside))
    state = replace(state, aliases=cut(state.aliases.join(aside.select(F.col("story_id").alias("alias")), "alias", "left_anti").join(aside.select(F.col("story_id").alias("target")), "target", "left_anti").select("alias", "target")))
    for layer in (1, 2):
        state, _ = _merge(state, links(state.entries, key_rows(state.entries), layer))
    moved, emptied = move_entries(state.entries)
    state = split(replace(state, entries=cut(moved), aliases=cut(state.aliases.unionAll(emptied))))
    keys = cut(key_rows(state.entries))
    frontier = keys
    for _ in range(MOST_ROUNDS):
        if read is not None:
            read.append(frontier.count())
        told = []
        for layer in (1, 2):
            state, merged = _merge(state, links(state.entries, frontier, layer))
            if merged is not None:
                told.append(merged)
                renamed = lambda df, by=merged: df.join(by, df["story_id"] == by["alias"], "left").withColumn("story_id", F.coalesce("target", "story_id")).select(df.columns).distinct()
                keys, frontier = cut(renamed(keys)), renamed(frontier)
        if not told:
            break
        frontier = cut(_touching(keys, told[0] if len(told) == 1 else told[0].unionAll(told[1])))
    else:
        raise ValueError(f"the registry did not settle in {MOST_ROUNDS} rounds")
    return replace(state, aliases=graph.flatten_aliases(state.aliases, state.entries.select(F.col("story_id").alias("id")).distinct()))


# -- containment of a run --------------------------------------------------------------------


def contain_run(entries: DataFrame, index: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a run did to the stories it touched, mended without reading the others: (entries of those stories, outcome).

    touched: story_id; index: (event_key, story_id). A story is looked at if the run
    touched it or a broad key of the index leads to it. Its unsupported keys are revoked,
    it comes apart where its timeline conflicts, and what can't be made safe is set aside.
    outcome: story_id, reasons in that order, index_keys (those the index keeps for it).
    Null keys and stories that own nothing are left out; an empty run mends nothing.
    """
    broad = index.where(identity.broad_key(F.col("event_key"))).select("story_id").distinct()
    asked = cut(touched.select("story_id").unionAll(broad).where("story_id is not null").distinct())
    own = entries.join(asked, "story_id", "left_semi")
    pruned = cut(prune(own))
    dropped = own.where("event_key is not null").join(pruned.where("event_key is null").select("entry_id"), "entry_id", "left_semi").select("story_id").distinct()
    whole = split(Registry.of(pruned))
    parts = whole.roots.select(F.col("root").alias("story_id")).distinct()
    aside = reasons(whole.entries)
    tagged = lambda df, n, name: df.select("story_id", F.struct(F.lit(n).alias("n"), F.lit(name).alias("why")).alias("r"))
    said = (
        tagged(broad, 0, "broad_event_mapping_revoked").unionAll(tagged(dropped, 1, "unsupported_structured_event_key_revoked")).unionAll(tagged(parts, 2, "timeline_coherence_repaired_split"))
        .unionAll(aside.select("story_id", F.posexplode("reasons").alias("n", "why")).select("story_id", F.struct((F.col("n") + 3).alias("n"), "why").alias("r")))
    )
    told = said.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_set("r")), lambda r: r["why"]).alias("reasons"))
    kept = cut(whole.entries.join(aside, "story_id", "left_anti"))
    named = kept.where(F.col("event_key").isNotNull() & ~identity.broad_key(F.col("event_key"))).groupBy("story_id").agg(F.countDistinct("event_key").alias("index_keys"))
    return kept, told.join(named, "story_id", "left").select("story_id", "reasons", F.coalesce("index_keys", F.lit(0)).alias("index_keys"))
