"""Story identity: matchers in tiers, timeline coherence and repair to a fixpoint."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators import graph
from tidewire.operators.checkpoints import cut
from tidewire.operators.ordered import first_by
from tidewire.operators.pairs import combined, meet, meet_on_keys, ranked


def event_family(title: Column) -> Column:
    low = F.array_join(text.words(title), " ")
    out = F.when(F.lit(False), "")
    for name, pattern in fixed.FAMILIES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unknown")


#: Words of event types and titles that put a story in a broad category, in order.
CATEGORY_WORDS = [
    ("crime_public_safety", ("crash", "arrest", "shoot", "missing person", "animal rescue", "crime")), ("government", ("meeting", "government", "budget", "ordinance", "commission", "council")),
    ("sports", ("baseball", "football", "basketball", "game", "mets", "cardinals")), ("weather", ("storm", "hurricane", "tornado", "weather", "flood")),
    ("business", ("business", "development", "company", "store", "restaurant")),
]


def story_category(c: Column) -> Column:
    """The resolver's broad category of event types and title."""
    low, out = F.lower(c), F.when(F.lit(False), "")
    for name, words in CATEGORY_WORDS:
        out = out.when(text.contains_any(low, words), name)
    return out.otherwise("general")


def broad_key(key: Column) -> Column:
    """Whether an event key names a class of events rather than one."""
    return key.rlike(r"^(?:fire|traffic-crash|missing-person)(?:-[a-z-]+)?$|^unknown-event$")


def class_key(key: Column) -> Column:
    """As broad_key(), but a key that ends in the ten digits of a digest is one event's, even where all of them are letters."""
    return broad_key(key) & ~key.rlike("-[0-9a-f]{10}$")


def _timeline_rows(entries: DataFrame) -> DataFrame:
    return entries.select("story_id", "entry_id", "event_key", text.headline_key(F.col("title")).alias("key"), text.timeline_tokens(F.col("title")).alias("tokens"), event_family(F.col("title")).alias("family"))


def close_entries(rows: DataFrame) -> DataFrame:
    """Pairs of entries of a story whose titles share a token: story_id, a, b (a < b), continues, spared.

    continues: they share enough to be one event. spared: their families are known and
    differ, but they share too much to conflict.
    """
    sets = ranked(rows.select(F.struct("story_id", "entry_id").alias("id"), "tokens"), 1).join(rows.select(F.struct("story_id", "entry_id").alias("id"), "family"), "id").withColumn("story_id", F.col("id.story_id"))
    met = meet(sets, sets, ["story_id"], F.col("l_id.entry_id") < F.col("r_id.entry_id"))
    shared, share = F.size(F.array_intersect("l_tokens", "r_tokens")), text.overlap(F.col("l_tokens"), F.col("r_tokens"))
    other = (F.col("l_family") != "unknown") & (F.col("r_family") != "unknown") & (F.col("l_family") != F.col("r_family"))
    return met.select("story_id", F.col("l_id.entry_id").alias("a"), F.col("r_id.entry_id").alias("b"), (((shared >= 2) & (share >= 0.30)) | (share >= 0.50)).alias("continues"), (other & ((share >= 0.20) | (shared >= 2))).alias("spared"))


def timeline_pairs(entries: DataFrame) -> DataFrame:
    """(story_id, entry_id, title, event_key) -> later entries with continuity and conflict against all earlier ones.

    An entry continues one of its event key, of its title, or whose title shares enough
    tokens. It conflicts with one of another known family whose title shares next to
    nothing. Only entries that share a token meet; keys and titles go by their first
    entry, and conflicts by counting the earlier entries of other families, less those
    that share too much.
    """
    t = _timeline_rows(entries)
    close = close_entries(t).groupBy("story_id", F.col("b").alias("entry_id")).agg(F.max("continues").alias("near"), F.count_if("spared").alias("spared"))
    before = Window.partitionBy("story_id").orderBy("entry_id").rowsBetween(Window.unboundedPreceding, -1)
    kin = Window.partitionBy("story_id", "family").orderBy("entry_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("family") != "unknown"
    out = t.withColumns({"others": F.count_if(known).over(before), "earlier": F.count(F.lit(1)).over(before)}).withColumn("others", F.when(known, F.col("others") - F.count(F.lit(1)).over(kin)).otherwise(0))
    for c in ("event_key", "key"):
        out = out.withColumn(f"first_{c}", F.min("entry_id").over(Window.partitionBy("story_id", c)))
    out = out.where("earlier > 0").join(close, ["story_id", "entry_id"], "left")
    same = (F.col("first_event_key") < F.col("entry_id")) | (F.col("first_key") < F.col("entry_id"))
    out = out.withColumns({"continues": F.coalesce(same, F.lit(False)) | F.coalesce("near", F.lit(False)), "conflicts": F.col("others") > F.coalesce("spared", F.lit(0))})
    return out.select("story_id", "entry_id", "continues", "conflicts", (~F.col("continues") & F.col("conflicts")).alias("reject"))


#: Entries of a family of a story among which a conflict is looked for before all are counted.
_TRIED = 6
#: Holders of a token in a story up to which they are met first.
_FEW = 64


def _run_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of a story's sets that share a run of tokens, in order of rarity, as long as the larger of them needs.

    Every two sets of a run continue one another, so all are linked with the first of
    them. Sets that share as much in several places are left to :func:`_across`.
    """
    n = F.size("tokens")
    need = F.greatest(F.least(n, F.lit(2)), F.ceil(n * 0.30 - 1e-9).cast("int"))
    runs = F.flatten(F.transform(F.sequence(need, F.least(n, need + 2)), lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice("tokens", i + 1, k), " "))))
    each = sets.select(F.col("id.story_id").alias("story_id"), F.col("id.entry_id").alias("b"), F.explode(runs).alias("run"))
    return each.select(F.min("b").over(Window.partitionBy("story_id", "run")).alias("a"), "b").where("a < b").distinct()


def _across(sets: DataFrame, few: bool) -> DataFrame:
    """Links (a, b) between parts of a story: parts with sets that share enough, by tokens that few of its sets hold or by the others.

    sets: story_id, part, tokens and what ranked() takes of them. Of the sets of a token
    the part that has most of them doesn't meet itself, so that where nearly all are of
    one part only the others are met.
    """
    torn = sets.groupBy("story_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("story_id")
    own = sets.join(torn, "story_id", "left_semi")
    side = lambda p, by: own.select("story_id", F.col("part").alias(f"{p}_part"), F.col("tokens").alias(f"{p}_tokens"), F.explode(by).alias("token"))
    small, large = side("r", "index"), side("l", "prefix")
    held = large.groupBy("story_id", "token", F.col("l_part").alias("part")).agg(F.count(F.lit(1)).alias("n")).groupBy("story_id", "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("n", "part")).alias("most"))
    met_by = cut(held.where((F.col("parts") > 1) & (F.col("n") <= _FEW if few else F.col("n") > _FEW)).select("story_id", "token", "most"))
    small, large = small.join(met_by, ["story_id", "token"]), large.join(met_by.select("story_id", "token", F.col("most").alias("l_most")), ["story_id", "token"])
    beside = small.where("r_part <> most").join(large.drop("l_most"), ["story_id", "token"]).where("l_part <> r_part").drop("most")
    within = small.where("r_part = most").drop("most").join(large.where("l_part <> l_most").drop("l_most"), ["story_id", "token"])
    met = beside.unionByName(within).where(F.size("r_tokens") <= F.size("l_tokens"))
    shared, share = F.size(F.array_intersect("l_tokens", "r_tokens")), text.overlap(F.col("l_tokens"), F.col("r_tokens"))
    return met.where(((shared >= 2) & (share >= 0.30)) | (share >= 0.50)).select(F.least("l_part", "r_part").alias("a"), F.greatest("l_part", "r_part").alias("b")).distinct()


def _parts(t: DataFrame) -> DataFrame:
    """Timeline rows -> entry_id, part: the first entry of those that continue one another, directly or through others."""
    named = t.select("story_id", "entry_id", F.array_sort("tokens").alias("tokens"), *("event_key", "key"))
    # equal titles, keys and sets hang on their first entry
    links = [named.where(F.col(c).isNotNull() if c != "tokens" else F.size(c) > 0).select(F.min("entry_id").over(Window.partitionBy("story_id", c)).alias("a"), F.col("entry_id").alias("b")).where("a < b") for c in ("event_key", "key", "tokens")]
    once = named.where("size(tokens) > 0").groupBy("story_id", "tokens").agg(F.min("entry_id").alias("entry_id"))
    sets = cut(ranked(once.select(F.struct("story_id", "entry_id").alias("id"), "tokens"), 1, 0.30))
    found = graph.components(links[0].unionAll(links[1]).unionAll(links[2]).unionAll(_run_links(sets)))
    placed = cut(named.select("story_id", "entry_id").join(found.withColumnRenamed("id", "entry_id"), "entry_id", "left").select("story_id", "entry_id", F.coalesce("component", "entry_id").alias("part")))
    sets = sets.select("id.*", "tokens", "prefix", "index")
    for few in (True, False):
        links = cut(_across(sets.join(placed.drop("story_id"), "entry_id"), few))
        if not links.isEmpty():
            joined = graph.components(links).withColumnRenamed("id", "part")
            placed = cut(placed.join(joined, "part", "left").select("story_id", "entry_id", F.coalesce("component", "part").alias("part")))
    return placed.select("entry_id", "part")


def _conflicts(t: DataFrame) -> DataFrame:
    """Timeline rows -> story_id of the stories of which two entries conflict.

    A conflict among the first entries of each family is enough. Where there is none,
    entries that hold the two commonest tokens of their story can't conflict with one
    another, so only those that lack one meet the others.
    """
    known = t.where("family <> 'unknown'").select("story_id", "entry_id", "family", "tokens")
    apart = known.groupBy("story_id").agg((F.min("family") < F.max("family")).alias("differ")).where("differ").select("story_id")
    known = cut(known.join(apart, "story_id", "left_semi"))
    side = lambda df, p: df.select("story_id", F.col("family").alias(f"{p}_family"), F.col("tokens").alias(f"{p}_tokens"))
    shared, share = F.size(F.array_intersect("l_tokens", "r_tokens")), text.overlap(F.col("l_tokens"), F.col("r_tokens"))
    against = lambda a, b: side(a, "l").join(side(b, "r"), "story_id").where("l_family <> r_family").where((shared < 2) & (share < 0.20)).select("story_id").distinct()
    tried = first_by(known, ["story_id", "family"], [F.asc("entry_id")], _TRIED)
    seen = cut(against(tried, tried))
    left = known.join(seen, "story_id", "left_anti")
    counts = left.select("story_id", F.explode("tokens").alias("token")).groupBy("story_id", "token").agg(F.count(F.lit(1)).alias("n"))
    core = first_by(counts, ["story_id"], [F.desc("n"), F.asc("token")], 2).groupBy("story_id").agg(F.collect_list("token").alias("core"))
    outside = left.join(core, "story_id", "left").where(F.coalesce((F.size("core") < 2) | (F.size(F.array_except("core", "tokens")) > 0), F.lit(True)))
    return seen.unionAll(against(outside, left))


def timeline_parts(entries: DataFrame) -> DataFrame:
    """(story_id, entry_id, title, event_key) -> story_id, entry_id, part, torn.

    part is the first entry of those that continue one another; torn says whether two
    entries of the story conflict. See timeline_pairs() for both. Neither lists the pairs
    of a story: parts are joined through what many share first, and then only across.
    """
    t = cut(_timeline_rows(entries))
    torn = _conflicts(t).select("story_id", F.lit(True).alias("torn"))
    return t.select("story_id", "entry_id").join(_parts(t), "entry_id").join(torn, "story_id", "left").select("story_id", "entry_id", "part", F.coalesce("torn", F.lit(False)).alias("torn"))


#: Weights of the shares of each kind of evidence; these make .88 of a score, titles .07 and event keys .05.
RESOLVER_WEIGHTS = {"facts": 0.25, "locations": 0.18, "agencies": 0.18, "types": 0.14, "entities": 0.25}


def resolve(articles: DataFrame, stories: DataFrame, *, least: float = 0.78) -> DataFrame:
    """The story of each article by the best structured evidence, or none.

    articles: id, title, event_key, and arrays facts, locations, agencies, types and
    entities; stories: id, title, those arrays, and if there, arrays events (keys) and
    title_tokens, and status. Archived stories get nothing. Contradicting locations,
    agencies or categories rule a pair out, each category has its own minimum, and the
    best score must reach ``least``. Pairs are blocked on shared values of as many kinds
    together as no score reaches that without.
    """
    kinds = list(RESOLVER_WEIGHTS)
    col = lambda df, name, kind: (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
    values = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array()), lambda x: F.lower(text.collapse(x))), lambda x: x != ""))
    cat = story_category(F.concat_ws(" ", F.array_join("types", " "), text.collapse(F.col("title")))).alias("cat")
    keyed = lambda c: text.resolver_tokens(F.replace(c, F.lit("-"), F.lit(" ")))

    def ready(df: DataFrame, key: str, tokens: Column, events: Column) -> DataFrame:
        return df.select(F.col("id").alias(key), "title", *[values(col(df, k, "array<string>")).alias(k) for k in kinds], tokens.alias("tokens"), events.alias("events")).select("*", cat)

    live = stories.where(F.coalesce(col(stories, "status", "string"), F.lit("")) != "archived")
    known = F.array_union(text.resolver_tokens(F.col("title")), F.coalesce(col(live, "title_tokens", "array<string>"), F.array()))
    a = ready(articles, "article_id", text.resolver_tokens(F.col("title")), keyed(col(articles, "event_key", "string")))
    s = ready(live, "story_id", known, F.array_distinct(F.flatten(F.transform(F.coalesce(col(live, "events", "array<string>"), F.array()), keyed))))
    pre = lambda df, p, key: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in (*kinds, "cat", "tokens", "events")])
    keys = lambda p: F.concat(*[combined(shared, lambda k: F.col(f"{p}_{k}")) for shared in _must_share(least)])
    # computed once for a row, not for each of its keys
    j = meet_on_keys(cut(pre(a, "a", "article_id")), cut(pre(s, "s", "story_id")), keys("a"), keys("s"))
    other = (F.col("a_cat") != "general") & (F.col("s_cat") != "general") & (F.col("a_cat") != F.col("s_cat"))
    shares = [text.overlap(F.col(f"a_{c}"), F.col(f"s_{c}")).alias(c) for c in (*kinds, "tokens", "events")]

    def judged(t: Column) -> Column:
        """The score of a pair that no rule keeps apart, by its shares, which are computed once."""
        has = {c: t[c] > 0 for c in kinds}
        clash = F.lit(False)
        for c in ("locations", "agencies"):
            clash = clash | ((F.size(f"a_{c}") > 0) & (F.size(f"s_{c}") > 0) & ~has[c])
        titles, events = t["tokens"], t["events"]
        anchors = has["locations"].cast("int") + has["agencies"].cast("int") + has["types"].cast("int") + has["entities"].cast("int")
        c = F.col("a_cat")
        enough = (
            F.when(c == "crime_public_safety", (anchors >= 2) & (has["facts"] | has["entities"] | (events >= 0.55)))
            .when(c == "government", (has["agencies"] | has["entities"]) & (has["facts"] | (titles >= 0.45)))
            .when(c == "sports", (has["entities"] | (titles >= 0.55)) & (has["facts"] | (events >= 0.55)))
            .when(c == "weather", has["types"] & (has["locations"] | has["entities"]))
            .when(c == "business", has["entities"] & (has["locations"] | (titles >= 0.5)))
            .otherwise((anchors >= 2) & has["facts"])
        )
        structured = sum((w * t[k] for k, w in RESOLVER_WEIGHTS.items()), F.lit(0.0))
        return F.when(~clash & enough, F.bround(0.88 * structured + 0.07 * titles + 0.05 * events, 6))

    good = j.where(~other).select("article_id", "story_id", text.bind(F.struct(*shares), judged).alias("score")).where(F.col("score") >= least)
    return first_by(good, ["article_id"], [F.desc("score"), F.asc("story_id")])


def _must_share(least: float) -> list[tuple[str, ...]]:
    """Sets of kinds of evidence; of each pair whose score reaches ``least`` the kinds with a shared value hold one of them."""
    kinds = list(RESOLVER_WEIGHTS)
    every = [set(c) for n in range(len(kinds) + 1) for c in combinations(kinds, n)]
    enough = [c for c in every if 0.88 * sum(RESOLVER_WEIGHTS[k] for k in c) + 0.12 >= least - 1e-6]
    fewest = [c for c in enough if c and not any(o and o < c for o in enough)]
    return [tuple(k for k in kinds if k in c) for c in fewest]


def first_tier(articles: DataFrame, hits: DataFrame, key: str = "article_id") -> DataFrame:
    """(key), and hits (key, tier, story_id) -> each article's first tier and its story; tier 9 without one."""
    best = hits.where("story_id is not null").groupBy(key).agg(F.min(F.struct("tier", "story_id")).alias("b"))
    return articles.select(key).join(best, key, "left").select(key, F.coalesce("b.tier", F.lit(9)).alias("tier"), F.col("b.story_id").alias("story_id"))


def owned(articles: DataFrame, stories: DataFrame, key: str, tier: int, id_col: str = "article_id") -> DataFrame:
    """Hits of articles on the one story that has their value of key; a value of several stories gives none."""
    owners = stories.where(F.col(key) != "").groupBy(key).agg(F.min("story_id").alias("story_id"), F.countDistinct("story_id").alias("n")).where("n = 1").drop("n")
    rows = articles.where(F.size(F.split("title_key", " ")) >= 4) if key == "title_key" else articles.where(F.col(key) != "")
    return rows.join(owners, key).select(id_col, F.lit(tier).alias("tier"), "story_id")


def cascade(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """The story of each article by the first tier that gives exactly one: event key, exact title, source URL.

    A tier with more than one story gives none, and the next tier is asked. What no tier
    resolves is a new story (tier 9, null story). The tiers after these need more than
    keys; see incidents.resolve_reports().
    """
    hits = [owned(articles, stories, key, n) for n, key in enumerate(("event_key", "title_key", "url"), 1)]
    return first_tier(articles, hits[0].unionAll(hits[1]).unionAll(hits[2]))


def repair(stories: DataFrame, aliases: DataFrame, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """Merge stories that share an exact title or a URL until none do; returns stories and flat aliases.

    stories: story_id long, titles and urls arrays, custom and priority ints. Each round
    joins stories on shared keys, takes components, unites arrays and keeps the primary:
    most custom, then highest priority, then lowest id. Merged ids become aliases.
    A repaired registry comes back unchanged; one that ``most`` rounds don't settle is an
    error, as nothing may be published from it.
    """
    now, renamed = cut(stories), cut(aliases.select("alias", "target"))
    for _ in range(most):
        keys = now.select("story_id", F.explode(F.concat(F.transform("titles", lambda t: F.concat(F.lit("t:"), text.headline_key(t))), F.transform("urls", lambda u: F.concat(F.lit("u:"), u)))).alias("k")).where("length(k) > 6")
        first = keys.groupBy("k").agg(F.min("story_id").alias("a"), F.countDistinct("story_id").alias("n")).where("n > 1")
        found = cut(graph.components(keys.join(first, "k").select("a", F.col("story_id").alias("b"))))
        if found.isEmpty():
            break
        placed = now.join(found.withColumnRenamed("id", "story_id"), "story_id", "left").withColumn("root", F.coalesce("component", "story_id"))
        rank = F.struct("custom", "priority", -F.col("story_id"))
        merged = placed.groupBy("root").agg(
            F.max_by("story_id", rank).alias("story_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("titles")))).alias("titles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"),
            F.sum("custom").cast("int").alias("custom"), F.max("priority").alias("priority"),
        )
        merged = cut(merged)
        gone = placed.select("root", F.col("story_id").alias("alias")).join(merged.select("root", F.col("story_id").alias("target")), "root").where("alias <> target").select("alias", "target")
        renamed = cut(renamed.unionAll(gone).distinct())
        now = merged.select("story_id", "titles", "urls", "custom", "priority")
    else:
        raise ValueError(f"the registry did not settle in {most} rounds")
    return now, graph.flatten_aliases(renamed, now.select(F.col("story_id").alias("id")))


def source_match(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """(article_id, url, title) -> the one story with the same identity URL, and why there is none.

    An address that rolls (weather, live, blogs) joins a story only if the titles agree
    too: equal, or two tokens shared and .35 of the smaller. More than one story is
    ambiguous and gives none. stories: story_id, url, title, one row for each title.
    """
    a = articles.select("article_id", "url", text.headline_key(F.col("title")).alias("key"), text.source_title_tokens(F.col("title")).alias("t"))
    s = stories.where("url <> ''").select("url", "story_id", text.headline_key(F.col("title")).alias("skey"), text.source_title_tokens(F.col("title")).alias("st"))
    rolling = F.arrays_overlap(text.words(F.regexp_replace("url", r"^\w+://[^/]*", "")), text.strings(fixed.ROLLING_PATHS))
    agrees = (F.col("key") == F.col("skey")) | ((F.size(F.array_intersect("t", "st")) >= 2) & (text.overlap(F.col("t"), F.col("st")) >= 0.35))
    met = a.where("url <> ''").join(s, "url").groupBy("article_id", "story_id").agg(F.max(~rolling | agrees).alias("ok"))
    found = met.groupBy("article_id").agg(F.count_if("ok").alias("n"), F.min(F.when(F.col("ok"), F.col("story_id"))).alias("only"))
    why = F.when(F.col("url") == "", "not_an_identity").when(F.col("n").isNull(), "no_story").when(F.col("n") == 0, "rolling_without_continuity").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return articles.select("article_id", "url").join(found, "article_id", "left").select("article_id", why.alias("outcome"), F.when(F.col("n") == 1, F.col("only")).alias("story_id"))


def corroborated_identity(cards: DataFrame, stories: DataFrame) -> DataFrame:
    """(article_id, story_id, slug, url, title) -> the story that evidence supports.

    A card's own story id counts only with its slug, URL or title, or a strongly
    overlapping title (medium confidence). Else the owner of the slug, the URL, then the
    title; the first story owns a key. stories: story_id, slug, url, title.
    """
    out = cards.withColumn("tk", text.title_tokens(F.col("title")))
    titled = stories.withColumn("title_key", text.headline_key(F.col("title")))
    out = out.withColumn("title_key", text.headline_key(F.col("title")))
    for key in ("slug", "url", "title_key"):
        owner = titled.where(F.col(key) != "").groupBy(key).agg(F.min("story_id").alias(f"by_{key}"))
        out = out.join(owner, key, "left")
    own = stories.select("story_id", F.lit(True).alias("known"), text.title_tokens(F.col("title")).alias("own_tk"))
    out = out.join(own, "story_id", "left")
    shared = F.size(F.array_intersect("tk", "own_tk"))
    strong = F.coalesce((shared >= 4) & ((text.overlap(F.col("tk"), F.col("own_tk")) >= 0.70) | (text.jaccard(F.col("tk"), F.col("own_tk")) >= 0.55)), F.lit(False))
    sid, known = F.col("story_id"), F.coalesce("known", F.lit(False))
    basis = (
        F.when(known & (F.col("by_slug") == sid), "persistent_story_id+canonical_slug").when(known & (F.col("by_url") == sid), "persistent_story_id+source_url")
        .when(known & (F.col("by_title_key") == sid), "persistent_story_id+exact_title").when(known & strong, "persistent_story_id+strong_title_overlap")
        .when(F.col("by_slug").isNotNull(), "canonical_slug").when(F.col("by_url").isNotNull(), "source_url").when(F.col("by_title_key").isNotNull(), "title")
        .when(sid.isNotNull(), "uncorroborated_persistent_story_id").otherwise("unmatched")
    )
    out = out.withColumn("basis", basis)
    story = F.when(F.col("basis").startswith("persistent"), sid).when(F.col("basis") == "canonical_slug", F.col("by_slug")).when(F.col("basis") == "source_url", F.col("by_url")).when(F.col("basis") == "title", F.col("by_title_key"))
    trust = F.when(F.col("basis") == "persistent_story_id+strong_title_overlap", "medium").when(F.col("basis") == "uncorroborated_persistent_story_id", "low").when(F.col("basis") == "unmatched", "unmatched").otherwise("high")
    return out.select("article_id", story.alias("story_id"), "basis", trust.alias("confidence"), (sid.isNotNull() & ~F.col("basis").startswith("persistent")).alias("conflict"))
