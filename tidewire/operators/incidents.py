"""Matching of reports with stories by incident: signatures, unified evidence, relationships.

All three meet reports and stories on concrete shared values (an anchor, a person, a
place with an agency, ...), without which their rules can't agree, never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.functions import incidents as told
from tidewire.operators import identity
from tidewire.operators.checkpoints import cut
from tidewire.operators.ordered import first_by
from tidewire.operators.pairs import combined, meet_on_keys

_NONE = "array<string>"


def _array(df: DataFrame, name: str) -> Column:
    return F.coalesce((F.col(name) if name in df.columns else F.lit(None)).cast(_NONE), F.array().cast(_NONE))


def _joined(df: DataFrame) -> Column:
    """All that is told beside the titles, in one text."""
    parts = [F.array_join(_array(df, n), " | ") for n in ("facts", "locations", "agencies", "types", "entities")]
    return F.concat_ws(" | ", *[F.when(p != "", p) for p in parts])


#: tasks that the animal cases of one sign and span of days are dealt to
_DEALT = 32

# -- signatures --------------------------------------------------------------------------


def signatures(df: DataFrame, id_col: str) -> DataFrame:
    """(id, titles, published array, and if there facts, locations, agencies, types, entities) -> id, family, anchor, tokens, counts, markers, published.

    family is named_person_death, infrastructure_condition, mass_animal_hoarding or empty.
    """
    title = F.array_join(F.filter("titles", lambda t: F.trim(t) != ""), " | ")
    t = df.select(id_col, "published", title.alias("title"), F.concat_ws(" | ", title, _joined(df)).alias("whole"), _joined(df).alias("more"), _array(df, "entities").alias("entities"))
    t = t.withColumns({"counts": told.animal_counts(F.col("whole")), "anchor": told.anchor(F.col("title"), F.col("more"), F.col("entities")), "asset": told.infrastructure(F.col("whole"))})
    dead = F.col("anchor").startswith("named-person-death:")
    kind = F.when(dead, "named_person_death").when(F.col("asset") != "", "infrastructure_condition").when(told.hoarding(F.col("title"), F.col("counts")), "mass_animal_hoarding").otherwise("")
    key = F.when(~dead & (F.col("asset") != ""), F.concat(F.lit("infrastructure-condition:"), F.col("asset"))).otherwise(F.col("anchor"))
    return t.select(id_col, kind.alias("family"), key.alias("anchor"), told.signature_tokens(F.col("whole")).alias("tokens"), "counts", told.markers(F.col("whole"), F.col("counts")).alias("markers"), "published")


def _gap(a: Column, b: Column) -> Column:
    """Days between the closest two of two arrays of times; null where one has none."""
    seconds = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.unix_micros(x) / 1e6)
    return F.array_min(F.flatten(F.transform(seconds(a), lambda x: F.transform(seconds(b), lambda y: F.abs(x - y) / 86400.0))))


def incident_match(reports: DataFrame, stories: DataFrame, entries: DataFrame, *, days: float = 7.0, first: tuple[int, ...] = (64, 1024)) -> DataFrame:
    """(report_id, story_id, confidence): the story of each report's incident, if one has it.

    reports and stories: id, titles, published and what signatures() takes; entries:
    story_id, title, one row for each entry of a story. Named deaths and assets agree by
    their anchor. Animal cases must be within ``days`` and share two of: counts, a
    distinctive marker, a fourth of their words, one of them a count or a marker. Of
    several stories the one whose entries are most of them about the incident counts,
    then the one with more of them, the surer one, the first. Animal cases are met in
    that order, first with the ``first`` stories that share a sign and a span of days;
    those that one as sure as can be isn't found for meet more of them, at last all.
    """
    # each is read from several sides
    r = cut(signatures(reports, "report_id").where("family <> ''"))
    s = cut(signatures(stories, "story_id").where("family <> ''"))
    side = lambda df, p: df.select(*[F.col(c).alias(c if c.endswith("_id") else f"{p}_{c}") for c in df.columns])
    r, s = side(r, "r"), side(s, "s")
    exact = ["named_person_death", "infrastructure_condition"]
    by_anchor = r.where(F.col("r_family").isin(*exact)).join(s.where(F.col("s_family").isin(*exact)), (F.col("r_family") == F.col("s_family")) & (F.col("r_anchor") == F.col("s_anchor")))
    sure = by_anchor.select("report_id", "story_id", F.lit(0.995).alias("confidence"), F.col("r_anchor").alias("anchor"))

    # how much of a story is about the incident: its entries, a death without a name taking the story's only subject
    subject = s.where(F.col("s_family") == "named_person_death").select("story_id", F.col("s_anchor").alias("inherited"))
    of = entries.where(F.trim("title") != "").join(subject, "story_id", "left")
    dead = F.col("title").rlike(fixed.DEATH_CONTEXT)
    own = told.anchor(F.col("title"), F.lit(None).cast("string"))
    of = of.select("story_id", F.when(dead, F.coalesce(F.nullif(own, F.lit("")), F.col("inherited"), F.lit(""))).otherwise("").alias("anchor"))
    total = cut(entries.groupBy("story_id").agg(F.count(F.lit(1)).alias("total")))
    matching = cut(of.groupBy("story_id", "anchor").agg(F.count(F.lit(1)).alias("matching")))

    def judged(hits: DataFrame) -> DataFrame:
        j = hits.join(total, "story_id", "left").join(matching, ["story_id", "anchor"], "left").withColumn("matching", F.coalesce("matching", F.lit(0)))
        return j.withColumn("purity", F.coalesce(F.col("matching") / F.col("total"), F.lit(0.0)))

    # an animal case meets others on what one of the two certain signs rests on, in spans of days
    span = F.floor(F.lit(days)).cast("int") + 1
    n = lambda c, w: F.when(c, w).otherwise(0.0)
    trust = lambda alike, marked, worded, dated: F.least(F.lit(0.99), F.lit(0.40) + n(alike, 0.18) + n(marked, 0.15) + n(worded, 0.14) + n(dated, 0.05))
    certain = lambda p: F.array_intersect(f"{p}_markers", text.strings(fixed.DISTINCTIVE_MARKERS))

    def keyed(df: DataFrame, p: str, around: list[int]) -> DataFrame:
        signs = F.concat(F.transform(certain(p), lambda m: F.concat(F.lit("m:"), m)), F.when(F.size(f"{p}_counts") > 0, F.array(F.lit("n"))).otherwise(F.array().cast(_NONE)))
        times = F.filter(f"{p}_published", lambda x: x.isNotNull())
        slot = lambda x: F.floor(F.unix_date(x.cast("date")) / span)
        dated = F.flatten(F.transform(times, lambda x: F.array(*[slot(x) + d for d in around])))
        return df.where(F.col(f"{p}_family") == "mass_animal_hoarding").select("*", F.explode(signs).alias("sign"), F.array_distinct(dated).alias("slots"))

    def cases(j: DataFrame) -> DataFrame:
        """The pairs that are of one incident, and how sure that is."""
        # generated columns are computed once, where a filter would take in a projection's; the dearest come last
        once = lambda df, **cols: df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
        j = once(j, gap=_gap(F.col("r_published"), F.col("s_published"))).where(F.col("gap").isNull() | (F.col("gap") <= days))
        j = once(j, alike=told.quantities_agree(F.col("r_counts"), F.col("s_counts")), marked=F.size(F.array_intersect(certain("r"), certain("s"))) > 0).where("alike or marked")
        j = once(j, shared=F.size(F.array_intersect("r_tokens", "s_tokens")))
        # two shared tokens rule out empty sets
        j = j.withColumn("worded", (F.col("shared") >= 2) & (F.col("shared") / F.least(F.size("r_tokens"), F.size("s_tokens")) >= 0.25)).where("alike and marked or worded")
        return j.withColumn("confidence", trust(F.col("alike"), F.col("marked"), F.col("worded"), F.col("gap").isNotNull()))

    a, b = keyed(r, "r", [-1, 0, 1]), cut(keyed(s, "s", [0]))
    undated = F.array(F.lit(-(1 << 40)))
    slotted = lambda df, slots: df.withColumn("slot", F.explode(slots)).drop("slots")
    known = slotted(b, F.when(F.size("slots") == 0, undated).otherwise(F.col("slots")))
    # most find their story among the first of those they could have: then no other can come before it
    some = judged(s.where(F.col("s_family") == "mass_animal_hoarding").select("story_id", F.lit("").alias("anchor"))).select("story_id", (-F.col("purity")).alias("p"), (-F.col("matching")).alias("m"))
    ordered = known.join(some, "story_id")
    left = cut(a.where((F.size("slots") > 0) & (F.col("r_anchor") == "")))
    # how sure the surest could be: the signs of reports and stories take few values, so their kinds meet
    kind = lambda df, p: df.select(F.col(f"{p}_counts"), certain(p).alias(f"{p}_markers"), "sign", "slot")
    asked = slotted(left, F.concat("slots", undated))
    kinds = kind(asked, "r").distinct().join(kind(known, "s").distinct(), ["sign", "slot"])
    alike, marked = told.quantities_agree(F.col("r_counts"), F.col("s_counts")), F.size(F.array_intersect("r_markers", "s_markers")) > 0
    kinds = cut(kinds.withColumn("sure", F.when(alike | marked, trust(alike, marked, F.lit(True), F.lit(True))).otherwise(0.0)).groupBy("r_counts", "r_markers", "sign", "slot").agg(F.max("sure").alias("sure")))
    most_sure = cut(asked.withColumn("r_markers", certain("r")).join(kinds, ["r_counts", "r_markers", "sign", "slot"]).groupBy("report_id").agg(F.max("sure").alias("most_sure")))
    hits = [judged(sure)]
    for most in first:
        if left.isEmpty():
            break
        best = first_by(ordered, ["sign", "slot"], [F.asc("p"), F.asc("m"), F.asc("story_id")], most + 1, rank="at").drop("s_family", "s_anchor")
        best = cut(best)
        look = slotted(left, F.concat("slots", undated))
        unseen = look.join(best.where(F.col("at") > most).select("sign", "slot", "p", "m", "story_id"), ["sign", "slot"]).groupBy("report_id").agg(F.min(F.struct("p", "m", "story_id")).alias("unseen"))
        # few signs and spans have all rows: the reports of one are dealt to several tasks
        dealt = best.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))))
        met = cases(look.withColumn("part", F.pmod(F.xxhash64("report_id"), F.lit(_DEALT)).cast("int")).join(dealt.hint("merge"), ["sign", "slot", "part"]))
        at = met.groupBy("report_id").agg(F.min(F.struct("p", "m", (-F.col("confidence")).alias("c"), "story_id")).alias("best"))
        at = left.select("report_id").distinct().join(at, "report_id", "left").join(unseen, "report_id", "left").join(most_sure, "report_id", "left")
        settled = F.col("unseen").isNull() | F.coalesce((-F.col("best.c") >= F.col("most_sure")) & (F.struct("best.p", "best.m", "best.story_id") <= F.col("unseen")), F.lit(False))
        at = cut(at.withColumn("settled", settled))
        hits.append(at.where("settled and best is not null").select("best.story_id", "report_id", (-F.col("best.c")).alias("confidence"), (-F.col("best.m")).alias("matching"), (-F.col("best.p")).alias("purity")))
        left = cut(left.join(at.where("not settled").select("report_id"), "report_id", "left_semi"))
    # the others meet all that they could have
    rest = left.unionAll(a.where((F.size("slots") == 0) | (F.col("r_anchor") != "")))
    dated = slotted(rest.where("size(slots) > 0"), F.concat("slots", undated)).join(known, ["sign", "slot"])
    every = dated.drop("slot").unionByName(rest.where("size(slots) = 0").drop("slots").join(b.drop("slots"), "sign"))
    hits.append(judged(cases(every).select("report_id", "story_id", "confidence", F.col("r_anchor").alias("anchor"))))
    cols = ["report_id", "story_id", "confidence", "matching", "purity"]
    found = hits[0].select(cols)
    for more_hits in hits[1:]:
        found = found.unionAll(more_hits.select(cols))
    return first_by(found, ["report_id"], [F.desc("purity"), F.desc("matching"), F.desc("confidence"), F.asc("story_id")]).select("report_id", "story_id", "confidence")


# -- unified evidence --------------------------------------------------------------------


def evidence_score(a: Column, b: Column) -> Column:
    """How sure two pieces of evidence are of one incident, 0 where they are not (from .86 on they are)."""
    # what both hold is read by many conditions, and found once
    both = {f: F.array_intersect(a[f], b[f]).alias(f) for f in ("concepts", "people", "locations", "agencies", "distinctive")}
    shares = {f"{f}_share": text.overlap(a[f], b[f]).alias(f"{f}_share") for f in ("distinctive", "title")}
    return text.bind(F.struct(*both.values(), *shares.values()), lambda shared: _score(a, b, shared))


def _score(a: Column, b: Column, both: Column) -> Column:
    clash = lambda x, y, shared: (F.size(x) > 0) & (F.size(y) > 0) & (F.size(shared) == 0)
    has = lambda c, *names: F.forall(text.strings(names), lambda n: F.array_contains(c, n))
    within = lambda c, names: F.array_intersect(c, text.strings(names))
    kind = lambda c, prefix: F.filter(c, lambda x: x.startswith(prefix))
    concepts, people, places, agencies, own = both["concepts"], both["people"], both["locations"], both["agencies"], both["distinctive"]
    n_own, own_share, title_share = F.size(own), both["distinctive_share"], both["title_share"]
    at = F.size(places) > 0
    fam = a["family"]
    # a missing person by first name and surname, on one side perhaps among the words alone
    in_words = lambda names, tokens: F.filter(names, lambda x: F.forall(F.split(x, " "), lambda w: F.array_contains(tokens, w)))
    alone = F.when(F.size(b["people"]) == 0, in_words(a["aliases"], b["distinctive"])).when(F.size(a["people"]) == 0, in_words(b["aliases"], a["distinctive"])).otherwise(F.array().cast(_NONE))
    aliases = F.when(fam == "missing_person", F.when(F.arrays_overlap(a["aliases"], b["aliases"]), F.array_intersect(a["aliases"], b["aliases"])).otherwise(alone)).otherwise(F.array().cast(_NONE))
    same_person = (F.size(people) > 0) | (F.size(aliases) > 0)
    more = lambda base, c, most=4: F.round(base + F.least(F.lit(most), F.size(c)) * 0.01, 2)
    by_person = F.when(F.size(aliases) > 0, F.greatest(F.lit(0.97), more(0.94, concepts))).otherwise(more(0.94, concepts))

    ages, bonds = (lambda s: kind(s["concepts"], "age_")), (lambda s: kind(s["concepts"], "bond_"))
    same_age, same_bond = F.array_intersect(ages(a), ages(b)), F.array_intersect(bonds(a), bonds(b))
    age_clash, bond_clash = clash(ages(a), ages(b), same_age), clash(bonds(a), bonds(b), same_bond)
    core = F.size(within(concepts, fixed.CRUELTY_CORE))
    office = F.size(agencies) > 0
    cruelty = (
        F.when(age_clash | bond_clash, 0.0).when(at & (F.size(same_age) > 0) & (F.size(same_bond) > 0) & (core >= 2), 0.99)
        .when(at & ((F.size(same_age) > 0) | (F.size(same_bond) > 0)) & office & (core >= 3), 0.97).when(at & office & (core >= 4) & (n_own >= 3), 0.93).otherwise(0.0)
    )
    searched = has(concepts, "missing_person_signal") & (has(concepts, "last_seen") | has(concepts, "public_search"))
    profile = F.size(within(concepts, ["autistic_subject", "minor_subject"])) > 0
    missing = (
        F.when(age_clash | ((F.size(a["people"]) > 0) & (F.size(b["people"]) > 0)), 0.0).when(at & (F.size(same_age) > 0) & (profile | searched), 0.96)
        .when(at & has(concepts, "autistic_subject", "minor_subject", "last_seen") & (title_share >= 0.30) & (n_own >= 4), 0.91).otherwise(0.0)
    )
    act, scene = ["pit_maneuver", "forced_off_road"], ["fence_collision", "family_victim"]
    acted = (F.size(within(a["concepts"], act)) > 0) & (F.size(within(b["concepts"], act)) > 0)
    rage = (
        F.when(acted & (F.size(within(concepts, scene)) > 0), more(0.94, concepts)).when(acted & has(concepts, "family_victim") & (title_share >= 0.25), 0.91)
        .when((F.size(concepts) >= 3) & (title_share >= 0.28), 0.90).when((F.size(within(concepts, scene)) >= 2) & (title_share >= 0.25), 0.88).when(at & (title_share >= 0.30), 0.87).otherwise(0.0)
    )
    worded = ((n_own >= 3) & (own_share >= 0.60) & (title_share >= 0.55)) | ((n_own >= 2) & (own_share >= 0.66) & (title_share >= 0.65))
    general = F.when(~fam.isin(*fixed.GENERAL_FAMILIES) | ~at, 0.0).when(office & (n_own >= 2) & (own_share >= 0.50) & (title_share >= 0.45), more(0.91, own)).when(worded, more(0.89, own)).otherwise(0.0)
    apart = F.abs(F.unix_micros(a["published"]) - F.unix_micros(b["published"])) / 86_400e6
    score = F.when(same_person, by_person).when(fam == "animal_cruelty", cruelty).when(fam == "missing_person", missing).when(fam == "road_rage", rage).otherwise(general)
    off = (fam == "unknown") | (fam != b["family"]) | F.coalesce(apart > 21, F.lit(False)) | (clash(a["locations"], b["locations"], places) & ~same_person & (fam != "road_rage"))
    return F.when(off, 0.0).otherwise(score)


#: how many pieces of a seat hold a value that is looked up at least, before it counts as common
_FEW = 64
_UNDATED = -(1 << 62)


def _read(e: Column) -> Column:
    """The evidence without what its family's rule doesn't read; null where no rule gives a score."""
    fam, named = e["family"], F.size(e["people"]) > 0
    rage, cruel, gone = fam == "road_rage", fam == "animal_cruelty", fam == "missing_person"
    general = fam.isin(*fixed.GENERAL_FAMILIES) & ~cruel & ~gone
    use = {"concepts": ~general | named, "aliases": gone, "agencies": cruel | general, "distinctive": cruel | gone | general, "title": rage | gone | general}
    fields = ("family", "concepts", "people", "aliases", "locations", "agencies", "distinctive", "title", "published")
    kept = F.struct(*[(F.when(use[f], e[f]).otherwise(F.array().cast(_NONE)) if f in use else e[f]).alias(f) for f in fields])
    return F.when((fam != "unknown") & (rage | cruel | gone | general | named), kept)


def _person_keys(e: Column) -> Column:
    """Values of which two pieces of evidence share one if they tell of the same person, or of one who is missing without being named."""
    tag = lambda prefix, c: F.transform(c, lambda x: F.concat_ws("|", e["family"], F.lit(prefix), x))
    # a name stands whole on one side, among the words alone on the other
    two = lambda ws: F.array_join(F.array_sort(ws), " ")
    spelled = F.transform(e["aliases"], lambda x: two(F.split(x, " ")))
    words = F.array_sort("e.distinctive")
    loose = F.when(F.size(e["people"]) == 0, F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: y >= x), lambda y: F.concat_ws(" ", x, y))))).otherwise(F.array().cast(_NONE))
    profile = F.forall(text.strings(["autistic_subject", "minor_subject", "last_seen"]), lambda n: F.array_contains(e["concepts"], n))
    marks = F.concat(F.filter(e["concepts"], lambda x: x.startswith("age_")), F.when(profile, F.array(F.lit("profile"))).otherwise(F.array().cast(_NONE)))
    placed = F.flatten(F.transform(e["locations"], lambda p: F.transform(marks, lambda m: F.concat_ws("|", p, m))))
    gone = F.when(e["family"] == "missing_person", F.concat(tag("n", spelled), tag("n", loose), tag("l", placed))).otherwise(F.array().cast(_NONE))
    return F.array_distinct(F.concat(tag("p", e["people"]), gone))


def _pieces(*tables: DataFrame, few: int = _FEW) -> list[DataFrame]:
    """Different pieces of evidence (known, e) -> rows known, e, keys, class, shape for each seat of theirs.

    A seat is a family at a place, or road rage anywhere. Values (words, concepts) that
    many pieces of a seat hold are common there. Pieces whose score rests on common
    values alone are all scored alike, so they make a class, whose shape is an evidence
    of its own: what isn't common is replaced by values that nothing shares. Pairs that
    share another value score at least as high as their classes do, and share a key; so do
    those who tell of the same person (in rows without a class).
    """
    e = F.col("e")
    seats = F.when(e["family"] == "road_rage", F.array(F.lit(""))).when(e["family"].isin(*fixed.GENERAL_FAMILIES) & (e["family"] != "missing_person"), e["locations"]).otherwise(F.array().cast(_NONE))
    tag = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
    values = F.concat(tag("c ", e["concepts"]), tag("d ", e["distinctive"]), tag("t ", e["title"]))
    seated = [cut(t.select("known", "e", F.explode(seats).alias("at")).select("known", "e", F.concat_ws("|", e["family"], "at").alias("seat"))) for t in tables]
    every = seated[0].select("seat", values.alias("values"))
    for t in seated[1:]:
        every = every.unionAll(t.select("seat", values.alias("values")))
    # a place narrows what meets, so that commoner values may be looked up with one
    share = F.when(F.col("seat").startswith("road_rage|"), 1 / 64).otherwise(1 / 16)
    size = every.groupBy("seat").agg(F.greatest(F.lit(few), F.ceil(F.count(F.lit(1)) * F.max(share))).alias("least"))
    common = every.select("seat", F.explode("values").alias("value")).groupBy("seat", "value").agg(F.count(F.lit(1)).alias("n")).join(size, "seat").where("n >= least")
    common = cut(common.groupBy("seat").agg(F.collect_list("value").alias("common")))
    is_common = lambda prefix: lambda x: F.array_contains("common", F.concat(F.lit(prefix), x))
    none = F.array().cast(_NONE)

    def shape(c: Column, prefix: str) -> Column:
        held = F.array_sort(F.filter(c, is_common(prefix)))
        return F.concat(held, F.slice(text.strings([f"#{i}" for i in range(48)]), F.lit(1), F.size(c) - F.size(held)))

    rare = lambda kind: F.exists(e["concepts"], lambda x: x.startswith(kind) & ~is_common("c ")(x))
    concepts = F.concat(F.array_sort(F.filter(e["concepts"], is_common("c "))), *[F.when(rare(k), F.array(F.lit(f"{k}#"))).otherwise(none) for k in ("age_", "bond_")])
    whole = F.struct(e["family"].alias("family"), concepts.alias("concepts"), e["people"].alias("people"), e["aliases"].alias("aliases"), e["locations"].alias("locations"), e["agencies"].alias("agencies"), shape(e["distinctive"], "d ").alias("distinctive"), shape(e["title"], "t ").alias("title"), F.lit(None).cast("timestamp").alias("published"))
    out = []
    for t, rows in zip(tables, seated, strict=True):
        j = rows.join(common, "seat", "left").withColumn("common", F.coalesce("common", none))
        keys = F.transform(F.filter(values, lambda v: ~F.array_contains("common", v)), lambda v: F.concat_ws("|", F.col("seat"), v))
        j = j.select("known", "e", "seat", keys.alias("keys"), F.when(F.size("common") > 0, whole).alias("shape"))
        j = j.select("known", "e", "keys", F.when(F.col("shape").isNotNull(), F.sha2(F.to_json(F.struct("seat", "shape")), 256)).alias("class"), "shape", "seat")
        alone = t.select("known", "e", _person_keys(e).alias("keys")).where(F.size("keys") > 0)
        out.append(cut(j.unionByName(alone, allowMissingColumns=True)))
    return out


def _linked_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Classes of pieces whose shapes are of one incident: l_class, r_class, score."""
    common = lambda c: F.filter(c, lambda x: ~F.contains(x, F.lit("#")))
    shape = F.col("shape")
    values = F.when(shape["family"] == "road_rage", F.concat(shape["concepts"], shape["title"])).when(shape["family"] == "animal_cruelty", shape["concepts"]).otherwise(shape["distinctive"])
    keys = F.transform(common(values), lambda v: F.concat_ws("|", "seat", v))
    own = lambda c: F.transform(c, lambda x: F.replace(x, F.lit("#"), F.lit("#l")))
    side = lambda df, p: df.where("class is not null").groupBy("class").agg(F.any_value("seat").alias("seat"), F.any_value("shape").alias("shape")).select(F.col("class").alias(f"{p}_class"), F.col("shape").alias(f"{p}_shape"), keys.alias(f"{p}_keys"))
    l_side = side(left, "l").withColumn("l_shape", F.col("l_shape").withField("concepts", own(F.col("l_shape.concepts"))).withField("distinctive", own(F.col("l_shape.distinctive"))).withField("title", own(F.col("l_shape.title"))))
    met = meet_on_keys(l_side, side(right, "r"), F.col("l_keys"), F.col("r_keys"))
    return met.withColumn("score", evidence_score(F.col("l_shape"), F.col("r_shape"))).where("score >= 0.86").select("l_class", "r_class", "score")


def _met_evidence(left: DataFrame, right: DataFrame, days: int = 21) -> DataFrame:
    """Pairs of rows (l_*, r_* with e and keys) that share a key, within the days where both are dated: each once, at the first key."""
    span = days + 1
    slot = lambda e: F.floor(F.unix_date(e["published"].cast("date")) / span)
    undated = lambda e: e["published"].isNull()
    tags = lambda *xs: F.array(*[F.coalesce(x.cast("string"), F.lit("?")) for x in xs])

    def side(df: DataFrame, p: str, slots: Column) -> DataFrame:
        hashed = F.array_sort(F.transform("keys", lambda k: F.xxhash64(k)))
        out = df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "keys"], hashed.alias(f"{p}_keys"), slots.alias("slots"))
        return out.select("*", F.explode(f"{p}_keys").alias("key")).select("*", F.explode("slots").alias("slot")).drop("slots")

    e = F.col("e")
    dated = F.when(undated(e), tags(F.lit("all"))).otherwise(tags(slot(e) - 1, slot(e), slot(e) + 1, F.lit("none")))
    known = F.when(undated(e), tags(F.lit("none"), F.lit("all"))).otherwise(tags(slot(e), F.lit("all")))
    # keys are made from a few numbers of a row, so that a side's size is guessed far too small: it must not be broadcast
    met = side(left, "l", dated).join(side(right, "r", known).hint("merge"), ["key", "slot"])
    return met.where(F.get(F.array_intersect("l_keys", "r_keys"), F.lit(0)) == F.col("key")).drop("key", "slot", "l_keys", "r_keys")


def _latest_within(items: DataFrame, asked: DataFrame, days: int = 21) -> DataFrame:
    """(class, x, story_id) and (class, x) asked for -> class, x, story_id: the last two stories of the class within the days of x, and perhaps some more.

    x counts microseconds. The days around a time lie in two blocks of as many, so what
    ends one and what begins the next hold them all: nothing is met with each other.
    """
    reach = days * 86_400_000_000
    block = 2 * reach + 1
    dated, undated = F.col("x") != _UNDATED, F.col("x") == _UNDATED
    last = lambda df: first_by(df.select("class", "story_id").distinct(), ["class"], [F.desc("story_id")], 2)
    found = [asked.where(dated).join(last(items.where(undated)), "class"), asked.where(undated).join(last(items), "class")]
    for away, order in ((reach, F.asc), (-reach, F.desc)):
        rows = items.where(dated).select("class", F.col("x").alias("pos"), F.lit(None).cast("long").alias("x"), "story_id")
        rows = rows.unionByName(asked.where(dated).select("class", (F.col("x") + away).alias("pos"), "x"), allowMissingColumns=True)
        w = Window.partitionBy("class", F.col("pos") - F.pmod("pos", F.lit(block))).orderBy(order("pos"), F.col("x").isNotNull())
        before = F.max("story_id").over(w.rowsBetween(Window.unboundedPreceding, -1))
        # the second so far is the greatest of what a story and those before it leave behind
        rows = rows.withColumn("before", before).withColumn("less", F.when(F.col("story_id") != F.col("before"), F.least("story_id", "before")))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        two = rows.select("class", "x", F.array(F.max("story_id").over(upto), F.max("less").over(upto)).alias("two")).where("x is not null")
        found.append(two.select("class", "x", F.explode(F.array_compact("two")).alias("story_id")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def unified_match(reports: DataFrame, stories: DataFrame, *, few: int = _FEW) -> DataFrame:
    """(report_id, story_id, confidence, ambiguous): the story whose evidence is a report's, from .86 on.

    reports: report_id, e; stories: story_id, e, one row for each title of a story. Where
    a second story comes within .03 of the first none is given. Pieces whose common
    values are enough are met by classes, and only the last two stories of a class
    within the days are looked at, as no others can be a first and a second.
    """
    # equal pieces of evidence are met once; of the stories that have one only the last two can be a first and a second
    asked, r = _known_by(reports, "report_id")
    held, s = _known_by(stories, "story_id")
    last = cut(first_by(held.select("known", "story_id").distinct(), ["known"], [F.desc("story_id")], 2))
    mine, theirs = _pieces(r, s, few=few)
    pairs = _met_evidence(mine.select("known", "e", "keys"), theirs.select("known", "e", "keys")).withColumn("score", evidence_score(F.col("l_e"), F.col("r_e"))).where("score >= 0.86")
    found = pairs.select(F.col("l_known").alias("asked"), F.col("r_known").alias("known"), "score").join(last, "known").select("asked", "story_id", "score")

    linked = cut(_linked_classes(mine, theirs))
    x = F.coalesce(F.unix_micros("e.published"), F.lit(_UNDATED)).alias("x")
    asks = mine.where("class is not null").select(F.col("known").alias("asked"), F.col("class").alias("l_class"), x)
    times = asks.select("l_class", "x").distinct().join(linked, "l_class")
    items = theirs.where("class is not null").select("known", "class", x).join(last, "known").select("class", "x", "story_id").distinct()
    tops = _latest_within(items, times.select(F.col("r_class").alias("class"), "x").distinct())
    two = lambda df, key: first_by(df.groupBy(*key, "story_id").agg(F.max("score").alias("score")), key, [F.desc("score"), F.desc("story_id")], 2)
    broad = two(times.join(tops.withColumnRenamed("class", "r_class"), ["r_class", "x"]), ["l_class", "x"])
    found = two(found.unionByName(asks.join(broad, ["l_class", "x"]).select("asked", "story_id", "score")), ["asked"])
    best = asked.select("report_id", F.col("known").alias("asked")).join(found, "asked").groupBy("report_id", "story_id").agg(F.max("score").alias("score"))
    ranked = first_by(best, ["report_id"], [F.desc("score"), F.desc("story_id")], 2, rank="rank")
    out = ranked.groupBy("report_id").agg(F.max(F.when(F.col("rank") == 1, F.col("story_id"))).alias("story_id"), F.max("score").alias("confidence"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    near = F.coalesce(F.round(F.col("second"), 6) >= F.round(F.col("confidence") - 0.03, 6), F.lit(False))
    return out.select("report_id", F.when(~near, F.col("story_id")).alias("story_id"), F.when(near, 0.0).otherwise(F.col("confidence")).alias("confidence"), near.alias("ambiguous"))


def unified_links(stories: DataFrame, *, few: int = _FEW) -> DataFrame:
    """Pairs (a, b) of stories that make the same components as all that have a piece of evidence in common; stories: story_id, e.

    Equal pieces are met once: their stories all hang on the first of them where the
    piece fits another, or itself. Of two linked classes a piece hangs on those nearest in
    time, and only pairs of classes that aren't linked are met one by one.
    """
    held, s = _known_by(stories, "story_id")
    (p,) = _pieces(s, few=few)
    classes = cut(_linked_classes(p, p).select("l_class", "r_class"))
    partners = classes.groupBy(F.col("l_class").alias("class")).agg(F.collect_list("r_class").alias("linked"))
    rows = p.select("known", "e", "keys", "class").join(partners, "class", "left")
    met = _met_evidence(rows, p.select("known", "e", "keys", "class")).where("l_known <= r_known")
    met = met.where(~F.coalesce(F.array_contains("l_linked", F.col("r_class")), F.lit(False)))
    alone = met.where(evidence_score(F.col("l_e"), F.col("r_e")) >= 0.86).select("l_known", "r_known")
    by_class = _nearest_links(p.where("class is not null").select("class", "known", F.unix_micros("e.published").alias("x")), classes.where("l_class <= r_class"))
    linked = cut(alone.unionByName(by_class).distinct())
    first = held.groupBy("known").agg(F.min("story_id").alias("first"))
    on = linked.select(F.explode(F.array("l_known", "r_known")).alias("known")).distinct()
    star = held.join(on, "known").join(first, "known").select(F.col("story_id").alias("a"), F.col("first").alias("b"))
    of = lambda p, name: first.select(F.col("known").alias(f"{p}_known"), F.col("first").alias(name))
    edges = star.unionAll(linked.join(of("l", "a"), "l_known").join(of("r", "b"), "r_known").select("a", "b"))
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _nearest_links(items: DataFrame, classes: DataFrame, days: int = 21) -> DataFrame:
    """Pieces (class, known, x) of linked classes -> pairs (l_known, r_known) that hang together as all within the days do.

    Between two pieces of linked classes within the days every other is within them too, so
    the nearest before and after each lead from one to the other. A class linked to itself
    hangs on the piece before, and every piece of it on itself. Pieces without a time
    hang on all of the other class.
    """
    key = ["l_class", "r_class"]
    side = lambda c, n: items.withColumnRenamed("class", c).join(classes, c).select(*key, F.lit(n).alias("side"), "known", "x")
    alike = F.col("l_class") == F.col("r_class")
    rows = cut(side("l_class", 0).unionByName(side("r_class", 1).where(~alike)))
    pair = lambda a, b: (F.col(a).alias("l_known"), F.col(b).alias("r_known"))
    out = rows.where(alike).select(*pair("known", "known"))
    for order in (F.asc, F.desc):
        w = Window.partitionBy(*key).orderBy(order("x"), order("side"), order("known")).rowsBetween(Window.unboundedPreceding, -1)
        near = lambda n: F.last(F.when(F.col("side") == n, F.struct("x", "known")), ignorenulls=True).over(w)  # noqa: B023, E731
        j = rows.where("x is not null").withColumns({"of_l": near(0), "of_r": near(1)})
        j = j.withColumn("near", F.when(alike | (F.col("side") == 1), F.col("of_l")).otherwise(F.col("of_r")))
        out = out.unionByName(j.where(F.abs(F.col("x") - F.col("near.x")) <= days * 86_400_000_000).select(*pair("known", "near.known")))
    ends = rows.groupBy(*key).agg(*[F.min(F.when((F.col("side") == n) & on, F.col("known"))).alias(f"{name}{n}") for n in (0, 1) for name, on in (("any", F.lit(True)), ("undated", F.col("x").isNull()))])
    ends = ends.where("undated0 is not null or undated1 is not null")
    other = lambda name: F.when(alike | (F.col("side") == 1), F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    loose = rows.join(ends, key).select("known", F.explode(F.array_compact(F.array(other("undated"), F.when(F.col("x").isNull(), other("any"))))).alias("other"))
    return out.unionByName(loose.select(*pair("known", "other")))


def _known_by(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, e) with the digest that tells what of its evidence counts, and each different piece once: known, e. What no rule reads is left out."""
    # evidence is read many times over, and would be told from the texts each time
    told = cut(df.select(key, "e")).select(key, F.explode(F.array(_read(F.col("e")))).alias("e")).where("e is not null")
    told = cut(told.select(key, "e", F.sha2(F.to_json("e"), 256).alias("known")))
    return told.select(key, "known"), told.groupBy("known").agg(F.any_value("e").alias("e"))


# -- relationships -----------------------------------------------------------------------

FOLLOW_UP = 0.68


def relationships(reports: DataFrame, stories: DataFrame) -> DataFrame:
    """How each report stands to the stories: follow_up with its story, or new_story, perhaps with a candidate.

    reports: report_id, title, event_key, facts, locations, agencies, types, entities;
    stories: story_id, title, titles, events, the same arrays, and if there status. A
    follow-up has an identity anchor, a new step or new facts, and a confidence of .68;
    the surest, then the first story counts. A report with none may have a story that
    its new steps point to: a candidate to look at, which attaches nothing. Places and
    casualties that contradict, and titles that the story's timeline contradicts, rule a
    story out. All anchors rest on an event key or on two kinds of shared values, so
    reports and stories meet on those.
    """
    kinds = ("facts", "locations", "agencies", "types", "entities")
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(text.collapse(x))), lambda x: x != ""))
    spaced = lambda c: F.replace(c, F.lit("-"), F.lit(" "))
    live = stories.where(F.coalesce((F.col("status") if "status" in stories.columns else F.lit(None)).cast("string"), F.lit("")) != "archived")
    key = F.coalesce("event_key", F.lit(""))
    r = reports.select("report_id", F.col("title").alias("r_title"), key.alias("r_key"), *[clean(_array(reports, k)).alias(f"r_{k}") for k in kinds])
    s = live.select("story_id", F.col("title").alias("s_title"), F.array_distinct(F.concat(F.array("title"), _array(live, "titles"))).alias("s_titles"), _array(live, "events").alias("s_events"), *[clean(_array(live, k)).alias(f"s_{k}") for k in kinds])
    step = lambda *parts: told.milestones(told.relation_tokens(F.concat_ws(" ", *parts)))
    phrase = lambda *parts: told.advisory_milestones(F.concat_ws(" ", *parts))
    r_parts = [F.col("r_title"), F.array_join("r_facts", " "), spaced(F.col("r_key"))]
    s_parts = [F.array_join("s_titles", " "), F.array_join("s_facts", " "), spaced(F.array_join("s_events", " "))]
    # facts of a report in no order of their own: phrases may span them, so both sides join them sorted
    r = r.withColumns({"r_facts": F.array_sort("r_facts")}).withColumns({"r_steps": step(*r_parts), "r_phrases": phrase(*r_parts), "r_hurt": told.casualties(F.col("r_facts")), "r_told": _titled(F.col("r_title")), "r_tokens": told.relation_tokens(F.col("r_title")), "r_ktokens": told.relation_tokens(spaced(F.col("r_key")))})
    s = s.withColumns({"s_facts": F.array_sort("s_facts")}).withColumns({"s_steps": step(*s_parts), "s_phrases": phrase(*s_parts), "s_hurt": told.casualties(F.col("s_facts")), "s_told": F.transform("s_titles", _titled), "s_tokens": told.relation_tokens(F.col("s_title")), "s_ktokens": told.relation_tokens(spaced(F.array_join("s_events", " ")))})

    # computed once for a report and a story, not for each pair of them
    r, s = cut(r), cut(s)

    distinct = lambda c: F.array_except(c, text.strings(fixed.COMMON_FACTS))

    def anchors(p: str, events: Column) -> Column:
        pair = lambda x, y: combined((x, y), lambda k: F.col(f"{p}_{k}"))
        return F.concat(F.transform(events, lambda e: F.concat(F.lit("event|"), e)), *[pair(x, y) for x, y in (("locations", "agencies"), ("locations", "entities"), ("agencies", "entities"), ("agencies", "facts"), ("entities", "facts"), ("locations", "facts"))])

    def followed(p: str, events: Column) -> Column:
        # a follow-up shares a fact that isn't common, beside it a place, an agency, a name or the event, and types don't contradict
        of = {"facts": distinct(F.col(f"{p}_facts")), "events": events, "types": F.col(f"{p}_types")}
        mine, other = ("L", "R") if p == "r" else ("R", "L")
        of["types"] = F.when(F.size(of["types"]) > 0, F.concat(F.transform(of["types"], lambda t: F.concat(F.lit("t:"), t)), F.array(F.lit(mine)))).otherwise(F.array(F.lit(other), F.lit("U")))
        return F.concat(*[combined(("facts", x, "types"), lambda k: of.get(k, F.col(f"{p}_{k}")), "follow ") for x in ("locations", "agencies", "entities", "events")])

    share = {k: F.size(F.array_intersect(f"r_{k}", f"s_{k}")) > 0 for k in kinds}
    against = {k: (F.size(f"r_{k}") > 0) & (F.size(f"s_{k}") > 0) & ~share[k] for k in kinds}
    place, office, kind, who = share["locations"], share["agencies"], share["types"], share["entities"]
    terms = lambda c: F.array_distinct(F.transform(c, lambda x: F.substring_index(x, ":", 1)))
    only = lambda c, t: F.array_sort(F.filter(c, lambda x: F.substring_index(x, ":", 1) == t))
    hurt = F.exists(F.array_intersect(terms(F.col("r_hurt")), terms(F.col("s_hurt"))), lambda t: only(F.col("r_hurt"), t) != only(F.col("s_hurt"), t))
    title_share = text.overlap(F.col("r_tokens"), F.col("s_tokens"))
    fact_share = text.overlap(distinct(F.col("r_facts")), distinct(F.col("s_facts")))
    event_share = text.overlap(F.col("r_ktokens"), F.col("s_ktokens"))
    ts, fs, es, new_step = F.col("title_share"), F.col("fact_share"), F.col("event_share"), F.size("steps") > 0
    exact = F.array_contains("s_events", F.col("r_key"))
    anchored = exact | (place & office) | (place & who) | (office & who & (ts >= 0.45)) | ((office | who) & kind & (ts >= 0.70) & (fs >= 0.50)) | (place & kind & (fs >= 0.66) & (ts >= 0.45))
    fresh = F.when(F.size("r_facts") > 0, F.size(F.array_except("r_facts", "s_facts")) / F.size("r_facts")).otherwise(0.0)
    moved = new_step | (fresh >= 0.34)
    loose = new_step & (fs >= 0.66) & ((ts >= 0.35) | (es >= 0.35))
    follows = (
        (kind & place & (fs >= 0.66) & moved & (new_step | office | who)) | (kind & place & office & (fs >= 0.50) & moved)
        | (kind & (place | office) & who & (fs >= 0.40) & moved) | (new_step & kind & (place | office | who) & (fs >= 0.50)) | loose
    )
    w = lambda c, x: F.when(c, x).otherwise(0.0)
    score = F.when(loose, F.lit(0.52) + 0.30 * fs + 0.10 * ts + 0.08 * es).otherwise(0.42 * fs + w(place, 0.18) + w(office, 0.18) + w(kind, 0.14) + w(who, 0.18) + 0.05 * ts + 0.03 * es + w(new_step, 0.08))
    hint = F.lit(0.38) + w(exact, 0.28) + w(place, 0.10) + w(office, 0.10) + w(kind, 0.08) + w(who, 0.12) + 0.10 * ts + 0.10 * fs - w(against["agencies"], 0.08) - w(against["types"], 0.06)
    rounded = lambda c: F.bround(F.least(F.lit(1.0), c), 6)
    # the dearest rules come last
    sound = ~hurt & ~_torn(F.col("r_told"), F.col("r_key"), F.col("s_told"), F.col("s_events"))
    good = ~against["locations"] & ~against["agencies"] & ~against["types"] & anchored & follows & (F.bround(score, 9) >= FOLLOW_UP) & sound

    def judged(j: DataFrame) -> DataFrame:
        # generated columns are computed once, where a filter would take in a projection's
        more = {"title_share": title_share, "fact_share": fact_share, "event_share": event_share, "steps": F.array_sort(F.array_except("r_steps", "s_steps")), "phrases": F.array_sort(F.array_except("r_phrases", "s_phrases"))}
        return j.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in more.items()]))))

    r_events, s_events = F.array("r_key"), F.col("s_events")
    follow = judged(meet_on_keys(r, s, followed("r", r_events), followed("s", s_events))).where(good).select("report_id", "story_id", "steps", rounded(score).alias("score"))
    best = cut(first_by(follow, ["report_id"], [F.desc("score"), F.asc("story_id")]).select("report_id", "story_id", F.col("score").alias("confidence"), "steps"))
    # only a report without one, with phrases of its own, can have a story to look at, which rests on less
    asked = r.where(F.size("r_phrases") > 0).join(best.select("report_id"), "report_id", "left_anti")
    look = judged(meet_on_keys(asked, s, anchors("r", r_events), anchors("s", s_events))).where((F.size("phrases") > 0) & ~against["locations"] & anchored & sound).select("report_id", "story_id", "phrases", rounded(hint).alias("hint"))
    maybe = first_by(look, ["report_id"], [F.desc("hint"), F.asc("story_id")]).select("report_id", F.col("story_id").alias("candidate_id"), "hint", "phrases")
    out = reports.select("report_id").join(best, "report_id", "left").join(maybe, "report_id", "left")
    won = F.col("story_id").isNotNull()
    return out.select(
        "report_id", F.when(won, "follow_up").otherwise("new_story").alias("relationship"), "story_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("story_id", "candidate_id").alias("candidate_id"), F.coalesce("confidence", "hint", F.lit(0.0)).alias("candidate_confidence"),
        F.array_join(F.when(won, F.col("steps")).otherwise(F.coalesce("phrases", F.array().cast(_NONE))), ",").alias("milestones"),
    )


def _titled(title: Column) -> Column:
    """What of a title its timeline asks: key, tokens, family."""
    return F.struct(text.headline_key(title).alias("k"), text.timeline_tokens(title).alias("t"), identity.event_family(title).alias("f"))


def _torn(mine: Column, key: Column, theirs: Column, events: Column) -> Column:
    """Whether a title continues none of a story's and conflicts with one of them."""
    shared, share = (lambda x: F.size(F.array_intersect(mine["t"], x["t"]))), (lambda x: text.overlap(mine["t"], x["t"]))
    on = lambda x: (mine["k"] == x["k"]) | ((shared(x) >= 2) & (share(x) >= 0.30)) | (share(x) >= 0.50)
    off = lambda x: (mine["f"] != "unknown") & (x["f"] != "unknown") & (x["f"] != mine["f"]) & (share(x) < 0.20) & (shared(x) < 2)
    return ~F.array_contains(events, key) & F.exists(theirs, off) & ~F.exists(theirs, on)


# -- the whole cascade -------------------------------------------------------------------


def resolve_reports(reports: DataFrame, stories: DataFrame, entries: DataFrame) -> DataFrame:
    """(report_id, tier, story_id): the story of each report by the first of seven tiers that gives one.

    1 event key (one event's, not a class of them), 2 exact title, 3 source URL, 4
    incident signature, 5 unified evidence, 6 follow-up, 7 structured evidence; 9 is a
    new story. reports: report_id, title, url, event_key, facts, locations, agencies,
    types, entities, published; stories: story_id, title, titles, events, published
    (array), the same arrays; entries: the stories' reports one by one, with story_id.
    """
    found = []

    def ask(n: int, tier) -> None:
        """A report's answer doesn't depend on others, so a tier is asked for what none before it has found a story for."""
        left = reports
        for hits in found:
            left = left.join(hits.select("report_id"), "report_id", "left_anti")
        hits = tier(cut(left) if found else left)
        found.append(cut(hits.where("story_id is not null").select("report_id", F.lit(n).alias("tier"), "story_id")))

    keyed = lambda df: df.withColumn("title_key", text.headline_key(F.col("title")))
    e = keyed(entries)
    ask(1, lambda r: identity.owned(r.withColumn("event_key", F.when(identity.broad_key(F.col("event_key")), "").otherwise(F.col("event_key"))), e, "event_key", 1, "report_id"))
    ask(2, lambda r: identity.owned(keyed(r), e, "title_key", 2, "report_id"))
    named = entries.select("story_id", "url", "title")
    ask(3, lambda r: identity.source_match(r.select(F.col("report_id").alias("article_id"), "url", "title"), named).withColumnRenamed("article_id", "report_id"))
    ask(4, lambda r: incident_match(r.withColumns({"titles": F.array("title"), "published": F.array("published")}), stories, entries.select("story_id", "title")))
    more = F.array_join(F.concat("facts", "entities"), " ")
    proof = lambda df, key: df.select(key, told.evidence(F.col("title"), more, F.col("locations"), F.col("agencies"), F.col("published")).alias("e"))
    ask(5, lambda r: unified_match(proof(r, "report_id"), proof(entries, "story_id")))
    ask(6, lambda r: relationships(r, stories).where("relationship = 'follow_up'"))
    known = stories.withColumnRenamed("story_id", "id").withColumn("title_tokens", F.array_distinct(F.flatten(F.transform("titles", text.resolver_tokens))))
    ask(7, lambda r: identity.resolve(r.withColumnRenamed("report_id", "id"), known).withColumnRenamed("article_id", "report_id"))
    every = found[0]
    for hits in found[1:]:
        every = every.unionAll(hits)
    return identity.first_tier(reports, every, "report_id")
