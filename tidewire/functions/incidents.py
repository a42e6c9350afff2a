"""What a report says of its incident: evidence, subjects and anchors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import fixed, text


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _only(values: Column) -> Column:
    """The one distinct value of an array, or an empty string."""
    return text.bind(F.array_distinct(values), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(""))


# -- evidence ----------------------------------------------------------------------------


def evidence_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(text.words(c), lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.EVIDENCE_STOP)))


def family(c: Column) -> Column:
    """The kind of incident, by the first pattern that fits."""

    def named(n):
        out = F.when(F.lit(False), "")
        for name, pattern in fixed.EVIDENCE_FAMILIES:
            out = out.when(n.rlike(pattern), name)
        return out.otherwise("unknown")

    return text.bind(text.headline_key(c), named)


def concepts(c: Column) -> Column:
    """Concrete facts by name, ages and bonds among them, sorted."""
    age = lambda a: F.concat(F.lit("age_"), a.cast("int").cast("string"))
    raw = text.text(c)
    bonds = F.concat(*[F.transform(_all(raw, p), lambda x: F.concat(F.lit("bond_"), F.replace(x, F.lit(","), F.lit("")))) for p in fixed.BONDS])

    def found(n):
        told = F.array_compact(F.array(*[F.when(n.rlike(p), F.lit(name)) for name, p in fixed.CONCEPTS]))
        return F.concat(told, F.transform(_all(n, fixed.AGE_BY_YEARS), age))

    return F.array_sort(F.array_distinct(F.concat(text.bind(text.headline_key(c), found), F.transform(_all(raw, fixed.AGE_BY_NAME), age), bonds)))


def people(c: Column) -> Column:
    """Names tied to a part in an incident, in lower case, sorted."""
    names = F.concat(*[_all(text.text(c), p) for p in fixed.PEOPLE])
    clean = F.transform(names, lambda n: F.lower(text.collapse(n)))
    person = lambda n: ~n.isin(*fixed.NOT_PEOPLE) & ~F.arrays_overlap(F.split(n, " "), text.strings(fixed.NOT_PEOPLE_WORDS))
    return F.array_sort(F.array_distinct(F.filter(clean, person)))


def alias(name: Column) -> Column:
    """First name and surname, without middle names and suffixes; empty with less than both."""
    bare = F.regexp_replace(F.array_join(text.words(name), " "), rf"(?: (?:{'|'.join(fixed.NAME_SUFFIXES)}))+$", "")
    return text.bind(F.split(bare, " "), lambda p: F.when(F.size(p) >= 2, F.concat_ws(" ", F.get(p, F.lit(0)), F.element_at(p, -1))).otherwise(""))


def evidence(title: Column, more: Column, locations: Column, agencies: Column, published: Column) -> Column:
    """struct<family, concepts, people, aliases, locations, agencies, distinctive, title, published> of a title and what else is told."""
    whole = F.concat_ws(" ", title, more)
    normal = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), text.headline_key), lambda x: x != "")))
    places = evidence_tokens(F.array_join(F.concat(normal(locations), normal(agencies)), " "))
    own = F.array_sort(F.array_except(F.array_except(evidence_tokens(whole), text.strings(fixed.EVIDENCE_GENERIC)), places))
    return F.struct(
        family(whole).alias("family"), concepts(whole).alias("concepts"), people(whole).alias("people"),
        F.array_distinct(F.filter(F.transform(people(whole), alias), lambda a: a != "")).alias("aliases"),
        normal(locations).alias("locations"), normal(agencies).alias("agencies"), F.slice(own, 1, 48).alias("distinctive"),
        F.slice(F.array_sort(evidence_tokens(title)), 1, 36).alias("title"), published.alias("published"),
    )


# -- subjects and anchors ----------------------------------------------------------------


def person_name(c: Column) -> Column:
    """A name in the shape of a person's, without a leading role; empty if it is none."""
    letters = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")

    def told(words):
        folded = F.transform(words, letters)
        bad = ~F.size(words).between(2, 3) | ((F.size(words) == 3) & (F.length(F.regexp_replace(F.get(words, F.lit(1)), "[^A-Za-z]", "")) != 1))
        bad = bad | F.exists(folded, lambda w: (w == "") | w.isin(*fixed.NAME_REJECTS)) | F.exists(words, lambda w: (F.length(w) >= 3) & (w == F.upper(w)) & (w != F.lower(w)))
        return F.when(bad, "").otherwise(F.array_join(words, " "))

    name = text.collapse(c)
    words = F.split(F.replace(name, F.lit("."), F.lit("")), " ")
    bare = F.when((F.size(words) == 3) & letters(F.get(words, F.lit(0))).isin(*fixed.NAME_ROLES), F.slice(words, 2, 2)).otherwise(words)
    return F.when(name.isin(*fixed.STOP_NAMES), "").otherwise(text.bind(bare, told))


def death_subject(c: Column, entities: Column | None = None) -> Column:
    """The one person whose death a text is about, as a slug, or an empty string.

    Each mention near words of death has points for standing early, and for what stands
    beside it; a name's points add up, and the first must lead by three. Without a
    mention the only name among the entities counts.
    """
    raw = text.text(c)

    def scored(hits, parts):
        size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda t, x: t + F.length(x))

        def points(m: dict):
            out = F.lit(2.0) + F.when(m["early"], 4.0).otherwise(0.0)
            for worth, patterns in fixed.NAME_POINTS:
                any_ = F.lit(False)
                for p in patterns:
                    any_ = any_ | m["marked"].rlike(p)
                out = out + F.when(any_, worth).otherwise(0.0)
            return F.struct(m["who"].alias("who"), F.when((m["who"] != "") & m["around"].rlike(fixed.DEATH_CONTEXT), out).alias("points"))

        def mention(h, i):
            place = lambda start: F.struct(start.alias("start"), F.greatest(F.lit(0), start - 120).alias("low"))
            near = lambda s: F.substring(raw, s["low"] + 1, s["start"] + F.length(h) + 120 - s["low"])
            told = lambda s: text.bind(F.struct(person_name(h).alias("n"), near(s).alias("x")), lambda v: text.bind(F.replace(v["x"], v["n"], F.lit("¤")), lambda marked: points({"who": text.slug(v["n"]), "marked": marked, "around": v["x"], "early": s["start"] < 420})))
            return text.bind(size(parts, i + 1) + size(hits, i), lambda start: text.bind(place(start), told))

        return F.filter(F.transform(hits, mention), lambda m: m["points"].isNotNull())

    def leader(found):
        names = F.array_distinct(F.transform(found, lambda m: m["who"]))
        total = lambda w: F.aggregate(F.filter(found, lambda m: m["who"] == w), F.lit(0.0), lambda t, m: t + m["points"])
        ranked = F.reverse(F.array_sort(F.transform(names, lambda w: F.struct(total(w).alias("points"), w.alias("who")))))
        lone = lambda r: (F.size(r) == 1) | (F.get(r, F.lit(0))["points"] - F.get(r, F.lit(1))["points"] >= 3.0)
        return text.bind(ranked, lambda r: F.when((F.get(r, F.lit(0))["points"] >= 5.0) & lone(r), F.get(r, F.lit(0))["who"]).otherwise(""))

    spare = _only(F.filter(F.transform(F.coalesce(entities, F.array().cast("array<string>")), lambda e: text.slug(person_name(e))), lambda e: e != "")) if entities is not None else F.lit("")
    found = scored(_all(raw, fixed.FULL_NAME), F.split(raw, fixed.FULL_NAME, -1))
    return text.bind(found, lambda f: F.when(F.size(f) > 0, leader(f)).otherwise(spare))


def missing_subject(c: Column) -> Column:
    """The one missing person a text names, as first name and surname in a slug, or an empty string."""
    raw = text.text(c)
    suffix = rf"(?i)(?: (?:{'|'.join(fixed.NAME_SUFFIXES)})\.?)+$"

    def key(m):
        clean = F.transform(F.split(text.collapse(m), " "), lambda w: F.regexp_replace(F.regexp_replace(w, "[^A-Za-z'’.-]", ""), "^[.'’-]+|[.'’-]+$", ""))
        whole = F.regexp_replace(F.array_join(F.filter(clean, lambda w: w != ""), " "), suffix, "")
        plain = F.transform(F.split(whole, " "), lambda w: F.regexp_replace(F.lower(w), "(?:'s|’s)$", ""))
        first, last = F.get(plain, F.lit(0)), F.element_at(plain, -1)
        bad = (F.size(plain) < 2) | F.array_join(plain, " ").isin(*fixed.MISSING_NOT_NAMES) | F.exists(plain, lambda w: w.isin("the", *fixed.MISSING_NOT_WORDS)) | (F.length(first) < 2) | (F.length(last) < 3)
        return F.when(bad, "").otherwise(F.concat_ws("-", text.slug(first), text.slug(last)))

    found = F.concat(*[_all(raw, p) for p in fixed.MISSING_SUBJECTS])
    return F.when(raw.rlike(fixed.MISSING_CONTEXT), _only(F.filter(F.transform(found, key), lambda k: k != ""))).otherwise("")


def operation(c: Column) -> Column:
    """The one named law-enforcement operation of a text, as a slug, or an empty string."""
    tail = rf"(?i)(?:\s+(?:{'|'.join(fixed.OPERATION_TAIL)}))+$"
    names = F.transform(_all(text.text(c), fixed.OPERATION), lambda m: F.regexp_replace(F.regexp_replace(text.collapse(m), "^[ .,:;\"'“”‘’]+|[ .,:;\"'“”‘’]+$", ""), tail, ""))
    slugs = F.transform(F.filter(names, lambda n: F.contains(n, F.lit(" "))), text.slug)
    return F.when(text.text(c).rlike(fixed.OPERATION_CONTEXT), _only(F.filter(slugs, lambda s: (s != "") & ~s.isin(*fixed.NO_OPERATIONS)))).otherwise("")


def infrastructure(c: Column) -> Column:
    """asset:road:nonoperational of a public asset that is out of order, or an empty string."""
    raw = text.text(c)
    asset = F.coalesce(*[F.when(raw.rlike(p), F.lit(name)) for name, p in fixed.ASSETS], F.lit(""))
    roads = F.transform(F.filter(F.transform(_all(raw, fixed.NAMED_ROAD), F.trim), lambda r: F.size(F.split(r, r"\s+")) >= 2), text.slug)
    key = text.bind(_only(roads), lambda road: F.when(road == "", "").otherwise(F.concat_ws(":", asset, road, F.lit("nonoperational"))))
    return F.when((asset != "") & raw.rlike(fixed.NONOPERATIONAL), key).otherwise("")


def anchor(title: Column, more: Column, entities: Column | None = None) -> Column:
    """The key of the incident that a report is about: a named death, a missing person, an operation, an asset, or none.

    A death must be in the title; its subject may be named elsewhere.
    """
    whole = F.concat_ws(" | ", title, more)
    named = lambda prefix, c: F.when(c != "", F.concat(F.lit(f"{prefix}:"), c))
    dead = F.when(text.text(title).rlike(fixed.DEATH_CONTEXT) & whole.rlike(fixed.DEATH_CONTEXT), named("named-person-death", death_subject(whole, entities)))
    return F.coalesce(dead, named("missing-person", missing_subject(whole)), named("law-enforcement-operation", operation(whole)), named("infrastructure-condition", infrastructure(whole)), F.lit(""))


def authoritative(key: Column) -> Column:
    """Whether an anchor names one incident, so that it may own a page by itself."""
    subject = key.rlike("^(?:missing-person|named-person-death|law-enforcement-operation):.*[^ :-]")
    return subject | key.rlike(r"^infrastructure-condition: *[^: ][^:]*: *[^: ][^:]*: *[^: ]")


def animal_counts(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(text.text(c), fixed.ANIMAL_COUNT), lambda n: n.cast("int"))))


def hoarding(title: Column, counts: Column) -> Column:
    """Whether titles tell of a mass rescue of animals."""
    t = text.text(title)
    strong = t.rlike(fixed.POSTAL_ROLE) | F.exists(counts, lambda n: n >= 50)
    return t.rlike(fixed.ANIMAL) & (t.rlike(fixed.HOARDING) | (t.rlike(fixed.ANIMALS) & t.rlike(fixed.ANIMAL_ACTION) & strong))


def signature_tokens(c: Column) -> Column:
    canon = F.create_map(*[F.lit(x) for kv in fixed.SIGNATURE_CANON.items() for x in kv])
    told = F.transform(text.words(c), lambda t: F.coalesce(F.element_at(canon, t), t))
    kept = F.filter(told, lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.SIGNATURE_STOP, *fixed.SIGNATURE_PUBLISHERS))
    return F.array_distinct(F.concat(kept, F.when(text.text(c).rlike(fixed.POSTAL_ROLE), text.strings(["postalworker"])).otherwise(F.array().cast("array<string>"))))


def markers(c: Column, counts: Column) -> Column:
    low = F.lower(text.text(c))
    tests = [
        ("hoarding", low.rlike("hoard")), ("postal_worker", low.rlike(fixed.POSTAL_ROLE)), ("animal_cruelty", F.contains(low, F.lit("animal cruelty"))),
        ("owner_reunion", low.rlike("reunit") & low.rlike("owner|pet|cat|dog")), ("filthy_home", low.rlike("filth|feces|faeces|cages|no ac")), ("sheriff", F.contains(low, F.lit("sheriff"))),
        ("arrest", low.rlike("arrest|charged")), ("large_rescue", F.exists(counts, lambda n: n >= 50) | F.contains(low, F.lit("nearly 100")) | F.contains(low, F.lit("dozens"))),
    ]
    return F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on in tests]))


def quantities_agree(a: Column, b: Column) -> Column:
    """Whether a count of one is within 30, or 30 % of the larger, of one of the other."""
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(30), F.floor(0.30 * F.greatest(x, y)).cast("int"))
    return F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))


# -- relationships -----------------------------------------------------------------------


def relation_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(text.words(c), lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.RELATION_STOP)))


def milestones(tokens: Column) -> Column:
    """Steps of an event that tokens speak of."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(tokens, text.strings(ws)), F.lit(name)) for name, ws in fixed.MILESTONES.items()]))


def advisory_milestones(c: Column) -> Column:
    """Steps of an event by whole phrases."""
    low = F.lower(text.collapse(c))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in fixed.ADVISORY_MILESTONES.items()]))


def casualties(facts: Column) -> Column:
    """term:number of each casualty word and number of the same fact."""

    def of(fact):
        numbers, terms = F.regexp_extract_all(fact, F.lit(r"\b\d+\b"), F.lit(0)), F.array_intersect(relation_tokens(fact), text.strings(fixed.CASUALTIES))
        return F.flatten(F.transform(terms, lambda t: F.transform(numbers, lambda n: F.concat_ws(":", t, n))))

    return F.array_distinct(F.flatten(F.transform(facts, of)))
