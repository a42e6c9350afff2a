"""Text functions: tokenizers, counts, claims and classifiers, as Column expressions.

Every function takes a string Column, treats null as empty, and stays inside the JVM.
Tokenizers differ in what they drop and are not interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import fixed


def bind(value: Column, fn) -> Column:
    """fn(value) with the value computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case and order."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def _kept(tokens: Column, least: int, stop, digits: bool = False) -> Column:
    def on(t):
        long_enough = F.length(t) >= least
        return (long_enough | t.rlike("^[0-9]+$") if digits else long_enough) & ~t.isin(*stop)

    return F.filter(tokens, on)


def title_tokens(c: Column) -> Column:
    return F.array_distinct(_kept(words(c), 3, fixed.TITLE_STOP))


def _canonical(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.HEADLINE_CANON.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t))


def headline_tokens(c: Column) -> Column:
    """In order, repeats kept; words are mapped to their canonical form after the stop list."""
    raw = F.filter(words(F.replace(F.lower(text(c)), F.lit("st."), F.lit("st"))), lambda t: ~t.isin(*fixed.HEADLINE_STOP))
    return F.filter(_canonical(raw), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))


def content_tokens(c: Column) -> Column:
    head = F.substring(text(c), 1, fixed.CONTENT_CHARS)
    raw = F.filter(words(F.replace(F.lower(head), F.lit("st."), F.lit("st"))), lambda t: ~t.isin(*fixed.HEADLINE_STOP))
    return F.array_distinct(_kept(_canonical(raw), 3, fixed.CONTEXT_TOKENS, digits=True))


def stem(t: Column) -> Column:
    out = F.when(t.endswith("ies") & (F.length(t) > 6), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
    for suffix in ("ing", "ed", "es", "s"):
        out = out.when(t.endswith(suffix) & (F.length(t) > len(suffix) + 3), F.substring(t, F.lit(1), F.length(t) - len(suffix)))
    return out.otherwise(t)


def timeline_tokens(c: Column) -> Column:
    return F.array_distinct(F.transform(_kept(words(c), 2, fixed.TIMELINE_STOP), stem))


def signature_tokens(c: Column) -> Column:
    raw = F.filter(F.split(F.trim(text(c)), r"\s+"), lambda t: (F.length(t) > 3) & ~F.lower(t).isin(*fixed.ARCHIVE_STOP))
    return F.array_distinct(F.transform(raw, lambda t: F.btrim(F.lower(t), F.lit(".,;:()"))))


def source_title_tokens(c: Column) -> Column:
    """A publisher's name of at most six words after the last separator is left out."""
    parts = F.split(F.trim(text(c)), r"\s+(?:-|–|—|\|)\s+")
    short = F.size(F.regexp_extract_all(F.element_at(parts, -1), F.lit("[a-z0-9]+"), F.lit(0))) <= 6
    head = F.when((F.size(parts) > 1) & short, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")).otherwise(F.trim(text(c)))
    return F.array_distinct(_kept(words(head), 3, fixed.SOURCE_TITLE_NOISE, digits=True))


def focus_tokens(c: Column) -> Column:
    return F.array_distinct(_kept(words(c), 4, fixed.FOCUS_STOP))


def resolver_tokens(c: Column) -> Column:
    return F.array_distinct(_kept(words(c), 3, fixed.RESOLVER_STOP))


def headline_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words of a collapsed text, parted by single spaces; what follows them is read only where the opening holds no more."""
    said = lambda x: F.split(collapse(x), " ")
    found = bind(said(F.substring(text(c), 1, 16 * (n + 1))), lambda w: F.when(F.size(w) > n, w).otherwise(said(c)))
    return F.array_join(F.slice(found, 1, n), " ")


def sentences(c: Column) -> Column:
    return F.filter(F.split(collapse(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(text(c), F.lit(r"(?U)\w[\w’'-]*"), F.lit(0)))


def words_upto(c: Column, most: int) -> Column:
    """word_count() where that is at most ``most``, else a number above it.

    Texts are read on only where their opening doesn't hold more words than that.
    """
    n = word_count(F.substring(text(c), 1, 16 * (most + 2)))
    return bind(n, lambda seen: F.when(seen > most, seen).otherwise(word_count(c)))


def paragraph_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text(c), r"\n\s*\n"), lambda p: words_upto(p, 7) > 7))


def refuses(c: Column) -> Column:
    """Whether a text in lower case talks of a refused task; a plain search for what each phrase must hold rules nearly all out."""
    return contains_any(c, fixed.REFUSAL_NEEDS) & c.rlike(fixed.REFUSAL)


def first_paragraph(c: Column) -> Column:
    return F.get(F.split(F.trim(text(c)), r"\n\s*\n"), F.lit(0))


def opening(c: Column, most_sentences: int = 2, most_words: int = 80) -> Column:
    head = F.array_join(F.slice(sentences(c), 1, most_sentences), " ")
    return F.array_join(F.slice(F.split(head, " "), 1, most_words), " ")


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def contains_any(c: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def money_claims(c: Column) -> Column:
    """Amounts in whole dollars; of ``$`` amounts only those without a unit count as they stand."""
    low = F.regexp_replace(F.lower(text(c)), "[-_]", " ")
    unit = F.create_map(*[F.lit(x) for x in ("billion", 1e9, "b", 1e9, "million", 1e6, "m", 1e6, "thousand", 1e3, "k", 1e3)])
    scaled = F.transform(
        F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9])\$?\s*\d+(?:\.\d+)?\s*(?:billion|million|thousand|[bmk])\b"), F.lit(0)),
        lambda m: F.bround(F.regexp_extract(m, r"(\d+(?:\.\d+)?)", 1).cast("double") * F.element_at(unit, F.regexp_extract(m, "([a-z]+)$", 1)), 0).cast("long"),
    )
    plain = F.transform(
        F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9])\$\s*(\d[\d,]*+(?:\.\d++)?+)(?!\s*(?:billion|million|thousand|[bmk])\b)"), F.lit(1)),
        lambda m: F.bround(F.replace(m, F.lit(","), F.lit("")).cast("double"), 0).cast("long"),
    )
    return F.array_sort(F.array_union(scaled, plain))


def percent_claims(c: Column) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(r"\b(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.regexp_replace(m, "0+$", ""), r"\.$", ""))))


def states_in(c: Column) -> Column:
    """States named as whole words, in lower case."""

    def named(low):
        # the plain search is far cheaper than the pattern, and rules nearly all states out
        return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(s)) & low.rlike(rf"\b\Q{s}\E\b"), F.lit(s)) for s in fixed.STATES]))

    return bind(F.lower(collapse(c)), named)


def measure_claims(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(fixed.MEASURES), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, collapse)))


def relevance_scope(c: Column) -> Column:
    """Federal, foreign and global signals; the first and last are substring tests."""

    def scope(low):
        n = F.size(states_in(low))
        foreign = low.rlike(r"\b(?:" + "|".join(fixed.FOREIGN_SIGNALS) + r")\b")
        major = contains_any(low, fixed.GLOBAL_SIGNALS)
        return (
            F.when(contains_any(low, fixed.FEDERAL_SIGNALS), "us_national").when(n >= 2, "us_multistate").when(n == 1, "us_state_regional")
            .when(foreign & major, "global_major").when(foreign, "international").when(major, "global_major_only").otherwise("unknown")
        )

    return bind(F.concat(F.lit(" "), F.lower(collapse(c)), F.lit(" ")), scope)


def scope_name(scope: Column) -> Column:
    return F.when(scope == "global_major_only", "global_major").otherwise(scope)


def scope_score(scope: Column) -> Column:
    """A major event without a foreign signal scores 85, not 88."""
    out = F.when(scope == "global_major_only", 85)
    for name, points in fixed.SCOPE_SCORE.items():
        out = out.when(scope == name, points)
    return out.otherwise(fixed.SCOPE_SCORE["unknown"])


def fatality_count(c: Column) -> Column:
    found = [F.transform(F.regexp_extract_all(F.lower(text(c)), F.lit(p), F.lit(1)), lambda m: m.cast("int")) for p in fixed.FATALITY_PATTERNS]
    return F.coalesce(F.array_max(F.concat(*found)), F.lit(0))


def importance_reasons(c: Column, scope: Column, updates: Column, agencies: Column) -> Column:
    """array<struct<code, points>> in rule order; phrases are substring tests."""
    reason = lambda code, points: F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"))

    def rules(low):
        dead = fatality_count(low)
        out = [F.when(contains_any(low, phrases), reason(code, points)) for code, points, phrases in fixed.IMPORTANCE]
        deaths = F.when(dead >= fixed.FATALITY_POINTS[0][0], reason(*fixed.FATALITY_POINTS[0][1:]))
        for least, code, points in fixed.FATALITY_POINTS[1:]:
            deaths = deaths.when(dead >= least, reason(code, points))
        out.append(deaths.when(low.rlike(fixed.DEATH_PATTERN), reason("single_death", 6)))
        out.append(F.when(updates > 1, reason("follow_up", 5)))
        out.append(F.when(agencies >= 2, reason("multi_agency", 5)))
        out.append(F.when(scope == "us_national", reason("national_scope", 15)).when(scope == "us_multistate", reason("multistate_scope", 10)).when(scope == "global_major", reason("global_scope", 10)))
        return F.array_compact(F.array(*out))

    return bind(F.lower(text(c)), rules)


def importance_score(reasons: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.aggregate(reasons, F.lit(0), lambda t, r: t + r["points"])))


def importance_level(score: Column) -> Column:
    out = F.when(score >= fixed.LEVELS[0][0], fixed.LEVELS[0][1])
    for least, name in fixed.LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def event_types(c: Column) -> Column:
    low = F.lower(text(c))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in fixed.EVENT_PATTERNS]))


def agencies_in(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text(c).rlike(p), F.lit(name)) for name, p in fixed.AGENCIES]))


def proper_names(c: Column) -> Column:
    """Runs of two to six capitalized words, small ones between them included, of 5 to 100 characters."""
    found = F.regexp_extract_all(text(c), F.lit(fixed.PROPER_NAME), F.lit(0))
    shown = F.transform(found, lambda m: F.btrim(F.regexp_replace(m, r"\s+", " "), F.lit(" ,.;:")))
    return F.array_distinct(F.filter(shown, lambda m: (F.length(m) >= 5) & (F.length(m) <= 100)))


def quantified_facts(c: Column) -> Column:
    """Counts of people killed, hurt or arrested and ages, number words as digits."""
    low = F.lower(text(c))
    people = F.regexp_extract_all(low, F.lit(rf"\b(?:\d{{1,5}}|{'|'.join(fixed.NUMBER_WORDS)})\s+(?:people\s+)?(?:were\s+)?(?:killed|dead|injured|arrested)\b"), F.lit(0))

    def said(m):
        n, verb = F.regexp_extract(m, r"^(\S+)", 1), F.regexp_extract(m, r"(\S+)$", 1)
        digit = F.array_position(strings(fixed.NUMBER_WORDS), n)
        return F.concat(F.when(digit > 0, digit.cast("string")).otherwise(n), F.lit(" people "), verb)

    ages = F.transform(F.regexp_extract_all(low, F.lit(r"\b(\d{1,3})[- ]year[- ]old\b"), F.lit(1)), lambda m: F.concat(m, F.lit("-year-old")))
    return F.array_distinct(F.concat(F.transform(people, said), ages))


def digest(c: Column, n: int) -> Column:
    return F.substring(F.sha2(text(c), 256), 1, n)


def hash_mod(hexdigest: Column, n: int) -> Column:
    """A SHA-256 digest in hex, as a number, modulo n: folded over chunks of eight digits."""
    step = (1 << 32) % n
    chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexdigest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda t, x: (t * step + x) % n)
