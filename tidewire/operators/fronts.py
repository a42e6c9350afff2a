"""Front page: significance tiers, image checks, update composition and safe backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import fixed, text, urls
from tidewire.operators.checkpoints import cut


def tier(category: Column, headline: Column) -> Column:
    """struct<tier, reason>: concrete national consequence before commentary and category."""
    low = F.lower(headline)
    has = {k: low.rlike(p) for k, p in fixed.TIER.items()}
    sure = ~has["analysis"]
    gov = (has["government"] | has["government_reverse"] | low.rlike(fixed.TIER_COURT)) & sure
    out = lambda n, reason: F.struct(F.lit(n).alias("tier"), F.lit(reason).alias("reason"))
    return (
        F.when(category.isin(*fixed.BLOCKED_CATEGORIES), out(0, "category_never_auto_hero"))
        .when(has["sports"] | has["entertainment"], out(0, "sports_entertainment_content_outside_its_category"))
        .when(gov & category.isin("tech", "business") & has["one_firm"] & ~has["broad"], out(3, "targeted_federal_entity_action"))
        .when(gov, out(5, "concrete_federal_action"))
        .when(has["foreign_crisis"] & sure, out(4, "major_foreign_government_crisis"))
        .when(has["war"] & sure & has["us_forces"], out(5, "major_international_development"))
        .when(has["war"] & sure, out(4, "major_international_development"))
        .when(has["economy"] & sure, out(4, "macroeconomic_development"))
        .when(has["security"] & sure & has["wide"], out(4, "security_emergency"))
        .when(has["security"] & sure, out(3, "security_emergency"))
        .when(has["election"] & sure, out(3, "significant_electoral_development"))
        .when(has["analysis"], out(1, "analysis_or_speculation"))
        .when((category == "politics") & has["politics"], out(3, "political_development"))
        .when(category == "world", out(2, "international_development_without_broad_consequence"))
        .when(category == "us", out(2, "domestic_development"))
        .otherwise(out(1, "limited_national_reach"))
    )


def front_score(tier_: Column, urgency: Column, relevance: Column, importance: Column, age: Column, national: Column) -> Column:
    fresh = F.greatest(F.lit(-45.0), 44.0 - age * 2.5)
    audience = F.when(national, F.bround(22.0 * F.greatest(F.lit(0.0), 1.0 - age / 12.0), 2)).otherwise(0.0)
    return F.bround(36.0 * tier_ + 4.0 * urgency + 0.15 * relevance + 0.15 * importance + fresh + audience, 2)


def image_rejection(url: Column, source: Column, alt: Column, width: Column, height: Column) -> Column:
    low, words = F.lower(F.trim(text.text(url))), F.lower(text.text(alt))
    ratio = F.greatest(width / height, height / width)
    same = urls.domain(url) == urls.domain(source)
    return (
        F.when(F.length(low) < 15, "missing_or_short").when(low.startswith("data:"), "data_url").when(text.contains_any(low, fixed.PLACEHOLDERS), "placeholder_or_logo_url")
        .when(text.contains_any(words, fixed.LOGO_WORDS) & (F.size(F.split(F.trim(words), r"\s+")) <= 8), "logo_alt_text")
        .when((width > 0) & (height > 0) & (F.least(width, height) <= 80), "tiny_dimensions").when((width > 0) & (height > 0) & (ratio >= 6), "extreme_aspect_ratio")
        .when(same & F.lower(urls.part(url, 3)).rlike(fixed.BRAND_PATH), "publisher_brand_asset").otherwise("")
    )


def update_tokens(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.UPDATE_CANON.items() for x in kv])
    raw = F.filter(text.words(c), lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.UPDATE_STOP))
    return F.array_distinct(F.transform(raw, lambda t: F.coalesce(F.element_at(table, t), t)))


def composition_errors(headline: Column, teaser: Column, body: Column, old_headline: Column, old_body: Column, news: Column, old_tokens: Column | None = None) -> Column:
    """Why a merged update can't be published: lengths, and tokens its lead and body lack.

    ``old_tokens`` may bring the tokens of the old headline and body, so that the old
    body need not be at hand.
    """
    split = F.filter(F.transform(F.split(F.trim(text.text(body)), r"\n\s*\n+"), text.collapse), lambda p: p != "")
    n = lambda c: F.size(F.filter(F.split(text.collapse(c), " "), lambda w: w != ""))
    words = F.size(F.regexp_extract_all(text.text(body), F.lit(r"(?U)\w+"), F.lit(0)))
    told = update_tokens(F.concat_ws(" ", old_headline, old_body)) if old_tokens is None else old_tokens
    hits = lambda a, b: F.size(F.array_intersect(a, b))

    def named(parts: Column) -> Column:
        lead = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        known = {"old_head": update_tokens(old_headline), "old": told, "new": update_tokens(news), "lt": update_tokens(lead), "bt": update_tokens(body), "ht": update_tokens(headline), "words": words, "lead": lead, "parts": F.size(parts)}
        return F.struct(*[c.alias(k) for k, c in known.items()])

    def judged(t: Column) -> Column:
        old_head, old, new, lt, bt = t["old_head"], t["old"], t["new"], t["lt"], t["bt"]
        fresh, fresh_head = F.array_except(new, old), F.array_except(new, old_head)
        checks = [
            (n(headline) < 5, "headline_missing_or_too_short"), (F.length(text.collapse(headline)) > 180, "headline_too_long"), (n(teaser) < 12, "teaser_missing_or_too_short"),
            (t["parts"] < 3, "insufficient_paragraphs"), (t["words"] < 170, "body_too_short"), (t["words"] > 700, "body_too_long"), (n(t["lead"]) < 24, "lead_too_short"),
            (F.lower(text.collapse(headline)) == F.lower(text.collapse(old_headline)), "headline_not_refreshed_for_material_update"),
            ((F.size(fresh_head) > 0) & (hits(t["ht"], fresh_head) == 0), "headline_missing_material_development"),
            ((F.size(old_head) > 0) & (hits(old_head, lt) < F.least(F.lit(2), F.size(old_head))), "lead_missing_original_event_context"),
            (F.when(F.size(fresh) > 0, hits(fresh, lt) == 0).otherwise(False), "lead_missing_new_development"),
            ((F.size(fresh) == 0) & (hits(new, lt) < F.least(F.lit(2), F.size(new))), "lead_missing_incoming_context"),
            (hits(old, bt) < F.least(F.lit(5), F.size(old)), "body_missing_canonical_context"), (hits(new, bt) < F.least(F.lit(5), F.size(new)), "body_missing_incoming_update"),
        ]
        return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in checks]))

    # each is computed once, however many checks ask it
    return text.bind(text.bind(split, named), judged)


def backfill(sources: DataFrame, limit: int) -> DataFrame:
    """Safe cards for each section in source order: none like one already chosen.

    (section, pos, article_id, tokens, url) -> chosen rows with urgency 7, 7, 7, 6, ...,
    at least 4. Titles are alike with 4 shared tokens that are .70 of the smaller, both
    of 4 at least. Each choice depends on those before, so there is a round for each
    place: the first row of every section is chosen, and what is like it goes.
    """
    left, chosen = cut(sources.select("section", "pos", "article_id", "tokens", "url")), None
    for slot in range(1, limit + 1):
        head = cut(left.groupBy("section").agg(F.min(F.struct("pos", "article_id", "tokens", "url")).alias("c")))
        row = head.select("section", F.col("c.article_id").alias("article_id"), F.lit(slot).alias("slot"), F.lit(max(4, 7 - (slot - 1) // 3)).alias("urgency"))
        chosen = row if chosen is None else chosen.unionAll(row)
        shared, least = F.size(F.array_intersect("tokens", "c.tokens")), F.least(F.size("tokens"), F.size("c.tokens"))
        alike = (shared >= 4) & (shared / least >= 0.70)
        gone = alike | ((F.col("url") != "") & (F.col("url") == F.col("c.url"))) | (F.col("article_id") == F.col("c.article_id"))
        left = cut(left.join(head, "section").where(~F.coalesce(gone, F.lit(False))).drop("c"))
    return chosen.select("section", "article_id", F.col("slot").cast("int").alias("slot"), F.col("urgency").cast("int").alias("urgency"))
