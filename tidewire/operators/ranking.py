"""Ranking: scores, eligibility, the diversified deck and what moves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.operators.ordered import first_by


def age_hours(ts: Column, reference: str) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(ts)) / F.lit(3.6e9))


def freshness_multiplier(age: Column) -> Column:
    return F.when(age.isNull(), 0.80).when(age <= 6, 1.0).when(age <= 24, 0.95).when(age <= 72, 0.85).when(age <= 168, 0.70).otherwise(0.55)


def freshness_score(age: Column) -> Column:
    left = 1 - F.least(age, F.lit(fixed.EXTENDED_HOURS)) / fixed.EXTENDED_HOURS
    return F.when(age.isNull(), 20.0).otherwise(F.bround(F.greatest(F.lit(0.0), 100 * left), 2))


def editorial_score(importance: Column, proximity: Column, trust: Column, age: Column) -> Column:
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    raw = clamp(importance) * F.bround(clamp(proximity) / 100, 4) * freshness_multiplier(age) * F.bround(0.85 + clamp(trust) / 100 * 0.30, 4)
    return clamp(F.bround(raw, 0).cast("int"))


def category_relevance(category: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, points in fixed.CATEGORY_RELEVANCE.items():
        out = out.when(category == name, points)
    return out.otherwise(fixed.OTHER_RELEVANCE)


def deck_score(importance: Column, age: Column, urgency: Column, relevance: Column, trust: Column) -> Column:
    weighted = 0.34 * importance + 0.24 * freshness_score(age) + 0.22 * (urgency * 10) + 0.12 * relevance + 0.08 * trust
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(weighted, 0).cast("int")))


def eligibility(headline: Column, age: Column, urgency: Column, category: Column) -> Column:
    urgent = urgency >= fixed.EXTENDED_URGENCY
    transient = text.contains_any(F.lower(headline), fixed.TRANSIENT)
    return (
        F.when(age.isNull() & urgent, "undated_high_urgency").when(age.isNull(), "undated").when(age > fixed.EXTENDED_HOURS, "older_than_60_hours")
        .when(transient & (age > fixed.TRANSIENT_HOURS), "expired_transient_story")
        .when((category == "sports") & (age > fixed.SPORTS_HOURS) & (urgency < 9), "routine_sports_older_than_24_hours")
        .when((age > fixed.FRESH_HOURS) & ~urgent, "older_than_48_hours_not_urgent_enough").when(age > fixed.FRESH_HOURS, "high_urgency_extended_window").otherwise("fresh_window")
    )


ELIGIBLE = ["undated_high_urgency", "high_urgency_extended_window", "fresh_window"]


def lifecycle(age: Column, headline: Column, level: Column, events: Column) -> Column:
    many = events >= 2
    return (
        F.when(age >= 720, "archived").when(text.contains_any(F.lower(headline), fixed.RESOLUTION), "resolved").when((level == "breaking") & (age.isNull() | (age <= 12)), "breaking")
        .when(many & (age.isNull() | (age <= 72)), "developing").when(many & (age <= 168), "ongoing").when(many, "active")
        .when(age.isNull() | (age <= 48), "active").when(age <= 168, "ongoing").otherwise("active")
    )


def greedy_deck(cards: DataFrame, limit: int = fixed.DECK) -> DataFrame:
    """The deck: place after place the best card, less what its category and its region already hold.

    Besides article_id, headline, category_key, score, age and position, cards may have
    regions (array), position_locked and pin_position. A locked card takes the place of
    its position or none; a chosen card with a pin is put in that place at the end.

    Every choice depends on those before, so it is made in one task, over the ``limit``
    best cards of each category and region, and the locked card of each place: no other
    can be chosen, as a better one with the same penalties always stands before it.
    Cards of no region or several have no region's penalty, so they are one group.
    """
    col = lambda name, kind: (F.col(name) if name in cards.columns else F.lit(None)).cast(kind)
    regions = F.array_distinct(F.filter(F.coalesce(col("regions", "array<string>"), F.array()), lambda r: F.trim(r) != ""))
    cards = cards.select(
        "article_id", "headline", "category_key", "score", "age", "position", regions.alias("regions"),
        F.coalesce(col("position_locked", "boolean"), F.lit(False)).alias("locked"), F.coalesce(col("pin_position", "int"), F.lit(0)).alias("pin"),
    ).withColumn("region", F.when(F.size("regions") == 1, F.get("regions", F.lit(0))).otherwise(""))
    order = [F.desc("score"), F.asc("age"), F.asc("position"), F.asc(F.lower("headline")), F.asc("article_id")]
    held = first_by(cards.where(F.col("locked") & F.col("position").between(1, limit)), ["position"], order)
    few = first_by(cards.where(~F.col("locked")), ["category_key", "region"], order, limit).unionByName(held)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left = [{**r, "regions": list(r["regions"])} for r in rows.to_dict("records")]
        out: list[tuple[dict, float]] = []
        categories: dict[str, int] = {}
        places: dict[str, int] = {}

        def cost(r) -> float:
            return _penalty(categories.get(r["category_key"], 0)) + (_region_penalty(places.get(r["region"], 0)) if r["region"] else 0.0)

        while left and len(out) < limit:
            best = next((r for r in left if r["locked"] and r["position"] == len(out) + 1), None)
            if best is None:
                free = [r for r in left if not r["locked"]]
                if not free:
                    break
                best = min(free, key=lambda r: (cost(r) - r["score"], -r["score"], r["age"], r["position"], r["headline"].lower(), r["article_id"]))
            left.remove(best)
            out.append((best, 0.0 if best["locked"] else cost(best)))
            categories[best["category_key"]] = categories.get(best["category_key"], 0) + 1
            for region in best["regions"]:
                places[region] = places.get(region, 0) + 1
        deck = [x for x in out if not x[0]["pin"]]
        for x in sorted((x for x in out if x[0]["pin"]), key=lambda x: x[0]["pin"]):
            deck.insert(min(max(1, x[0]["pin"]) - 1, len(deck)), x)
        return pd.DataFrame([(r["article_id"], n, r["score"], c) for n, (r, c) in enumerate(deck, 1)], columns=["article_id", "deck_position", "score", "penalty"])

    return few.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(choose, "article_id long, deck_position int, score int, penalty double")


def _penalty(n: int) -> float:
    """What a card costs whose category holds n places."""
    return 0.0 if n < 2 else 6.0 if n == 2 else 12.0 if n == 3 else min(24.0, 18.0 + (n - 4) * 3.0)


def _region_penalty(n: int) -> float:
    """What a card of one region costs, n places holding that region."""
    return min(8.0, max(0, n - 3) * 2.0)
