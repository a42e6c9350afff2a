"""Scorers: the pluggable place of a model, with a deterministic default.

A scorer takes rows with ``id`` and ``text`` and gives ``id`` and ``label``. The engine
never calls a model itself; without an answer a row has no label and is held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import contains_any

#: Keywords of the default classifier by section.
KEYWORDS = {
    "politics": ["congress", "senate", "election", "ballot", "governor"], "business": ["market", "merger", "tariff", "prices", "inflation"], "tech": ["software", "data breach", "chip"],
    "sports": ["finals", "league", "championship"], "entertainment": ["oscars", "film", "album"], "world": ["ukraine", "russia", "iran", "ceasefire"],
}


def keyword_label(c: Column) -> Column:
    out, low = F.when(F.lit(False), ""), F.lower(c)
    for label, words in KEYWORDS.items():
        out = out.when(contains_any(low, words), label)
    return out.otherwise("none")


def keyword_scorer(rows: DataFrame) -> DataFrame:
    return rows.select("id", keyword_label(F.col("text")).alias("label"))


def classify(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame], labels: list[str]) -> DataFrame:
    """rows with the scorer's label; one outside ``labels``, or none, becomes ``hold``."""
    got = scorer(rows.select("id", "text")).groupBy("id").agg(F.min("label").alias("label"))
    known = F.col("label").isin(*labels, "none")
    return rows.join(got, "id", "left").withColumn("label", F.when(known, F.col("label")).otherwise("hold"))
