"""Rules over single texts: what several of them ask is computed once, and long texts are read on only where need be."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("name", "step", "most"),
    [
        ("source_focus", "(?<=[.!?])", 1),
        ("clean_texts", "regexp_replace(", 40),
        ("update_composition", "regexp_extract_all(", 9),
    ],
)
def test_steps_are_taken_once(spark, name, step, most):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(step) <= most


def test_openings_decide_only_what_they_can(spark):
    texts = ["", None, "a b c", "x" * 500 + " b", " " * 900 + "one two three four", "one\n\ttwo  three", "é’a b-c d " * 200, "w " * 30 + "-" * 900 + " end", "a" * 47 + " b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    rows = df.select(text.word_count(c).alias("n"), *[text.words_upto(c, k).alias(f"u{k}") for k in (1, 3, 7)], *[text.first_words(c, k).alias(f"f{k}") for k in (1, 2, 3)], *[F.array_join(F.slice(F.split(text.collapse(c), " "), 1, k), " ").alias(f"w{k}") for k in (1, 2, 3)]).collect()
    for r in rows:
        assert all(r[f"u{k}"] == r.n if r.n <= k else r[f"u{k}"] > k for k in (1, 3, 7))
        assert all(r[f"f{k}"] == r[f"w{k}"] for k in (1, 2, 3))
