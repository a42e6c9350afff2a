"""Fill-in-the-middle against plain string cutting, and the directory against plain counts."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import infill


def plain(doc_id, text, seed=1):
    text = text or ""
    n = len(text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", p, q - p, f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}"
    return doc_id, n, "psm", p, q - p, f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=900))
def test_rank_and_select(text):
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    bounds = infill.Boundaries(data)
    at = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]
    places = np.arange(len(raw) + 1)
    assert bounds.rank(places).tolist() == [sum(a < p for a in at) for p in places.tolist()]
    assert bounds.select(np.arange(len(at))).tolist() == at


def test_select_over_many_blocks():
    rng = np.random.default_rng(5)
    data = rng.choice(np.array([0x41, 0x80, 0x80, 0xC3], np.uint8), 40_000)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = infill.Boundaries(data)
    assert (bounds.select(np.arange(len(at))) == at).all()
    assert (bounds.rank(at) == np.arange(len(at))).all()


TEXTS = [
    None, "", "a", "é", "日本語のテキスト\U0001f600 ende", "with <P> inside", "<S>", "x<M>y", "<", ">", "<P", "S><M", "<<S", "P>M>S>", " \n\t ", "\x00 zero \x00",
    "word " * 30_000, "é" * 70_000, "<P <S <M" * 50, "ABC" * 9,
]


def test_matches_plain_cutting(spark, odd_texts):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "without an id"), (None, None), (3, "again"), (3, "again"), (-7, "negative")] + odd_texts
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, n string, output string").repartition(3)
    want = sorted((plain(i, t) for i, t in rows), key=str)
    for size in (1 << 22, 64):
        done = infill.fill_in_middle(df, group_bytes=size)
        assert sorted((tuple(r) for r in done.collect()), key=str) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = infill.fill_in_middle(df).select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("text"))
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    digests = infill.infill_digests(df).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id, r.output_sha256) for r in digests if r.doc_id is not None) == sorted((w[0], sha(w[5])) for w in want if w[0] is not None)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="<>PSMé x", max_size=14), min_size=1, max_size=20))
def test_markers_cannot_arise(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    back = infill.fill_in_middle(df).select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("text"))
    assert sorted(tuple(r) for r in back.collect()) == list(enumerate(texts))


def test_parameters_and_empty_table(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(300)], "doc_id long, text string")
    assert {r.form for r in infill.fill_in_middle(df, reordered=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(df, reordered=100, suffix_first=100).collect()} == {"spm"}
    assert infill.fill_in_middle(df, seed=2).exceptAll(infill.fill_in_middle(df)).count() > 200
    assert infill.infill_digests(df.limit(0)).count() == 0


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert "Exchange" not in infill.infill_digests(df)._jdf.queryExecution().executedPlan().toString()
