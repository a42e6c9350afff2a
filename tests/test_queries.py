"""Every registered query of the engine against its SQL in DuckDB."""

import os
import re
import subprocess
import sys
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.functions import fixed, text
from tidewire.plans import registry
from tidewire.sources.views import articles, web_pages

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


def plain_ratio(a, b):
    return SequenceMatcher(None, " ".join(a), " ".join(b)).ratio()


def test_headline_similarity_by_hand(spark):
    tok = lambda v: [t for t in (fixed.HEADLINE_CANON.get(w, w) for w in re.findall("[a-z0-9]+", v.lower().replace("st.", "st")) if w not in fixed.HEADLINE_STOP) if len(t) >= 2 or t.isdigit()]
    got = {r.article_id: r.score for r in registry.queries()["headline_similarity"](spark, SF).collect()}
    for r in articles(spark, SF).collect():
        a, b = tok(r.headline), tok(r.source_title)
        x, y = set(a), set(b)
        n = len(x & y)
        blend = max(0.5 * n / min(len(x), len(y)) + 0.3 * n / len(x | y) + 0.2 * plain_ratio(sorted(x), sorted(y)), 0.88 * plain_ratio(a, b))
        assert got[r.article_id] == pytest.approx(min(1.0, blend), abs=6e-5)


def test_source_focus_by_hand(spark):
    got = {r.article_id: (r.n_chars, r.narrowed) for r in registry.queries()["source_focus"](spark, SF).collect()}
    words = lambda v: re.findall("[a-z0-9]+", v.lower())
    narrowed = 0
    for r in articles(spark, SF).collect():
        whole = re.sub(r"[ \t\n\x0b\f\r]+", " ", r.body or "").strip(" ")
        title = f"{r.source_title} {' '.join(whole.split(' ')[299:308])}"
        tokens = {t for t in words(title) if len(t) >= 4 and t not in fixed.FOCUS_GENERIC}
        parts = [s for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", whole) if s]
        scores = [len(set(words(s)) & tokens) for s in parts]
        best = max(scores, default=0)
        at = scores.index(best) if scores else -1
        before = sum(len(s.split(" ")) for s in parts[:at]) if at >= 0 else 0
        window = " ".join(parts[max(0, at - 1) : min(len(parts), at + 5)])
        n, m = len(whole.split(" ")), len(window.split(" "))
        use = n >= 220 and len(tokens) >= 2 and best >= 2 and before > 140 and m >= 45 and m < n * 0.85
        narrowed += use
        assert got[r.article_id] == (len(window if use else whole), use and window != whole), r.article_id
    assert narrowed


def test_first_seen_pages_by_hand(spark):
    rows = web_pages(spark, SF).select("page_id", "domain", text.headline_key(F.col("title")).alias("k"), "identity_url").collect()
    seen, want = set(), set()
    for r in sorted(rows, key=lambda r: r.page_id):
        keys = {(r.domain, n, v) for n, v in (("t", r.k), ("u", r.identity_url)) if v}
        if not keys & seen:
            seen |= keys
            want.add(r.page_id)
    assert {r.page_id for r in registry.queries()["first_seen_pages"](spark, SF).collect()} == want


def test_section_backfill_by_hand(spark):
    got = {}
    for r in registry.queries()["section_backfill"](spark, SF).collect():
        got.setdefault(r.section, {})[r.slot] = r.article_id
    want = {}
    for r in articles(spark, SF).withColumn("n", text.word_count(F.col("body"))).orderBy("article_id").collect():
        tokens = {t for t in re.findall("[a-z0-9]+", r.source_title.lower()) if len(t) >= 3 and t not in fixed.BACKFILL_STOP}
        chosen = want.setdefault(r.category_key, [])
        if r.n >= fixed.SOURCE_WORDS and len(chosen) < 6 and not any(len(tokens & s) >= 4 and len(tokens & s) / min(len(tokens), len(s)) >= 0.70 for _, s in chosen):
            chosen.append((r.article_id, tokens))
    assert {s: list(dict(sorted(c.items())).values()) for s, c in got.items()} == {s: [i for i, _ in c] for s, c in want.items() if c}


def test_entry_survives_a_missing_dependency():
    code = "import sys; sys.modules['public_tokenizers'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; from tidewire.plans import registry; assert set(e.queries()) == set(registry.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
