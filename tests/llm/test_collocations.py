"""Collocations against plain counting in Python, and the sketch's promise never to lose a frequent phrase."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=4, least=30, percent=80, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    often = {g: c for g, c in f.items() if c >= least and len(g) > 2}
    within = Counter()
    for g, c in often.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                key = (g[0], *g[i : i + k])
                within[key] = max(within[key], c)
    out = []
    for g, a in often.items():
        if 100 * within[g] >= percent * a:
            continue
        cuts = [(2000000 * a // (l + r), k, l, r) for k in range(1, len(g) - 1) for l, r in [(f[g[: k + 1]], f[(g[0], *g[k + 1 :])])]]  # noqa: E741
        score, _, l, r = min(cuts)  # noqa: E741
        out.append((g[0], -score, -a, " ".join(g[1:]).encode(), l, r))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):  # noqa: E741
        seen[lang] += 1
        if seen[lang] <= first:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(i, t, la, "clash", 0) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f int").repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).collect())


def texts(n=400, seed=1, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["New", "YORK", "é", "ÉTÉ", "a-b", "日本"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    p /= p.sum()
    glue = np.array([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "!", "\x0b"])
    out = []
    for _ in range(n):
        w = rng.choice(vocabulary, words, p=p)
        out.append("".join(a + b for a, b in zip(w, rng.choice(glue, words), strict=True)) + ("New York state of mind " * int(rng.integers(0, 3))))
    return out


ODD = [("en", None), (None, "new york " * 40), ("en", ""), ("en", " \t\n"), ("en", "a a a a a a"), ("de", "NEW YORK. new york, New\tYork;x" * 20), ("", "empty language name " * 31), ("en", "x" * 9000), ("en", "\x00 \x00 " * 40)]


def test_matches_plain_counting(spark):
    rows = [(("en", "en", "en", "fr", None)[i % 5], t) for i, t in enumerate(texts())] + ODD + ODD[:2]
    want = plain(rows)
    assert len(want) > 40 and {w[0] for w in want} >= {"en", "fr", "und", "de", ""}
    assert run(spark, rows) == sorted(want)
    assert run(spark, rows, parts=7, first=5, least=50, subsumed_percent=50) == sorted(plain(rows, least=50, percent=50, first=5))
    assert run(spark, rows, most=3, least=200) == sorted(plain(rows, most=3, least=200))
    assert run(spark, rows, most=2) == sorted(plain(rows, most=2))


def test_small_sketch_loses_nothing(spark, monkeypatch):
    rows = [("en", t) for t in texts(300, 2)]
    monkeypatch.setattr(collocations, "_LEAST_BITS", 8)  # cells meet many phrases each
    assert run(spark, rows, most_bits=8) == sorted(plain(rows))


def test_ties_and_long_text_cut_at_pieces(spark, monkeypatch):
    tie = " ".join(f"b{i} c{i}." for i in range(30))
    rows = [("en", tie * 35), ("fr", "q r s t " * 3000 + ". " + "u v, " * 2000)]
    monkeypatch.setattr(collocations, "_CHUNK", 64)
    monkeypatch.setattr(collocations, "_FLUSH", 500)
    got = run(spark, rows, first=17)
    assert got == sorted(plain(rows, first=17))
    assert sum(g[0] == "en" for g in got) == 17


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000_000
    table = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "", 0, 2 * big), ("en", "a b c", 3, big // 2), ("en", "b c", 2, big - 2), ("en", "c", 1, big - 2)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **k: table)
    got = {r.phrase: r.score for r in collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect()}
    a = big // 2
    assert got == {"a b": 2000000 * (big - 1) // (2 * big + 1), "b c": 2000000 * (big - 2) // (2 * big - 1), "a b c": min(2000000 * a // (big + big - 2), 2000000 * a // (big - 1 + big - 2))}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab .\tÉ,", max_size=30), min_size=1, max_size=5))
def test_words_and_pieces(parts):
    words = collocations.Words("\n".join(parts).encode())
    want = [(i, w) for i, p in enumerate(re.split("[.,\n]", "\n".join(parts))) for w in re.split("[ \t]", p.translate(LOWER)) if w]
    table = words.table.to_pylist()
    assert [table[i].decode() for i in words.ids] == [w for _, w in want]
    rank = {p: i for i, p in enumerate(sorted({i for i, _ in want}))}
    mine = {p: i for i, p in enumerate(sorted(set(words.piece.tolist())))}
    assert [mine[p] for p in words.piece.tolist()] == [rank[i] for i, _ in want]
