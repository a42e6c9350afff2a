"""Language identification and the co-trained quality classifier."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, quality string"
EN = "the quick people of this town were there when their own house was with them and that is what they have".split()
DE = "und die der nicht mit einem haus ist das wir auch für eine große straße über schon wenn aber".split()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang, words = ("en", EN) if i % 2 else ("de", DE)
        out.append((i, " ".join(rng.choices(words, k=40)), lang, f"s{i % 3}", 100))
    return out


def test_forward_sums_every_segmentation():
    pieces, probs = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"], np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.2], [0.1, 0.2], [0.1, 0.1], [0.2, 0.1]])
    scorer = langid.Unigrams(pieces, probs, unknown=0.01)
    for word in ("▁ab", "▁aba", "▁babab", "▁axb", "b"):
        for lang in (0, 1):
            total = 0.0
            for cuts in itertools.product((0, 1), repeat=len(word) - 1):
                parts, start = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(word[start:i])
                        start = i
                p = 1.0
                for x in parts:
                    p *= probs[pieces.index(x), lang] if x in pieces else 0.01 if len(x) == 1 else 0.0
                total += p
            assert scorer.forward([word, "▁b"])[0, lang] == pytest.approx(np.log(total))


def test_expected_counts_add_up():
    pieces = ["▁", "▁a", "a", "b", "ab"]
    got = langid.expected_counts(pieces, [0.1, 0.3, 0.2, 0.2, 0.2], 1e-7, Counter({"▁ab": 2}))
    # ▁a|b, ▁|ab, ▁|a|b
    a, b, c = 0.3 * 0.2, 0.1 * 0.2, 0.1 * 0.2 * 0.2
    t = a + b + c
    assert got == pytest.approx({0: 2 * (b + c) / t, 1: 2 * a / t, 2: 2 * c / t, 3: 2 * (a + c) / t, 4: 2 * b / t})


def test_letters_are_letters():
    assert langid.words_of("½ ² ①Ⅷ 12 _a_ x²y Ǆ it's") == ["▁a", "▁x", "▁y", "▁ǆ", "▁it", "▁s"]


def test_scripts_without_spaces_are_learned(spark, pieces):
    rng = random.Random(3)
    texts = [("".join(rng.choices("abcde" if k % 2 else "vwxyz", k=300)), "la" if k % 2 else "lz") for k in range(60)]
    out = langid.identify(frame(spark, [(k, t, lang, "s", 1) for k, (t, lang) in enumerate(texts)] + [(99, "½ ² ①", "la", "s", 1)]), pieces).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {**{k: lang for k, (_, lang) in enumerate(texts)}, 99: "und"}


def test_many_languages(spark, pieces):
    docs = [(i, " ".join([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}"] * 9), f"l{i:04}", "s", 1) for i in range(600)]
    langs, probs = langid.fit(frame(spark, docs), pieces, rounds=1)
    assert langs == [d[2] for d in docs] and probs.shape[1] == 600 and np.allclose(probs.sum(axis=0), 1)


def plain_forward(word, prob, reach, unknown=1e-7):
    """Log of the sum over all segmentations, as a plain sum in logarithms."""
    alpha = [0.0]
    for j in range(1, len(word) + 1):
        ways = [alpha[i] + np.log(prob[word[i:j]]) for i in range(max(0, j - reach), j) if word[i:j] in prob]
        if word[j - 1 : j] not in prob:
            ways.append(alpha[j - 1] + np.log(unknown))
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


def test_long_words_are_summed_whole(pieces):
    names = langid.vocabulary(pieces)
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.ones(len(names)), 2).T
    scorer = langid.Unigrams(names, probs)
    reach = max(map(len, names))
    letters = "".join(rng.choice(list("etaoinshrdlu"), 1000))
    words = [*langid.words_of(letters + " plain"), *langid.words_of("q" * 3000), *langid.words_of("日" * 400)]
    assert list(map(len, words)) == [1001, 6, 3001, 401]
    for lang in (0, 1):
        prob = dict(zip(names, probs[:, lang], strict=True))
        assert scorer.forward(words)[:, lang] == pytest.approx([plain_forward(w, prob, reach) for w in words])


def test_long_words_are_learned_whole():
    pieces, probs = ["▁", "▁a", "a", "b", "ab", "aba"], [0.1, 0.3, 0.2, 0.15, 0.2, 0.05]
    short, long = "▁" + "abab" * 7, "▁" + "abab" * 9  # a plain sum, and one in logarithms
    assert len(short) <= langid.SHORT < len(long)
    for word in (short, long, "▁" + "ab" * 3000):
        got = langid.expected_counts(pieces, probs, 1e-7, Counter({word: 3}))
        assert sum(n * len(pieces[k]) for k, n in got.items()) == pytest.approx(3 * len(word))  # every letter is in a piece
    # the derivative of the likelihood gives the same counts
    for word in (short, long):
        got = langid.expected_counts(pieces, probs, 1e-7, Counter({word: 1}))
        for k in range(len(pieces)):
            up = dict(zip(pieces, probs, strict=True))
            up[pieces[k]] *= 1 + 1e-6
            change = (plain_forward(word, up, 3) - plain_forward(word, dict(zip(pieces, probs, strict=True)), 3)) / 1e-6
            assert got.get(k, 0) == pytest.approx(change, abs=1e-3)


def test_identify_equals_a_plain_version(spark, pieces):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choices(EN if i % 2 else DE, k=rng.randint(1, 7))) + rng.choice(["", " " + "".join(rng.choices("enhaus", k=40))]), "en" if i % 2 else "de", "s", 1) for i in range(40)]
    docs += [(100, None, "en", "s", 1), (101, "", None, "s", 1), (102, "12 34", "de", "s", 1), (103, "das haus", None, "s", 1)]
    names = langid.vocabulary(pieces)
    start = np.array([1.0 / (10 + i) for i in range(len(names))])
    reach, langs = max(map(len, names)), ["de", "en"]
    prob = {k: dict(zip(names, start / start.sum(), strict=True)) for k in langs}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in docs}
    for _ in range(2):
        for k in langs:
            uses = Counter()
            for i, t, lang, *_ in docs:
                if lang == k and t and not out[i]:
                    for w in langid.words_of(t):
                        whole = plain_forward(w, prob[k], reach)
                        ahead = [plain_forward(w[:j], prob[k], reach) if j else 0.0 for j in range(len(w) + 1)]
                        behind = [0.0] * (len(w) + 1)
                        for j in range(len(w) - 1, -1, -1):
                            ways = [np.log(prob[k][w[j:e]]) + behind[e] for e in range(j + 1, min(len(w), j + reach) + 1) if w[j:e] in prob[k]]
                            behind[j] = np.logaddexp.reduce([*ways, *([] if w[j] in prob[k] else [np.log(1e-7) + behind[j + 1]])])
                        for j in range(len(w)):
                            for e in range(j + 1, min(len(w), j + reach) + 1):
                                if w[j:e] in prob[k]:
                                    uses[w[j:e]] += np.exp(ahead[j] + np.log(prob[k][w[j:e]]) + behind[e] - whole)
            fresh = np.array([0.5 + uses[p] for p in names])
            prob[k] = dict(zip(names, fresh / fresh.sum(), strict=True))
    got = {r.doc_id: r for r in langid.identify(frame(spark, docs), pieces).collect()}
    for i, t, *_ in docs:
        words = langid.words_of(t or "")
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = np.array([sum(plain_forward(w, prob[k], reach) for w in words) for k in langs])
        assert got[i].lang_pred == langs[int(np.argmax(total))] and got[i].held_out == out[i]
        assert got[i].score == pytest.approx(1 / np.exp((total - total.max()) / np.sqrt(len(words))).sum(), abs=1e-5)


def test_languages_are_told(spark, pieces):
    odd = [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "123 !!", "en", "s", 1), (None, "und die straße", "de", "s", 1), (903, "the house " * 20_000, None, None, None), (1, "there was the house", "en", "s", 1)]
    rows = corpus() + odd
    out = langid.identify(frame(spark, rows), pieces).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert 0.0 <= r.score <= 1.0
    import zlib

    for i, _, lang, _, _ in corpus():
        assert all(r.lang_pred == lang for r in by[i]) and by[i][0].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [by[i][0].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[None][0].lang_pred == "de" and by[903][0].lang_pred == "en" and len(by[1]) == 2


def test_languages_are_never_inputs(spark, pieces):
    df = frame(spark, corpus())
    fitted = langid.fit(df.where(~langid.held_out()), pieces)
    a = langid.predict(df, fitted, pieces).collect()
    b = langid.predict(frame(spark, [(i, t, "xx", None, None) for i, t, *_ in corpus()]), fitted, pieces).collect()
    assert sorted(a) == sorted(b)


def test_nothing_to_learn_from(spark, pieces):
    got = langid.identify(frame(spark, [(i, "some text", None, "s", 1) for i in range(4)]), pieces).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(frame(spark, []), pieces).count() == 0


def test_held_out_accuracy(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, pieces).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.98


def graded(n=300, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = rng.choices(EN, k=50)
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def label_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_is_learned(spark):
    docs, labels = graded()
    df = frame(spark, docs)
    model = quality.fit(df, label_frame(spark, labels + [(1, None, 0), (None, 1, 0), (999, 1, 0)]))
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert all(got[i].kept == (i % 3 != 0) for i in got)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if i % 3}


def test_labels_are_not_thinned_by_documents_without(spark):
    docs, labels = graded(6000)
    few = [x for x in labels if x[0] < 240]
    model = quality.fit(frame(spark, docs), label_frame(spark, few), sample=300, least=40)
    got = {r.doc_id: r for r in quality.score(frame(spark, docs[:300]), model).collect()}
    assert model is not None and all(got[i].kept == (i % 3 != 0) for i in got)


def test_a_rare_class_is_kept_and_odds_set_back(spark):
    rng = random.Random(2)
    # a tenth is bad and nothing tells which: the score must stay near the share of good ones
    docs = [(i, " ".join(rng.choices(EN, k=30)), "en", "s", 100) for i in range(4000)]
    labels = [(i, int(rng.random() > 0.1), 0) for i in range(4000)]
    model = quality.fit(frame(spark, docs), label_frame(spark, labels), sample=1200, least=300)
    scores = [r.score for r in quality.score(frame(spark, docs), model).collect()]
    assert 0.84 < sum(scores) / len(scores) < 0.96


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1200)
    text, meta = ((2 * y - 1)[:, None] * 1.3 + rng.normal(size=(1200, 2)) for _ in "ab")
    seen = np.where(np.arange(1200) < 60, y, -1)
    model = quality.cotrain(text, meta, seen, quality.dealt(seen), rounds=4, sure=0.9)
    assert ((model.score(text, meta) >= 0.5) == y).mean() > 0.93


def plain_logistic(x, y, ridge):
    x = np.hstack([np.asarray(x, float), np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-12)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def plain_cotraining(docs, labels, rounds=4, sure=0.97):
    """The method row by row, without Spark: documents -> probability of good quality."""
    odds = lambda w, x: np.asarray(x, float) @ w[:-1] + w[-1]
    docs = sorted(docs)
    text = np.array([np.concatenate([quality.shape_view(d[1]), quality.content_view(d[1])]) for d in docs]).astype(np.float16).astype(float)
    meta = np.zeros((len(docs), 3 * quality.META_BUCKETS))
    for i, d in enumerate(docs):
        meta[i, quality.meta_view(d[3], d[2], d[4])] = 1
    truth = {i: q for i, q, _ in labels}
    turn, part = {0: 0, 1: 0}, []
    for d in docs:
        q = truth.get(d[0])
        part.append(None if q is None else "tcmtt"[turn[q] % 5])
        if q is not None:
            turn[q] += 1
    taught = [{i: truth[d[0]] for i, d in enumerate(docs) if part[i] == "t"} for _ in "ab"]
    for r in range(rounds + 1):
        fits = [plain_logistic(x[list(t)], np.array(list(t.values()), float), 1.0) for x, t in zip((text, meta), taught, strict=True)]
        if r == rounds:
            break
        for v, x in enumerate((text, meta)):
            p = 1 / (1 + np.exp(-odds(fits[v], x)))
            other = taught[1 - v]
            for label, c in ((1, p), (0, 1 - p)):
                other.update((i, label) for i in range(len(docs)) if part[i] is None and i not in other and c[i] >= sure)
    at = lambda k: [i for i in range(len(docs)) if part[i] == k]
    y = lambda k: np.array([truth[docs[i][0]] for i in at(k)], float)
    raw = [odds(fits[0], text)[:, None], odds(fits[1], meta)[:, None]]
    cals = [plain_logistic(z[at("c")], y("c"), 1e-2) for z in raw]
    both = np.clip(np.column_stack([odds(c, z) for c, z in zip(cals, raw, strict=True)]), -8, 8)
    use = [0, 1]
    mixed = plain_logistic(both[at("m")], y("m"), 1.0)
    if min(mixed[:2]) < 0:
        use = [int(mixed[0] < 0)]
        alone = plain_logistic(both[at("m")][:, use], y("m"), 1.0)
        mixed = np.zeros(3)
        mixed[use[0]], mixed[2] = alone
    return {d[0]: 1 / (1 + np.exp(-s)) for d, s in zip(docs, odds(mixed, both), strict=True)}


def test_scores_are_those_of_plain_cotraining(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < 0.6
        words = rng.choices(EN if good or rng.random() < 0.3 else DE, k=12)
        docs.append((i, " ".join(words), "en", f"s{rng.randrange(3) if good else rng.randrange(2, 5)}", rng.randrange(400)))
        if i % 2:
            labels.append((i, int(good), 0))
    want = plain_cotraining(docs, labels)
    df = frame(spark, docs)
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, label_frame(spark, labels))).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 2e-3
    assert np.std(list(want.values())) > 0.1


def test_text_content_is_seen(spark):
    # same shape and metadata: only the words tell the classes apart
    rng = random.Random(8)
    good, bad = ["alpha", "gamma", "delta", "omega"], ["prize", "money", "click", "lucky"]
    docs = [(i, " ".join(rng.choices(good if i % 2 else bad, k=20)), "en", "s", 120) for i in range(400)]
    df = frame(spark, docs)
    got = {r.doc_id: r.kept for r in quality.score(df, quality.fit(df, label_frame(spark, [(i, i % 2, 0) for i in range(200)]))).collect()}
    assert all(got[i] == bool(i % 2) for i in got)


def test_a_hot_id_is_one_row_of_the_sample(spark):
    docs, labels = graded(60)
    df = frame(spark, docs + [(1, "the same row", "en", "s", 1)] * 3000 + [(None, "no id", "en", "s", 1)] * 3000)
    model = quality.fit(df, label_frame(spark, labels), sample=100)
    assert model is not None and quality.score(df, model).count() == 6060


def test_quality_edges(spark):
    docs, labels = graded(60)
    df = frame(spark, docs + [(None, None, None, None, None), (500, "", None, None, None), (500, "", None, None, None), (501, "w" * 50_000, "en", "s", 1)])
    for rows in ([], [(1, 1, 0)], [(i, 1, 0) for i in range(40)]):
        with pytest.warns(UserWarning, match="both classes"):
            model = quality.fit(df, label_frame(spark, rows))
        with pytest.raises(ValueError):
            quality.fit(df, label_frame(spark, rows), strict=True)
        assert model is None and {(r.score, r.kept) for r in quality.score(df, model).collect()} == {(None, True)}
        assert quality.keep_good(df, model).count() == df.count()
    assert quality.fit(df, label_frame(spark, [(0, 0, 0), (1, 1, 0)])) is not None
    model = quality.fit(df, label_frame(spark, labels))
    assert quality.score(df, model).count() == 64
    none = frame(spark, [])
    assert quality.score(none, quality.fit(none, label_frame(spark, labels))).count() == 0
    assert quality.score(none, model).count() == 0


def test_language_model_learns_from_every_document(spark, monkeypatch):
    """Counts and thresholds are those of all documents, none drawn; a sample of all of them gives the same."""
    import public_tokenizers

    import corpus_pipeline

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, f"the storm came over the hills {'again ' * (i % 5)}", "en", "s", 1) for i in range(40)] + [(100 + i, "der sturm kam wieder über die hügel", "de", "s", 1) for i in range(20)]
    rows += [(200, None, "en", "s", 1), (201, "zzz", None, "s", 1), (202, "", "xx", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    counts = {(r.lang, r.word): r.n for r in langid.word_counts(docs).collect()}
    assert counts[("en", "▁the")] == 80 and counts[("de", "▁sturm")] == 20 and ("en", "▁zzz") not in counts
    (langs, probs), usual = langid.fit_all(docs, model)
    fitted = langid.fit(docs, model, per_lang=1000)
    assert langs == fitted[0] == ["de", "en", "xx"] and np.allclose(probs, fitted[1], rtol=1e-9)
    assert np.allclose(usual[:2], langid.usual(docs, fitted, model, per_lang=1000)[:2], rtol=1e-6, atol=1e-6)
    assert langid.fit_all(docs.limit(0), model)[0][0] == []
    monkeypatch.setattr(langid, "_sample", lambda *a: pytest.fail("documents are drawn"))
    assert corpus_pipeline.language_stage(spark, docs, "").count() > 50
