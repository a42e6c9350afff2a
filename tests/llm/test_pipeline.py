"""The corpus pipeline, stage by stage, and its registered queries."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidewire.llm import minhash, registry
from tests.llm.test_near import brute
from tests.llm.test_pii import luhn_ok

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, component_id long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage made, written and read again."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "pii", "packing"]
    for name in ("quality", "language", "near_dedup", "pii"):
        assert stages[name].columns == COLUMNS
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_clean_documents(spark, stages):
    kept = rows(stages["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    more = "/root/testdata/sf0.01"  # with enough bad documents to learn from
    kept = rows(corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{more}/documents.parquet"), more))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{more}/labels.parquet").collect()}
    bad = [i for i, q in labels.items() if q == 0]
    assert all(i in kept for i, q in labels.items() if q == 1) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_language_keeps_what_can_be_told(stages):
    assert rows(stages["language"]).keys() == rows(stages["quality"]).keys()


@pytest.mark.parametrize("langs", [1, 2, 3, 4])
def test_language_rejects_torn_and_unlearned(spark, langs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = ["en", "de", "es", "fr"][:langs]
    learned = docs.where(docs.lang.isin(names) & (docs.n_chars > 300)).orderBy("doc_id")
    long = {k: [r.text.split()[:40] for r in learned.where(learned.lang == k).limit(30).collect()] for k in names}
    pairs = [(a, b) for a in names for b in names if a < b]
    torn = [" ".join(x + y) for a, b in pairs for x, y in zip(long[a], long[b], strict=True)]
    other = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Pchnąć w tę łódź jeża lub ośm skrzyń fig, a potem wszyscy poszli do domu na obiad",
        "Все люди рождаются свободными и равными в своём достоинстве и правах",
        "すべての人間は生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
    ]
    pure = [" ".join(x) for k in names for x in long[k]]
    added = [(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(torn + other + pure)]
    both = learned.select(*COLUMNS).unionByName(spark.createDataFrame(added, learned.select(*COLUMNS).schema))
    kept = set(rows(corpus_pipeline.language_stage(spark, both, SF)))
    got = [i in kept for i, *_ in added]
    gone = got[: len(torn)]
    assert sum(gone) <= 0.05 * len(torn) and not any(got[len(torn) : len(torn) + 4])
    assert sum(got[len(torn) + 4 :]) >= 0.97 * len(pure)
    assert sum(i < 10_000_000 for i in kept) >= 0.98 * learned.count()


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages["language"]), rows(stages["near_dedup"])
    groups = brute([(i, r.text) for i, r in before.items()])
    assert after.keys() == set(groups.values())
    assert all(after[i] == before[i] for i in after)


def test_personal_data_goes(stages):
    before, after = rows(stages["near_dedup"]), rows(stages["pii"])
    assert before.keys() == after.keys()
    private = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])(?:\d+\.){3}\d+(?![\d.]*\d)")
    for i, r in before.items():
        found = {x for x in private.findall(r.text) if not (x.isdigit() and not luhn_ok(x))}
        assert (after[i].text == r.text) == (not found and "password" not in r.text and "token" not in r.text and "AKIA" not in r.text)
        assert not any(x in after[i].text for x in found) and after[i].n_chars == len(after[i].text)


def test_packing_holds_all(stages, bpe):
    tok = Tokenizer.from_file(bpe)
    got = Counter()
    for r in stages["packing"].collect():
        got[r.doc_id] += r.length
    assert got == {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows(stages["pii"]).items()}


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages["packing"].agg({"length": "sum", "doc_id": "max"}).first()
    assert got.agg({"length": "sum", "doc_id": "max"}).first() == want


ODD = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the words of a text that is plain", None, "s", 3), (3, "the words of a text that is plain", None, "s", 3), (4, "y " * 20_000, "en", None, 5), (5, "me@x.org 123 \x00", "en", "s", None)]


def test_stages_take_odd_rows(spark):
    for rows_in in ([], ODD):
        df = spark.createDataFrame([(*r, "clash", 0.0, 1) for r in rows_in], SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= max(len(rows_in), 100 * bool(rows_in))
            if name != "packing":
                assert out.columns == COLUMNS


def test_one_of_repeated_rows_stays(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven eight nine ten eleven twelve"
    rows_in = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " u", "en", "s", 1), (3, None, "en", "s", 1), (3, None, "en", "s", 1)]
    got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert sorted(((r.doc_id, r.text or "") for r in got.collect())) == [(1, a), (1, b), (3, ""), (3, "")]


def test_null_ids_are_kept_by_dedup(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (8, "a b c d e f", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.dedup_stage(spark, df, SF).count() == 3


def test_registered_queries_run(spark):
    q = registry.queries()
    assert sorted(q) == sorted(["pipeline", *(n for n in q if n.startswith("op"))]) and len(q) == 11
    assert sorted(int(n[2:].split("_")[0]) for n in q if n.startswith("op")) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(q)
    assert q["op3_minhash_dedup"](spark, SF).count() == 200 == q["op9_quality"](spark, SF).count()
    assert minhash.near_documents(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").count() < 200
