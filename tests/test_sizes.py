"""What only shows in larger tables, on small ones made for it."""

import hashlib
import os

import duckdb

import __spark_entry__ as entry


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _against_sql(spark, folder, name):
    """Rows of a query and of its SQL over a folder's tables, sorted."""
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{t}/*.parquet')")
    got = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in want.description].index(c) for c in got.columns]
    order = lambda rows: sorted(rows, key=repr)
    return order([tuple(r) for r in got.collect()]), order([tuple(r[i] for i in at) for r in want.fetchall()])


def test_digests_of_letters_alone_are_no_classes(spark, tmp_path):
    letters = [n for n in (2411, 43266, 48234) if hashlib.md5(str(n).encode()).hexdigest()[:10].isalpha()]
    assert len(letters) == 3
    folder = _documents(spark, tmp_path, [(n, "Some text of a few words", "en", "src1", 24) for n in [*letters, 12, 24, 7, 8]])
    got, want = _against_sql(spark, folder, "exclusions")
    assert got == want


def _sets(n: int = 400):
    """Sets of a common core, some of whose words are their own: most links rest on the core alone."""
    import random

    rng = random.Random(5)
    cores = [[f"c{k}_{i}" for i in range(7)] for k in range(3)]
    own = [f"w{i}" for i in range(60)]
    return [(i, sorted(set(rng.sample(cores[i % 3], rng.randint(4, 7)) + rng.sample(own, rng.randint(0, 6))))) for i in range(n)]


def test_links_on_common_tokens_are_counted_by_classes(spark):
    from tidewire.operators import graph, pairs

    rows = _sets()
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    tokens = {i: frozenset(t) for i, t in rows}
    firsts, own = {}, {}
    for i, t in tokens.items():
        firsts.setdefault(t, i)
        own[firsts[t]] = own.get(firsts[t], 0) + 1
    for common in (40, 10**9):  # with heavy tokens, and without
        got = {r.id: (r.set_id, r.n_sets, r.n_ids, r.nearest) for r in pairs.linked_sets(df, 4, 0.70, "containment >= 0.70 or jaccard >= 0.55", common=common).collect()}
        want = {}
        for i, t in tokens.items():
            me, linked = firsts[t], []
            for u, other in firsts.items():
                s, least, every = len(t & u), min(len(t), len(u)), len(t | u)
                if other != me and s >= 4 and (s / least >= 0.70 or s / every >= 0.55):
                    linked.append((-round(s / every, 9), other))
            want[i] = (me, len(linked), sum(own[o] for _, o in linked) + own[me] - 1, min(linked)[1] if linked else None)
        assert got == want
        sets = spark.createDataFrame([(i, sorted(t)) for t, i in firsts.items()], "id long, tokens array<string>")
        edges = pairs.joined_sets(sets, 5, 1.2 / 1.6, "jaccard >= 0.6", wide=0.6, common=common)
        found = {r.id: r.component for r in graph.components(edges).collect()}
        leader = {i: i for i in firsts.values()}

        def top(x, leader=leader):
            while leader[x] != x:
                x = leader[x]
            return x

        for t, i in firsts.items():
            for u, other in firsts.items():
                if other > i and len(t & u) >= 5 and len(t & u) / len(t | u) >= 0.6:
                    x, y = sorted((top(i), top(other)))
                    leader[y] = x
        assert {i: found.get(i, i) for i in leader} == {i: top(i) for i in leader}


def test_images_told_alike_are_met_once(spark):
    from tidewire.operators import surface

    bank = spark.createDataFrame([(3, ["dog", "show"]), (1, ["show", "dog"]), (2, ["cat", "show"])], "image_id long, tokens array<string>")
    assert sorted((r.id, tuple(r.tokens)) for r in surface.firsts(bank).collect()) == [(1, ("dog", "show")), (2, ("cat", "show"))]
    cards = spark.createDataFrame([(9, "us", ["show", "dog", "new"])], "id long, category_key string, tokens array<string>")
    assert [(r.id, r.image_id) for r in surface.image_match(cards, bank).collect()] == [(9, 1)]


def test_equal_evidence_is_met_once(spark):
    from pyspark.sql import functions as F

    from tidewire.functions import incidents as told
    from tidewire.operators import graph, incidents

    title = "Road rage driver used PIT maneuver, family SUV into fence in Ohio"
    df = spark.createDataFrame([(i, title) for i in range(1, 61)], "story_id long, title string")
    none = F.array().cast("array<string>")
    e = df.select("story_id", told.evidence(F.col("title"), F.lit("vehicle struck"), F.array(F.lit("Ohio")), none, F.lit("2026-01-03").cast("timestamp")).alias("e"))
    links = incidents.unified_links(e)
    assert links.count() == 59
    assert {(r.id, r.component) for r in graph.components(links).collect()} == {(i, 1) for i in range(1, 61)}
    asked = e.where("story_id < 3").withColumnRenamed("story_id", "report_id")
    assert [(r.ambiguous, r.story_id) for r in incidents.unified_match(asked, e).collect()] == [(True, None)] * 2
    assert [(r.ambiguous, r.story_id) for r in incidents.unified_match(asked, e.where("story_id = 7")).collect()] == [(False, 7)] * 2


def test_duplicates_go_by_kept_rows(spark):
    import random

    from tidewire.operators import activation

    rng = random.Random(3)
    rows = [(i, sorted(set(rng.sample([f"f{i % 3}{k}" for k in range(6)], rng.randint(1, 6)) + rng.sample([f"w{k}" for k in range(9)], rng.randint(0, 2))))) for i in range(300)]
    kept, want = [], {}
    for i, t in rows:
        met = [k for k, o in kept if len(set(t) & set(o)) >= 4] if len(t) >= 3 else []
        want[i] = max(met) if met else i
        if not met:
            kept.append((i, t))
    df = spark.createDataFrame(rows, "pos long, tokens array<string>")
    for at_once in (7, 4096):
        assert {r.pos: r.kept_pos for r in activation.kept_of_duplicates(df, at_once=at_once).collect()} == want


def test_signatures_are_asked_only_where_nothing_surer_is_found(spark, monkeypatch):
    from tidewire.operators import pairs

    met, meet = [], pairs.meet
    monkeypatch.setattr(pairs, "meet", lambda a, b, *x, **k: met.append((a.count(), b.count())) or meet(a, b, *x, **k))
    words = ["alpha", "bravo", "charlie", "delta"]
    archive = spark.createDataFrame([(f"https://n.org/stories/no{i}", i, i // 2, words if i > 4 else words[:3]) for i in range(9)], "url string, pos long, story_id long, tokens array<string>")
    probes = spark.createDataFrame([(10, "https://n.org/stories/no3", 0, words), (11, None, 2, words), (12, None, 90, words), (13, None, 91, words), (14, None, 92, words[:2])], "article_id long, url string, story_id long, tokens array<string>")
    got = sorted(tuple(r) for r in pairs.archive_match(probes, archive).collect())
    assert got == [(10, 1, 3), (11, 2, 4), (12, 3, 5), (13, 3, 5)]
    assert met == [(1, 2)]  # two probes of one signature, against the two that the archive holds


def test_pairs_meet_once_on_values_of_several_kinds(spark):
    from pyspark.sql import functions as F

    from tidewire.operators import identity, pairs

    rows = [(i, [f"p{i % 2}", f"p{i % 3}"], [f"f{i % 4}"]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, places array<string>, facts array<string>")
    side = lambda p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    keys = lambda p: pairs.combined(("places", "facts"), lambda k: F.col(f"{p}_{k}"))
    met = sorted((r.l_id, r.r_id) for r in pairs.meet_on_keys(side("l"), side("r"), keys("l"), keys("r")).collect())
    assert met == [(a, b) for a, x, f in rows for b, y, g in rows if set(x) & set(y) and f == g]
    # a value of one kind alone makes no pair meet where no score could be reached by it
    assert min(len(k) for k in identity._must_share(0.78)) == 4 and min(len(k) for k in identity._must_share(0.6)) == 3


def test_alternates_by_common_tokens_are_met_by_kinds(spark):
    from tidewire.operators import surface

    rows = [(i, f"s{i % 3}" if i % 7 else None, t) for i, t in _sets(300)]
    df = spark.createDataFrame(rows, "id long, source string, tokens array<string>")
    want = {}
    for i, s, t in rows:
        scored = [(-round(len({*t} & {*u}) / min(len(t), len(u)), 6), j) for j, o, u in rows if s and o and s != o and len({*t} & {*u}) >= 2]
        if scored and -min(scored)[0] >= 0.45:
            want[i] = min(scored)
    for few, common in ((10, 30), (512, 40), (1, 10**9)):
        got = {r.id: (-r.score, r.alternate_id) for r in surface.alternates(df, df, few=few, common=common).collect()}
        assert got == want


def test_content_lookup_by_common_words_is_met_by_kinds(spark):
    from tidewire.operators import activation

    rows = [(i, " ".join(t).replace("_", "x")) for i, t in _sets(300)]
    probes, bank = rows[::2], rows[1::2] + [(900 + i, t) for i, t in rows[1:40:2]]
    want = {}
    for i, t in probes:
        scored = sorted((-len({*t.split()} & {*u.split()}), j) for j, u in bank if len({*t.split()} & {*u.split()}) >= 2)
        for rank, (n, j) in enumerate(scored[:5], 1):
            want[i, rank] = (j, -n)
    for few, common in ((10, 30), (512, 40), (1, 10**9)):
        found = activation.content_lookup(spark.createDataFrame(probes, "id long, title string"), spark.createDataFrame(bank, "entry_id long, title string"), few=few, common=common)
        assert {(r.id, r.rank): (r.entry_id, r.shared) for r in found.collect()} == want
