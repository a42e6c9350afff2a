"""Repair of a registry against plain folds in Python."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import activation, graph, identity, ordered, repair, surface
from tidewire.plans import registry
from tidewire.plans.repair import registry_entries

SF = "/root/testdata/sf0.001"
ENTRY = "entry_id long, story_id long, title string, event_key string, url string, anchor string, source string, custom int, priority int, trust int"


# -- the sequential rules ------------------------------------------------------------------


def plain_union(edges, roots):
    """Edge by edge, in order; an edge that would join two ids of one root makes nothing."""
    leader, held = {}, defaultdict(set)
    for i, r in roots:
        held[i].add(r)

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for _, a, b in sorted(edges):
        a, b = sorted((find(a), find(b)))
        if a != b and not held[a] & held[b]:
            leader[b] = a
            held[a] |= held[b]
    ends = {x: find(x) for x in list(leader)}
    many = Counter(ends.values())
    return {x: r for x, r in ends.items() if many[r] > 1}


def rank(e):
    return e["custom"], e["priority"], e["trust"]


def plain_moves(entries):
    """(entries after, moved): each anchor's entries under its owner, judged as things stand at first."""
    total, best, held = Counter(e["story_id"] for e in entries), {}, defaultdict(Counter)
    for e in entries:
        best[e["story_id"]] = max(best.get(e["story_id"], rank(e)), rank(e))
        if e["anchor"]:
            held[e["anchor"]][e["story_id"]] += 1
    owner = {a: max(by, key=lambda s: (by[s] / total[s], by[s], best[s], -s)) for a, by in held.items() if len(by) > 1}
    after = [e | {"story_id": owner.get(e["anchor"], e["story_id"]) if e["anchor"] else e["story_id"]} for e in entries]
    moved = [(e["entry_id"], e["story_id"], x["story_id"]) for e, x in zip(entries, after, strict=True) if e["story_id"] != x["story_id"]]
    gone = {e["story_id"] for e in entries} - {e["story_id"] for e in after}
    last = {}
    for e in sorted((e for e in entries if e["story_id"] in gone), key=lambda e: e["anchor"]):
        last[e["story_id"]] = owner[e["anchor"]]
    return after, moved, last


def plain_edges(entries, layer):
    """Order, first story and other story of each shared key."""
    by = defaultdict(set)
    for e in entries:
        if layer == 2:
            if e["url"]:
                by[2, e["url"]].add(e["story_id"])
            continue
        if len(e["key"].split(" ")) >= 4:
            by[0, e["key"]].add(e["story_id"])
        if e["event_key"] and not e["broad"]:
            by[1, e["event_key"]].add(e["story_id"])
    return [((kind, min(s), k, b), min(s), b) for (kind, k), s in by.items() for b in s if b != min(s)]


def plain_merge(entries, roots, aliases, layer):
    found = plain_union(plain_edges(entries, layer), roots)
    best = {}
    for e in entries:
        best[e["story_id"]] = max(best.get(e["story_id"], rank(e)), rank(e))
    primary = {}
    for s, c in found.items():
        primary[c] = max(primary.get(c, s), s, key=lambda x: (best[x], -x))
    to = {s: primary[c] for s, c in found.items()}
    told = {s: t for s, t in to.items() if s != t}
    return [e | {"story_id": to.get(e["story_id"], e["story_id"])} for e in entries], {(to.get(s, s), r) for s, r in roots}, aliases | told, told


def plain_split(entries, roots, aliases):
    stories, new, out = defaultdict(list), [], {}
    for e in entries:
        stories[e["story_id"]].append(e)
    shared = lambda a, b: len(a["tokens"] & b["tokens"])
    share = lambda a, b: shared(a, b) / min(len(a["tokens"]), len(b["tokens"])) if a["tokens"] and b["tokens"] else 0
    for s in sorted(stories):
        own = stories[s]
        pairs = [(a, b) for a in own for b in own if a["entry_id"] < b["entry_id"]]
        torn = any("unknown" not in (a["family"], b["family"]) and a["family"] != b["family"] and share(a, b) < 0.2 and shared(a, b) < 2 for a, b in pairs)
        near = lambda a, b: (a["event_key"] and a["event_key"] == b["event_key"]) or a["plain"] == b["plain"] or (shared(a, b) >= 2 and share(a, b) >= 0.3) or share(a, b) >= 0.5
        part = plain_union([((a["entry_id"], b["entry_id"]), a["entry_id"], b["entry_id"]) for a, b in pairs if near(a, b)], [])
        parts = defaultdict(list)
        for e in own:
            parts[part.get(e["entry_id"], e["entry_id"])].append(e)
        if torn and len(parts) > 1:
            stays = max(parts, key=lambda p: (len(parts[p]), len({e["source"] for e in parts[p]}), -p))
            new += [(s, p, [e["entry_id"] for e in parts[p]]) for p in parts if p != stays]
    above = max([*stories, *aliases, 0])
    roots, inherited = set(roots), defaultdict(set)
    for s, r in roots:
        inherited[s].add(r)
    for n, (s, _, ids) in enumerate(sorted(new), 1):
        out |= dict.fromkeys(ids, above + n)
        roots |= {(above + n, s), (s, s)} | {(above + n, r) for r in inherited[s]}
    return [e | {"story_id": out.get(e["entry_id"], e["story_id"])} for e in entries], roots


def plain_repair(entries, spoken):
    """All passes, one after the other; ``spoken`` tells the titles that speak of a death."""
    says = {e["story_id"] for e in entries if e["title"] in spoken}
    entries = [e | {"event_key": None} if (e["event_key"] or "").startswith("named-person-death:") and e["story_id"] not in says else e for e in entries]
    keys, titles, told = defaultdict(set), defaultdict(set), defaultdict(set)
    for e in entries:
        keys[e["story_id"]].add(e["broad"] and bool(e["event_key"]))
        titles[e["story_id"]].add(e["title"])
        if e["event_key"] is not None:
            told[e["story_id"]].add((e["event_key"], e["url"], e["title"]))
    aside = {s for s in titles if any(keys[s]) or (len(titles[s]) >= 8 and len(titles[s]) > 4 * max(1, len(told[s])))}
    entries = [e for e in entries if e["story_id"] not in aside]
    roots, aliases = set(), {}
    for layer in (1, 2):
        entries, roots, aliases, _ = plain_merge(entries, roots, aliases, layer)
    entries, _, emptied = plain_moves(entries)
    aliases |= emptied
    entries, roots = plain_split(entries, roots, aliases)
    while True:
        done = {}
        for layer in (1, 2):
            entries, roots, aliases, told = plain_merge(entries, roots, aliases, layer)
            done |= told
        if not done:
            break
    live = {e["story_id"] for e in entries}

    def end(s):
        while s in aliases and s not in live:
            s = aliases[s]
        return s

    return {e["entry_id"]: e["story_id"] for e in entries}, {(a, end(a)) for a in aliases if a not in live and end(a) in live}, aside


# -- tests -----------------------------------------------------------------------------------


def test_lineage_safe_is_the_sequential_rule(spark):
    rng = random.Random(7)
    edges, roots, want = [], [], {}
    for trial in range(25):  # many graphs at once, apart by their ids
        base, n = 1000 * trial, rng.randint(3, 40)
        own = [((trial, k), base + rng.randrange(n), base + rng.randrange(n)) for k in rng.sample(range(10_000), rng.randint(2, 70))]
        held = [(base + rng.randrange(n), base + rng.randrange(4)) for _ in range(rng.randint(0, 14))]
        own = [e for e in own if e[1] != e[2]]
        edges, roots = edges + own, roots + held
        want |= plain_union(own, held)
    df = spark.createDataFrame([(a, b, 10_000 * t + k) for (t, k), a, b in edges] + [(5, 5, 0), (None, 3, 1)], "a long, b long, at long")
    held = spark.createDataFrame([*roots, (1, None)], "id long, root long")
    assert {r.id: r.component for r in graph.lineage_safe(df, held).collect()} == want


def test_lineage_keeps_the_order_of_edges(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 4, 3)], "a long, b long, at long")
    roots = spark.createDataFrame([(1, 9), (4, 9)], "id long, root long")
    assert {r.id: r.component for r in graph.lineage_safe(edges, roots, 0).collect()} == {1: 1, 2: 1, 3: 1}
    late = edges.withColumn("at", -F.col("at"))
    assert {r.id: r.component for r in graph.lineage_safe(late, roots).collect()} == {2: 2, 3: 2, 4: 2}
    assert graph.lineage_safe(edges.limit(0), roots).count() == 0


def made(n=300, seed=3):
    rng = random.Random(seed)
    words = "storm hits coast mayor budget vote fire crash arrest shooting flood school board plan river bridge".split()
    out = []
    for i in range(n):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(3, 6))) + rng.choice(["", "", " crash", " killed", " fire", " budget"])
        key = rng.choice([None, "", f"k{rng.randrange(90)}", f"k{rng.randrange(90)}", f"named-person-death:p{rng.randrange(12)}", f"x{i}", ])
        key = "fire-town" if i % 60 == 0 else key
        url = rng.choice(["", "", f"https://x.org/news/{rng.randrange(60)}"])
        out.append((i, rng.randrange(n // 2), title, key, url, rng.choice([None, "", f"a{rng.randrange(40)}"]), f"s{rng.randrange(5)}", int(i % 17 == 0), rng.randrange(3), rng.randrange(3)))
    return out


def derived(df):
    key = text.headline_key(surface.without_publisher(F.col("title"))).alias("key")
    rows = df.select("*", key, text.headline_key(F.col("title")).alias("plain"), text.timeline_tokens(F.col("title")).alias("tokens"), identity.event_family(F.col("title")).alias("family"), F.coalesce(identity.broad_key(F.col("event_key")), F.lit(False)).alias("broad"), F.lower("title").rlike(repair.fixed.DEATH_PATTERN).alias("spoken")).collect()
    return [r.asDict() | {"tokens": set(r.tokens)} for r in rows]


@pytest.mark.parametrize("source", ["made", "tables"])
def test_passes_equal_a_plain_fold(spark, source):
    df = spark.createDataFrame(made(), ENTRY) if source == "made" else registry_entries(spark, SF)
    rows = derived(df)
    owners, aliases, aside = plain_repair(rows, {r["title"] for r in rows if r["spoken"]})
    read = []
    done = repair.repair_passes(repair.Registry.of(df), read)
    assert {r.entry_id: r.story_id for r in done.entries.collect()} == owners
    assert {(r.alias, r.target) for r in done.aliases.collect()} == aliases
    assert {r.story_id for r in done.set_aside.collect()} == aside
    assert read == sorted(read, reverse=True) and (len(read) == 1 or read[-1] < read[0])
    if source == "made":
        assert aside and aliases and len(set(owners.values())) < 150


def test_moves_conserve_entries(spark):
    df = spark.createDataFrame(made(400, 5), ENTRY)
    rows = [r.asDict() for r in df.collect()]
    after, moved, emptied = plain_moves(rows)
    assert sorted((r.entry_id, r.story_id, r.owner) for r in repair.moves(df).collect()) == sorted(moved) and moved
    now, aliases = repair.move_entries(df)
    same = lambda rs: Counter(tuple(str(r[k]) for k in sorted(r) if k != "story_id") for r in rs)
    got = [r.asDict() for r in now.collect()]
    assert same(got) == same(rows) and {r["entry_id"]: r["story_id"] for r in got} == {r["entry_id"]: r["story_id"] for r in after}
    assert dict(map(tuple, aliases.collect())) == emptied
    assert repair.moves(now).count() == 0
    assert repair.moves(df.limit(0)).count() == 0


def test_a_death_moves_and_leaves_the_rest(spark):
    rows = [
        (1, 10, "Firefighter John Smith dies after long illness", "d1", "", None, "a", 0, 0, 0), (2, 10, "Firefighter dies following personal tragedy", "d2", "", None, "b", 0, 0, 0),
        (3, 11, "Former chief John Smith dies, department mourns", "d3", "", None, "c", 0, 1, 0), (4, 11, "House fire on Oak Street", "f1", "", None, "c", 0, 0, 0), (5, 11, "Cat rescued from a tree", "c1", "", None, "c", 0, 0, 0),
        (6, 12, "Police arrest man in Denver", "p1", "", None, "d", 0, 0, 0),
    ]
    told = repair.with_anchors(spark.createDataFrame(rows, ENTRY))
    anchors = {r.entry_id: r.anchor for r in told.collect()}
    assert anchors[1] == anchors[2] == anchors[3] == "named-person-death:john-smith"
    assert anchors[4] is anchors[5] is anchors[6] is None
    now, aliases = repair.move_entries(told)
    assert {r.entry_id: r.story_id for r in now.collect()} == {1: 10, 2: 10, 3: 10, 4: 11, 5: 11, 6: 12} and aliases.count() == 0
    s = {r.story_id: r for r in repair.story_rows(now).collect()}
    assert s[10].n_entries == 3 and s[10].canonical_title.startswith("Former chief") and s[11].titles == ["Cat rescued from a tree", "House fire on Oak Street"]
    assert s[11].anchors == [] and s[10].sources == ["a", "b", "c"]


def test_rolling_addresses_need_titles_that_agree(spark):
    url = "https://x.org/weather/today"
    rows = [(i, i, t, f"k{i}", u, None, "s", 0, 0, 0) for i, (t, u) in enumerate([("Storm nears coast tonight", url), ("Coast braces as storm nears", url), ("Council debates parking", url), ("Parking again", "https://x.org/n/a"), ("Something else", "https://x.org/n/a")])]
    e = spark.createDataFrame(rows, ENTRY)
    edges = repair.links(e, repair.key_rows(e), 2)
    assert sorted((r.a, r.b) for r in edges.collect()) == [(0, 1), (3, 4)]


def test_containment_reads_what_a_run_touched(spark):
    rows = [
        (1, 1, "Two vehicles in crash on highway", "a", "", None, "s", 0, 0, 0), (2, 1, "City budget passes after debate", "b", "", None, "t", 0, 0, 0), (3, 1, "Highway crash: vehicles towed", "c", "", None, "s", 0, 0, 0),
        (4, 2, "School plan for the river", "named-person-death:x", "", None, "s", 0, 0, 0), (5, 3, "Untouched crash of a vehicle", "d", "", None, "s", 0, 0, 0), (6, 3, "Budget of another town", "e", "", None, "s", 0, 0, 0),
        (7, 4, "Barn fire", "fire-town", "", None, "s", 0, 0, 0), (8, 5, "Quiet day", "q", "", None, "s", 0, 0, 0),
    ]
    e = spark.createDataFrame(rows, ENTRY)
    index = e.select("event_key", "story_id")
    kept, outcome = repair.contain_run(e, index, spark.createDataFrame([(1,), (2,), (5,), (None,), (99,)], "story_id long"))
    got = {r.story_id: (r.reasons, r.index_keys) for r in outcome.collect()}
    assert got == {1: (["timeline_coherence_repaired_split"], 2), 2: (["unsupported_structured_event_key_revoked"], 0), 4: (["broad_event_mapping_revoked", "legacy_unsuffixed_generic_event_key"], 0)}
    owners = {r.entry_id: r.story_id for r in kept.collect()}
    assert set(owners) == {1, 2, 3, 4, 8} and owners[1] == owners[3] == 1 and owners[2] not in (1, 2, 3, 4, 5)
    nothing, none = repair.contain_run(e, index.where("story_id = 8"), spark.createDataFrame([], "story_id long"))
    assert nothing.count() == none.count() == 0


def test_first_seen_folds_chains_in_few_checkpoints(spark, monkeypatch):
    cuts = []
    for module in (ordered, graph):
        real = module.cut
        monkeypatch.setattr(module, "cut", lambda df, real=real: cuts.append(1) or real(df))
    n = 1000  # each row shares a key with the one before it, so that the second is dropped, the third kept, ...
    rows = [(0, k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(n)] + [(1, k, "hot", f"c{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "g long, k long, a string, b string")
    want = {(0, k) for k in range(0, n, 2)} | {(1, 0)}
    assert {(r.g, r.k) for r in ordered.first_seen(df, "g", "k", ["a", "b"]).collect()} == want
    assert len(cuts) <= 20
    got = ordered.first_seen(df.where("k < 16"), "g", "k", ["a", "b"], most=6).collect()  # too long for a task: rounds go on
    assert {(r.g, r.k) for r in got} == {(g, k) for g, k in want if k < 16}


def test_activation_is_rolled_back_beyond_its_limit(spark):
    places = [("a", 0, 1, "", "One two three four", False), ("a", 1, 2, "", "Five six seven eight", False), ("a", 2, 3, "", "One two three four", False), ("a", 3, 4, "", "One two three four", True), ("b", 0, 5, "", "Nine ten eleven twelve", False)]
    df = spark.createDataFrame(places, "section string, pos int, item_id int, url string, title string, custom boolean")
    recs = spark.createDataFrame([("", "one two three four!", True), ("", "Nine ten eleven twelve", False)], "url string, title string, enforceable boolean")
    at = lambda **o: {r.item_id: (r.action, r.new_pos) for r in activation.activate(df, recs, **o).collect()}
    stay = {1: ("kept", 0), 2: ("kept", 1), 3: ("kept", 2), 4: ("kept", 3), 5: ("kept", 0)}
    assert at(mode="enforce", most=2) == {1: ("removed", None), 2: ("promoted", 0), 3: ("removed", None), 4: ("kept", 1), 5: ("kept", 0)}
    assert at(mode="enforce", most=1) == at(mode="shadow", most=9) == stay  # one recommendation, two placements


def test_timeline_parts_without_the_pairs_of_a_story(spark, monkeypatch):
    """Parts and conflicts are those of all pairs, but no pairs of a story are listed."""
    monkeypatch.setattr(identity, "close_entries", lambda rows: pytest.fail("pairs of a story are listed"))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    heads = ["storm floods coast town homes", "fire burns barn valley farm", "council votes budget school roads"]
    rows = []
    for n in range(240):
        story = n % 6
        head = heads[0] if story < 2 else rng.choice(heads)  # the first stories hold one headline with other words behind
        if story == 4:
            head = rng.choice(heads).split()[0]
        tail = rng.sample(words, rng.randint(0, 9)) + (["fire"] if story == 1 and n % 5 == 0 else [])
        rows.append((story, n, " ".join([head, *tail]) if n % 17 else None, rng.choice([None, f"k{n % 40}"])))
    df = spark.createDataFrame(rows, "story_id long, entry_id long, title string, event_key string")
    t = {r.entry_id: r for r in identity._timeline_rows(df).collect()}
    link, torn = {n: n for n in t}, set()

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for x, y in itertools.combinations(t.values(), 2):
        if x.story_id != y.story_id:
            continue
        a, b = set(x.tokens), set(y.tokens)
        n, share = len(a & b), len(a & b) / max(1, min(len(a), len(b)))
        if (x.event_key and x.event_key == y.event_key) or x.key == y.key or (n >= 2 and share >= 0.3) or share >= 0.5:
            lo, hi = sorted((find(x.entry_id), find(y.entry_id)))
            link[hi] = lo
        if "unknown" not in (x.family, y.family) and x.family != y.family and n < 2 and share < 0.2:
            torn.add(x.story_id)
    got = {r.entry_id: (r.part, r.torn) for r in identity.timeline_parts(df).collect()}
    assert got == {n: (find(n), r.story_id in torn) for n, r in t.items()}
    assert 0 < len(torn) < 6
