"""Replies and pages that aren't as they should be."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import fixed, pages
from tidewire.operators import gate

WORDS = "The council met on Monday to weigh the plan for the river bridge. "


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('{"a": 1} and then {"b": 2}', {"a": 1}), ('Use {braces} like so: {"a": "}{"} done', {"a": "}{"}), ('```json\n{"a": [1, 2]}\n```\nHope that helps {smile}', {"a": [1, 2]}),
        ('[{"a": 1}, {"b": 2}]', {"a": 1}), ('{"a": 1, "b": [1, 2,],}', {"a": 1, "b": [1, 2]}), ('{"a": 1, "b": "cut sho', {"a": 1, "b": "cut sho"}), ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}),
        ('{"a": 1, "b":', {"a": 1, "b": None}), ('{"a": 1, "b', {"a": 1, "b": None}), ('{"a": 1, "b": tru', {"a": 1}), ('{"a": "x\\', {"a": "x"}), ('{"a": "say \\"hi\\""}', {"a": 'say "hi"'}),
        ("", None), (None, None), ("no braces", None), ("{", None), ("{]", None), ("}{", None), ("[1, 2]", None),
    ],
)
def test_first_object(raw, want):
    got = gate.first_object(raw)
    assert (None if got is None else json.loads(got)) == want


def test_a_reply_cut_short_is_judged(spark):
    good = '{"selected_candidate_slug": "s1", "same_real_world_event": true, "material_new_update": true, "confidence": 0.9, "recommended_action": "%s"' % gate.UPDATE
    rows = [(1, "I {think}: " + good + "} ok {bye}"), (2, good + ","), (3, good + ', "novel_facts": ["a", "b'), (4, "nothing"), (5, None)]
    df = spark.createDataFrame([(i, r, ["s1"]) for i, r in rows], "id int, response string, slugs array<string>")
    got = {r.id: (r.action, r.status) for r in gate.validated(df, "response", "slugs").collect()}
    assert got[1] == got[2] == got[3] == (gate.UPDATE, "validated") and got[4][0] == got[5][0] == gate.HOLD


def test_article_text_takes_the_first_rule_that_suffices(spark):
    ld = lambda v: f'<script type="application/ld+json">{v}</script>'
    body = WORDS * 15
    para = "<p>" + WORDS * 8 + "</p>"
    nav = "<nav><p>Home and menu of this place here.</p></nav>"
    cases = {
        "object": (ld(json.dumps({"@type": "NewsArticle", "articleBody": body})) + para, "json_ld", 15),
        "graph": (ld(json.dumps({"@graph": [{"@type": "X"}, {"articleBody": body}]})), "json_ld", 15),
        "list": (ld(json.dumps([{"a": 1}, {"articleBody": body}])), "json_ld", 15),
        "second block": (ld("{broken") + ld(json.dumps({"articleBody": "too short"})) + ld(json.dumps({"articleBody": body})), "json_ld", 15),
        "short ld": (ld(json.dumps({"articleBody": WORDS * 3})) + nav + f"<article>{para}</article><footer><p>{WORDS}</p></footer>", "paragraphs", 8),
        "no article": (nav + para, "paragraphs", 8),
        "unclosed article": ("<article><p>" + WORDS * 8 + "</p>", "paragraphs", 8),
        "script decoy": ("<script>var a='<p>';</script><article>" + para + "<script>track('x.')</script></article>", "paragraphs", 8),
        "junk": ("<article>" + para + "<p>Please subscribe to our letter for more of it. Too few words.</p></article>", "paragraphs", 8),
        "thin": ("<article><p>" + WORDS * 3 + "</p></article>", "none", 0),
        "empty": ("", "none", 0),
        "null": (None, "none", 0),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, html string")
    for r in df.select("k", pages.article_text(F.col("html")).alias("t")).collect():
        _, rule, n = cases[r.k]
        assert (r.t.rule, r.t.text.count("river bridge")) == (rule, n), r.k
        assert r.k != "junk" or "subscribe" not in r.t.text
    long = spark.createDataFrame([("<p>" + WORDS * 400 + "</p>",)], "html string").select(pages.article_text(F.col("html")).alias("t")).first()
    assert len(long.t.text.split()) == fixed.ARTICLE_MOST_WORDS


def test_titles_that_hold_each_other(spark):
    import random

    from tidewire.operators import substrings

    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("ab cd") for _ in range(n))
    heads = [(i, say(rng.choice([0, 2, 5, 9, 30, 70]))) for i in range(60)] + [(90, None), (91, "Storm HITS the coast"), (92, "x" * 60)] + [(i, "hot one here") for i in range(100, 130)]
    bank = [(i, say(rng.choice([0, 1, 3, 6, 7, 12, 60]))) for i in range(80)] + [(200, None), (201, "hits the"), (202, "big storm hits the coast at night"), (203, "x" * 50 + "y"), (204, "hot one here"), (205, "hot one here")]
    low = lambda v: (v or "").lower()[:50]
    want = {i: min((e for e, t in bank if low(h) and low(t) and (low(h) in low(t) or low(t) in low(h))), default=None) for i, h in heads}
    got = substrings.first_title(spark.createDataFrame(heads, "id long, headline string"), spark.createDataFrame(bank, "entry_id long, title string"))
    assert {r.id: r.entry_id for r in got.collect()} == want and want[91] is not None and want[92] == 203
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cleaned(spark):
    from tidewire.functions import cleanup

    summary = 'By John Smith The <b>mayor</b> said "no" &amp; left\\ https://x.org/a?b Read more at our site\nNext line stays [+120 chars] gone\nClick here to see'
    draft = "Good morning, # Title\n**Bold** and *soft* and _low_ [site](http://x) \n- first\n* second\n\n\n\nEnd"
    told = "The fire burned. Officials have not said why. It spread.\n\nNo details were given. Done."
    df = spark.createDataFrame([(summary, draft, told), (None, None, None), ("", "", "")], "s string, d string, t string")
    rows = df.select(cleanup.summary(F.col("s")).alias("s"), cleanup.without_markdown(F.col("d")).alias("d"), cleanup.without_absence(F.col("t")).alias("t")).collect()
    assert rows[0].s == "The mayor said 'no' left Next line stays"
    assert rows[0].d == "Title\nBold and soft and low site \nfirst\nsecond\n\nEnd"
    assert rows[0].t == "The fire burned. It spread. Done."
    assert tuple(rows[1]) == tuple(rows[2]) == ("", "", "")
