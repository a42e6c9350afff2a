"""Reading raw pages: title, body text and source quality, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions.text import collapse, contains_any, sentences, text

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescape(c: Column) -> Column:
    """The common entities; ``&amp;`` last, so that nothing is decoded twice."""
    for name, value in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def visible(html: Column) -> Column:
    """Text between tags, scripts and styles left out."""
    bare = F.regexp_replace(text(html), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return collapse(unescape(F.regexp_replace(bare, "<[^>]+>", " ")))


def title(html: Column) -> Column:
    return collapse(unescape(F.regexp_extract(text(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def body(html: Column) -> Column:
    bare = F.regexp_replace(text(html), r"(?is)<script.*?</script>|<style.*?</style>|<title.*?</title>", " ")
    return collapse(unescape(F.regexp_replace(bare, "<[^>]+>", " ")))


def cleaned(c: Column) -> Column:
    """Sentences of five words or more without page furniture, up to ARTICLE_MOST_WORDS words."""
    words = lambda s: F.filter(F.split(s, " "), lambda w: w != "")
    junk = lambda s: contains_any(F.lower(s), fixed.PAGE_JUNK)
    kept = F.filter(sentences(visible(c)), lambda s: (F.size(words(s)) >= 5) & ~junk(s))
    return F.array_join(F.slice(words(F.array_join(kept, " ")), 1, fixed.ARTICLE_MOST_WORDS), " ")


_NODES = "array<struct<articleBody: string, `@graph`: array<struct<articleBody: string>>>>"


def _ld_bodies(html: Column) -> Column:
    """The articleBody of every JSON-LD node of a page, in order; blocks that aren't JSON are passed over."""
    blocks = F.regexp_extract_all(html, F.lit(fixed.LD_JSON), F.lit(1))
    nodes = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(F.trim(b), _NODES), F.array())))
    bodies = F.flatten(F.transform(nodes, lambda n: F.when(n["@graph"].isNotNull(), F.transform(n["@graph"], lambda g: g["articleBody"])).otherwise(F.array(n["articleBody"]))))
    return F.filter(bodies, lambda b: F.coalesce(b, F.lit("")) != "")


def article_text(html: Column) -> Column:
    """struct<rule, text>: the first of a page's rules that gives enough words, or rule none and no text.

    json_ld: the first articleBody of FULL_SOURCE_WORDS; paragraphs: the p blocks of the
    first article element, or of the page if there is none, from SOURCE_WORDS on. Menus
    and footers outside of them don't count.
    """
    page = text(html)
    n = lambda c: space_words(c)
    told = F.filter(F.transform(_ld_bodies(page), cleaned), lambda t: n(t) >= fixed.FULL_SOURCE_WORDS)
    scope = F.when(page.rlike(fixed.ARTICLE), F.regexp_extract(page, fixed.ARTICLE, 1)).otherwise(page)
    blocks = cleaned(F.array_join(F.regexp_extract_all(scope, F.lit(fixed.PARAGRAPH), F.lit(1)), " "))
    found = lambda rule, t: F.struct(F.lit(rule).alias("rule"), t.alias("text"))
    return F.when(F.size(told) > 0, found("json_ld", F.get(told, F.lit(0)))).when(n(blocks) >= fixed.SOURCE_WORDS, found("paragraphs", blocks)).otherwise(found("none", F.lit("")))


def space_words(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def quality(words: Column, discovery: Column) -> Column:
    return (
        F.when(words >= fixed.FULL_SOURCE_WORDS, "full").when(words >= fixed.SOURCE_WORDS, "summary").when(words >= fixed.BRIEF_WORDS, "brief")
        .when(discovery, "discovery_only").otherwise("thin")
    )
