"""Clean-up of summaries and drafted text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions.text import bind, collapse, contains_any, text

_SPACE = "[ \\t\\n\\x0B\\f\\r]"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def summary(c: Column) -> Column:
    """A feed's summary without tags, addresses, bylines and calls to read on; one line, without quotes that break JSON."""
    out = F.regexp_replace(F.regexp_replace(text(c), "<[^>]+>", " "), f"https?://[^{_SPACE[1:]}+", "")

    def quiet(whole: Column) -> Column:
        # a plain search tells texts that no pattern can touch
        noisy = contains_any(F.lower(whole), fixed.SUMMARY_NEEDS) | whole.rlike("(?mdi)^by [a-z]")
        out = whole
        for pattern in fixed.SUMMARY_NOISE:
            # lines end at \n alone, as in the patterns' home
            out = F.regexp_replace(out, f"(?md){pattern}", "")
        return F.when(noisy, out).otherwise(whole)

    return collapse(F.translate(bind(out, quiet), "\\\"", " '"))


def without_absence(c: Column) -> Column:
    """A text without the sentences that say what isn't known; paragraphs stay."""

    def told(whole: Column) -> Column:
        kept = F.filter(F.split(whole, "\\."), lambda s: ~contains_any(F.lower(s), fixed.ABSENCE))
        # where the whole says none of it no sentence does
        return F.when(contains_any(F.lower(whole), fixed.ABSENCE), F.array_join(kept, ".")).otherwise(whole)

    return _trimmed(F.replace(bind(F.replace(text(c), F.lit("\n\n"), F.lit("<<PARA>>")), told), F.lit("<<PARA>>"), F.lit("\n\n")))


def without_markdown(c: Column) -> Column:
    """A text without marks of headings, emphasis, links and lists, and without a greeting at its start."""
    out = F.regexp_replace(text(c), f"#{{1,6}}{_SPACE}*", "")
    for pattern, kept in ((r"\*{1,2}([^*]+)\*{1,2}", "$1"), ("_([^_]+)_", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (f"(?md)^[-*]{_SPACE}+", ""), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, kept)

    def begun(out: Column) -> Column:
        greets = F.lit(False)
        for g in fixed.GREETINGS:
            greets = greets | F.lower(F.left(out, F.lit(max(map(len, fixed.GREETINGS))))).startswith(g)
        after = F.regexp_replace(F.regexp_replace(out, "(?i)^good (?:morning|afternoon|evening)[.,]", ""), f"^{_SPACE}+", "")
        return F.when(greets, after).otherwise(out)

    return bind(_trimmed(out), begun)
