"""Times: several formats to one timestamp, and which of several stamps counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """ISO-8601 or RFC-2822 text as a timestamp, without an offset as UTC; else a leading date, else null.

    A time of day alone is no timestamp, so the ISO branch asks for a year first.
    """
    raw = F.trim(F.coalesce(c, F.lit("")))
    mail = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"\s+", " ")
    iso = F.when(raw.rlike(r"^\d{4}-"), F.try_to_timestamp(raw))
    day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(raw, 1, 10)))
    named = F.when(mail.rlike(r"[A-Z]{2,4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")))
    offset = F.when(mail.rlike(r"[+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))
    return F.coalesce(iso, offset, named, day)


def effective(stamps: list[tuple[str, Column]]) -> Column:
    """struct<at, basis>: the first stamp of a ladder that can be read, and its name."""
    out = F.when(F.lit(False), F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("basis")))
    for name, c in stamps:
        out = out.when(c.isNotNull(), F.struct(c.alias("at"), F.lit(name).alias("basis")))
    return out.otherwise(F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit("missing").alias("basis")))
