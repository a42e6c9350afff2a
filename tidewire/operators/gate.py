"""Decisions: model responses validated, actions chosen, updates classified."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DUPLICATE, UPDATE, NEW, HOLD = "duplicate_use_existing_canonical", "update_existing_canonical", "new_story", "hold"
SAME_EVENT_LEAST, NEW_LEAST = 0.82, 0.65

DECISION = "selected_candidate_slug string, same_real_world_event boolean, material_new_update boolean, independently_newsworthy_followup boolean, confidence double, recommended_action string, novel_facts array<string>"


def mended(raw: str) -> str | None:
    """A JSON value at the start of a text, without commas that lead nowhere, closed where the text ends too soon."""
    out, ends, quoted, escaped = [], [], False, False
    for ch in raw:
        if quoted:
            out.append(ch)
            quoted, escaped = escaped or ch != '"', not escaped and ch == "\\"
            continue
        if ch in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if not ends or ends.pop() != ch:
                return None
        elif ch in "{[":
            ends.append("}" if ch == "{" else "]")
        quoted = ch == '"'
        out.append(ch)
        if not ends:
            return "".join(out)
    text = "".join(out[:-1] if escaped else out) + '"' * quoted
    closing = "".join(reversed(ends))
    while text:  # what was begun last may not be whole: a key, a number, a word
        bare = text.rstrip().rstrip(",")
        for tail in ("", "null" if bare.endswith(":") else ":null"):
            try:
                json.loads(bare + tail + closing)
                return bare + tail + closing
            except ValueError:
                continue
        text = bare[: max(bare.rfind(","), 0)]
    return None


def first_object(raw: str | None) -> str | None:
    """The first JSON object in a model's reply, as JSON: commentary, fences and braces of prose around it don't matter.

    What reads as it stands comes first; only where nothing does, a reply with trailing
    commas or one that was cut short is mended.
    """
    raw = (raw or "").strip()
    if raw.startswith("```"):
        raw = raw.split("```")[1].strip()
        raw = raw[4:] if raw.lower().startswith("json") else raw
    starts = [i for i, ch in enumerate(raw) if ch == "{"]
    for at in starts:
        try:
            value, _ = json.JSONDecoder().raw_decode(raw, at)
            return json.dumps(value)
        except ValueError:
            continue
    for at in starts:
        found = mended(raw[at:])
        try:
            value = json.loads(found) if found else None
        except ValueError:
            continue
        if value:
            return json.dumps(value)
    return None


@F.pandas_udf(StringType())
def tolerant_json(replies: pd.Series) -> pd.Series:
    return replies.map(first_object, na_action="ignore")


def validated(df: DataFrame, response: str, slugs: str) -> DataFrame:
    """Adds action, status, errors and repairs to rows with a model's response and candidate slugs.

    No response, or one that can't be read, holds; rules are applied in order, and any
    error holds.
    """
    d = F.from_json(tolerant_json(F.col(response)), DECISION)
    t = df.withColumn("d", d)
    selected = F.trim(F.coalesce("d.selected_candidate_slug", F.lit("")))
    known = F.array_contains(F.col(slugs), selected) & (selected != "")
    same, material = F.coalesce("d.same_real_world_event", F.lit(False)), F.coalesce("d.material_new_update", F.lit(False))
    follow = F.coalesce("d.independently_newsworthy_followup", F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("d.confidence", F.lit(0.0))))
    asked = F.trim(F.coalesce("d.recommended_action", F.lit("")))
    facts = F.size(F.filter(F.coalesce("d.novel_facts", F.array()), lambda x: F.trim(x) != "")) > 0
    inferred = F.when(asked != "", asked).when(same & known, F.when(material, UPDATE).otherwise(DUPLICATE)).when(~same & (sure >= NEW_LEAST), NEW).otherwise("")
    t = t.select(*df.columns, selected.alias("selected"), known.alias("known"), same.alias("same"), material.alias("material0"), follow.alias("follow"), sure.alias("confidence"), asked.alias("asked"), facts.alias("facts"), inferred.alias("requested"))
    lifted = F.col("same") & F.col("known") & (F.col("requested") == UPDATE) & ~F.col("material0") & F.col("facts")
    t = t.withColumn("lifted", lifted).withColumn("material", F.col("material0") | F.col("lifted"))
    c = F.col
    errors = [
        (~c("requested").isin(DUPLICATE, UPDATE, NEW, HOLD), "unknown_recommended_action"),
        (c("same") & (c("requested") == UPDATE) & ~c("material"), "update_action_without_material_evidence"),
        (c("same") & ~c("known"), "same_event_without_valid_candidate"),
        (~c("same") & c("requested").isin(DUPLICATE, UPDATE), "same_event_action_without_same_event"),
        (c("same") & (c("confidence") < SAME_EVENT_LEAST), "same_event_confidence_below_threshold"),
    ]
    t = t.withColumn("errors", F.array_compact(F.array(*[F.when(x, F.lit(n)) for x, n in errors])))
    action = (
        F.when(F.size("errors") > 0, HOLD).when(c("same") & c("follow") & (c("requested") == NEW) & c("material"), NEW)
        .when(c("same"), F.when(c("material"), UPDATE).otherwise(DUPLICATE)).when((c("requested") == HOLD) | (c("confidence") < NEW_LEAST), HOLD).otherwise(NEW)
    )
    return t.select(*df.columns, action.alias("action"), F.when(F.size("errors") == 0, "validated").otherwise("invalid_model_response").alias("status"), "confidence", F.array_join("errors", ",").alias("errors"), (c("lifted") | ((c("asked") == "") & (c("requested") != ""))).alias("repaired"))


def update_class(correction: Column, major: Column, new_facts: Column, status_changed: Column) -> Column:
    return F.when(correction, "correction").when(major, "major_update").when((F.size(new_facts) > 0) | status_changed, "update").otherwise("no_change")


def editorial_action(confirmed: Column, exists: Column, custom: Column, existing_custom: Column, update: Column) -> Column:
    return (
        F.when(~confirmed, "hold_for_review").when(~exists, "publish_new").when(custom & ~existing_custom, "replace_canonical")
        .when(update == "no_change", "ignore").otherwise("update_existing")
    )
