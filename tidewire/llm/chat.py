"""Chat formatting: every assistant turn becomes an example with its context.

A turn is written ``<s>[role]\\n`` text ``</s>``. In roles and texts a backslash is
doubled and ``<``, ``[`` and ``]`` are followed by one, so no control string can occur
in them, and :func:`unescape` gives them back. All of it is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<s>[", "]\n", "</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), r"([<\[\]])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\]])\\|\\(\\)", "$1$2")


def prefix_target_examples(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """One row per example: conv_id, example (from 0), text, loss_start, loss_end.

    Each assistant turn gives an example: the formatted conversation up to its end. The
    loss mask is the code points [loss_start, loss_end) of text, the escaped reply
    alone. Turns after the last reply (all turns where there is none) can't be context
    of a reply; they close the conversation in one more example of empty mask, both
    bounds null. Turns go by turn number, equal numbers by role and text; null numbers
    come first. A null role or text counts as empty, a null conv_id is a conversation
    of its own, so all rows without one are a single conversation; repeated turns stay
    repeated, an empty table gives no examples, and other columns aren't carried. A
    conversation is put together in one row, and an example holds its whole context:
    one conversation must fit in a task, and its examples grow with the square of its turns.
    """
    conv = F.col(conv_col).cast("long")
    rows = turns.select(
        conv.alias("conv_id"),
        F.col(turn_col).cast("long").alias("n"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("raw"),
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    shown = rows.select("conv_id", "n", "role", "raw", head.alias("head"), escape(F.col("raw")).alias("body"))
    shown = shown.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("n", "role", "raw")
    placed = shown.select(
        "conv_id",
        F.row_number().over(before).alias("at"),
        (F.col("role") == target_role).alias("target"),
        "piece",
        F.length("head").alias("head_len"),
        F.length("body").alias("body_len"),
        F.coalesce(F.sum(F.length("piece")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "target", "piece", "head_len", "body_len", "start"))).alias("turns"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("full"),
        F.concat(
            F.transform(
                F.filter("turns", lambda t: t["target"]),
                lambda t: F.struct((t["start"] + t["head_len"]).cast("long").alias("loss_start"), (t["start"] + t["head_len"] + t["body_len"]).cast("long").alias("loss_end")),
            ),
            F.when(~F.element_at("turns", -1)["target"], F.array(F.struct(F.lit(None).cast("long").alias("loss_start"), F.lit(None).cast("long").alias("loss_end")))).otherwise(
                F.array().cast("array<struct<loss_start:bigint,loss_end:bigint>>")
            ),
        ).alias("spans"),
    )
    each = whole.select("conv_id", "full", F.posexplode("spans").alias("example", "span"))
    end = F.coalesce(F.col("span.loss_end") + F.lit(len(CLOSE)), F.length("full").cast("long"))
    return each.select(
        "conv_id",
        F.col("example").cast("int").alias("example"),
        F.substring(F.col("full"), F.lit(1), end.cast("int")).alias("text"),
        F.col("span.loss_start").alias("loss_start"),
        F.col("span.loss_end").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: turns and trained text, unescaped.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars (code
    points of all its examples).
    """
    trained = F.when(
        F.col("loss_start").isNotNull(),
        F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")),
    )
    per = examples.select("conv_id", "example", "text", trained.alias("trained")).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("parts"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("parts", lambda p: unescape(F.coalesce(p["trained"], F.lit("")))), "")
    turns = F.filter(F.split("text", CLOSE, -1), lambda t: t != "")
    line = lambda t: F.concat(unescape(F.regexp_extract(t, r"(?s)^<s>\[(.*?)\]\n", 1)), F.lit("\n"), unescape(F.regexp_extract(t, r"(?s)^<s>\[.*?\]\n(.*)$", 1)), F.lit("\n"))
    return per.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
