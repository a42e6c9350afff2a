"""Graphs in tables: components, alias chains and merges that respect lineage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.checkpoints import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): the smallest id reachable, for ids with an edge.

    Large-star and small-star steps alternate until nothing moves. Null ends and loops
    don't count. Every round is cut, and no list of edges or ids reaches the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, seen = cut(pairs.distinct()), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(small.where("u > v").distinct())
    # every id now points at its root, and roots at nothing
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def flatten_aliases(aliases: DataFrame, active: DataFrame) -> DataFrame:
    """(alias, target) chains -> (alias, target) with active terminal targets.

    An alias has one target: of several, the smallest. Chains are halved in each round,
    so after as many rounds as the logarithm of their number what still moves is, or
    leads into, a cycle. Cycles, self-links, aliases that are active themselves and
    targets that aren't active are left out.
    """
    now = cut(aliases.where("alias <> target").groupBy("alias").agg(F.min("target").alias("target")))
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        step = now.select(F.col("alias").alias("target"), F.col("target").alias("further"))
        joined = now.join(step, "target", "left").select("alias", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved"))
        now = cut(joined.where("alias <> target"))
        if now.where("moved").isEmpty():
            break
    else:
        now = now.where("not moved")
    on = active.select(F.col("id").alias("target"))
    return now.select("alias", "target").join(on, "target", "left_semi").join(active.select(F.col("id").alias("alias")), "alias", "left_anti").select("alias", "target")


def lineage_safe(edges: DataFrame, roots: DataFrame, most: int = 50_000) -> DataFrame:
    """(id, component) of the components that edges make, in their order, where an edge that would join two ids of one root makes none.

    edges: a, b and, if there, at (its place in the order; without it edges go by their
    ends); roots: id or story_id, root. The rule hangs on the order: an edge is judged
    against all that earlier ones joined. Where no root is held twice in a connected part
    every edge counts, and the part is a component as it stands. The other parts are
    folded one by one in tasks if they have at most ``most`` edges, else in rounds over
    the whole table. Ids that nothing joined are left out, null ends and loops don't count.
    """
    roots = roots.select(F.col(roots.columns[0]).alias("id"), "root").where("root is not null").distinct()
    at = F.col("at") if "at" in edges.columns else F.struct(F.least("a", "b"), F.greatest("a", "b"))
    edges = cut(edges.where("a <> b").select("a", "b", at.alias("at")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("at").alias("at")))
    found = cut(components(edges))
    held = found.join(roots, "id")
    clash = cut(held.groupBy("component", "root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component").distinct())
    whole = found.join(clash, "component", "left_anti").select("id", "component")
    if clash.isEmpty():
        return whole
    torn = edges.join(found.join(clash, "component").withColumnRenamed("id", "a"), "a").select("component", "a", "b", "at")
    large = cut(torn.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component"))
    placed = held.select("component", "id", "root")
    small = torn.join(large, "component", "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy("at", "a", "b"))).select("component", "a", "b", "n")
    kind = dict(edges.dtypes)["a"]
    own = cut(placed.join(large, "component", "left_anti").select(F.col("component").alias("part"), "id", "root"))
    folded = cut(small).groupBy("component").cogroup(own.groupBy("part")).applyInPandas(_fold_lineages, f"id {kind}, component {kind}")
    rest = _lineage_rounds(torn.join(large, "component").select("a", "b", "at"), placed.join(large, "component").select("id", "root"))
    return whole.unionByName(folded) if rest is None else whole.unionByName(folded).unionByName(rest)


def _fold_lineages(edges: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
    """The rule on one connected part, edge by edge."""
    leader: dict = {}
    held = {i: set(r) for i, r in roots.groupby("id")["root"]}

    def find(x):
        while leader.setdefault(x, x) != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for e in edges.sort_values("n").itertuples():
        a, b = sorted((find(e.a), find(e.b)))
        if a != b and not (held.get(a, set()) & held.get(b, set())):
            leader[b] = a
            held[a] = held.get(a, set()) | held.get(b, set())
    ends = {x: find(x) for x in list(leader)}
    joined = [(x, r) for x, r in ends.items() if x != r]
    joined += [(r, r) for r in {r for _, r in joined}]
    return pd.DataFrame(joined, columns=["id", "component"])


def _lineage_rounds(edges: DataFrame, roots: DataFrame) -> DataFrame | None:
    """The rule in rounds, for parts too large for a task; None without edges.

    An edge is settled when it comes first for both its ends, or for an end without roots:
    nothing earlier can change what it joins. So ends without roots are gone after few
    rounds, and the rest meets in pairs.
    """
    now, held, names = cut(edges), cut(roots), None
    while not now.isEmpty():
        ends = now.select(F.col("a").alias("id"), "at", "a", "b").unionAll(now.select(F.col("b").alias("id"), "at", "a", "b"))
        best = ends.groupBy("id").agg(F.min(F.struct("at", "a", "b")).alias("e"))
        bare = best.join(held, "id", "left_anti").select("e")
        mutual = best.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("e")
        chosen = cut(bare.unionAll(mutual).distinct().select("e.a", "e.b"))
        of = lambda end: held.select(F.col("id").alias(end), "root")
        barred = cut(chosen.join(of("a"), "a").join(of("b"), ["b", "root"]).select("a", "b").distinct())
        made = cut(components(chosen.join(barred, ["a", "b"], "left_anti")))
        to = lambda df, c, made=made: df.join(made.select(F.col("id").alias(c), F.col("component").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        named = made.select("id", "component")
        names = cut(named if names is None else to(names, "component").unionByName(named.join(names.select("id"), "id", "left_anti")))
        held = cut(to(held, "id").distinct())
        left = to(to(now.join(barred, ["a", "b"], "left_anti"), "a"), "b").where("a <> b")
        now = cut(left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("at").alias("at")))
    return names
