"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host, with all its subdomains, and the start of a path; the longest that
fits decides. URLs that a rule decides are the labelled ones: the trees are trained on a
bounded sample of them, drawn by a hash of the URL, and judge the URLs that no rule fits.
Features are lengths, depths, digit ratios, entropies, parameter counts and statistics of
suffixes (of the host, alone and with the path's first segment, and of the path's last
segment). All of it is Spark SQL and Spark's
own trees.
"""

from __future__ import annotations

import warnings

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.checkpoints import cut

#: (verdict, host, start of path)
Rule = tuple[str, str, str]

#: labelled URLs that the trees and the suffix statistics see at most, about half of each verdict
SAMPLE = 20_000
FOLDS = 5
SMOOTHING = 20.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEXICAL = (
    "url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "host_digits",
    "path_digits", "host_entropy", "path_entropy", "n_params", "n_hyphens", "has_fragment",
)
SUFFIXES = ("last_label", "last_two", "last_three", "extension", "segment", "place")


def parse_rule(text: str) -> Rule:
    """``block example.com/en/`` as a rule; the path is all from the first slash."""
    verdict, _, place = text.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {text}")
    return verdict, host, slash + path


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Of equally long ones the one with the longer host is taken."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(set(rules), key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")

    def term(total, char):
        p = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda t, c: F.when(c == "", t).otherwise(term(t, c)))).otherwise(0.0)


def _share_of_digits(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, "[^0-9]", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """df with the columns of LEXICAL, as doubles without nulls, and the suffixes of SUFFIXES, null where there is none."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    segments = F.filter(F.split(p, "/"), lambda x: x != "")
    last = F.get(segments, F.size(segments) - 1)
    values = {
        "url_length": F.length(u),
        "host_length": F.length(h),
        "path_length": F.length(p),
        "query_length": F.length(query),
        "host_depth": F.size(labels),
        "path_depth": F.size(segments),
        "host_digits": _share_of_digits(h),
        "path_digits": _share_of_digits(p),
        "host_entropy": _entropy(h),
        "path_entropy": _entropy(p),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "n_hyphens": F.length(u) - F.length(F.replace(u, F.lit("-"), F.lit(""))),
        "has_fragment": F.contains(u, F.lit("#")),
    }
    suffix = lambda k: F.when(F.size(labels) >= k, F.concat_ws(".", F.slice(labels, -k, k)))
    ends = {"last_label": suffix(1), "last_two": suffix(2), "last_three": suffix(3), "extension": F.nullif(F.regexp_extract(last, r"\.([A-Za-z0-9]{1,8})$", 1), F.lit("")), "segment": F.get(segments, F.lit(0))}
    ends["place"] = F.concat_ws("/", ends["last_label"], ends["segment"])
    return df.select("*", *(v.cast("double").alias(k) for k, v in values.items()), *(ends[k].alias(k) for k in SUFFIXES))


class Filter:
    """Fitted trees with the suffix statistics they were fitted on; ``trees`` is None where nothing could be learned."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior


def _rates(df: DataFrame, stats: DataFrame, prior: float, fold: Column | None) -> DataFrame:
    """df with a smoothed rate of blocked URLs for each suffix; those of row's own fold are left out.

    ``stats`` has at most six rows for a labelled URL of the bounded sample, so it can be broadcast.
    """
    for kind in SUFFIXES:
        own = stats.where(F.col("kind") == kind).select(F.col("suffix").alias("__suffix"), F.col("n").alias("__n"), F.col("blocked").alias("__blocked"))
        df = df.join(F.broadcast(own), df[kind] == F.col("__suffix"), "left")
        n, blocked = F.col("__n"), F.col("__blocked")
        total, bad = F.aggregate(n, F.lit(0.0), lambda t, x: t + x), F.aggregate(blocked, F.lit(0.0), lambda t, x: t + x)
        if fold is not None:
            total, bad = total - F.get(n, fold), bad - F.get(blocked, fold)
        rate = (F.coalesce(bad, F.lit(0.0)) + SMOOTHING * prior) / (F.coalesce(total, F.lit(0.0)) + SMOOTHING)
        df = df.withColumn(f"{kind}_rate", rate).drop("__suffix", "__n", "__blocked")
    return df


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*LEXICAL, *(f"{k}_rate" for k in SUFFIXES)], outputCol="__features").transform(df)


def fit(labelled: DataFrame, *, sample: int = SAMPLE, trees: int = 20, depth: int = 4, seed: int = 7) -> Filter:
    """Trees from labelled URLs: columns url and verdict (``allow`` or ``block``), others are ignored.

    Of more than ``sample`` different labelled URLs about so many are drawn by a hash of
    the URL, of both verdicts at rates that make them even where the table has enough.
    A repeated URL counts once for a verdict. Null verdicts and URLs aren't learned from.
    Without URLs of both verdicts, as in an empty table, nothing is learned, and a
    warning says so.
    """
    told = labelled.where("url IS NOT NULL AND verdict IN ('allow', 'block')").select("url", "verdict")
    have = {r["verdict"]: r["n"] for r in told.groupBy("verdict").agg(F.approx_count_distinct("url", 0.02).alias("n")).collect()}
    if len(have) < 2:
        warnings.warn("no labelled URLs of both verdicts: the trees say allow", stacklevel=2)
        return Filter(None, None, 0.0)
    few = min(have.values())
    shares = {v: min(1.0, (sample // 2 if n == few else sample - min(few, sample // 2)) / n) for v, n in have.items()}
    unit = F.pmod(F.xxhash64(F.lit("sample"), "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("verdict") == "block", shares["block"]).otherwise(shares["allow"])
    drawn = told.where(unit < rate).distinct().withColumn("label", (F.col("verdict") == "block").cast("double"))
    drawn = drawn.select("url", "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int").alias("fold"))
    drawn = cut(lexical(drawn, "url", "host", "path").coalesce(8))
    counted = drawn.select("label", "fold", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in SUFFIXES))).alias("s")).where("s.suffix IS NOT NULL")
    per_fold = lambda c: F.array(*(F.sum(F.when(F.col("fold") == i, c).otherwise(0.0)) for i in range(FOLDS)))
    stats = cut(counted.groupBy("s.kind", "s.suffix").agg(per_fold(F.lit(1.0)).alias("n"), per_fold(F.col("label")).alias("blocked")).coalesce(8))
    prior = drawn.agg(F.avg("label")).first()[0]
    if prior in (None, 0.0, 1.0):
        warnings.warn("no labelled URLs of both verdicts: the trees say allow", stacklevel=2)
        return Filter(None, None, 0.0)
    # the statistics of a row leave out its own fold, else the trees would read its label from them
    known = _vectors(_rates(drawn, stats, prior, F.col("fold"))).select("__features", "label")
    grower = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=seed, cacheNodeIds=False)
    return Filter(grower.fit(known), stats, prior)


def score(df: DataFrame, model: Filter, *, url: str = "url", host: str = "host", path: str = "path", score_col: str = "score") -> DataFrame:
    """df with the trees' probability that a URL is to be blocked, or 0 where nothing was learned."""
    if model.trees is None:
        return df.withColumn(score_col, F.lit(0.0))
    kept = df.columns
    ready = _vectors(_rates(lexical(df, url, host, path), model.suffixes, model.prior, None))
    out = model.trees.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__class").transform(ready)
    return out.select(*kept, vector_to_array("__probability")[1].alias(score_col))


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    sample: int = SAMPLE,
    block_at: float = 0.5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block) and score.

    The longest rule that fits gives the verdict; ``rule`` is its host and path. Where none
    fits rule is null and the trees, trained on the pages that rules decide, block at a
    score of ``block_at`` or more; score is theirs for every page. ``rules`` is a short list that goes
    into the plan. A null URL or one without ``://`` has an empty host and path and is
    judged by the trees like others; repeated rows get the same verdict; long URLs are
    read whole; null ids stay; other columns aren't carried; an empty table gives no
    rows. Without labelled pages of both verdicts, pages that no rule fits are allowed.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).cast("long").alias("page"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).select("page", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("told"))
    model = fit(seen.where("told IS NOT NULL").select("url", F.col("told").alias("verdict")), sample=sample)
    judged = score(seen, model)
    by_trees = F.when(F.col("score") >= block_at, "block").otherwise("allow")
    return judged.select(F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("told", by_trees).alias("verdict"), "score")
