"""Feed documents landed as XML files: entries as rows, bad documents as none.

Fetching is left to whatever lands the files; reading them is a distributed scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import pages, text, times, urls

MEDIA = T.StructType([T.StructField("_url", T.StringType()), T.StructField("_width", T.StringType()), T.StructField("_height", T.StringType())])
ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "link", "description", "content:encoded", "pubDate", "guid", "source")]
    + [T.StructField("enclosure", T.ArrayType(MEDIA)), T.StructField("media:content", T.ArrayType(MEDIA)), T.StructField("media:thumbnail", T.ArrayType(MEDIA))]
)
#: The most bytes of a feed document that are read.
FEED_BYTES = 4_000_000


def read_feeds(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of all feed documents under a path, with the file and their place in it.

    Of a document over FEED_BYTES its first FEED_BYTES are read, and what is whole in
    them; an entry cut off there or never closed, and one that can't be parsed, is left
    out, while the others stay. Missing elements are null. ``pos`` counts the entries of
    a document from 0. Text is UTF-8.
    """
    files = spark.read.format("binaryFile").load(path)
    text_ = F.substring(F.col("content"), 1, FEED_BYTES).cast("string")
    whole = F.regexp_extract_all(text_, F.lit(rf"(?s)<{row_tag}(?:\s[^>]*)?>.*?</{row_tag}\s*>"), F.lit(0))
    found = files.select(F.col("path").alias("feed"), F.posexplode(whole).alias("pos", "xml"))
    entry = F.from_xml("xml", T.StructType([*ENTRY.fields, T.StructField("_broken", T.StringType())]), {"columnNameOfCorruptRecord": "_broken"})
    read = found.select(entry.alias("e"), "feed", F.col("pos").cast("long").alias("pos"))
    return read.where(F.col("e").isNotNull() & F.col("e._broken").isNull()).select(*[F.col(f"e.`{f.name}`").alias(f.name) for f in ENTRY.fields], "feed", "pos")


def body(content: Column, summary: Column) -> Column:
    """The longer of an entry's content and summary, as plain text."""
    a, b = (pages.visible(text.text(c)) for c in (content, summary))
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def entries(raw: DataFrame) -> DataFrame:
    """Source rows: id, title, link, body, published, domain, type, image.

    An entry without a title, a link or a body is left out; see :func:`rejects`.
    """
    text_ = body(F.col("`content:encoded`"), F.col("description"))
    title = pages.visible(F.col("title"))
    images = F.transform(F.concat(*[F.coalesce(F.col(f"`{c}`"), F.array().cast(T.ArrayType(MEDIA))) for c in ("media:content", "media:thumbnail", "enclosure")]), lambda m: m["_url"])
    out = raw.select(
        "feed", "pos", title.alias("title"), F.trim(text.text(F.col("link"))).alias("link"), text_.alias("body"), times.parsed(F.col("pubDate")).alias("published"), F.get(images, F.lit(0)).alias("image_url"),
    )
    key = F.lower(F.concat_ws("|", "feed", "title", "link"))
    dom = urls.domain(F.col("link"))
    return out.withColumns({"article_id": F.concat(F.lit("rss-"), text.digest(key, 20)), "domain": dom, "source_type": urls.source_type(dom)})


def complete(df: DataFrame) -> DataFrame:
    return df.where("title <> '' and link <> '' and body <> ''")


def rejects(df: DataFrame) -> DataFrame:
    """What :func:`complete` leaves out, and why."""
    why = F.when(F.col("title") == "", "title").when(F.col("link") == "", "link").otherwise("body")
    return df.where("title = '' or link = '' or body = ''").withColumn("missing", why)
