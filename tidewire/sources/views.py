"""Views of the driver's tables in the shape of articles, stories and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import fixed, pages, text, urls

#: The one reference time of all age computations; the clock is never read.
REFERENCE = "2026-01-08 00:00:00"

#: Headlines dealt to documents by id, so that rules meet English words in the tables.
HEADLINES = [
    "Congress approves $2.5 billion tariff bill after Senate vote in Ohio and Texas",
    "Wildfire forces evacuation order in California, 3 people killed",
    "Supreme Court rules on gun lawsuit from Florida challenging state law",
    "Federal Reserve holds interest rate at 4.50% as inflation slows",
    "Death toll rises to 57 after earthquake in Japan",
    "Small bakery wins local prize for bread",
    "Police arrested two people after shooting near Main St. in Denver, Colorado",
    "Ukraine and Russia discuss ceasefire as missile strikes continue",
    "Tech merger worth $900 million draws antitrust review",
    "Software award goes to student team",
    "Hurricane warning lifted, road reopened in Louisiana - Coast Daily News",
    "Voters reject Proposition 12 by 51.20% in Nevada primary",
    "NBA Finals return to New York with $75 tickets",
    "Ten people were injured in traffic crash on Highway 9, 34-year-old driver charged",
    "Data breach exposes 40,000 records, company says",
    "Flood advisory issued for three counties in Iowa",
    "Mayor resigns over budget ordinance dispute | City Ledger",
    "EPA proposes new rules for power plants across the United States",
    "Oil prices climb 3% on sanctions against Iran",
    "Oscars move to new venue",
]


#: And as many words of the text itself, so that headlines differ as much as texts do.
OWN_WORDS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: a headline, an opening line of the text, category, urgency and time."""
    docs = table(spark, sf_dir, "documents")
    bank = text.strings(HEADLINES)
    n = len(HEADLINES)
    cats = text.strings(fixed.CATEGORIES)
    own = text.first_words(F.col("text"), OWN_WORDS)
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.get(bank, (F.col("doc_id") % n).cast("int")), F.lit(" "), own).alias("headline"),
        F.get(bank, ((F.col("doc_id") * 7 + 3) % n).cast("int")).alias("source_title"),
        F.col("text").alias("body"),
        "source",
        F.get(cats, (F.col("doc_id") % 7).cast("int")).alias("category_key"),
        (F.col("doc_id") * 5 % 11).cast("int").alias("urgency"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01 00:00:00")) + F.col("doc_id") * 600 % 864000).alias("published_at"),
    )


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same view in SQL, as a common table expression.
ARTICLES_SQL = f"""articles AS (
  SELECT doc_id AS article_id,
    list_extract({_quoted(HEADLINES)}, CAST(doc_id % {len(HEADLINES)} AS INTEGER) + 1) || ' ' ||
      array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, {OWN_WORDS}), ' ') AS headline,
    list_extract({_quoted(HEADLINES)}, CAST((doc_id * 7 + 3) % {len(HEADLINES)} AS INTEGER) + 1) AS source_title,
    text AS body, source,
    list_extract({_quoted(fixed.CATEGORIES)}, CAST(doc_id % 7 AS INTEGER) + 1) AS category_key,
    CAST(doc_id * 5 % 11 AS INTEGER) AS urgency,
    TIMESTAMP '2026-01-01 00:00:00' + to_seconds(doc_id * 600 % 864000) AS published_at
  FROM documents)"""


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with domain, identity URL, title, body and word count."""
    p = table(spark, sf_dir, "pages")
    body = pages.body(F.col("html"))
    return p.select("page_id", "url", urls.domain(F.col("url")).alias("domain"), urls.identity_url(F.col("url")).alias("identity_url"), pages.title(F.col("html")).alias("title"), body.alias("body")).withColumn("n_words", pages.space_words(F.col("body")))
