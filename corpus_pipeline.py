"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before it kept. All but the last return the
columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import langid, minhash, pii, quality
from tidewire.llm.common import table
from tidewire.llm.packing import pack_documents
from tidewire.operators.checkpoints import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good.

    Null and empty texts and missing metadata are scored like others, long texts over
    their whole; repeated rows share a fate. Where no class or only one has labels, as in
    an empty table, nothing is told and all stay. Columns beyond those of documents go.
    """
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: with letters, not torn between languages, and in one of those learned.

    Null and empty texts and those without a letter go; long texts count whole; a null
    language only isn't learned from; every other row is; repeated rows share a fate. Where no document has a
    language nothing can be told, and none stays.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select(*COLUMNS)
    fitted, usual = langid.fit_all(docs, model)
    return langid.keep_known(docs, fitted, usual, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates.

    Of repeated rows one stays, and other texts of its id stay or go on their own. Null
    ids, null texts and texts without words are no duplicates. Texts are compared whole.
    """
    docs = docs.select(*COLUMNS).withColumn("__hash", F.xxhash64("text"))
    found = minhash.near_documents(docs, with_hash=True)
    fate = found.groupBy("doc_id", F.col("text_hash").alias("__hash")).agg(F.count_if("kept").alias("__stay"), F.count(F.lit(1)).alias("__rows"))
    told = docs.join(fate.where("__stay < __rows").select("doc_id", "__hash", "__stay"), ["doc_id", "__hash"], "left")
    whole = told.where(F.col("__stay").isNull()).select(*COLUMNS)
    return whole.unionAll(told.where("__stay > 0").dropDuplicates(["doc_id", "__hash"]).select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text.

    Null and empty texts stay as they are, with their n_chars; long ones are searched
    whole; repeated rows get the same surrogates; an empty table stays empty.
    """
    docs = pii.replace_entities(docs.select(*COLUMNS), "tidewire")
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; long texts fill several sequences; null
    ids and repeated rows are packed as often as they occur; an empty table gives none.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Classifiers, signatures and tokenizers can't be expressed in SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
