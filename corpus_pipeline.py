"""The corpus pipeline: quality rules, n-gram Jaccard join, PII, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again for the next. All but the last return the columns of documents. A null
doc_id is kept by its row only; rows that repeat a doc_id with other texts are judged each by its own text. Texts
of any length go through whole; an empty table gives no rows; other columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import byte_bpe, jaccard_join, mixing, pii, quality_rules
from chronofold.llm.frames import keep
from chronofold.llm.queries import pii_key, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio verdict; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.filter_kept(docs, labels).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    return jaccard_join.keep_first(docs, k=5, percent=80).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by pseudonyms of the same format; n_chars follows the text."""
    return pii.scrub(docs.select(*COLUMNS), pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row."""
    return byte_bpe.encode_digests(docs, *vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixture", mixture), ("tokens", tokens)]

#: Hashed models and digests of token ids have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
