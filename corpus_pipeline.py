"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, personal data, best-fit packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimforge.llm import line_dup, near_dup, packing, pii, quality
from claimforge.llm.common import new_path, scratch

#: Documents that go to a Python worker at once; both sides hold whole texts of so many.
BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    """Lowers Spark's number of rows of an Arrow batch to BATCH; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; those with null or empty texts fail the base rules."""
    _small_batches(spark)
    return quality.filter_quality(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and with them documents that have no other words."""
    _small_batches(spark)
    return line_dup.drop_repeated_lines(docs, min_words=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays: the one of smallest id, and one of repeated rows."""
    _small_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; other texts stay as they are."""
    _small_batches(spark)
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in training sequences; a document without a token but its end is one piece."""
    _small_batches(spark)
    return packing.pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("personal data", redact),
    ("best-fit packing", pack),
]
#: Expectation-maximisation, message passing and tokens can't be said in SQL; tests compare the stages with brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's result is written and read again as the next one's documents.

    A stage's intermediates are deleted once its result is written. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
