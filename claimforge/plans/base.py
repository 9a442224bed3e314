"""What the modules of registered queries share: the registry, tables, sentences and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators import claims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with a column row, by which its rows stand as in its files."""
    return table(spark, sf_dir, name).select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("row"))


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows dealt out evenly where it has fewer partitions than there are cores, as a file that can't be split has.

    Larger tables have more partitions than cores and stay as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.split_sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.split_sentences(table(spark, sf_dir, "benchmark"), key="item_id").select("item_id", F.col("sentence").alias("fact"))


SENTENCES = r"""
pieces AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?;\n]+')) p, generate_subscripts(string_split_regex(text, '[.!?;\n]+'), 1) - 1 AS sent_no FROM documents),
sents AS (SELECT doc_id, CAST(sent_no AS INTEGER) sent_no, trim(p) sentence FROM pieces WHERE length(trim(p)) >= 4 AND regexp_matches(p, '[\p{L}\p{N}]')),
bpieces AS (SELECT item_id, unnest(string_split_regex(text, '[.!?;\n]+')) p FROM benchmark),
seeds AS (SELECT item_id, trim(p) fact FROM bpieces WHERE length(trim(p)) >= 4 AND regexp_matches(p, '[\p{L}\p{N}]'))
"""
HASH = "CAST(('0x' || substr(sha256({0}), 1, 16))::UBIGINT & 9223372036854775807 AS BIGINT)"
