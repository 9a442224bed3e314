"""Readers and writers of fact bases, logs, query results, metrics and spans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KB_SCHEMA = "map<string, struct<facts:array<string>, fact:string, source:string, category:string>>"
SPARQL_SCHEMA = "struct<head:struct<vars:array<string>>, results:struct<bindings:array<map<string, struct<type:string, value:string>>>>>"


def read_kb_json(spark: SparkSession, path: str) -> DataFrame:
    """key, pos, fact, source of JSON knowledge bases; keys that start with _ are metadata, `fact` and `facts` both count."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", KB_SCHEMA)).alias("key", "e"))
    facts = F.coalesce("e.facts", F.when(F.col("e.fact").isNotNull(), F.array("e.fact")))
    return entries.where(~F.startswith("key", F.lit("_"))).select("key", F.posexplode(facts).alias("pos", "fact"), "e.source")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_sparql_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per binding of SPARQL result files: a map from variable to value."""
    own = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SPARQL_SCHEMA)["results"]["bindings"]).alias("b"))
    return own.select(F.transform_values("b", lambda k, v: v["value"]).alias("binding"))


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    """batch and folder of the store's finished batches; the log of a batch counts once it has its success mark."""
    if not _exists(spark, f"{path}/log"):
        return None
    return spark.read.schema("batch string, folder string").option("recursiveFileLookup", "true").parquet(f"{path}/log")


def read_fact_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The facts of a store that write_facts() makes: those of finished batches only. A store not begun yet is empty."""
    log = _committed(spark, path)
    folders = [f"{path}/{r['folder']}" for r in log.collect()] if log is not None else []  # one row a batch
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)


def write_facts(facts: DataFrame, path: str, batch: str, shards: int = 16, key: str = "hash", stop_before_commit: bool = False) -> bool:
    """Adds a batch's facts to the store, each key once, those that the store lacks only; whether the batch was added now.

    Idempotent: a batch of a name that is finished changes nothing. Rows are written into a folder of their own, by shard
    (the key modulo `shards`), spread over tasks by a hash as well; then one log row commits the folder. What a run that
    ended before its commit has left is never read, so the batch can be run again. One writer at a time. Rows with a null
    key are left out. stop_before_commit is for tests of that.
    """
    spark = facts.sparkSession
    log = _committed(spark, path)
    if log is not None and not log.where(F.col("batch") == batch).isEmpty():
        return False
    schema = ", ".join(f"`{n}` {t}" for n, t in facts.dtypes)
    own = facts.where(F.col(key).isNotNull()).dropDuplicates([key])
    own = own.join(read_fact_table(spark, path, schema).select(key), key, "left_anti").select(*facts.columns)
    folder = f"data/{uuid.uuid4().hex}"
    own = own.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))
    own.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("shard").parquet(f"{path}/{folder}")
    if not stop_before_commit:
        spark.createDataFrame([(batch, folder)], "batch string, folder string").coalesce(1).write.mode("append").parquet(f"{path}/log")
    return not stop_before_commit


def append_log(rows: DataFrame, path: str, texts: tuple[str, ...] = (), most: int = 200) -> None:
    """Rows as JSON lines, long texts cut as a log does."""
    rows.withColumns({t: F.substring(t, 1, most) for t in texts}).write.mode("append").json(path)


def spans_to_otlp(spans: DataFrame) -> DataFrame:
    """One JSON document per trace, spans in order of their start."""
    own = F.struct("start", "span_id", "parent_id", "name", "service", "duration_ms", "status")
    return spans.groupBy("trace_id").agg(F.array_sort(F.collect_list(own)).alias("spans")).select("trace_id", F.to_json(F.struct("trace_id", "spans")).alias("json"))


def spans_to_zipkin(spans: DataFrame) -> DataFrame:
    own = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"), F.col("parent_id").alias("parentId"), "name", F.round(F.col("start") * 1_000_000).cast("long").alias("timestamp"), F.round(F.col("duration_ms") * 1000).cast("long").alias("duration"))
    return spans.select(F.to_json(own).alias("json"))


def export_prometheus(df: DataFrame, name: str, value: str, labels: tuple[str, ...]) -> DataFrame:
    """Lines of the text exposition format."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels))
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))
