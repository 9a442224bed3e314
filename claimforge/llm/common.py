"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker turns into Python objects at once; long texts stay few in memory.
SLICE = 256
_FOLDER = "claimforge"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a fresh local folder; on a cluster executors would not see each other's files
    there, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_FOLDER}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a narrow intermediate once into the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates made inside go to a folder of their own in the shared one, which is deleted at the end.

    Write results that read them before the end.
    """
    global _FOLDER
    before, _FOLDER = _FOLDER, f"claimforge/run-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_FOLDER}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _FOLDER = before


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[list[pa.Array]]:
    """Columns of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield [c.slice(at, rows) for c in batch.columns]


def sized(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = 4096, most: int = 16 << 20) -> Iterator[list[pa.Array]]:
    """Columns of at most `rows` rows and about `most` bytes in the column of place `text`; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, min(rows, int(np.searchsorted(ends, before + most, "right")) - at))
            yield [c.slice(at, n) for c in batch.columns]
            at += n


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[list[list]]:
    """Columns of at most `rows` rows as Python lists."""
    for own in columns(batches, rows):
        yield [c.to_pylist() for c in own]
