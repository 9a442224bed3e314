"""Balanced contiguous shards by global byte-size prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage_table


def byte_size(text: Column, overhead: int) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Documents stand in ascending order of id (null ids first; equal ids by checksum, then size). The order is range
    partitioned, each partition's bytes are summed, and the prefix sums of these totals plus the running sum inside a
    partition give each document's first byte in the whole corpus. A document goes to the shard in whose equal share of
    all bytes its middle lies: shards are contiguous and differ by less than two documents' bytes. slot counts from 0
    in a shard. size is the text's UTF-8 bytes plus `overhead`; a null text counts as empty. Rows that are alike in all
    three are interchangeable. An empty table gives an empty result. Other columns are not read.

    Only 28 bytes a document are shuffled, never texts. The tables of totals have one row per partition or shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    text = F.col(text_col)
    narrow = stage_table(docs.select(F.col(id_col).alias("doc_id"), byte_size(text, overhead).alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32")), "sizes")
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    dealt = narrow.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # the id's upper bits are the partition, its lower 33 bits the row's place there
    rows = stage_table(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "ordered")
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before, all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(all_parts).alias("all_bytes"),
    )
    running = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("size").over(running)).join(F.broadcast(offsets), "part")
    placed = placed.withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("end")) - F.col("size"))
    placed = placed.select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(n_shards - 1), F.expr(f"twice_middle * {n_shards} div (2 * greatest(all_bytes, 1))")).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("row"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Writes the documents as Parquet under path/shard=N, each shard in the order of assign_shards, and returns the assignment.

    Documents find their shard by id, checksum and size; alike rows are numbered on both sides, so each finds its own. A
    shard is written by as many tasks as its share of the rows needs, whose files follow each other in order. Columns may
    have any names, but one named shard is replaced. An empty table writes no shard.
    """
    text = F.col(text_col)
    alike = Window.partitionBy("doc_id", "text_crc32", "size")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), byte_size(text, overhead).alias("size"), F.struct(*docs.columns).alias("row"))
    keyed = keyed.withColumn("copy", F.row_number().over(alike.orderBy("doc_id")))
    given = assign_shards(docs, n_shards, id_col, text_col, overhead)
    to = given.withColumn("copy", F.row_number().over(alike.orderBy("shard", "slot")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_crc32", "size", "copy")]
    out = keyed.alias("a").join(to.alias("b"), same).select("a.row", "b.shard", "b.slot")
    dealt = out.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "shard"), "shard").write.partitionBy("shard").parquet(path)
    return given
