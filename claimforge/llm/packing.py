"""Best-fit packing of token sequences, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, sized, stage_table
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, low long, high long, first_sequence long, offset long"


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, low, high, first_sequence, offset).

    Pieces of a length with ranks low..high-1 stand at `offset` in the sequences first_sequence, first_sequence + 1 and
    so on. Sequences with equal room are kept as ranges, so work and plan depend on the lengths, not on the pieces.
    """
    room: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # free tokens: ranges of sequences
    runs, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            best = min((r for r, x in room.items() if r >= length and x), default=None)
            if best is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        for j in range(k):
                            runs.append((length, rank, rank + n, made, j * length))
                            rank += n
                        if free := capacity - k * length:
                            room[free].append((made, made + n))
                        made += n
                break
            first, end = room[best].popleft()
            n = min(left, end - first)
            runs.append((length, rank, rank + n, first, capacity - best))
            if n < end - first:
                room[best].appendleft((first + n, end))
            if best > length:
                room[best - length].append((first, first + n))
            rank, left = rank + n, left - n
    return runs


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece of a document's ids: doc_id, piece, start, length, ids_crc32.

    A document that fits is one piece. A longer one is cut into pieces of `capacity`, of which the first may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for doc_ids, texts in sized(batches, rows=1024, most=4 << 20):
            rows = []
            for d, own in zip(doc_ids.to_pylist(), own_encoder.encode(texts), strict=True):
                ids = memoryview(own + end)
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    rows.append((d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces' lengths are counted (at most `capacity` counts, whatever the corpus), best-fit decreasing is planned on
    the counts, and a piece takes the planned slot of its rank among pieces of its length. Ranks come from counts per
    (length, hash bucket) and a row number inside such a small group, so a length that many pieces share is not sorted
    by one task. A null or empty text is the end id alone. Equal rows are packed one by one. An empty table gives an
    empty result. Other columns are not read.
    """
    spark, buckets = docs.sparkSession, partitions(docs.sparkSession)
    pieces = cut_pieces(docs, tokenizer, capacity, id_col, text_col, end_id)
    pieces = stage_table(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))), "pieces")
    counts = pieces.groupBy("length", "bucket").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_best_fit(histogram, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    # the plan's size is bounded by the lengths: a few runs for each of at most `capacity` lengths
    slots = F.broadcast(plan.withColumnRenamed("length", "_length"))
    out = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
