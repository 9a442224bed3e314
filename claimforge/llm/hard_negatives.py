"""Hard negatives by exact integer inner products, several candidates in one number (Kronecker substitution).

Candidates' components are made non-negative by a bias and stand in separated fields of one number. A product with an
anchor's component multiplies all fields at once, so one matrix product gives the scores of several candidates a number,
and shifts and masks unpack them. Numbers are doubles, whose products and sums are exact below 2**53; where even one
field needs more bits, they are Python's integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, new_path, stage_table

EXACT = 53
LOW, HIGH = -(2**63 - 1), 2**63 - 1  # of scores and ids: no entry
CHUNK = 1 << 16  # anchors that a pass over all rows compares; what is broadcast is bounded by it
TILE, BLOCK = 256, 4096  # anchors and candidates of one matrix product
PARTIAL = "anchor long, place int, other_id long, score long"


def field_bits(anchors: np.ndarray, candidates: np.ndarray) -> tuple[int, int]:
    """The bias and the bits of a field in which every sum of products, with its sign, has room."""
    bias = max(0, -int(candidates.min(initial=0)))
    largest = int(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[1])
    return bias, (largest * (int(candidates.max(initial=0)) + bias)).bit_length() + 1


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all candidates, both of integral doubles: int64, the nearest one where a score needs more."""
    bias, bits = field_bits(anchors, candidates)
    fields = max(1, EXACT // bits) if bits <= EXACT else 4
    if bits > EXACT:
        anchors, candidates = (np.array([list(map(int, row)) for row in x], object).reshape(x.shape) for x in (anchors, candidates))
    n = -(-len(candidates) // fields)
    words = np.zeros((n, candidates.shape[1]), candidates.dtype)
    for f in range(fields):
        own = candidates[f * n : (f + 1) * n]
        words[: len(own)] += (own + bias) * (1 << bits * f)
    half = 1 << (bits - 1)
    products = anchors @ words.T
    products = (products.astype(np.int64) if bits <= EXACT else products) + sum(half << bits * f for f in range(fields))
    sums = (anchors.sum(1).astype(np.int64) if bits <= EXACT else anchors.sum(1)) * bias + half
    mask = (1 << bits) - 1
    out = np.concatenate([((products >> bits * f) & mask) - sums[:, None] for f in range(fields)], axis=1)[:, : len(candidates)]
    return out if bits <= EXACT else np.clip(out, LOW + 1, HIGH - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each slot: higher scores first, then smaller ids; an entry that comes again counts once."""

    def __init__(self, slots: int, k: int):
        self.k, self.scores, self.ids = k, np.full((slots, k), LOW), np.full((slots, k), HIGH)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        last, last_id = self.scores[slots, -1], self.ids[slots, -1]
        better = (scores > last) | ((scores == last) & (ids < last_id))
        if not better.any():
            return
        touched = np.unique(slots[better])
        slots = np.concatenate([slots[better], np.repeat(touched, self.k)])
        scores = np.concatenate([scores[better], self.scores[touched].ravel()])
        ids = np.concatenate([ids[better], self.ids[touched].ravel()])
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        new = np.ones(len(slots), bool)
        new[1:] = (slots[1:] != slots[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        slots, scores, ids = slots[new], scores[new], ids[new]
        nth = np.arange(len(slots)) - np.searchsorted(slots, slots)
        slots, scores, ids, nth = (x[nth < self.k] for x in (slots, scores, ids, nth))
        self.scores[touched], self.ids[touched] = LOW, HIGH
        self.scores[slots, nth], self.ids[slots, nth] = scores, ids

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, ids and scores of all entries."""
        slots, nth = np.nonzero(self.scores > LOW)
        return slots, self.ids[slots, nth], self.scores[slots, nth]


def _matrix(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles; a vector that is shorter than others is followed by zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), max(dims, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * out)


def _alike(anchors: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dims = max(anchors.shape[1], candidates.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (anchors, candidates))


def _least(low: int, high: int, score: int) -> int:
    """The smallest n with low * score <= high * n."""
    return -(-low * score // high)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor with every positive.

    Scores are exact inner products of the components floor(scale * x). An anchor's positives are its best `positives`
    other rows of its label; a positive's negatives the best `negatives` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score. Ties go to the smaller id. is_anchor is a
    condition on the rows.

    Anchors are taken CHUNK at a time: all rows are read for the positives and again for the negatives, in blocks against
    the broadcast chunk; a task keeps only the best of each anchor, and these are merged by key. So no pair list ever
    exists, a hot label or vector costs no more than others, and what passes the driver is one chunk.

    Rows with a null id, label or vector, or with a null component or one that isn't finite (times the scale) take no
    part. Other rows are those with another id; a row that comes again with the same id, label and score counts once, and
    equal anchors are one. Vectors of unequal lengths count as followed by zeros, and scores beyond 64 bits as the nearest
    64-bit number. An anchor without positives, and a positive without negatives in the window (so each with a score
    below 0), has no rows. An empty table, or one without anchors, gives an empty result. Other columns are not read,
    unless is_anchor does.
    """
    spark = vectors.sparkSession
    most = float(np.finfo(np.float64).max) / max(1.0, abs(scale))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("is_anchor")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) <= most, F.lit(False))))
    anchors = stage_table(rows.where("is_anchor").select("id", "label", "vector").distinct(), "anchors")
    candidates, path = rows.select("id", "label", "vector"), new_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/none")
    held: list = []

    def passed(make: Callable[[], tuple[int, Callable]], k: int) -> DataFrame:
        """The k best of each slot that visit(best, tile, scores, ids, labels) offers, over all rows."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, slots, per, visit = make()
            best = Best(slots, k)
            for ids, labels, vectors_ in columns(batches, BLOCK):
                ids, labels = (x.to_numpy(zero_copy_only=False) for x in (ids, labels))
                own, other = _alike(matrix, _matrix(vectors_, matrix.shape[1], scale))
                for at in range(0, len(own), TILE):
                    visit(best, slice(at, at + TILE), packed_scores(own[at : at + TILE], other), ids, labels)
            found, other_ids, scores = best.rows()
            for at in range(0, len(found), 1 << 16):
                own = found[at : at + (1 << 16)]
                arrays = [pa.array(own // per), pa.array((own % per).astype(np.int32)), pa.array(other_ids[at : at + (1 << 16)]), pa.array(scores[at : at + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "place", "other_id", "score"])

        order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "other_id")
        merged = candidates.mapInArrow(scan, PARTIAL).withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
        return merged.dropDuplicates(["anchor", "place", "rank"])

    def mine(number: int) -> None:
        ids, labels, matrix = np.array([r["id"] for r in held]), np.array([r["label"] for r in held]), _matrix(pa.array([r["vector"] for r in held], pa.list_(pa.float64())), 0, scale)
        shared = spark.sparkContext.broadcast((ids, labels, matrix))

        def for_positives():
            ids, labels, matrix = shared.value

            def visit(best, tile, scores, other_ids, other_labels):
                own, other = np.nonzero((scores >= best.scores[tile, -1][:, None]) & (labels[tile][:, None] == other_labels) & (ids[tile][:, None] != other_ids))
                best.offer(own + tile.start, scores[own, other], other_ids[other])

            return matrix, len(ids), 1, visit

        found = passed(for_positives, positives).select("anchor", "rank", "other_id", "score").collect()  # at most `positives` for each of the chunk's anchors
        top, top_ids = np.full((len(held), positives), -1), np.zeros((len(held), positives), np.int64)
        for r in found:  # a positive whose score is below 0 has an empty window
            top[r["anchor"], r["rank"] - 1], top_ids[r["anchor"], r["rank"] - 1] = max(r["score"], -1), r["other_id"]
        least = np.array([[_least(low, high, int(s)) if s >= 0 else HIGH for s in row] for row in top], np.int64).reshape(top.shape)
        windows = spark.sparkContext.broadcast((top, top_ids, least))

        def for_negatives():
            ids, labels, matrix = shared.value
            top, _, least = windows.value

            def visit(best, tile, scores, other_ids, other_labels):
                last = best.scores.reshape(len(ids), positives, negatives)[tile, :, -1]
                floor = np.where(top[tile] >= 0, np.maximum(last, least[tile]), HIGH).min(1)
                own, other = np.nonzero((scores >= floor[:, None]) & (scores <= top[tile].max(1)[:, None]) & (labels[tile][:, None] != other_labels) & (ids[tile][:, None] != other_ids))
                own, found, found_ids = own + tile.start, scores[own, other], other_ids[other]
                for j in range(positives):
                    fits = (found <= top[own, j]) & (found >= least[own, j])
                    best.offer(own[fits] * positives + j, found[fits], found_ids[fits])

            return matrix, len(ids) * positives, positives, visit

        names = spark.createDataFrame(
            [(a, j, int(ids[a]), int(top_ids[a, j]), int(top[a, j])) for a, j in zip(*np.nonzero(top >= 0), strict=True) for a, j in [(int(a), int(j))]],
            "anchor long, place int, anchor_id long, positive_id long, positive_score long",
        )
        out = passed(for_negatives, negatives).join(F.broadcast(names), ["anchor", "place"])  # as many rows at most as the chunk has positives
        out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/chunk-{number}")
        shared.unpersist()
        windows.unpersist()
        held.clear()

    number = 0
    for row in anchors.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == CHUNK:
            mine(number)
            number += 1
    if held:
        mine(number)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
