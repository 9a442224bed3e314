"""Concatenate and cut: all documents' ids as one stream, cut into fixed windows.

First pass: documents are encoded once; a task numbers its ids from 0 and writes them. The partitions' totals, summed up
in order, give each partition's place in the stream. Second pass: every document knows its place, so it is cut where
windows begin, wherever it is read. No ids are shuffled; windows over a partition's edge are put together from boundary
records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, sized, stage_table
from .tokens import encoder

ENCODED = "part int, inside long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PARTS = "sequence_id long, offset long, length long, size long, ids binary"


def encode_stream(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encodes documents once into a table: doc_id, n_tokens, ids, and `begin`, their place in the stream of all ids.

    ids are little-endian unsigned numbers of 2 bytes where all of a document's fit, else of 4. The stream's order is that
    of the partitions of docs and of their rows. A null or empty text is the end id alone; equal rows stand one by one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own_encoder, end, at = TaskContext.get().partitionId(), encoder(tokenizer), end_id.to_bytes(4, "little"), 0
        for doc_ids, texts in sized(batches, rows=1024, most=4 << 20):
            ids = [np.frombuffer(own + end, "<u4") for own in own_encoder.encode(texts)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            stored = pa.array([(x.astype("<u2") if x.max() < 1 << 16 else x).tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), doc_ids, pa.array(sizes), stored], names=["part", "inside", "doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = stage_table(rows.mapInArrow(encode, ENCODED), "stream")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))  # one row per partition of docs
    placed = table.join(F.broadcast(bases), "part")
    return placed.select("doc_id", "n_tokens", (F.col("base") + F.col("inside")).alias("begin"), "ids")


def tail_cuts(total: int, capacity: int) -> list[int]:
    """Where the sequences of a stream's last, unfull window begin: its length is a sum of powers of two, the largest first."""
    at = total - total % capacity
    out = []
    while at < total:
        out.append(at)
        at += 1 << (total - at).bit_length() - 1
    return out


class Cutter:
    """Cuts the stream of `total` ids into windows of `capacity`, the last one by tail_cuts(), so that nothing is padded."""

    def __init__(self, total: int, capacity: int):
        self.total, self.capacity, self.full = total, capacity, total // capacity
        self.tail = np.array([*tail_cuts(total, capacity), total], np.int64)

    def cuts(self, begin: int, end: int) -> np.ndarray:
        """begin, the starts of windows between, and end."""
        first = begin - begin % self.capacity + self.capacity
        inner = np.arange(first, min(end, self.full * self.capacity + 1), self.capacity)
        tail = self.tail[(self.tail > max(begin, self.full * self.capacity)) & (self.tail < end)]
        return np.concatenate([[begin], inner, tail, [end]])

    def window(self, place: int) -> tuple[int, int, int]:
        """The sequence in which an id of this place stands, that sequence's first place, and its size."""
        if place < self.full * self.capacity:
            return place // self.capacity, place - place % self.capacity, self.capacity
        k = int(np.searchsorted(self.tail, place, "right")) - 1
        return self.full + k, int(self.tail[k]), int(self.tail[k + 1] - self.tail[k])


def _ids(stored: bytes, n: int) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if len(stored) == 2 * n else "<u4").astype("<u4", copy=False)


def _total(stream: DataFrame) -> int:
    return stream.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]


def pack_windows(stream: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    stream is what encode_stream() gives. All sequences hold `capacity` ids but for those of the last window, whose lengths
    are different powers of two. An empty stream gives an empty result.
    """
    cutter = Cutter(_total(stream), capacity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in columns(batches, 1024):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, n, begin, stored in zip(*(c.to_pylist() for c in own), strict=True):
                ids = memoryview(_ids(stored, n)).cast("B")
                places = cutter.cuts(begin, begin + n).tolist()
                for at, stop in zip(places[:-1], places[1:], strict=True):
                    sequence, first, _ = cutter.window(at)
                    row = (doc_id, at - begin, stop - at, zlib.crc32(ids[4 * (at - begin) : 4 * (stop - begin)]), n, sequence, at - first)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in PIECES.split(", ")])

    return stream.select("doc_id", "n_tokens", "begin", "ids").mapInArrow(cut, PIECES)


def window_ids(stream: DataFrame, capacity: int = 1024) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of ints), those of pack_windows().

    A task sends on the windows that its rows hold whole. Pieces of other windows are its boundary records, at most two for
    each run of rows that follow one another in the stream; only these are shuffled and joined in the order of their offsets.
    """
    cutter = Cutter(_total(stream), capacity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, at = np.zeros(0, "<u4"), 0  # ids from the place `at` on that are not sent yet

        def send(rows: list[tuple], last: bool) -> None:
            nonlocal rest, at
            places = cutter.cuts(at, at + len(rest)).tolist() if len(rest) else []
            for start, stop in zip(places[:-1], places[1:], strict=True):
                sequence, first, size = cutter.window(start)
                if last or first + size == stop:
                    rows.append((sequence, start - first, stop - start, size, rest[start - at : stop - at].tobytes()))
                else:
                    rest, at = rest[start - at :], start
                    return
            rest, at = np.zeros(0, "<u4"), at + len(rest)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*[pa.int64()] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])

        for own in columns(batches, 256):
            rows: list[tuple] = []
            for n, begin, stored in zip(*(c.to_pylist() for c in own), strict=True):
                if begin != at + len(rest):
                    send(rows, last=True)
                    at = begin
                rest = np.concatenate([rest, _ids(stored, n)])
                if len(rest) >= capacity:
                    send(rows, last=False)
            if rows:
                yield batch(rows)
        rows = []
        send(rows, last=True)
        if rows:
            yield batch(rows)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequences, pieces in columns(batches, 1024):
            lists = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in pieces.to_pylist()]
            yield pa.RecordBatch.from_arrays([sequences, pa.array(lists, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    parts = stage_table(stream.select("n_tokens", "begin", "ids").mapInArrow(cut, PARTS), "windows")
    whole = parts.where("length = size").select("sequence_id", F.array("ids").alias("pieces"))
    edges = parts.where("length < size").groupBy("sequence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]).alias("pieces"))
    return whole.union(edges).mapInArrow(unpack, "sequence_id long, ids array<int>")


def concat_and_cut(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences, as encode_stream() and pack_windows() make them.

    A null or empty text is the end id alone, and so is a row of nulls, under a null id. Equal rows are packed one by one.
    An empty table gives an empty result. Other columns are not read.
    """
    return pack_windows(encode_stream(docs, tokenizer, id_col, text_col, end_id), capacity)
