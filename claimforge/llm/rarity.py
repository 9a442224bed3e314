"""How often words occur, and which ids are needed: tables of a fixed size that every task can hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, sized
from .words import batch_words, mix

#: Slots of the table of word numbers, 2 ** SLOT_BITS of one byte each, whatever the corpus.
SLOT_BITS = 20
#: Bits of the table of needed ids, 2 ** NEED_BITS, whatever the corpus.
NEED_BITS = 26
_PAGE = 1 << 12


def _merged(pages: DataFrame, kind: str, merge: np.ufunc) -> dict[int, bytes]:
    """Pages of one number, from any task, merged into one. A task merges its pages as they come; the driver gets the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, kind)
                held[number] = merge(held[number], own) if number in held else own
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["page", "data"])

    rows = pages.repartition(partitions(pages.sparkSession), "page").mapInArrow(run, "page int, data binary")
    found = {r["page"]: r["data"] for r in rows.collect()}  # the fixed table
    return found


def _pages(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = table.reshape(-1, _PAGE)
    at = np.flatnonzero(parts.any(1))
    for k in range(0, len(at), 64):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 64].astype(np.int32)), pa.array([parts[i].tobytes() for i in at[k : k + 64]], pa.binary())], names=["page", "data"])


def rarity_levels(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A byte for each slot of words: the more its words occur in all documents, the more.

    Joins by rare words give the same results with any levels; only their work depends on them. Every word of every
    document is counted, and the table has 2 ** SLOT_BITS bytes on any corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for (texts,) in sized(batches, 0, most=2 << 20):
            total += np.bincount(slots(batch_words(texts).hashes), minlength=1 << SLOT_BITS)
        yield from _pages(total)

    found = _merged(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "page int, data binary"), "<i8", np.add)
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    for page, data in found.items():
        levels[page * _PAGE : (page + 1) * _PAGE] = np.minimum(255, 4 * np.log2(1 + np.frombuffer(data, "<i8")))
    return levels


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _bits(ids: pa.Array) -> np.ndarray:
    known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    h = mix(known * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return np.concatenate([h >> np.uint64(64 - NEED_BITS), (h >> np.uint64(4)) & np.uint64((1 << NEED_BITS) - 1)]).astype(np.int64)


def needed(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of long ids that is true for all in the one column of `ids` and false for most others; null counts as 0.

    It keeps texts out of a shuffle that an exact join would drop after it. The table has 2 ** NEED_BITS bits; with many
    more ids than that it lets all through, which changes the work only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << NEED_BITS - 3, np.uint8)
        for batch in batches:
            at = _bits(batch.column(0))
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from _pages(table)

    found = _merged(ids.toDF("id").mapInArrow(run, "page int, data binary"), "u1", np.bitwise_or)
    table = np.zeros(1 << NEED_BITS - 3, np.uint8)
    for page, data in found.items():
        table[page * _PAGE : (page + 1) * _PAGE] = np.frombuffer(data, "u1")
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def may(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            at = _bits(batch)
            hit = (own[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.array(hit[: len(batch)] & hit[len(batch) :])

    return may
