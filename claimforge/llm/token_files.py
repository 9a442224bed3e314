"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A file holds, little-endian:

    header   magic "PFR1", uint32 version, uint32 block length, uint64 documents, uint64 tokens, uint64 blocks
    docs     int64 id, uint8 1 where the id is not null, uint64 tokens, for each document, column by column
    index    uint64 start of each block from the blocks' beginning, and their end
    blocks   uint32 minimum, uint8 width, uint16 exceptions; `width` bit planes of block length / 8 bytes each;
             uint8 places and uint32 values of the exceptions

A block's ids less their minimum are packed at the width that holds `share` of them; the rest are exceptions, listed
whole. The last block is filled up with its last id, which the reader cuts off by the header's count.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, sized, slices, stage_table
from .tokens import encoder

MAGIC, BLOCK = b"PFR1", 256
HEADER = struct.Struct("<4sIIQQQ")
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2")])
MANIFEST = "part long, seq long, file string, n_docs long, n_tokens long, n_bytes long"


def pack_blocks(ids: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, bytes]:
    """Block starts (with the end) and the blocks of uint32 ids."""
    if not len(ids):
        return np.zeros(1, "<u8"), b""
    grid = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], "<u4")]).reshape(-1, BLOCK)
    low = grid.min(1)
    rest = grid - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.uint8)
    odd = (rest >> width[:, None].astype(np.uint64)) != 0
    n = odd.sum(1)
    heads = np.zeros(len(grid), HEAD)
    heads["low"], heads["width"], heads["n"] = low, width, n
    sizes = HEAD.itemsize + width.astype(np.int64) * (BLOCK // 8) + n * 5
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    out = np.zeros(int(starts[-1]), np.uint8)
    first = starts[:-1].astype(np.int64)
    out[first[:, None] + np.arange(HEAD.itemsize)] = heads.view(np.uint8).reshape(-1, HEAD.itemsize)
    for k in range(int(width.max())):
        rows = np.flatnonzero(width > k)
        plane = np.packbits((rest[rows] >> np.uint32(k)).astype(np.uint8) & 1, axis=1)
        out[(first[rows] + HEAD.itemsize + k * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)] = plane
    block, place = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    tail = first[block] + HEAD.itemsize + width[block].astype(np.int64) * (BLOCK // 8)
    out[tail + nth] = place
    out[(tail + n[block] + 4 * nth)[:, None] + np.arange(4)] = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts, out.tobytes()


def unpack_blocks(starts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The uint32 ids of the blocks that begin at `starts` in data (uint8); any run of blocks can be read alone."""
    first = starts[:-1].astype(np.int64)
    if not len(first):
        return np.zeros(0, "<u4")
    heads = data[first[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0]
    width, n = heads["width"].astype(np.int64), heads["n"].astype(np.int64)
    grid = np.zeros((len(first), BLOCK), "<u4")
    for k in range(int(width.max())):
        rows = np.flatnonzero(width > k)
        plane = data[(first[rows] + HEAD.itemsize + k * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
        grid[rows] |= np.unpackbits(plane, axis=1).astype("<u4") << np.uint32(k)
    block = np.repeat(np.arange(len(first)), n)
    nth = np.arange(len(block)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    tail = first[block] + HEAD.itemsize + width[block] * (BLOCK // 8)
    grid[block, data[tail + nth]] = data[(tail + n[block] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
    return (grid + heads["low"][:, None]).reshape(-1)


def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, step: int = 2048) -> bytes:
    """A whole file; blocks are packed `step` at a time, which bounds the memory."""
    starts, blocks, end = [np.zeros(1, "<u8")], [], 0
    for at in range(0, len(ids), step * BLOCK):
        own, data = pack_blocks(ids[at : at + step * BLOCK])
        starts.append(own[1:] + np.uint64(end))
        blocks.append(data)
        end += len(data)
    index = np.concatenate(starts).astype("<u8")
    return b"".join([
        HEADER.pack(MAGIC, 1, BLOCK, len(doc_ids), len(ids), len(index) - 1),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], "u1").tobytes(), np.array(counts, "<u8").tobytes(),
        index.tobytes(), *blocks,
    ])


def parse_file(data: bytes, step: int = 2048) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, its ids) in the file's order."""
    magic, version, block, n_docs, n_tokens, n_blocks = HEADER.unpack_from(data)
    if (magic, version, block) != (MAGIC, 1, BLOCK):
        raise ValueError("not a token file of this version")
    at = HEADER.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    known = np.frombuffer(data, "u1", n_docs, at := at + 8 * n_docs)
    counts = np.frombuffer(data, "<u8", n_docs, at := at + n_docs).astype(np.int64)
    index = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * n_docs)
    blocks = np.frombuffer(data, np.uint8, offset=at + 8 * (n_blocks + 1))
    ids = np.empty(n_blocks * BLOCK, "<u4")
    for k in range(0, n_blocks, step):
        own = unpack_blocks(index[k : k + step + 1], blocks)
        ids[k * BLOCK : k * BLOCK + len(own)] = own
    ends = np.cumsum(counts)
    if n_docs and ends[-1] != n_tokens:
        raise ValueError("a token file's counts disagree")
    for d, ok, end, n in zip(doc_ids.tolist(), known.tolist(), ends.tolist(), counts.tolist(), strict=True):
        yield (d if ok else None), ids[end - n : end]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_tokens: int = 2_000_000) -> DataFrame:
    """Encodes the documents and writes their ids in ascending order of id into files under `path`; returns the manifest.

    tokenizer is the path of a byte-level BPE file on every node. Null ids come first, and equal ids by text. A null text
    counts as empty; each document ends with end_id. A file takes whole documents until it holds file_tokens ids, and the
    files in the order of (part, seq) hold the corpus. Tasks write under names of their own, and only files in the
    manifest count, so a task that runs twice harms nothing. `path` is any URI that pyarrow.fs opens.

    The manifest is a table in the shared folder: part, seq, file, n_docs, n_tokens, n_bytes. An empty table of documents
    gives an empty manifest. Other columns are not read.
    """
    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own_encoder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, store, root = TaskContext.get().partitionId(), *fs.FileSystem.from_uri(path)
        rows, seq = [], 0
        doc_ids, counts, held, size = [], [], io.BytesIO(), 0

        def close() -> None:
            nonlocal seq, size
            if doc_ids:
                name = f"part-{part:05d}-{seq:04d}-{uuid.uuid4().hex[:12]}.pfr"
                data = file_bytes(doc_ids, counts, np.frombuffer(held.getvalue(), "<u4"))
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)
                rows.append((part, seq, name, len(doc_ids), size, len(data)))
                seq, size = seq + 1, 0
                doc_ids.clear(), counts.clear(), held.seek(0), held.truncate()

        for ids, texts in sized(batches, rows=1024, most=4 << 20):
            for d, own in zip(ids.to_pylist(), own_encoder.encode(texts), strict=True):
                own += end
                held.write(own)
                doc_ids.append(d)
                counts.append(len(own) // 4)
                size += len(own) // 4
                if size >= file_tokens:
                    close()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "seq", "file", "n_docs", "n_tokens", "n_bytes"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    return stage_table(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, path: str, digest=None, columns: str = "ids array<long>") -> DataFrame:
    """One row per document of the files in the manifest: doc_id, start (ids of all documents before it), n_tokens and `columns`.

    digest(ids) makes the values of `columns` from a document's uint32 ids; without it they are the ids themselves.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # one row per partition
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(upto), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    files = files.select("file", (F.col("part_start") + F.col("file_start")).alias("start")).repartition(partitions(manifest.sparkSession), "file")
    names = [c.split()[0] for c in columns.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for names_, starts in slices(batches):
            for file, start in zip(names_, starts, strict=True):
                with store.open_input_stream(f"{root}/{file}") as own:
                    data = own.read()
                at, rows = start, []
                for d, ids in parse_file(data):
                    rows.append((d, at, len(ids), *(digest(ids) if digest else (ids.tolist(),))))
                    at += len(ids)
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n)) for n, c in zip(("doc_id", "start", "n_tokens", *names), zip(*rows, strict=True), strict=True)], names=["doc_id", "start", "n_tokens", *names])

    return files.mapInArrow(read, f"doc_id long, start long, n_tokens long, {columns}")


def crc_of_ids(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.tobytes()),)
