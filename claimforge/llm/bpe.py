"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import PieceCache, byte_alphabet


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model with the vocabulary of `ranks`.

    Piece 0 is the unknown piece; the token of rank r is piece r + 1, its bytes written in the byte alphabet and scored
    -r, so the pair of lowest rank merges first. The normalizer changes nothing. In the model's message, field 1 is a
    piece (1 text, 2 score, 3 kind), 2 the trainer's settings (3 kind of model: 2 is BPE), 3 the normalizer's (1 name,
    3 dummy prefix, 4 extra spaces, 5 escaped spaces).
    """
    chars = byte_alphabet()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))

    pieces = [piece("<unk>", 0.0, 2), *(piece("".join([chars[b] for b in t]), -float(r), 1) for r, t in enumerate(order))]
    trainer = _field(2, 2, _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces))))
    normalizer = _field(3, 2, _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5)))
    return b"".join([*pieces, trainer, normalizer])


class Codec:
    """encode(texts) gives decimal ids joined by a space for each text; decode gives a text's bytes back. Ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 250_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        chars = byte_alphabet()
        table = str.maketrans(dict(enumerate(chars)))
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = {str(i): bytes([back[c] for c in model.id_to_piece(i + 1)]) for i in range(len(ranks))}

        def encode_words(words: list[str]) -> list[str]:
            ids = model.encode([w.encode().decode("latin-1").translate(table) for w in words], num_threads=1)
            return [" ".join([str(i - 1) for i in x]) for x in ids]

        self.cache = PieceCache(encode_words, regex.compile(pattern).findall, " ", "|", most)

    def encode(self, texts: list[str | None]) -> list[str]:
        """Each match of the pattern by itself; see tokens.PieceCache."""
        return self.cache.encode(texts)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.split(" "))) if ids else b""


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again; one row per document.

    Columns: doc_id, n_tokens, ids array<int>, decoded binary; with digest=True instead of the last two ids_sha256 (of
    the decimal ids joined by one space) and decoded_sha256. A null text counts as empty and has no ids. ranks_path
    names a rank file on every node; pattern is the splitting pattern, whose matches must break before each lone space
    and line feed, as those of the published byte-level vocabularies do. Each row stands alone: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(ranks_path), pattern)
        for doc_ids, texts in slices(batches):
            rows = []
            for d, ids in zip(doc_ids, codec.encode(texts), strict=True):
                back = codec.decode(ids)
                n = ids.count(" ") + 1 if ids else 0
                rows.append((d, n, *((hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()) if digest else ([int(x) for x in ids.split()], back))))
            kinds = [pa.int64(), pa.int64(), *([pa.string()] * 2 if digest else [pa.list_(pa.int32()), pa.binary()])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    kinds = ("long", "long", *(("string", "string") if digest else ("array<int>", "binary")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
