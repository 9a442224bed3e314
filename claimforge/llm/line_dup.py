"""Line dedup by an exact set-similarity join: prefix, positional and length filters, then Jaccard over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, slices, stage_table
from .rarity import needed, rarity_levels, slots
from .setjoin import Overlap, candidates, crowded, ordered_tokens, parity
from .words import batch_words, mix

LINES = "doc long, line long, k1 long, k2 long, n int, odd long, even long, tokens array<long>"
#: Stands for a null id, which so comes first.
NO_ID = -(2**63)


def _lines(docs: DataFrame, levels: np.ndarray, rule: Overlap, min_words: int) -> DataFrame:
    """Each line of min_words words or more: a key of its word set, its size, and the rare words of its prefix.

    A set so small that only an equal one is similar has no prefix: equal sets are found by their keys.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, least = shared.value, rule.least
        for ids, texts in sized(batches, most=2 << 20):
            words = batch_words(texts)
            if not len(words.hashes):
                continue
            lines, n, h, token = ordered_tokens(words.hashes, words.line, level[slots(words.hashes)])
            first = np.cumsum(n) - n
            k1, k2 = np.add.reduceat(mix(h), first), np.add.reduceat(mix(h ^ np.uint64(0x94D049BB133111EB)), first)
            text = np.searchsorted(words.first_line, lines, "right") - 1
            take = n >= min_words
            prefix = np.where((n >= least * (n + 1) - 1e-9) & take, rule.prefix(n), 0)
            kept = token[np.arange(len(h)) - np.repeat(first, n) < np.repeat(prefix, n)]
            ends = np.concatenate([[0], np.cumsum(prefix)])
            columns = [
                ids.take(pa.array(text)), pa.array(lines - words.first_line[text]), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n.astype(np.int32)),
                *map(pa.array, parity(h, first)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(kept.view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "line", "k1", "k2", "n", "odd", "even", "tokens"]).filter(pa.array(take))

    return docs.select("doc", "text").mapInArrow(run, LINES)


def _jaccard_pairs(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Of the pairs (x, y, bx, by) of lines those whose sets of words are similar; docs has doc and text."""
    pairs = stage_table(pairs, "pairs")
    need = pairs.select(F.col("x").alias("doc"), F.col("y").alias("line")).union(pairs.select("bx", "by")).distinct()
    by_doc = stage_table(need.groupBy("doc").agg(F.collect_set("line").alias("lines")), "needed")
    found = docs.where(needed(by_doc.select("doc"))(F.col("doc"))).join(by_doc.hint("shuffle_hash"), "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lines in slices(batches, 64):
            rows = []
            for d, text, own in zip(ids, texts, lines, strict=True):
                parts = text.split("\n") if text else []
                rows += [(d, k, parts[k]) for k in own if k < len(parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc", "line", "words"])

    texts = stage_table(found.select("doc", "text", "lines").mapInArrow(cut, "doc long, line long, words string").distinct(), "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                for a, b in zip(batch.column("words").slice(at, 256).to_pylist(), batch.column("bwords").slice(at, 256).to_pylist(), strict=True):
                    p, q = set(a.encode().split()), set(b.encode().split())
                    both = len(p & q)
                    keep.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y", "bx", "by"])

    own = pairs.join(texts.toDF("x", "y", "words"), ["x", "y"]).join(texts.toDF("bx", "by", "bwords"), ["bx", "by"])
    return own.select("x", "y", "bx", "by", "words", "bwords").mapInArrow(run, "x long, y long, bx long, by long")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, min_words: int = 1) -> DataFrame:
    """One row per line that an earlier line makes needless: doc_id, line, match_doc_id, match_line (an earlier match).

    Lines are cut at line feeds and counted from 0; they stand in the order of (doc_id, line), a null id first (and equal
    to the smallest long). A line repeats an earlier one if the Jaccard similarity of their sets of words (runs without
    ASCII white space) is `least` or more, whether or not that one is itself repeated. Lines of fewer than min_words
    different words are left alone and match nothing; with 1, these are only the lines without words. A null text has no
    lines. Rows with equal ids count as one document. An empty table gives an empty result. Other columns are not read.

    Lines with one set of words are compared once, at the first of them. A set's words are ordered by rarity and those of
    its prefix are joined. Each set is first compared with the earliest that may match at each of its words, which settles
    most members of a large group, then, if still unmatched, with all others that may, so nothing is missed.
    """
    rule = Overlap(least, True)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    lines = stage_table(_lines(own, rarity_levels(own), rule, min_words), "lines")
    sets = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line", "n", "odd", "even", "tokens")).alias("s"))
    postings = sets.select(F.col("s.doc").alias("x"), F.col("s.line").alias("y"), F.col("s.n").alias("n"), "s.odd", "s.even", F.posexplode("s.tokens").alias("place", "token"))
    pairs, crowd = candidates(postings, rule, first_only=True)
    found = stage_table(_jaccard_pairs(pairs, own, least), "similar")
    if not crowd.isEmpty():
        asked = crowd.select("x", "y").distinct().join(found.select("x", "y").distinct(), ["x", "y"], "left_anti")
        found = found.union(stage_table(_jaccard_pairs(crowded(crowd, rule, asked), own, least), "similar"))

    earliest = found.groupBy("x", "y").agg(F.min(F.struct(F.col("bx").alias("doc"), F.col("by").alias("line"))).alias("b"))
    firsts = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line")).alias("at"), F.count("*").alias("lines"))
    known = firsts.join(earliest, (F.col("at.doc") == F.col("x")) & (F.col("at.line") == F.col("y")), "left").where("lines > 1 or b is not null")
    known = known.select("k1", "k2", F.coalesce("b", "at").alias("match"))
    out = lines.select("doc", "line", "k1", "k2").join(known.hint("shuffle_hash"), ["k1", "k2"]).where(F.col("match") < F.struct("doc", "line"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), F.col("line").cast("int").alias("line"), real("match.doc").alias("match_doc_id"), F.col("match.line").cast("int").alias("match_line")).distinct()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, min_words: int = 1) -> DataFrame:
    """The documents, all columns, with the repeated lines taken out of the text; a document left without a word goes.

    Documents that lose nothing are unchanged, also empty and null ones, and aren't shuffled as far as the table of
    needed ids tells. Columns may have any names. Repeated rows lose the same lines; an empty table gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, least, min_words).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    gone = stage_table(gone.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "lines"), "gone")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    some = needed(gone.select("doc"))(key)

    @F.arrow_udf("string")
    def without(texts: pa.Array, lines: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts.to_pylist(), lines.to_pylist(), strict=True):
            if own and text is not None:
                drop = set(own)
                text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in drop])
                text = text if text.encode().split() else None
            rows.append(text)
        return pa.array(rows, pa.string())

    whole = F.struct(*docs.columns)
    rest = docs.where(some).select(key.alias("doc"), whole.alias("row")).join(gone.hint("shuffle_hash"), "doc", "left")
    text = F.when(F.col("lines").isNotNull(), without(F.col("row")[text_col], F.col("lines"))).otherwise(F.col("row")[text_col])
    rest = rest.select("row", "lines", text.alias("text")).where(F.col("lines").isNull() | F.col("text").isNotNull())
    rest = rest.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
    return docs.where(~some).unionByName(rest)
