"""Exact ranked lexical search by ball trees over sparse impact vectors.

A document's vector holds, for each term of the queries, the integer impact of the term in the document; a query's vector
holds how often it has each term; the score is their inner product. Documents are gathered in trees of balls. By the
Cauchy-Schwarz inequality no document of a ball scores more than query * centroid + |query| * radius. Texts share few of
their terms, so in the whole space that bound excludes little; the terms are therefore dealt into groups, a ball has a
radius in each group's subspace as well, and |query| * radius may be summed up over the groups that the query has terms in.
Both bounds have a margin for rounding. A search visits balls best-first and ends at the first whose bound is below the
query's last place. At leaves, scores are exact in 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, sized, stage_table

#: Bytes of UTF-8 as terms need them: A-Z lower-cased, other ASCII than digits and letters a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Different terms of a block of queries (a query of more is a block of its own), and queries of a block.
BLOCK_TERMS, BLOCK_ITEMS = 8192, 4096
#: Documents of a leaf, of a tree at most, and numbers in a tree's table of centroids at most.
LEAF, TREE, CENTROIDS = 8, 2048, 1 << 22
#: Groups of terms at most; the bound is right with any number, and tighter with more.
GROUPS = 1024
NO_ID = 2**63 - 1  # stands for a null id, the last of equal scores


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of digits, ASCII letters (lower-cased) and characters beyond ASCII."""
    return text.translate(TERM_BYTES).split()


@dataclass
class Block:
    """A block of queries: its terms' numbers, and for each query its id and its terms' numbers and counts."""

    vocabulary: dict[bytes, int]
    ids: list
    numbers: list[np.ndarray]
    counts: list[np.ndarray]


def query_blocks(items: Iterator[tuple[int | None, bytes]]) -> Iterator[Block]:
    """Blocks of queries of bounded size. A query without a term is left out, as no document scores above 0 for it."""
    block = Block({}, [], [], [])
    for item_id, text in items:
        own = Counter(terms(text))
        if not own:
            continue
        new = [t for t in own if t not in block.vocabulary]
        if block.ids and (len(block.vocabulary) + len(new) > BLOCK_TERMS or len(block.ids) == BLOCK_ITEMS):
            yield block
            block, new = Block({}, [], [], []), list(own)
        for t in new:
            block.vocabulary[t] = len(block.vocabulary)
        block.ids.append(item_id)
        block.numbers.append(np.array([block.vocabulary[t] for t in own], np.int64))
        block.counts.append(np.array(list(own.values()), np.int64))
    if block.ids:
        yield block


@dataclass
class Rows:
    """Sparse rows: row i has the values of begins[i] to begins[i + 1] in the columns that stand there."""

    begins: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.begins)[rows]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(begins[-1]) + np.repeat(self.begins[rows] - begins[:-1], sizes)
        return Rows(begins, self.columns[places], self.values[places])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner products of the rows, none of which is empty, with a dense vector."""
        return np.add.reduceat(self.values * dense[self.columns], self.begins[:-1])


class BallTree:
    """Balls over rows of non-negative integers; node 0 is the root, and a node's rows are order[first[node]:end[node]].

    group has the group of each column.
    """

    def __init__(self, rows: Rows, group: np.ndarray, leaf: int = LEAF):
        n, width = len(rows.begins) - 1, len(group)
        row = np.repeat(np.arange(n), np.diff(rows.begins))
        by_group = np.lexsort((group[rows.columns], row))  # a row's columns of one group stand together
        rows = Rows(rows.begins, rows.columns[by_group], rows.values[by_group])
        self.group, self.order = group, np.arange(n)
        self.first, self.end, self.children, centroids, radii, in_groups = [0], [n], [], [], [], []
        floats = Rows(rows.begins, rows.columns, rows.values.astype(np.float64))
        norms = np.add.reduceat(floats.values**2, floats.begins[:-1])
        error = (width + 16) * 2.0**-50  # more than a sum of so many products can lose, as a share of its parts
        node = 0
        while node < len(self.first):
            own = self.order[self.first[node] : self.end[node]]
            members = floats.take(own)
            centroid = np.bincount(members.columns, members.values, minlength=width) / len(own)
            length = float(centroid @ centroid)
            squares = np.maximum(norms[own] - 2 * members.dot(centroid) + length, 0.0)
            largest, slack = float(squares.max()), 4 * error * (float(norms[own].max()) + length)
            centroids.append(centroid)
            radii.append(math.sqrt(largest + slack) * (1 + 1e-12))
            in_groups.append(self._group_radii(members, centroid, slack))
            self.children.append(())
            if len(own) > leaf and largest > 64 * error * length:
                left = self._left(members, norms[own], int(squares.argmax()), width)
                sides = own[left], own[~left]
                self.order[self.first[node] : self.end[node]] = np.concatenate(sides)
                middle = self.first[node] + len(sides[0])
                self.children[node] = (len(self.first), len(self.first) + 1)
                self.first += [self.first[node], middle]
                self.end += [middle, self.end[node]]
            node += 1
        self.centroids, self.radii, self.in_groups, self.error = np.array(centroids).T.copy(), np.array(radii), np.array(in_groups).T.copy(), error
        self.rows = rows.take(self.order)

    def _group_radii(self, members: Rows, centroid: np.ndarray, slack: float) -> np.ndarray:
        """The largest distance from the centroid in each group's subspace; 0 where no row has a column of the group."""
        group = self.group[members.columns]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        new[members.begins[:-1]] = True
        runs = np.flatnonzero(new)
        away = np.add.reduceat(members.values * (members.values - 2 * centroid[members.columns]), runs)
        lengths = np.bincount(self.group, centroid**2)
        out = lengths.copy()  # a row without a column of the group
        np.maximum.at(out, group[runs], away + lengths[group[runs]])
        return np.where(lengths > 0, np.sqrt(out + slack) * (1 + 1e-12), 0.0)

    @staticmethod
    def _left(members: Rows, norms: np.ndarray, pivot: int, width: int) -> np.ndarray:
        """The rows nearer to the one far out than to the one farthest from it; half of them, where that is lopsided."""

        def dense(row: int) -> np.ndarray:
            out = np.zeros(width)
            own = slice(members.begins[row], members.begins[row + 1])
            out[members.columns[own]] = members.values[own]
            return out

        to_pivot = members.dot(dense(pivot))
        other = int((norms - 2 * to_pivot).argmax())
        lead = to_pivot - members.dot(dense(other)) - (norms[pivot] - norms[other]) / 2
        left = lead > 0
        if min(left.sum(), len(left) - left.sum()) * 16 < len(left):
            left = np.zeros(len(left), bool)
            left[np.argsort(lead, kind="stable")[: len(left) // 2]] = True
        return left

    def bounds(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For every node a number that no row's exact score exceeds."""
        counts = counts.astype(np.float64)
        groups, place = np.unique(self.group[numbers], return_inverse=True)
        reach = np.sqrt(np.bincount(place, counts**2)) @ self.in_groups[groups]
        spread = np.minimum(math.sqrt(float(counts @ counts)) * self.radii, reach)
        return (counts @ self.centroids[numbers] + spread) * (1 + 8 * self.error) + 1

    def search(self, numbers: np.ndarray, counts: np.ndarray, query: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Puts the rows' scores into best, a heap of the k best (score, -id); returns how many rows were scored.

        query is the dense vector of the same counts, ids are those of the rows before they were put in order.
        """
        bounds = self.bounds(numbers, counts).tolist()
        front, scored = [(-bounds[0], 0)], 0
        while front:
            bound, node = heapq.heappop(front)
            least = best[0][0] if len(best) == k else 1
            if -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if (own := min(-bound, bounds[child])) >= least:
                        heapq.heappush(front, (-own, child))
                continue
            first, end = self.first[node], self.end[node]
            begins = self.rows.begins[first : end + 1]
            part = slice(begins[0], begins[-1])
            scores = np.add.reduceat(self.rows.values[part] * query[self.rows.columns[part]], begins[:-1] - begins[0])
            scored += len(scores)
            for row in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[row]), -int(ids[self.order[first + row]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), numbers and counts of the vocabulary's terms, for each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for ids, texts in sized(batches, rows=4096, most=4 << 20):
            keep, sizes, numbers, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                words = terms(text) if text else ()
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                keep.append(row)
                sizes.append(len(words))
                numbers += found.keys()
                counts += found.values()
                ends.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((numbers, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "numbers", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, numbers array<int>, counts array<long>")


def weights(df: dict[int, int], n_docs: int, n_terms: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of the terms 0 to n_terms - 1."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(n_terms)], np.int64)


def _search_block(vectors: DataFrame, block: Block, k: int) -> DataFrame:
    """item_id, doc_id, score of each query's k best documents in each task."""
    spark, width = vectors.sparkSession, len(block.vocabulary)
    n_docs, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = {r["t"]: r["count"] for r in vectors.select(F.explode("numbers").alias("t")).groupBy("t").count().collect()}  # at most a block's terms
    weight = weights(df, n_docs, width)
    group = np.empty(width, np.int64)
    group[np.argsort(weight, kind="stable")] = np.arange(width) % GROUPS  # frequent terms go to groups of their own
    shared = spark.sparkContext.broadcast((block.ids, block.numbers, block.counts, weight, group))
    most = max(2 * LEAF, min(TREE, CENTROIDS // (4 * width) * LEAF))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, numbers, counts, weight, group = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in item_ids]
        query = np.zeros(width, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                ids, n, own_numbers, own_counts = (c.slice(at, most) for c in batch.columns)
                ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                sizes = own_numbers.value_lengths().to_numpy(zero_copy_only=False)
                columns, tf = own_numbers.flatten().to_numpy(), own_counts.flatten().to_numpy()
                m = np.array([100 - 25 + 25 * x * n_docs // length for x in n.to_pylist()], np.int64)
                values = weight[columns] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes)))
                row = np.repeat(np.arange(len(ids)), sizes)[values > 0]
                kept, sizes = np.unique(row, return_counts=True)
                if not len(kept):
                    continue
                tree = BallTree(Rows(np.concatenate([[0], np.cumsum(sizes)]), columns[values > 0].astype(np.int64), values[values > 0]), group)
                for i, (t, c) in enumerate(zip(numbers, counts, strict=True)):
                    query[t] = c
                    tree.search(t, c, query, ids[kept], best[i], k)
                    query[t] = 0
        for i, own in enumerate(best):
            if own:
                found = [None if -d == NO_ID else -d for _, d in own]
                yield pa.RecordBatch.from_arrays([pa.array([item_ids[i]] * len(own), pa.int64()), pa.array([i] * len(own), pa.int32()), pa.array(found, pa.int64()), pa.array([s for s, _ in own], pa.int64())], names=["item_id", "item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "numbers", "counts").mapInArrow(search, "item_id long, item int, doc_id long, score long")


def search_ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Items are taken in blocks (BLOCK_TERMS, BLOCK_ITEMS); for each, one pass turns whole texts into narrow vectors of the
    block's terms, sums over these give the documents' and terms' numbers, and tasks build trees of TREE documents at most
    and search them with each item's best scores so far. A task sends k rows an item, which are merged in two steps, so no
    item's rows meet in one task.

    A null or empty text has no terms: such documents count nowhere and such items have no rows. Repeated documents are
    documents each; items equal in id and text are one, others of equal id are ranked each by itself. A null doc_id is the
    last of equal scores. An empty table of either kind gives an empty result. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    path, schema = new_path(spark, "ranked-search"), "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/none")
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    asked = stage_table(asked, "items")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for number, block in enumerate(query_blocks((r["item_id"], bytes(r["text"])) for r in asked.toLocalIterator(prefetchPartitions=True))):
        vectors = stage_table(term_vectors(docs, block.vocabulary, id_col, text_col), "term-vectors")
        found = _search_block(vectors, block, k).withColumn("salt", F.spark_partition_id() % partitions(spark))
        some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        out = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        out.select("item_id", "rank", "doc_id", "score").write.parquet(f"{path}/block-{number}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
