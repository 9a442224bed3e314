"""Near-duplicate texts by order MinHash over five-word shingles, verified by banded alignment of words."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, sized, stage_table
from .graph import components
from .rarity import needed, rarity_levels, slots
from .setjoin import CROWD, Overlap, candidates, crowded, ordered_tokens, parity
from .words import Words, batch_words, labelled, mix, shingles

K = 5
TOP = np.uint64(2**64 - 1)
#: Stands for a null id in joins.
NO_ID = -(2**63)
#: Texts that a text is compared with at first; whatever buckets these don't settle goes through the later steps.
FIRST = 3
#: Bits of a text's mark: the bit of each word, labelled by its occurrences, is flipped once.
MARK_BITS = 2048
#: Pairs of texts that a task looks at together.
CELLS = 1 << 20
_EPS = 1e-6


def order_sketches(words: Words, n_sketches: int, size: int, k: int = K) -> np.ndarray:
    """For each text and each of n_sketches orders a hash of its `size` smallest labelled shingles, in the order of the text.

    Texts without words have rows of zeros. An order multiplies labels by an odd number of its own.
    """
    n_texts = len(words.first_line) - 1
    out = np.zeros((n_texts, n_sketches), np.uint64)
    runs, text = shingles(words, k)
    if not len(runs):
        return out
    label = labelled(runs, text)
    held, first, n = np.unique(text, return_index=True, return_counts=True)
    local = np.repeat(np.arange(len(held)), n)
    odd = np.random.default_rng(5).integers(1, 2**63, n_sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        for s in range(n_sketches):
            h = label * odd[s]
            places = []
            for _ in range(size):
                low = np.minimum.reduceat(h, first)
                at = np.flatnonzero(h == low[local])
                if len(at) != len(held):  # equal hashes
                    at = at[np.unique(local[at], return_index=True)[1]]
                places.append(at)
                h[at] = TOP
            at = np.sort(np.stack(places), axis=0)
            acc = np.full(len(held), s + 1, np.uint64)
            for k_th, place in enumerate(at):
                acc = np.where(k_th < n, mix(acc * np.uint64(0x9E3779B97F4A7C15) + label[np.minimum(place, len(label) - 1)]), acc)
            short = n < size  # all the shingles of a text of few, in order
            for i in np.flatnonzero(short).tolist():
                acc[i] = mix(np.bitwise_xor.reduce(mix(label[first[i] : first[i] + n[i]] + np.arange(n[i], dtype=np.uint64)), keepdims=True) + np.uint64(s))[0]
            out[held, s] = acc
    return out


def banded_common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest alignment of equal items of a and b whose places differ by at most `band`.

    A row of the table is one integer with a bit for each item of a; a step down is an addition with carries.
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    window, row = (1 << (2 * band + 1)) - 1, full
    for j, y in enumerate(b):
        if m := places.get(y):
            m &= window << (j - band) if j >= band else window >> (band - j)
            both = row & m
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Words of a and b that align in order, by the words of the longer text; 0 where that is under `least`.

    One minus it is the share of words that were put in, taken out or replaced. If `need` words align, places of aligned
    words differ by no more than the longer text has others, which bounds the band; a count of common words comes first.
    """
    n, m = len(a), len(b)
    most = max(n, m)
    need = math.ceil(least * most - 1e-9)
    if not n or not m or min(n, m) < need:
        return 0.0
    differ = np.flatnonzero(a[: min(n, m)] != b[: min(n, m)])
    head = int(differ[0]) if len(differ) else min(n, m)
    x, y = a[head:], b[head:]
    differ = np.flatnonzero(x[::-1][: min(len(x), len(y))] != y[::-1][: min(len(x), len(y))])
    tail = int(differ[0]) if len(differ) else min(len(x), len(y))
    x, y = x[: len(x) - tail].tolist(), y[: len(y) - tail].tolist()
    if head + tail + min(len(x), len(y)) < need or x and y and head + tail + (Counter(x) & Counter(y)).total() < need:
        return 0.0
    common = head + tail + (banded_common(x, y, most - need) if x and y else 0)
    return common / most if common >= need else 0.0


def text_key(text: Column) -> Column:
    """16 bytes that name a text; a null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def word_marks(words: Words) -> np.ndarray:
    """Marks of all texts, MARK_BITS / 64 words each. Texts differ in at least as many words as their marks in bits."""
    n_texts = len(words.first_line) - 1
    h = mix(labelled(words.hashes, words.text))
    flipped = np.bincount(words.text * MARK_BITS + (h % np.uint64(MARK_BITS)).astype(np.int64), minlength=n_texts * MARK_BITS).astype(np.uint8) & 1
    return np.packbits(flipped, bitorder="little").view(np.int64).reshape(n_texts, MARK_BITS // 64)


def _sketch(docs: DataFrame, n_sketches: int, size: int) -> DataFrame:
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sized(batches, rows=1024, most=2 << 20):
            words = batch_words(texts)
            keys = [hashlib.md5((t or "").encode(), usedforsecurity=False).digest() for t in texts.to_pylist()]
            n = np.bincount(words.text, minlength=len(texts)).astype(np.int32)
            sketches = order_sketches(words, n_sketches, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(n), lists(sketches), lists(word_marks(words))], names=["doc_id", "key", "n", "sketches", "mark"])

    return docs.mapInArrow(run, "doc_id long, key binary, n int, sketches array<long>, mark array<long>")


def _plausible(pairs: DataFrame, known: DataFrame, least: float, share: bool = False) -> DataFrame:
    """The pairs (akid, bkid) of numbers of texts that can align by lengths and marks; share: and share a sketch."""
    side = lambda s: known.select(*(F.col(c).alias(f"{s}{c}") for c in ("kid", "n", "mark", *(["sketches"] if share else []))))
    own = pairs.join(side("a"), "akid").join(side("b"), "bkid")
    differ = F.aggregate(F.zip_with("amark", "bmark", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    need = least * F.greatest("an", "bn") - _EPS
    own = own.where((F.least("an", "bn") >= need) & (differ <= F.col("an") + F.col("bn") - 2 * need))
    own = own.where(F.arrays_overlap("asketches", "bsketches")) if share else own
    return stage_table(own.select("akid", "bkid"), "plausible")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (akid, bkid) of numbers of texts that align, as pairs (a, b) of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            at = 0
            for _, _, text_a, text_b in sized([batch], 2, 256, 2 << 20):
                sides = []
                for side in (text_a, text_b):
                    words = batch_words(side)
                    sides.append((words.hashes, np.searchsorted(words.text, np.arange(len(side) + 1)).tolist()))
                (x, p), (y, q) = sides
                for i in range(len(text_a)):
                    keep[at + i] = alignment_similarity(x[p[i] : p[i + 1]], y[q[i] : q[i + 1]], least) > 0
                at += len(text_a)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    text = lambda s: texts.select(F.col("kid").alias(f"{s}kid"), F.col("key").alias(s), F.col("text").alias(f"text_{s}"))
    own = pairs.join(text("a"), "akid").join(text("b"), "bkid").select("a", "b", "text_a", "text_b")
    return stage_table(own.mapInArrow(run, "a binary, b binary"), "verified")


def open_pairs(part: np.ndarray, n: np.ndarray, mark: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i < j of texts of different parts that can align by their lengths and marks, and the bits in which these differ."""
    step = max(1, CELLS // max(1, len(n)))
    for k in range(0, len(n), step):
        own, rest = slice(k, k + step), slice(k, len(n))
        low, high = np.minimum(n[own, None], n[None, rest]), np.maximum(n[own, None], n[None, rest])
        i, j = np.nonzero((part[own, None] != part[None, rest]) & (low >= least * high - _EPS) & ~np.tri(len(n[own]), len(n[rest]), dtype=bool))
        for at in range(0, len(i), CELLS // MARK_BITS * 64):
            a, b = i[at : at + CELLS // MARK_BITS * 64] + k, j[at : at + CELLS // MARK_BITS * 64] + k
            differ = np.bitwise_count(mark[a] ^ mark[b]).sum(1, dtype=np.int64)
            keep = differ <= n[a] + n[b] - 2 * (least * np.maximum(n[a], n[b]) - _EPS)
            yield a[keep], b[keep], differ[keep]


def _bucket_pairs(open_: DataFrame, known: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Pairs (akid, bkid) of texts of a bucket's different parts that can align by their lengths and marks.

    open_ has bucket, chunk, kid and part; the texts of a bucket's chunk, CROWD or so, are compared in one task. A pair comes
    at the first bucket that it shares. With nearest, each text comes with the one text of all chunks whose mark is nearest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            flat = {c: rows.column(c).to_numpy() for c in ("bucket", "chunk", "kid", "part", "n")}
            mark, sketches = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) for c in ("mark", "sketches"))
            edge = np.flatnonzero((np.diff(flat["bucket"]) != 0) | (np.diff(flat["chunk"]) != 0)) + 1
            for low, high in zip([0, *edge.tolist()], [*edge.tolist(), rows.num_rows], strict=True):
                kid, own, bucket = flat["kid"][low:high], sketches[low:high], flat["bucket"][low]
                best, near = np.full(len(kid), np.iinfo(np.int64).max), np.zeros(len(kid), np.int64)
                for a, b, differ in open_pairs(flat["part"][low:high], flat["n"][low:high].astype(np.int64), mark[low:high].view(np.uint64), least):
                    if nearest:
                        for x, y in ((a, b), (b, a)):
                            order = np.lexsort((differ, x))
                            first = order[np.append(True, np.diff(x[order]) != 0)] if len(order) else order
                            better = first[differ[first] < best[x[first]]]
                            best[x[better]], near[x[better]] = differ[better], y[better]
                        continue
                    same = own[a] == own[b]
                    at = same.argmax(1)
                    keep = (own[a, at] == bucket) | ~same[np.arange(len(a)), at]
                    yield from _numbered(kid[a[keep]], kid[b[keep]], differ[keep])
                if nearest:
                    found = best < np.iinfo(np.int64).max
                    yield from _numbered(kid[found], kid[near[found]], best[found])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("bucket").to_numpy(), batch.column("chunk").to_numpy()
            new = int(np.argmax((last[0] == last[0][-1]) & (last[1] == last[1][-1])))  # where the batch's last chunk begins
            before = held[-1] if held else None
            if before is not None and (new or (before.column("bucket")[-1], before.column("chunk")[-1]) != (batch.column("bucket")[0], batch.column("chunk")[0])):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, new)]))
                held = [batch.slice(new)]
            elif new:
                yield from done(pa.Table.from_batches([batch.slice(0, new)]))
                held = [batch.slice(new)]
            else:
                held.append(batch)
        if held:
            yield from done(pa.Table.from_batches(held))

    rows = open_.join(known, "kid").select("bucket", "chunk", "kid", "part", "n", "mark", "sketches")
    rows = rows.repartition(partitions(rows.sparkSession), "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "kid")
    found = rows.mapInArrow(run, "x long, y long, differ long")
    if nearest:
        found = found.groupBy("x").agg(F.min(F.struct("differ", "y")).alias("s")).select("x", F.col("s.y").alias("y"))
    return found.select(F.least("x", "y").alias("akid"), F.greatest("x", "y").alias("bkid")).distinct()


def _numbered(x: np.ndarray, y: np.ndarray, differ: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(x), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 10_000]) for c in (x, y, differ)], names=["x", "y", "differ"])


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the buckets that hold several parts: bucket, size, key, kid, component, part and chunk.

    labels: node, component. A bucket of more than CROWD texts is dealt to chunks of half as many.
    """
    own = members.select("key", "kid", "bucket").join(labels.withColumnRenamed("node", "key"), "key", "left")
    own = stage_table(own.withColumn("component", F.coalesce("component", "key")), "labelled")
    held = own.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    chunk = F.when(F.col("size") > CROWD, F.pmod(F.xxhash64("kid"), F.ceil(2 * F.col("size") / CROWD))).otherwise(0).cast("long").alias("chunk")
    return own.join(held.where("low <> high").select("bucket", "size"), "bucket").select("bucket", "size", "key", "kid", "component", F.xxhash64("component").alias("part"), chunk)


def _prefix_pairs(left: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (akid, bkid) of texts of different components that can be similar: an exact prefix join of their labelled words.

    Texts that align enough share most of their words, and so one of the rarest of each; a text with many words of its
    own, such as one that shares only a passage with others, has none of the common ones in its prefix and meets none.
    """
    rule = Overlap(least, False)
    own = stage_table(texts.join(left, "key").select("kid", "component", "text"), "open-texts")
    shared = left.sparkSession.sparkContext.broadcast(rarity_levels(own))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for kids, parts, found in sized(batches, 2, most=2 << 20):
            words = batch_words(found)
            if not len(words.hashes):
                continue
            rare = level[slots(words.hashes)]
            groups, n, h, token = ordered_tokens(labelled(words.hashes, words.text), words.text, rare)
            first, prefix = np.cumsum(n) - n, rule.prefix(n)
            place = np.arange(len(h)) - np.repeat(first, n)
            take = place < np.repeat(prefix, n)
            of = np.repeat(np.arange(len(n)), n)[take]
            texts_at = pa.array(groups[of])
            whole = pa.RecordBatch.from_arrays(
                [pa.array(token[take].view(np.int64)), kids.take(texts_at), parts.take(texts_at), pa.array(n[of]), pa.array(place[take]), *(pa.array(x[of]) for x in parity(h, first))],
                names=["token", "x", "part", "n", "place", "odd", "even"],
            )
            for k in range(0, whole.num_rows, 10_000):
                yield whole.slice(k, 10_000)

    rows = own.select("kid", F.xxhash64("component").alias("part"), "text").mapInArrow(run, "token long, x long, part long, n long, place long, odd long, even long")
    pairs, crowd = candidates(rows.withColumn("y", F.lit(0).cast("long")), rule, first_only=False)
    return pairs.union(crowded(crowd, rule)).select(F.col("x").alias("akid"), F.col("bx").alias("bkid")).distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, n_sketches: int = 32, sketch_size: int = 2) -> DataFrame:
    """One row per document: doc_id, key (of its text), class_id (the smallest doc_id of its class), n_class (documents in it).

    Texts are linked if `least` or more of the longer one's words align in order with the other's (an edit similarity);
    classes are connected texts. Copies of a text share its key and are compared once. Candidates share one of n_sketches
    order-MinHash sketches, each of the sketch_size smallest five-word shingles in text order.

    In a bucket of texts with one sketch, texts are first compared with its lowest one, each text with FIRST such ones;
    where a bucket then still holds several classes, each text with the one whose mark is nearest. What are different
    classes after that is compared as far as lengths and marks allow, in buckets of CROWD texts or fewer; larger ones are
    joined exactly, on the rarest words of each text. So a large group of copies costs few comparisons, and every two
    texts in a bucket end up in one class or are known to differ.

    A null text counts as empty; texts without words are linked to equal ones only. Null ids come last in the choice of
    class_id. Repeated rows are copies. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = stage_table(_sketch(rows, n_sketches, sketch_size), "sketches")
    kid = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long")  # names a text well enough to look it up
    distinct = sketched.where("n > 0").groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "n", "sketches", "mark")).alias("s"))
    distinct = stage_table(distinct.select("key", kid.alias("kid"), "s.*"), "texts-sketched")
    members = distinct.select("key", "kid", F.explode(F.array_distinct("sketches")).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("kid").alias("center"), F.max("kid").alias("high")).where("center <> high").select("bucket", "center")
    members = stage_table(members.join(shared.hint("shuffle_hash"), "bucket"), "buckets")

    found = stage_table(distinct.select("key", "kid", "doc").join(members.select("kid").distinct(), "kid", "left_semi"), "found")
    doc = F.coalesce("doc_id", F.lit(NO_ID))
    texts = rows.where(needed(found.select("doc"))(doc)).select(doc.alias("doc"), text_key(F.col("text")).alias("key"), "text")
    texts = stage_table(texts.join(found, ["key", "doc"]).select("key", "kid", "text").dropDuplicates(["key"]), "texts")
    known = stage_table(distinct.join(found.select("kid"), "kid", "left_semi").select("kid", "n", "mark", "sketches"), "known")

    ordered = [F.least("kid", "other").alias("akid"), F.greatest("kid", "other").alias("bkid")]
    centers = members.where("kid <> center").groupBy("kid").agg(F.array_sort(F.collect_set("center")).alias("centers"))  # at most n_sketches each
    done = stage_table(centers.select("kid", F.explode(F.slice("centers", 1, FIRST)).alias("other")).select(*ordered).distinct(), "pairs")
    links = _verified(_plausible(done, known, least), texts, least)
    # the nearest one of each text in buckets that aren't one class, as far as the links of the first step tell
    both = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    opened = _open(members, both.select("node", F.least("node", "low").alias("component")))
    pairs = stage_table(_bucket_pairs(opened, known, least, True).join(done, ["akid", "bkid"], "left_anti"), "pairs")
    done = done.union(pairs)
    links = links.union(_verified(pairs, texts, least))
    # whatever two classes of a bucket are left
    opened = stage_table(_open(members, components(links)), "open")
    pairs = _bucket_pairs(opened.where(F.col("size") <= CROWD), known, least, False)
    pairs = stage_table(pairs.join(done, ["akid", "bkid"], "left_anti"), "pairs")
    links = links.union(_verified(pairs, texts, least))
    left = opened.where(F.col("size") > CROWD).select("key", "component").distinct()
    if not left.isEmpty():
        done = done.union(pairs)
        pairs = _prefix_pairs(left, texts, least).select(F.least("akid", "bkid").alias("akid"), F.greatest("akid", "bkid").alias("bkid"))
        links = links.union(_verified(_plausible(pairs.join(done, ["akid", "bkid"], "left_anti"), known, least, share=True), texts, least))
    labels = components(links)

    # per text first, so that a large group of copies is a few numbers
    per_text = sketched.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    linked = per_text.join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = linked.where("component is not null").groupBy("component").agg(F.min("low").alias("class_id"), F.sum("copies").alias("n_class"))
    linked = linked.withColumn("component", F.coalesce("component", "key"))  # no null, which would gather all other texts in one task
    per_text = linked.join(named, "component", "left").select("key", F.coalesce("class_id", "low").alias("class_id"), F.coalesce("n_class", "copies").alias("n_class"))
    return sketched.select("doc_id", "key").join(stage_table(per_text, "classes"), "key").select("doc_id", "key", "class_id", "n_class")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The documents, all columns, less all but one of each class: the one of smallest id, or one of its repeated rows.

    A document alone in its class stays as it is and isn't shuffled as far as the table of needed ids tells. Columns may
    have any names. Nulls, empty texts and empty tables as in near_duplicate_classes.
    """
    classes = stage_table(near_duplicate_classes(docs, id_col, text_col, least).where("n_class > 1"), "classes")
    first = classes.groupBy("class_id", "doc_id", "key").agg(F.count("*").alias("alike"))
    lowest = first.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("key").alias("kept_key"))
    same = [F.col("f.class_id").eqNullSafe(F.col("k.class_id"))]
    fate = first.alias("f").join(lowest.alias("k"), same).select(
        F.coalesce("f.doc_id", F.lit(NO_ID)).alias("doc"), "f.key", (F.col("f.doc_id").eqNullSafe(F.col("f.class_id")) & (F.col("f.key") == F.col("kept_key"))).alias("kept"), F.col("alike")
    )
    fate = stage_table(fate, "fates")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    some = needed(fate.select("doc"))(doc)
    own = docs.where(some).select(doc.alias("doc"), text_key(F.col(text_col).cast("string")).alias("key"), F.struct(*docs.columns).alias("row"))
    own = own.join(fate.hint("shuffle_hash"), ["doc", "key"], "left").where(F.coalesce("kept", F.lit(True)))
    repeated = F.coalesce("alike", F.lit(1)) > 1
    out = own.where(~repeated).select("row")
    if not fate.where("kept and alike > 1").isEmpty():  # repeated rows, seldom any
        out = out.union(own.where(repeated).dropDuplicates(["doc", "key"]).select("row"))
    return docs.where(~some).unionByName(out.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
