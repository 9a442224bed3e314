"""Memories: hashed text vectors, filtered recall, clusters of similar ones and their merge, forgetting, learned consensus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.text import let
from claimforge.sources.staging import staged

#: FNV-1a's start and prime, and the step of the linear congruential generator.
FNV_START, FNV_PRIME, STEP, PLUS = 2166136261, 16777619, 1103515245, 12345


def text_grams(text: Column) -> Column:
    """Runs of three characters of each Latin word with a space on both sides, and single characters and pairs of all else.

    Lower case, repeated ones too; white space counts nowhere else. A blank or null text has none.
    """

    def grams(part: Column) -> Column:
        word = F.concat(F.lit(" "), part, F.lit(" "))
        threes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), lambda i: F.substring(word, i, 3))
        return F.when(part.rlike("^[a-z0-9]"), threes).otherwise(let(F.split(F.regexp_replace(part, r"\s", ""), ""), others))

    def others(chars: Column) -> Column:
        chars = F.filter(chars, lambda c: c != "")
        n = F.greatest(F.size(chars) - 1, F.lit(0))
        return F.concat(chars, F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b)))

    parts = F.regexp_extract_all(F.lower(F.trim(text)), F.lit(r"([a-z0-9]+|[^a-z0-9]+)"), 1)
    return F.flatten(F.transform(parts, grams))


def gram_signs(gram: Column, dim: int, sparse: int) -> Column:
    """The places and signs of a gram's sparse vector: array<struct<place, sign>>; of a place drawn twice the last counts."""
    codes = F.transform(F.split(gram, ""), F.ascii)
    seed = F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    none = F.array().cast("array<bigint>")
    begin = F.struct(seed.alias("s"), none.alias("all"))
    step = lambda s: (s * STEP + PLUS).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(sparse)), begin, lambda a, _: F.struct(step(a["s"]).alias("s"), F.concat(a["all"], F.array(step(a["s"]))).alias("all")), lambda a: a["all"])
    drawn = F.transform(states, lambda s: F.struct((s % dim).cast("int").alias("place"), F.when(F.shiftright(s, 30).bitwiseAND(F.lit(1).cast("long")) == 1, 1.0).otherwise(-1.0).alias("sign")))
    return let(drawn, lambda d: F.filter(d, lambda x, i: ~F.exists(F.slice(d, i + 2, F.lit(sparse)), lambda y: y["place"] == x["place"])))


def embed_text(texts: DataFrame, key: str, text: str, dim: int = 256, sparse: int = 12) -> DataFrame:
    """key, place, value: the entries other than 0 of each text's vector of length 1, the sum of its grams' sparse vectors.

    A join of the texts' counted grams with a table of the different grams' signs, which are drawn once each. Texts
    without grams, and those whose grams cancel out, have no rows.
    """
    own = texts.select(F.col(key).alias("key"), F.explode(text_grams(F.col(text))).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("tf"))
    signs = own.select("gram").distinct().select("gram", F.explode(gram_signs(F.col("gram"), dim, sparse)).alias("s")).select("gram", "s.*")
    sums = own.join(signs, "gram").groupBy("key", "place").agg(F.sum(F.col("tf") * F.col("sign")).alias("value")).where("value <> 0")
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("key")))
    return sums.select(F.col("key").alias(key), "place", F.round(F.col("value") / norm, 6).alias("value"))


def dense_vectors(entries: DataFrame, key: str, dim: int = 256) -> DataFrame:
    """key, vector (array<double>) from the rows of embed_text."""
    held = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


# -- recall

PARTIAL = "query_id long, id long, score double, similarity double"
CHUNK = 4096  # queries that one pass compares; what is broadcast is bounded by it


def _unit(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows scaled to length 1; zeros stay, and a shorter vector is followed by zeros."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), max(dims, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12)


def _sixth(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def recall(
    queries: DataFrame, memories: DataFrame, k: int = 5, kind: str | None = None, tags: tuple[str, ...] = (), least: float = 0.0,
    weights: tuple[float, float, float] = (0.6, 0.3, 0.1),
) -> DataFrame:
    """query_id, rank, id, score, similarity: each query's k best memories other than itself.

    queries: query_id, vector; memories: id, vector, and type, tags, importance, age_days. Score: 0.6 cosine + 0.3 importance
    + 0.1 / (1 + age in days); null importance counts as 0.5 and a null age as 0. Filters on type, all of the tags and the
    least importance hold before vectors are read. Queries are taken CHUNK at a time; each task multiplies blocks of
    memories with the broadcast chunk and sends k rows a query, which are merged in two steps. Scores count to six places,
    ties go to the smaller id. A null or zero vector has a cosine of 0; memories with a null id are left out.
    """
    spark = queries.sparkSession
    own = memories.where("id is not null")
    own = own.where(F.col("type") == kind) if kind is not None else own
    own = own.where(F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains("tags", t))) if tags else own
    own = own.where(F.coalesce("importance", F.lit(0.0)) >= least) if least > 0 else own
    fixed = weights[1] * F.coalesce("importance", F.lit(0.5)) + weights[2] / (1 + F.coalesce("age_days", F.lit(0)))
    own = own.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("vector").cast("array<double>"), F.array().cast("array<double>")).alias("vector"), fixed.alias("fixed"))
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(F.col("vector").cast("array<double>"), F.array().cast("array<double>")).alias("vector"))
    order = [F.col("score").desc(), "id"]

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), _unit(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), 0)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, matrix = shared.value
            best = pd.DataFrame(columns=["q", "id", "score", "similarity"])
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    ids, vectors, fixed_ = (c.slice(at, 2048) for c in batch.columns)
                    ids, other = ids.to_numpy(zero_copy_only=False), _unit(vectors, matrix.shape[1])
                    mine = np.pad(matrix, ((0, 0), (0, other.shape[1] - matrix.shape[1])))
                    alike = np.clip(mine @ other.T, -1.0, 1.0)
                    scores = _sixth(weights[0] * alike + fixed_.to_numpy(zero_copy_only=False))
                    scores[query_ids[:, None] == ids] = -np.inf
                    cut = np.partition(scores, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                    q, m = np.nonzero((scores >= cut[:, None]) & np.isfinite(scores))
                    new = pd.DataFrame({"q": q, "id": ids[m], "score": scores[q, m], "similarity": _sixth(alike[q, m])})
                    best = pd.concat([best, new]) if len(best) else new
                    best = best.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
            if len(best):
                q = best["q"].to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(best["id"].to_numpy().astype(np.int64)), pa.array(best["score"].to_numpy().astype(float)), pa.array(best["similarity"].to_numpy().astype(float))], names=["query_id", "id", "score", "similarity"])

        found = own.mapInArrow(scan, PARTIAL).withColumn("_salt", F.spark_partition_id() % 64)
        some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))).where(F.col("rank") <= k)
        merged = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
        return staged(merged.select("query_id", "rank", "id", "score", "similarity"), "recalled")

    out, held = spark.createDataFrame([], "query_id long, rank int, id long, score double, similarity double"), []
    for row in asked.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == CHUNK:
            out, held = out.union(search(held)), []
    return out.union(search(held)) if held else out


# -- clusters


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, cluster: the smallest id of each connected component; nodes has id, edges has a and b.

    In each round a node takes the smallest label of its neighbours and itself, and then that label's own label, so rounds
    grow with the logarithm of a component's length. Labels are written after each round; the end is when none changes.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(nodes.select("id", F.col("id").alias("cluster")).distinct(), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
        low = labels.join(near, "id", "left").select("id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("near", "cluster")).alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("cluster").alias("further"))
        new = staged(low.join(jump, "to", "left").select("id", "old", F.least("to", F.coalesce("further", "to")).alias("cluster")), "labels")
        labels = new.select("id", "cluster")
        if new.where("old <> cluster").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def similar_memories(memories: DataFrame, least: float = 0.6, recall_wanted: float = 0.95, block: int = 2048, seed: int = 11) -> DataFrame:
    """a, b, similarity: pairs of one type with a cosine of `least` or more, a < b; memories has id, type and vector.

    Equal vectors of a type are compared once, by their smallest id (members of equal vectors are linked to it). The rows
    of a type are dealt into buckets by the signs of random projections; the largest type decides how many signs a bucket
    has (none while a type fits a block: every pair is then compared, exactly) and how many times that is done, so that a
    pair at `least` meets with a chance of `recall_wanted`. With recall_wanted 1 a type is one bucket, whatever its size,
    and no pair is lost. A bucket's rows are compared in blocks of `block` by matrix products, each pair of blocks in a task;
    pairs found are exact. Null ids, types and vectors have no pairs; zero vectors are like none.
    """
    spark = memories.sparkSession
    rows = memories.where("id is not null and type is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("type").cast("string").alias("type"), F.col("vector").cast("array<double>").alias("vector"))
    own = staged(rows.withColumn("h", F.sha2(F.to_json("vector"), 256)), "memories")
    reps = own.groupBy("type", "h").agg(F.min("id").alias("id"))
    copies = own.join(reps.withColumnRenamed("id", "rep"), ["type", "h"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    zero = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) <= 1e-24
    copies = copies.join(own.where(zero).select(F.col("id").alias("a")), "a", "left_anti")
    different = own.join(reps.select("id"), "id", "left_semi").where(~zero).select("id", "type", "vector")
    largest = different.groupBy("type").count().agg(F.max("count")).head()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, largest) / block))) if recall_wanted < 1 else 0
    meet = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    tables = 1 if bits == 0 else math.ceil(math.log(1 - recall_wanted) / math.log(1 - meet))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(2), 0)
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).normal(size=(unit.shape[1], bits))
                key = ((unit @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(unit), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(unit), t, np.int32)), pa.array(key.astype(np.int64)), batch.column(2)], names=["id", "type", "t", "bucket", "vector"])

    dealt = different.mapInArrow(deal, "id long, type string, t int, bucket long, vector array<double>")
    sizes = dealt.groupBy("type", "t", "bucket").agg(F.count("*").alias("n"))
    # a bucket's rows go to ceil(n / block) blocks by hash, and each pair of blocks is one group
    dealt = dealt.join(sizes, ["type", "t", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    grouped = dealt.withColumn("p", F.explode(pairs)).select("type", "t", "bucket", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "own", "id", "vector")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = (group[group["own"] == group[c].iloc[0]].drop_duplicates("id") for c in ("i", "j"))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        x = _unit(pa.array(list(left["vector"])), 0)
        y = _unit(pa.array(list(right["vector"])), x.shape[1])
        alike = np.pad(x, ((0, 0), (0, y.shape[1] - x.shape[1]))) @ y.T
        a, b = np.nonzero(alike >= least)
        out = pd.DataFrame({"a": left["id"].to_numpy()[a], "b": right["id"].to_numpy()[b], "similarity": _sixth(alike[a, b])})
        low, high = out[["a", "b"]].min(axis=1), out[["a", "b"]].max(axis=1)
        return out.assign(a=low, b=high)[low != high].drop_duplicates(["a", "b"])

    found = grouped.groupBy("type", "t", "bucket", "i", "j").applyInPandas(compare, "a long, b long, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).union(copies)


def cluster_memories(memories: DataFrame, least: float = 0.6, recall_wanted: float = 0.95) -> DataFrame:
    """id, cluster, n: the connected components of similar memories of one type, named by their smallest id."""
    own = components(memories.where("id is not null").select(F.col("id").cast("long").alias("id")), similar_memories(memories, least, recall_wanted))
    return own.withColumn("n", F.count("*").over(Window.partitionBy("cluster")))


def merge_memories(memories: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster: the most important member's id (the smaller of equal ones), type, tags of all in order, mean
    importance, largest decay and how many they were. Importances are added in the order of ids, so that a mean at the edge
    of rounding doesn't depend on how Spark deals rows out; thousandths are rounded as SQL does, after multiplying."""
    line = Window.partitionBy("cluster").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = memories.join(clusters.select("id", "cluster"), "id").withColumn("_s", F.sum(F.coalesce("importance", F.lit(0.5))).over(line))
    best = F.min_by(F.struct("id", "type"), F.struct((-F.coalesce("importance", F.lit(0.0))).alias("i"), "id"))
    out = own.groupBy("cluster").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), (F.round(F.max_by("_s", "id") / F.count("*") * 1000) / 1000).alias("importance"), F.max("decay").alias("decay"), F.count("*").alias("n"))
    return out.select("cluster", F.col("b.id").alias("id"), F.col("b.type").alias("type"), "tags", "importance", "decay", "n")


def apply_forgetting(memories: DataFrame, days: Column, least: float = 0.05) -> DataFrame:
    """Memories with their importance after `days` at their decay a day, and whether they go to the archive (below `least`)."""
    now = F.col("importance") * F.exp(-F.col("decay") * days)
    return memories.withColumn("importance_now", F.round(now, 6)).withColumn("archived", now < least)


# -- learned consensus


def vote_features(votes: DataFrame, key: str, checkers: list[str]) -> DataFrame:
    """key and a column for each checker: its confidence where it contradicts, minus half of it where it verifies, else 0."""
    value = F.when(F.col("verdict") == "contradicted", F.col("confidence")).when(F.col("verdict") == "verified", -F.col("confidence") / 2).otherwise(0.0)
    return votes.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("checker") == c, value)), F.lit(0.0)).alias(c) for c in checkers))


def fit_consensus(features: DataFrame, checkers: list[str], label: str, penalty: float = 0.01) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression (L2 penalty, no scaling) on the features, fitted on the executors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    own = VectorAssembler(inputCols=checkers, outputCol="_x", handleInvalid="skip").transform(features).select("_x", F.col(label).cast("double").alias("_y"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=penalty, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(own)
    return [float(w) for w in model.coefficients], float(model.intercept)


def score_consensus(features: DataFrame, checkers: list[str], weights: list[float], bias: float) -> DataFrame:
    """features with the probability of a hallucination: one column expression."""
    z = F.lit(bias)
    for c, w in zip(checkers, weights, strict=True):
        z = z + F.col(c) * w
    return features.withColumn("probability", F.round(1 / (1 + F.exp(-z)), 4))
