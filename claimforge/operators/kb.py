"""The fact base: inserts, manifests, merges, conflicts, graph queries, trust and provenance, generated facts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimforge.functions.text import half_life, stable_hash
from claimforge.sources.staging import staged


def dedupe_exact(facts: DataFrame, text: str = "fact") -> DataFrame:
    """One row for each different text: its hash, the text, how often it occurs, and in how many sources."""
    return facts.groupBy(stable_hash(F.col(text)).alias("hash")).agg(F.min(text).alias(text), F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


def insert_new(facts: DataFrame, batch: DataFrame, text: str = "fact") -> DataFrame:
    """Facts of the batch that the store lacks, each once."""
    own = batch.groupBy(stable_hash(F.col(text)).alias("hash")).agg(F.min(text).alias(text))
    return own.join(facts.select(stable_hash(F.col(text)).alias("hash")).distinct(), "hash", "left_anti")


def manifest(kb: DataFrame, key: str, fact: str, source: str) -> DataFrame:
    """A hash of each entry's facts and source, whatever their order."""
    return kb.groupBy(key).agg(F.sha2(F.concat_ws("|", F.concat_ws("|", F.array_sort(F.collect_set(fact))), F.min(source)), 256).alias("entry_hash"))


def diff_manifest(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    n, o = new.select(key, F.col("entry_hash").alias("_n")), old.select(key, F.col("entry_hash").alias("_o"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_n") == F.col("_o"), "unchanged").otherwise("modified")
    return n.join(o, key, "full_outer").select(key, change.alias("change"))


def merge_kb(kbs: list[DataFrame], key: str, fact: str) -> DataFrame:
    """Facts of every key, those of earlier bases first, without repeats: key, pos, fact."""
    every = None
    for k, kb in enumerate(kbs):
        own = kb.select(key, fact, F.lit(k).alias("_kb"))
        every = own if every is None else every.unionByName(own)
    once = every.groupBy(key, fact).agg(F.min("_kb").alias("_kb"))
    return once.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_kb", fact)) - 1).alias("pos"), fact)


def fact_stats(facts: DataFrame, *by: str) -> DataFrame:
    """Numbers of facts and different texts, in all and for each prefix of the columns."""
    return facts.rollup(*by).agg(F.count("*").alias("n"), F.count_distinct("fact").alias("n_distinct"))


def find_conflicts(triples: DataFrame) -> DataFrame:
    """Pairs of (hash, subj, rel, obj, negation) that disagree: one negates the other's value, or values differ.

    Equal values of a subject and relation are joined once, so a relation that many facts repeat stays small.
    """
    own = triples.groupBy("subj", "rel", "obj", "negation").agg(F.min("hash").alias("hash"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.subj") == F.col("b.subj")) & (F.col("a.rel") == F.col("b.rel")) & (F.col("a.hash") < F.col("b.hash")))
    kind = F.when((F.col("a.negation") != F.col("b.negation")) & (F.col("a.obj") == F.col("b.obj")), "direct_negation").when(~F.col("a.negation") & ~F.col("b.negation") & (F.col("a.obj") != F.col("b.obj")), "value_conflict")
    return pairs.select(F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"), "a.subj", "a.rel", kind.alias("conflict")).where("conflict is not null")


def kg_query(triples: DataFrame, subj: str | None = None, rel: str | None = None, obj: str | None = None) -> DataFrame:
    for name, value in (("subj", subj), ("rel", rel), ("obj", obj)):
        triples = triples if value is None else triples.where(F.col(name) == value)
    return triples


def neighbors(triples: DataFrame) -> DataFrame:
    """Both directions of every edge; the way back is marked."""
    back = triples.select(F.col("obj").alias("node"), F.concat(F.lit("<-"), "rel").alias("rel"), F.col("subj").alias("other"))
    return triples.select(F.col("subj").alias("node"), "rel", F.col("obj").alias("other")).union(back).distinct()


def apply_feedback(pairs: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """The verdict of the latest applied feedback of a pair replaces its own."""
    latest = feedback.where("applied = 1").groupBy(*keys).agg(F.max_by("user_verdict", "id").alias("_v"))
    return pairs.join(latest, keys, "left").withColumn("verdict", F.coalesce("_v", "verdict")).drop("_v")


def propagate_trust(edges: DataFrame, roots: DataFrame, hops: int = 3, decay: float = 0.7) -> DataFrame:
    """Trust of each node in each root's reach: the weight of a direct edge, else the product along the path times decay
    for each further hop; the fewest hops count, then the largest product. Each round joins nodes, not paths."""
    found = edges.join(roots.select(F.col("node").alias("src")), "src").groupBy(F.col("src").alias("root"), F.col("dst").alias("node")).agg(F.max("weight").alias("trust")).withColumn("hops", F.lit(1))
    last = found
    for k in range(2, hops + 1):
        step = last.join(edges, F.col("node") == F.col("src")).where(F.col("dst") != F.col("root")).groupBy("root", F.col("dst").alias("node")).agg(F.max(F.col("trust") * F.col("weight") * decay).alias("trust")).withColumn("hops", F.lit(k))
        last = step.join(found.select("root", "node"), ["root", "node"], "left_anti")
        found = found.unionByName(last)
    return found.withColumn("trust", F.round("trust", 6))


def trust_path(edges: DataFrame, roots: DataFrame, hops: int = 3, decay: float = 0.7) -> DataFrame:
    """root, node, hops, trust and the path (array of nodes) by which propagate_trust gets it; no node comes twice in a path.

    Of paths with the fewest hops the one of the largest product counts, of equal ones the first in order. edges: src, dst,
    weight; each round extends one path for each root and node that was reached last.
    """
    own = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    first = own.join(roots.select(F.col("node").alias("src")).distinct(), "src")
    last = staged(first.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("hops"), F.col("weight").alias("trust"), F.array("src", "dst").alias("path")), "paths")
    found = last
    for k in range(2, hops + 1):
        step = last.join(own, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("root", F.col("dst").alias("node"), (F.col("trust") * F.col("weight") * decay).alias("trust"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("root", "node").agg(F.min_by(F.struct("trust", "path"), F.struct((-F.col("trust")).alias("t"), "path")).alias("b"))
        best = best.select("root", "node", F.lit(k).alias("hops"), "b.trust", "b.path").join(found.select("root", "node"), ["root", "node"], "left_anti")
        last = staged(best, "paths")
        found = found.unionByName(last)
    return found.withColumn("trust", F.round("trust", 6))


def source_reputation(checks: DataFrame, source: str, accurate: Column) -> DataFrame:
    return checks.groupBy(source).agg(F.count("*").alias("n"), F.round((F.sum(accurate.cast("int")) + 1) / (F.count("*") + 2), 6).alias("reputation"))


def source_pollution(occurrences: DataFrame, fact: str, source: str) -> DataFrame:
    """Facts by sources and occurrences; many occurrences from few sources are suspicious."""
    own = occurrences.groupBy(fact).agg(F.count("*").alias("n"), F.count_distinct(source).alias("n_sources"))
    ratio = F.col("n") / F.col("n_sources")
    return own.withColumn("ratio", F.round(ratio, 6)).withColumn("suspicious", (ratio > 5) & (F.col("n_sources") < 3))


def trust_now(records: DataFrame, score: Column, days: Column, half: Column, floor: Column) -> DataFrame:
    now = F.greatest(floor, half_life(score, days, half))
    return records.withColumn("trust_now", F.round(now, 6)).withColumn("needs_reverify", now < 0.5)


def trust_fold(events: DataFrame, key: str, order: list[str], delta: str, start: float = 0.5) -> DataFrame:
    """Score of each key after its events in order, each added and clipped to [0, 1].

    Additions with clips compose to one addition with clips, so each day of a key is folded first and then the days: no
    row holds a key's whole history. order begins with a timestamp, or a number, of which a thousand make a day. Null
    changes count as 0.
    """
    step = lambda s, d: F.struct((s["a"] + d).alias("a"), _clip(s["low"] + d).alias("low"), _clip(s["high"] + d).alias("high"))
    none = F.struct(F.lit(0.0).alias("a"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    timed = dict(events.dtypes)[order[0]].startswith(("timestamp", "date"))
    day = F.date_trunc("day", order[0]) if timed else F.floor(F.col(order[0]) / 1000)
    daily = events.groupBy(key, day.alias("_day")).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(delta).cast("double"), F.lit(0.0)).alias("_d")))).alias("_own"), F.count("*").alias("_n"))
    daily = daily.select(key, "_day", "_n", F.aggregate("_own", none, lambda s, x: step(s, x["_d"])).alias("_f"))
    days = F.array_sort(F.collect_list(F.struct("_day", "_f")))
    fold = F.aggregate(days, F.lit(start), lambda s, x: F.least(x["_f"]["high"], F.greatest(x["_f"]["low"], s + x["_f"]["a"])))
    return daily.groupBy(key).agg(F.round(fold, 6).alias("score"), F.sum("_n").alias("n_events"))


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def flow_path(flows: DataFrame, key: str, order: list[str], zone: str) -> DataFrame:
    """The zones that a key went through, in order."""
    own = F.array_sort(F.collect_list(F.struct(*order, zone)))
    return flows.groupBy(key).agg(F.concat_ws(">", F.transform(own, lambda x: x[zone])).alias("path"))


def range_label(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """The first range (start, end, label, rank) that holds the value; the ranges are a bounded parameter."""
    every = ranges.agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "label"))).alias("_ranges"))  # one row
    hit = F.get(F.filter("_ranges", lambda r: F.col(value).between(r["start"], r["end"])), F.lit(0))
    return df.crossJoin(F.broadcast(every)).select(*df.columns, hit["label"].alias("label"))


def generate_facts(entities: DataFrame, name: str, relation: str, value: str, values: DataFrame) -> DataFrame:
    """A true fact for each entity and a false one with every other value; values has few rows, its size is checked."""
    if values.limit(1001).count() > 1000:
        raise ValueError("values are crossed with all entities: at most 1,000")
    own = entities.crossJoin(F.broadcast(values.select(F.col(value).alias("_v"))))
    return own.select(name, F.concat(F.col(name), F.lit(f" {relation} "), "_v").alias("fact"), F.col("_v").eqNullSafe(F.col(value)).alias("label"))


def perturb_numbers(facts: DataFrame, key: str, text: str, offsets: tuple[int, ...] = (-10, -1, 1, 10)) -> DataFrame:
    """False facts: the first number of a fact moved by each offset; the rest of the text stays. Texts without one give none."""
    part = lambda k: F.regexp_extract(F.col(text), r"(?s)^([^0-9]*)([0-9]{1,9})(.*)$", k)
    own = facts.where(part(2) != "").select(key, part(1).alias("_a"), part(2).cast("long").alias("_n"), part(3).alias("_b"), F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    return own.select(key, "offset", F.concat("_a", (F.col("_n") + F.col("offset")).cast("string"), "_b").alias("fact"))


#: To these bases no composite number under 2**64 passes the Miller-Rabin test.
BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def is_prime(n: int) -> bool:
    """Exact for all 64-bit numbers, by the Miller-Rabin test to fixed bases."""
    if n < 2:
        return False
    for p in BASES:
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in BASES:
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def number_facts(numbers: DataFrame, n: str) -> DataFrame:
    """Facts of each different 64-bit number: even, square, prime, divisors (those of 2 to 9), leap_year and century.

    Nulls are left out; numbers under 2 aren't prime, and years under 1 have no century. Work a number is bounded: neither
    divisors nor factors are listed.
    """
    own = numbers.select(F.col(n).cast("long").alias(n)).where(F.col(n).isNotNull()).distinct()
    test = F.pandas_udf(lambda x: x.map(is_prime), "boolean")
    root = F.round(F.sqrt(F.greatest(F.col(n), F.lit(0)))).cast("decimal(19,0)")
    exact = root * root == F.col(n).cast("decimal(19,0)")  # the rounded root of a square is its root, below 2**63
    small = F.concat_ws(",", *(F.when(F.col(n) % d == 0, str(d)) for d in range(2, 10)))
    leap = ((F.col(n) % 4 == 0) & (F.col(n) % 100 != 0)) | (F.col(n) % 400 == 0)
    return own.select(n, (F.col(n) % 2 == 0).alias("even"), exact.alias("square"), test(n).alias("prime"), small.alias("divisors"), leap.alias("leap_year"), F.when(F.col(n) >= 1, F.floor((F.col(n) - 1) / 100).cast("long") + 1).alias("century"))


def primes_upto(spark: SparkSession, top: int, block: int = 1 << 20) -> DataFrame:
    """All primes up to `top` (10**12 at most) by a sieve in segments of `block` numbers; a task sieves segments one by one.

    Each task finds the primes up to the root of `top` by itself.
    """
    if top > 10**12:
        raise ValueError("at most 10**12")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = math.isqrt(max(top, 1))
        flags = np.ones(last + 1, bool)
        flags[:2] = False
        for p in range(2, math.isqrt(last) + 1):
            if flags[p]:
                flags[p * p :: p] = False
        base = np.flatnonzero(flags)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high = k * block, min((k + 1) * block, top + 1)
                own = np.ones(high - low, bool)
                own[: max(0, min(2 - low, len(own)))] = False
                for p in base[base * base < high].tolist():
                    own[max(p * p, -(-low // p) * p) - low :: p] = False
                yield pa.RecordBatch.from_arrays([pa.array(low + np.flatnonzero(own))], names=["prime"])

    return spark.range(0, max(0, top) // block + 1).mapInArrow(sieve, "prime long")


def adjacent_pairs(numbers: DataFrame, n: str) -> DataFrame:
    """Each different number with the next larger one (next). Ranges of numbers are paired inside, and by their first ones across."""
    own = staged(numbers.where(F.col(n).isNotNull()).select(n).distinct().repartitionByRange(n).withColumn("_part", F.spark_partition_id()), "ranges")
    edges = own.groupBy("_part").agg(F.min(n).alias("_first"))
    edges = edges.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_edge"))  # one row for each partition
    out = own.withColumn("_next", F.lead(n).over(Window.partitionBy("_part").orderBy(n))).join(F.broadcast(edges), "_part")
    return out.select(n, F.coalesce("_next", "_edge").alias("next")).where("next is not null")


def sample_balanced(samples: DataFrame, label: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """At most n samples of each label, in the order of a seeded hash: a sampling operator."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))))
    return samples.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
