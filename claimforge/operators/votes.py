"""Votes of checkers on (claim, fact): weighted, majority and Borda decisions, consensus, truth score, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _of(verdict: str, value: Column) -> Column:
    return F.when(F.col("verdict") == verdict, value).otherwise(0.0)


def _sums(votes: DataFrame, by: list[str], order: str | None, **sums: Column) -> DataFrame:
    """Sums of doubles by key. With order, a unique column, rows are added in that order, so that the last bits, which can
    decide ties, are the same however Spark deals the rows out; a key's rows are sorted and streamed, not held."""
    if order is None:
        return votes.groupBy(*by).agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    line = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = votes.select(*by, F.col(order).alias("_o"), F.struct(*(F.sum(x).over(line).alias(n) for n, x in sums.items())).alias("_s"))
    return run.groupBy(*by).agg(F.max_by("_s", "_o").alias("_s")).select(*by, "_s.*")


def decide_weighted(votes: DataFrame, keys: list[str]) -> DataFrame:
    """hallucination score, and the winner: most weight times confidence among weights of 0.85 or more, else among all.

    A contradiction of little weight and confidence is uncertain. Ties go to the checker of the smaller name. Weights and
    confidences count to six places and are summed up as decimals, so the score doesn't depend on the rows' order.
    """
    w, c = F.col("weight"), F.col("confidence")
    dw, dc = (x.cast("decimal(10,6)") for x in (w, c))
    total = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, dw * dc).otherwise(F.lit(0).cast("decimal(1,0)"))).cast("double")
    rank = F.struct((w < 0.85).alias("light"), (-w * c).alias("wc"), "checker", "verdict")
    best = F.min_by(F.struct("verdict", "confidence", "weight"), rank).alias("best")
    out = votes.groupBy(*keys).agg((total("contradicted") + 0.5 * total("uncertain")).alias("s"), F.sum(dw).cast("double").alias("w"), best)
    weak = (F.col("best.verdict") == "contradicted") & (F.col("best.weight") < 0.85) & (F.col("best.confidence") < 0.65)
    return out.select(*keys, (F.floor(F.when(F.col("w") == 0, 0.0).otherwise(F.col("s") / F.col("w")) * 1e6 + 0.5) / 1e6).alias("hallucination"), F.when(weak, "uncertain").otherwise(F.col("best.verdict")).alias("verdict"), F.when(weak, 0.5).otherwise(F.col("best.confidence")).alias("confidence"))


def verify_with_retrieval(results: DataFrame, checks: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """key, verdict, confidence, stage: results, with the verdict of several retrieved facts (checks) put in where a result is
    uncertain or less sure than `least`, and the other's confidence isn't lower. One row a key on either side."""
    other = checks.select(key, F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    own = results.select(key, "verdict", "confidence").join(other, key, "left")
    take = ((F.col("verdict") == "uncertain") | (F.col("confidence") < least)) & F.coalesce(F.col("_c") >= F.col("confidence"), F.lit(False))
    return own.select(key, F.when(take, F.col("_v")).otherwise(F.col("verdict")).alias("verdict"), F.when(take, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"), F.when(take, "retrieval").otherwise("first").alias("stage"))


def vote_majority(votes: DataFrame, keys: list[str], least: int = 2, order: str | None = None) -> DataFrame:
    """The verdict of most weight; one that isn't clear and has a contradiction is uncertain, few voters abstain.

    Here and below, order is a column in whose order a key's weights are added up; see _sums.
    """
    names = ("contradicted", "uncertain", "unverifiable", "verified")
    own = _sums(votes, keys, order, n=F.lit(1), all=F.col("weight"), **{n: _of(n, F.col("weight")) for n in names})
    top = F.greatest(*names)
    first = F.coalesce(*(F.when(F.col(n) == top, F.lit(n)) for n in names))
    verdict = F.when(F.col("n") < least, "unverifiable").when((top / F.col("all") < 0.5) & (F.col("contradicted") > 0), "uncertain").otherwise(first)
    return own.select(*keys, verdict.alias("verdict"), F.round(top / F.col("all"), 6).alias("share"))


def vote_weighted(votes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The verdict of most weight times confidence, and its share of all; an unclear contradiction is made uncertain.

    Of the votes on the winning verdict the mean confidence, weighted by weight times confidence, is its strength. A
    contradiction under a strength of 0.4 is uncertain. Ties go to the smaller verdict name; no weight at all is unverifiable.
    """
    wc = F.col("weight") * F.col("confidence")
    by = _sums(votes, [*keys, "verdict"], order, s=wc, c=wc * F.col("confidence"))
    parts = F.array_sort(F.collect_list(F.struct("verdict", "s")))  # a row for each verdict
    own = by.groupBy(*keys).agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"]).alias("all"), F.min_by(F.struct("verdict", "s", "c"), F.struct((-F.col("s")).alias("o"), "verdict")).alias("top"))
    strength = F.col("top.c") / F.col("top.s")
    verdict = F.when(F.col("all") <= 0, "unverifiable").when((F.col("top.verdict") == "contradicted") & (strength <= 0.4), "uncertain").otherwise(F.col("top.verdict"))
    return own.select(*keys, verdict.alias("verdict"), F.round(F.when(F.col("all") > 0, F.col("top.s") / F.col("all")).otherwise(0.0), 6).alias("share"))


def compare_vote_modes(votes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The verdicts of the three ways to vote side by side, and whether they agree."""
    modes = (("majority", vote_majority(votes, keys, order=order)), ("weighted", vote_weighted(votes, keys, order)), ("borda", vote_borda(votes, keys)))
    out = None
    for name, mode in modes:
        own = mode.select(*keys, F.col("verdict").alias(name))
        out = own if out is None else out.join(own, keys)
    return out.withColumn("agree", (F.col("majority") == F.col("weighted")) & (F.col("weighted") == F.col("borda")))


def vote_borda(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Points n - rank by weight times confidence, summed by verdict; the verdict of most points, ties by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("weight") * F.col("confidence")), "checker", "verdict")
    own = votes.withColumn("_p", F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    by = own.groupBy(*keys, "verdict").agg(F.sum("_p").alias("p"), F.max("_n").alias("n"))
    by = by.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "verdict"))).where("_r = 1")
    return by.select(*keys, "verdict", F.round(F.col("p") / (F.col("n") * (F.col("n") + 1) / 2), 6).alias("share"))


def consensus_score(votes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Weighted contradiction less half the verification over all weight, in [0, 1], and its band."""
    w, c = F.col("weight"), F.col("confidence")
    own = _sums(votes, keys, order, bad=_of("contradicted", w * c), good=_of("verified", w * c), all=w)
    own = own.select(*keys, ((F.col("bad") - 0.5 * F.col("good")) / F.greatest(F.col("all"), F.lit(1.0))).alias("s"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s")))
    return own.select(*keys, F.round(s, 6).alias("score"), F.when(s >= 0.6, "contradicted").when(s >= 0.3, "likely_contradicted").when(s >= 0.1, "uncertain").otherwise("verified").alias("band"))


def aggregate_checks(checks: DataFrame, key: str) -> DataFrame:
    """The best check of each claim: verified before contradicted before uncertain, then by confidence."""
    order = F.when(F.col("verdict") == "verified", 3).when(F.col("verdict") == "contradicted", 2).when(F.col("verdict") == "uncertain", 1).otherwise(0)
    return checks.groupBy(key).agg(F.max(F.struct(order.alias("o"), F.col("confidence").alias("c"), F.col("verdict").alias("v"))).alias("b")).select(key, F.col("b.v").alias("verdict"), F.col("b.c").alias("confidence"))


def truth_score(checks: DataFrame, key: str, retrieval: str = "retrieval") -> DataFrame:
    """0.4 retrieval + 0.3 mean confidence + 0.3 consistency of the verdicts, and its band."""
    by = checks.groupBy(key, "verdict").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.max(retrieval).alias("r"))
    own = by.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("kinds"), F.sum("c").alias("c"), F.max("r").alias("r"))
    consistency = F.when(F.col("kinds") == 1, 0.9).when(F.col("kinds") == F.col("n"), 0.3).otherwise(0.3 + 0.6 * F.col("top") / F.col("n"))
    s = F.round(0.4 * F.col("r") + 0.3 * F.col("c") / F.col("n") + 0.3 * consistency, 6)
    return own.select(key, s.alias("score"), F.when(s >= 0.75, "high").when(s >= 0.4, "medium").otherwise("low").alias("level"))


def confusion_matrix(rows: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, FN, TN of boolean `predicted` against `actual`, in all and by each column of `by`, in one pass."""
    n = lambda p, a: F.sum(F.when((F.col("predicted") == p) & (F.col("actual") == a), 1).otherwise(0))
    out = rows.groupingSets([[], *([F.col(b)] for b in by)], *map(F.col, by)).agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    ratio = lambda x, y: F.round(F.when(y == 0, 0.0).otherwise(x / y), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return out.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def checker_performance(votes: DataFrame, checker: str = "checker") -> DataFrame:
    """For each checker, with boolean `actual` (the claim is false): counts, F1 and a suggested weight of 0.3 to 0.95."""
    hit, bad = F.col("verdict") == "contradicted", F.col("actual")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    own = votes.groupBy(checker).agg(n(hit & bad).alias("tp"), n(hit & ~bad).alias("fp"), n(~hit & bad).alias("fn"), n(~hit & ~bad).alias("tn"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return own.withColumn("f1", F.round(f1, 6)).withColumn("weight", F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.95), f1)), 6))


def checker_coverage(pairs: DataFrame, votes: DataFrame, key: str) -> DataFrame:
    """Hits, misses and hit rate of each checker over all pairs; under a tenth is weak."""
    total = pairs.agg(F.count("*").alias("n_pairs"))
    own = votes.groupBy("checker").agg(F.count_distinct(key).alias("hits"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).crossJoin(F.broadcast(total))  # one row
    rate = F.round(F.col("hits") / F.col("n_pairs"), 6)
    return own.select("checker", "hits", (F.col("n_pairs") - F.col("hits")).alias("misses"), rate.alias("hit_rate"), "mean_confidence", (rate < 0.1).alias("weak"))
