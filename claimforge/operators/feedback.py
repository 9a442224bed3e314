"""User feedback, audit logs and evaluation: statistics, corrections, latest records, root causes, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feedback_stats(feedback: DataFrame, detected: str = "detected_verdict", said: str = "user_verdict") -> DataFrame:
    """Counts by detected and user verdict, in all and for each detected verdict, with the share that agrees.

    Null verdicts never agree. One grouping-sets aggregate; an empty table gives no rows but the grand total of 0.
    """
    agrees = F.sum(F.when(F.col(detected) == F.col(said), 1).otherwise(0))
    return feedback.groupingSets([[], [F.col(detected)], [F.col(detected), F.col(said)]], F.col(detected), F.col(said)).agg(F.count("*").alias("n"), F.round(agrees / F.count("*"), 6).alias("agreement"), F.grouping_id().cast("int").alias("grouping"))


def disagreed_claims(feedback: DataFrame, claim: str = "claim", detected: str = "detected_verdict", said: str = "user_verdict") -> DataFrame:
    """Different claims on which a user disagreed; a null verdict disagrees with nothing."""
    return feedback.where(F.col(detected) != F.col(said)).select(claim).distinct()


def approve_corrections(feedback: DataFrame, claim: str = "claim", correction: str = "correction", least: int = 2) -> DataFrame:
    """The most frequent correction of each claim with `least` or more in all; ties go to the smaller. Nulls and empty ones don't count."""
    own = feedback.where(F.coalesce(F.col(correction), F.lit("")) != "").groupBy(claim, correction).agg(F.count("*").alias("n"))
    by = own.groupBy(claim).agg(F.min_by(F.struct(correction, "n"), F.struct((-F.col("n")).alias("o"), correction)).alias("b"), F.sum("n").alias("n_all")).where(F.col("n_all") >= least)
    return by.select(claim, F.col(f"b.{correction}").alias(correction), F.col("b.n").alias("n"), "n_all")


def latest_record(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key by `order`; partial maxima are taken before anything is shuffled. Equal rows count once."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def compliance_report(audit: DataFrame, kind: str, ts: str, operator: str) -> DataFrame:
    """Events by kind, by hour and in all, with the number of different operators; `section` names the grouping."""
    own = audit.withColumn("_hour", F.date_trunc("hour", ts))
    out = own.groupingSets([[], [F.col(kind)], [F.col("_hour")]], F.col(kind), F.col("_hour")).agg(F.count("*").alias("n"), F.count_distinct(operator).alias("n_operators"), F.grouping_id().alias("_g"))
    section = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "kind").otherwise("hour")
    return out.select(section.alias("section"), F.col(kind).alias("kind"), F.col("_hour").alias("hour"), "n", "n_operators")


def error_root_causes(samples: DataFrame, causes: tuple[tuple[str, Column], ...], by: str, least: int = 3) -> DataFrame:
    """Wrong samples (boolean predicted and actual) by checker and first cause that holds, with shares; small cells go."""
    cause = F.coalesce(*(F.when(c, F.lit(n)) for n, c in causes), F.lit("other"))
    wrong = samples.where(F.col("predicted") != F.col("actual")).withColumn("kind", F.when(F.col("predicted"), "FP").otherwise("FN")).withColumn("cause", cause)
    own = wrong.groupBy(by, "kind", "cause").agg(F.count("*").alias("n"))
    return own.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6)).where(F.col("n") >= least)


def baseline_compare(snapshots: DataFrame, order: str, score: str, worse: float = 0.9) -> DataFrame:
    """Each snapshot against the best before it: degraded under `worse` of it, and the trend from the one before.

    One row per snapshot of a series that is small by its nature (one a run). Null scores compare with nothing.
    """
    w = Window.orderBy(order)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag(score).over(w)
    trend = F.when(F.col(score) > last, "up").when(F.col(score) < last, "down").when(last.isNotNull(), "same")
    return snapshots.select(order, F.round(score, 6).alias(score), F.round(best, 6).alias("best_before"), F.coalesce(F.col(score) < worse * best, F.lit(False)).alias("degraded"), trend.alias("trend"))


def trace_summary(spans: DataFrame, by: str, duration: str, failed: Column) -> DataFrame:
    """Mean, exact p50 and p99, maximum and error share of spans for each service."""
    from claimforge.operators.metrics import exact_quantiles

    rest = spans.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(duration), 6).alias("avg"), F.round(F.max(duration), 6).alias("max"), F.round(F.avg(failed.cast("int")), 6).alias("error_rate"))
    q = exact_quantiles(spans, [by], duration, {"p50": 0.5, "p99": 0.99}).select(F.col(by).alias("_by"), F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))
    return rest.join(q, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def log_stats(log: DataFrame, kind: str, verdict: str, confidence: str, claim: str) -> DataFrame:
    """For each kind of log row: rows, different claims, mean confidence, and the number of each verdict as a sorted text."""
    by = log.groupBy(kind, verdict).agg(F.count("*").alias("n"), F.sum(confidence).alias("c"))
    rest = log.groupBy(kind).agg(F.count_distinct(claim).alias("n_claims"))
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce(verdict, F.lit("none")), F.col("n").cast("string")))), ",")
    out = by.groupBy(kind).agg(F.sum("n").alias("n"), F.round(F.sum("c") / F.sum("n"), 6).alias("mean_confidence"), parts.alias("verdicts"))
    return out.join(rest, kind)


def should_alert(results: DataFrame, verdict: str = "verdict", confidence: str = "confidence", least: float = 0.7) -> DataFrame:
    """Contradicted results of over `least` confidence."""
    return results.where((F.col(verdict) == "contradicted") & (F.col(confidence) > least))
