"""Service metrics over request rows: snapshots, trends, histograms, objectives, rates, billing."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.sources.staging import staged


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float | Callable[[Column], Column]]) -> DataFrame:
    """Interpolated quantiles of each group, exact, without one task that holds a group's values.

    Equal values of a group are counted first. The different ones are dealt into sorted ranges; a value's rank is the sum of
    the counts before it, in its range and in the ranges before (one number for each range and group). So neither one
    large group nor outliers nor ties make a large task. A share may be a function from a group's count to a rank from 0
    instead. Null values don't count; a group without values has null
    quantiles. An empty table gives no rows.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = staged(own.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("_part").alias("_b"), F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_t").over(Window.partitionBy(*by)).alias("_n"))
    match = F.col("_part") == F.col("_b")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    inside = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.withColumn("_before", F.coalesce(inside, F.lit(0))).join(bases, match).withColumn("_before", F.col("_before") + F.col("_base"))
    picks = []
    for name, q in shares.items():
        place = q(F.col("_n")) if callable(q) else F.lit(q) * (F.col("_n") - 1)
        at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")), F.col("_v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        picks.append((low + F.max(place - F.floor(place)) * (high - low)).alias(name))
    out = ranked.groupBy(*by).agg(*picks)
    if not by:
        return out
    renamed = out.select(*(F.col(c).alias(f"_q_{c}") for c in by), *shares)
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return df.select(*by).distinct().join(renamed, match, "left").select(*by, *shares)


def snapshot(metrics: DataFrame, value: str, status: str, by: list[str]) -> DataFrame:
    """Count, mean, exact percentiles and error share of each group."""
    rest = metrics.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("avg"), F.round(F.avg(F.when(F.col(status) == "error", 1.0).otherwise(0.0)), 6).alias("error_rate"))
    p = exact_quantiles(metrics, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*(F.col(c).alias(f"_{c}") for c in by), *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rest.join(p, same).select(*by, "n", "avg", "p50", "p95", "p99", "error_rate")


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """Interpolated percentiles, mean and sample deviation."""
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    rest = df.agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"))
    return exact_quantiles(df, [], value, names).select(*(F.round(c, 6).alias(c) for c in names)).crossJoin(rest)  # one row each


def hourly_trend(metrics: DataFrame, ts: str, status: str, value: str) -> DataFrame:
    return metrics.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"), F.sum(F.when(F.col(status) == "error", 1).otherwise(0)).alias("errors"), F.round(F.avg(value), 6).alias("avg_value"))


def day_hour_rollup(metrics: DataFrame, ts: str) -> DataFrame:
    own = metrics.select(F.date_trunc("day", ts).alias("day"), F.hour(ts).alias("hour"))
    return own.rollup("day", "hour").agg(F.count("*").alias("n"))


def latency_histogram(df: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts of values up to each bound; the last row is all of them."""
    return df.agg(*(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("all")).select(
        F.explode(F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))).alias("x")
    ).select("x.*")


def slo_report(metrics: DataFrame, status: str, by: str, target: float = 0.8) -> DataFrame:
    """Share of good requests, burn of the error budget and the band of alert."""
    own = metrics.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(F.col(status) != "error", 1.0).otherwise(0.0)).alias("good"))
    burn = F.round((1 - F.col("good")) / (1 - target), 6)
    return own.select(by, "n", F.round("good", 6).alias("compliance"), burn.alias("burn"), F.when(burn >= 2, "critical").when(burn >= 1, "warning").otherwise("ok").alias("alert"))


def throughput(metrics: DataFrame, ts: str, key: str, seconds: int = 60) -> DataFrame:
    """Requests of the key in the `seconds` up to each request, per second."""
    w = Window.partitionBy("user").orderBy("_s").rangeBetween(-seconds, 0)
    own = metrics.select(key, F.col("user_id").alias("user"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s"))
    return own.select(key, F.round(F.count("*").over(w) / seconds, 6).alias("per_second"))


def bot_rate(metrics: DataFrame, ts: str, user: str, most: int, seconds: int) -> DataFrame:
    """Users with more than `most` requests within `seconds`, and the most they made."""
    w = Window.partitionBy(user).orderBy("_s").rangeBetween(-seconds + 1, 0)
    own = metrics.select(user, F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s")).withColumn("n", F.count("*").over(w))
    return own.groupBy(user).agg(F.max("n").alias("peak")).where(F.col("peak") > most)


def usage_billing(usage: DataFrame, account: str, tokens: Column, plans: DataFrame, plan: str) -> DataFrame:
    """Requests and tokens of each account against its plan's quota, what is left, and what is over."""
    own = usage.groupBy(account, plan).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))
    out = own.join(F.broadcast(plans), plan)  # one row for each plan
    return out.select(account, plan, "requests", "tokens", F.greatest(F.lit(0), F.col("quota") - F.col("tokens")).alias("remaining"), (F.col("tokens") > F.col("quota")).alias("over"))


def cost_projection(daily: DataFrame, day: str, tokens: str, price: float, hosting: float, limit: float) -> DataFrame:
    """Daily and running cost and whether the limit is reached; one row per day of a bounded calendar."""
    own = daily.withColumn("cost", F.col(tokens) / 1000 * price + hosting)
    own = own.withColumn("total", F.sum("cost").over(Window.orderBy(day)))
    return own.select(day, F.round("cost", 6).alias("cost"), F.round("total", 6).alias("total"), (F.col("total") >= limit).alias("reached"))


def _folded(df: DataFrame, key: str, order: list[str], begin, step, schema: str) -> DataFrame:
    """Rows of df with what step(state, ts) says of each, in the order of `order` inside a key; begin() is a key's first state.

    Keys are sorted inside partitions and read as a stream, so a key with very many rows takes time but no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, started = None, None, False
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[order[0]], strict=True):
                if not started or k != last:
                    last, state, started = k, begin(), True
                out.append(step(state, t))
            yield batch.assign(accepted=pd.Series(out, batch.index, dtype=bool))

    own = df.select(key, *order).repartition(key).sortWithinPartitions(key, *order)
    return own.mapInPandas(run, schema)


def _folded_schema(df: DataFrame, *columns: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{c} {kinds[c]}" for c in columns), "accepted boolean"])


def _pointers(t: np.ndarray, s: np.ndarray, cooldown: float) -> np.ndarray:
    """For each time of t the place of the first start in s that is `cooldown` or more later; their number if none is."""
    k = np.searchsorted(s, t + cooldown)
    while (early := (k < len(s)) & (s[np.minimum(k, len(s) - 1)] - t < cooldown)).any():  # the sum was rounded
        k[early] += 1
    while (late := (k > 0) & (s[np.maximum(k - 1, 0)] - t >= cooldown)).any():
        k[late] -= 1
    return k


def alert_cooldown(alerts: DataFrame, rule: str, ts: str, cooldown: float, blocks: int = 64, start: str | None = None) -> DataFrame:
    """Alerts that fire: the first of a rule, then each at least `cooldown` seconds after the last that fired. No nulls.

    With `start` an alert began before its time, and that beginning must be `cooldown` or more after the last; a later
    alert doesn't begin earlier.

    Time is cut into blocks of `blocks` cooldowns, so a rule with very many alerts is split. In a block each alert points
    to the next that could fire after it, which tells for every alert that may come first in it how the block ends. Only
    such alerts, those within a cooldown of the block's beginning and one more, are folded along the rule's blocks; then
    every block is read again with the last alert before it.
    """
    own = alerts.select(F.col(rule).alias("k"), F.col(ts).cast("double").alias("t"), F.col(start or ts).cast("double").alias("s"))
    if cooldown <= 0:
        return alerts.select(rule, ts)
    own = own.withColumn("b", F.floor(F.col("t") / (blocks * cooldown)))
    kind = dict(own.dtypes)["k"]

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        t, s = np.sort(group["t"].to_numpy()), np.sort(group["s"].to_numpy())
        step, out = _pointers(t, s, cooldown), np.empty(len(t))
        for i in range(len(t) - 1, -1, -1):
            out[i] = t[i] if step[i] == len(t) else out[step[i]]
        begin = float(group["b"].iloc[0]) * blocks * cooldown
        n = min(len(t), int(np.searchsorted(s, begin + cooldown, "right")) + 1)
        return pd.DataFrame({"k": [group["k"].iloc[0]], "b": [group["b"].iloc[0]], "firsts": [s[:n].tolist()], "lasts": [out[:n].tolist()]})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        last, before = -math.inf, []
        for firsts, lasts in group.sort_values("b")[["firsts", "lasts"]].itertuples(index=False):
            before.append(last)
            fires = np.flatnonzero(np.asarray(firsts) - last >= cooldown)
            last = lasts[fires[0]] if len(fires) else last
        return pd.DataFrame({"k": [group["k"].iloc[0]] * len(before), "b": np.sort(group["b"].to_numpy()), "last": before})

    def fired(group: pd.DataFrame) -> pd.DataFrame:
        t, s, last = np.sort(group["t"].to_numpy()), np.sort(group["s"].to_numpy()), float(group["last"].iloc[0])
        step, out = _pointers(t, s, cooldown), []
        fits = np.flatnonzero(s - last >= cooldown)
        at = int(fits[0]) if len(fits) else len(t)
        while at < len(t):
            out.append(t[at])
            at = int(step[at])
        return pd.DataFrame({"k": pd.Series([group["k"].iloc[0]] * len(out), dtype=object), "t": pd.Series(out, dtype=float)})

    by_block = own.groupBy("k", "b").applyInPandas(ends, f"k {kind}, b long, firsts array<double>, lasts array<double>")
    before = staged(by_block.groupBy("k").applyInPandas(fold, f"k {kind}, b long, last double"), "blocks")
    out = own.join(before, ["k", "b"]).groupBy("k", "b").applyInPandas(fired, f"k {kind}, t double")
    return out.select(F.col("k").alias(rule), F.col("t").alias(ts))


def token_bucket(events: DataFrame, key: str, ts: str, order: str, rate: float, burst: float, cost: float = 1.0) -> DataFrame:
    """Whether each request is accepted: tokens refill at `rate` a second up to `burst`. Order is (ts, order). No nulls."""

    def step(state: list, t: float) -> bool:
        tokens, last = state or (burst, t)
        tokens = min(burst, tokens + (t - last) * rate)
        ok = tokens >= cost
        state[:] = [tokens - cost if ok else tokens, t]
        return ok

    return _folded(events, key, [ts, order], list, step, _folded_schema(events, key, ts, order))


def sliding_rate_limit(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int = 60) -> DataFrame:
    """Whether each request is accepted: under `most` accepted ones in the last `seconds`; rejected ones don't count. No nulls.

    A key's state is the at most `most` times of its accepted requests.
    """

    def step(state: deque, t: float) -> bool:
        while state and state[0] <= t - seconds:
            state.popleft()
        ok = len(state) < most
        if ok:
            state.append(t)
        return ok

    return _folded(events, key, [ts, order], deque, step, _folded_schema(events, key, ts, order))


def exponential_ban(failures: DataFrame, key: str, ts: str, order: str, most: int = 3, window: int = 300, first: int = 300, longest: int = 86400) -> DataFrame:
    """Failures (key, ts, order) that start a ban: `most` within `window` seconds while not banned; each ban is six times
    as long as the one before, `longest` at most. Failures during a ban don't count. No nulls."""

    def step(state: dict, t: float) -> bool:
        if t < state.get("until", t):
            return False
        held = [x for x in state.get("held", []) if x > t - window] + [t]
        bans = len(held) >= most
        if bans:
            size = min(longest, first * 6 ** state.get("n", 0))
            state.update(until=t + size, n=state.get("n", 0) + 1, held=[])
        else:
            state["held"] = held
        return bans

    return _folded(failures, key, [ts, order], dict, step, _folded_schema(failures, key, ts, order)).where("accepted").drop("accepted")


def verify_chain(audit: DataFrame) -> DataFrame:
    """Rows (id, payload, hash, prev_hash) whose hash isn't that of their content or whose link is broken.

    The order is range partitioned by id; inside a partition rows are compared with the row before, and across
    partitions only each one's first and last rows are.
    """
    own = audit.repartitionByRange("id").withColumn("part", F.spark_partition_id())
    own = own.withColumn("good", F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256) == F.col("hash"))
    inside = own.withColumn("before", F.lag("hash").over(Window.partitionBy("part").orderBy("id")))
    edges = own.groupBy("part").agg(F.min_by("id", "id").alias("id"), F.max_by("hash", "id").alias("last"))
    edges = edges.select("id", F.lag("last").over(Window.orderBy("part")).alias("edge"))  # one row for each partition
    out = inside.join(edges, "id", "left").withColumn("link", F.coalesce("before", "edge"))
    return out.where(~F.col("good") | (F.col("link").isNotNull() & (F.col("link") != F.col("prev_hash")))).select("id", "good")

