"""Structured Streaming jobs: windows with watermarks, idempotent requests, sessions, and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_hourly(events: DataFrame, ts: str = "ts", status: str = "event_type", value: str = "value", late: str = "2 hours") -> DataFrame:
    """Tumbling hours: requests, errors, mean value. Rows later than the watermark are dropped."""
    own = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"))
    return own.agg(F.count("*").alias("n"), F.sum(F.when(F.col(status) == "error", 1).otherwise(0)).alias("errors"), F.round(F.avg(value), 6).alias("avg_value")).select(F.col("w.start").alias("hour"), "n", "errors", "avg_value")


def stream_sliding(events: DataFrame, ts: str = "ts", value: str = "value", size: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    own = events.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"))
    return own.agg(F.count("*").alias("n"), F.percentile_approx(value, F.lit(0.95)).alias("p95")).select(F.col("w.start").alias("start"), "n", "p95")


def stream_dedupe(requests: DataFrame, key: str, ts: str, ttl: str = "5 minutes") -> DataFrame:
    """The first request of each id within the time to live."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def stream_session_window(turns: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    own = turns.withWatermark(ts, gap).groupBy(key, F.session_window(ts, gap).alias("w"))
    return own.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_token_bucket(events: DataFrame, key: str, ts: str, order: str, rate: float, burst: float, cost: float = 1.0, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Whether each request is accepted, with the bucket of a key as state. It expires when the watermark
    has passed the key's last request by `idle`.

    Inside a micro-batch requests are taken in the order (ts, order); a later batch's requests follow.
    """
    seconds = pd.Timedelta(idle).total_seconds()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        own = pd.concat(list(frames)).sort_values([ts, order])
        ok = []
        for t in own[ts].map(lambda x: x.timestamp()):
            if last is not None:
                tokens = min(burst, tokens + max(0.0, t - last) * rate)
            last = t if last is None else max(last, t)
            ok.append(tokens >= cost)
            tokens -= cost if ok[-1] else 0
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: own[key], ts: own[ts], order: own[order], "accepted": ok})

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {ts} {kinds[ts]}, {order} {kinds[order]}, accepted boolean"
    return events.select(key, ts, order).withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def insert_batches(stream: DataFrame, store: str, checkpoint: str, text: str = "fact"):
    """Writes each micro-batch's unseen facts to the store's Parquet folder; the checkpoint keeps what was read."""
    from claimforge.operators.kb import insert_new

    def insert(batch: DataFrame, epoch: int) -> None:
        try:
            known = batch.sparkSession.read.parquet(store)
        except Exception as e:  # the first batch has no store yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.limit(0)
        insert_new(known, batch, text).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and writes Parquet."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
