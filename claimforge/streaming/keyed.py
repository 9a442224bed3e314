"""Keyed event-time state with several variables a key and timers: session drift, alerts with a cooldown, growing bans.

Rows wait in a key's buffer until the watermark has passed them; a timer then takes them in the order of (time, order), so
results don't depend on how rows came, as long as none is later than the watermark allows. They equal the batch operators
of the same names. State is in the checkpoint; a restarted query goes on where it stopped. The RocksDB state store is
needed: see keyed_state().
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that these streams need for the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Holds rows (at: microseconds, ord, values: doubles) of a key back until the watermark has passed them.

    A subclass has its own state variables (open), says what a row gives (step: a tuple or None, in the order of names), and
    may forget a key that has been idle for `idle` seconds (forget).
    """

    names: tuple[str, ...] = ()

    def __init__(self, idle: float | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "at long, ord long, vals array<double>")
        self.last = handle.getValueState("last", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, at: int, order: int, values: list[float]) -> tuple | None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        read = ((a, o, v) for frame in rows for a, o, v in zip(frame["at"], frame["ord"], frame["vals"], strict=True) if not (pd.isna(a) or pd.isna(o)))
        new = [(int(a), int(o), [float(x) for x in v]) for a, o, v in read]
        if new and key[0] is not None:
            self.buffer.appendList(new)
            self.handle.registerTimer(-(-min(new)[0] // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((a, o, list(v)) for a, o, v in self.buffer.get())
        due = [r for r in held if r[0] <= now]
        out = []
        for at, order, values in due:
            if self.idle is not None and self.last.exists() and at - self.last.get()[0] >= self.idle * 1e6:
                self.forget()
            self.last.update((at,))
            made = self.step(at, order, values)
            if made is not None:
                out.append((key[0], *made))
        if due:
            rest = held[len(due) :]
            self.buffer.put(rest) if rest else self.buffer.clear()
            if rest:
                self.handle.registerTimer(-(-rest[0][0] // 1000))
            elif self.idle is not None:
                self.handle.registerTimer(int(due[-1][0] // 1000 + self.idle * 1000) + 1)
        elif not held and self.idle is not None and self.last.exists() and now - self.last.get()[0] >= self.idle * 1e6:
            self.forget()
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", *self.names])

    def close(self) -> None:
        pass


class SessionDrift(InOrder):
    """values: injection, drift, and 0 or 1 for each sensitive term. See sessions.session_drift."""

    names = ("turn", "seen", "score", "risk", "block")

    def __init__(self, least: int, idle: float | None):
        super().__init__(idle)
        self.least = least

    def open(self, handle) -> None:
        self.seen = handle.getMapState("seen", "term int", "at long")
        self.recent = handle.getListState("recent", "score double")

    def forget(self) -> None:
        self.seen.clear()
        self.recent.clear()

    def step(self, at, order, values):
        injection, drift, *terms = values
        for k, hit in enumerate(terms):
            if hit and not self.seen.containsKey((k,)):
                self.seen.updateValue((k,), (at,))
        n_seen = sum(1 for _ in self.seen.keys())
        score = 0.4 * injection + 0.3 * drift + (0.2 if n_seen >= self.least else 0.0)
        before = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        recent = [score, *before][:5]
        self.recent.put([(x,) for x in recent])
        risk = sum(x * 0.7**k for k, x in enumerate(recent)) / sum(0.7**k for k in range(len(recent)))
        if score > 0.1 and before and before[0] > 0.1:
            risk = 0.5 + 0.1 * (score + before[0])
        return order, n_seen, score, risk, risk >= 0.25


class Cooldown(InOrder):
    """Alerts that fire: the first, then each at least `cooldown` seconds after the last that fired. See metrics.alert_cooldown."""

    names = ("at",)

    def __init__(self, cooldown: float):
        super().__init__()
        self.cooldown = cooldown

    def open(self, handle) -> None:
        self.fired = handle.getValueState("fired", "at long")

    def step(self, at, order, values):
        if self.fired.exists() and at / 1e6 - self.fired.get()[0] / 1e6 < self.cooldown:
            return None
        self.fired.update((at,))
        return (at / 1e6,)


class Ban(InOrder):
    """Failures that start a ban. See metrics.exponential_ban."""

    names = ("ord",)

    def __init__(self, most: int, window: float, first: float, longest: float):
        super().__init__()
        self.most, self.window, self.first, self.longest = most, window, first, longest

    def open(self, handle) -> None:
        self.ban = handle.getValueState("ban", "till double, n long")
        self.held = handle.getListState("held", "at double")

    def step(self, at, order, values):
        t = at / 1e6
        till, n = self.ban.get() if self.ban.exists() else (t, 0)
        if t < till:
            return None
        held = [x[0] for x in self.held.get() if x[0] > t - self.window] if self.held.exists() else []
        held.append(t)
        if len(held) < self.most:
            self.held.put([(x,) for x in held])
            return None
        self.held.clear()
        self.ban.update((t + min(self.longest, self.first * 6**n), n + 1))
        return (order,)


def _keyed(rows: DataFrame, key: str, ts: str, order: Column, values: list[Column], late: str, processor: InOrder, schema: str) -> DataFrame:
    """schema: of the output, after the key. Rows with a null key, time or order count for the watermark only."""
    vals = F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values)) if values else F.array().cast("array<double>")
    own = rows.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), order.cast("long").alias("ord"), vals.alias("vals"))
    own = own.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    out = own.groupBy("key").transformWithStateInPandas(processor, f"key {dict(own.dtypes)['key']}, {schema}", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


def stream_session_drift(turns: DataFrame, session: str, turn: str, ts: str, injection: Column, drift: Column, terms: dict[str, Column], least: int = 4, late: str = "10 minutes", idle: float | None = 1800) -> DataFrame:
    """sessions.session_drift over a stream; a session that is idle for `idle` seconds begins anew."""
    out = _keyed(turns, session, ts, F.col(turn), [injection, drift, *terms.values()], late, SessionDrift(least, idle), "turn long, seen int, score double, risk double, block boolean")
    return out.withColumn("score", F.round("score", 6)).withColumn("risk", F.round("risk", 6)).withColumnRenamed("turn", turn)


def stream_alert(alerts: DataFrame, rule: str, ts: str, cooldown: float, late: str = "10 minutes") -> DataFrame:
    """Rule and time (seconds) of the alerts that fire. Rows are the requests above a rule's threshold."""
    return _keyed(alerts, rule, ts, F.lit(0), [], late, Cooldown(cooldown), "at double")


def stream_ban(failures: DataFrame, key: str, ts: str, order: str, most: int = 3, window: int = 300, first: int = 300, longest: int = 86400, late: str = "10 minutes") -> DataFrame:
    """Key and order of the failures that start a ban."""
    return _keyed(failures, key, ts, F.col(order), [], late, Ban(most, window, first, longest), "ord long").withColumnRenamed("ord", order)


def run_to_end(make, source: DataFrame, ts: str, path: str, late: str) -> None:
    """Runs make(rows) over what the streaming DataFrame `source` holds now and writes Parquet to path/rows.

    Nothing is later than `late` behind what came before. First all of the source is taken; then the query is stopped and
    started again from its checkpoint with one row of a clock, which is far ahead in time and of no key, so that the
    watermark passes the last rows too.
    """
    spark = source.sparkSession
    keyed_state(spark)
    clock = spark.createDataFrame([], source.schema)
    clock.write.parquet(f"{path}/clock")
    rows = source.union(spark.readStream.schema(source.schema).parquet(f"{path}/clock"))

    def run() -> None:
        q = make(rows).writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        q.trigger(availableNow=True).start().awaitTermination()

    run()
    ahead = F.lit("2200-01-01").cast(source.schema[ts].dataType)
    spark.range(1).select(*(ahead.alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema)).write.mode("append").parquet(f"{path}/clock")
    run()
