"""Ordered state over conversation turns, as windows: drift, slow burn, escalation, pleasing, self-contradiction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.text import char_ngrams, word_array


def _order(session: str, turn: str):
    return Window.partitionBy(session).orderBy(turn)


def session_drift(turns: DataFrame, session: str, turn: str, injection: Column, drift: Column, terms: dict[str, Column], least: int = 4) -> DataFrame:
    """Score of each turn, its weighted mean over the last five turns, and whether to block.

    A turn scores 0.4 injection + 0.3 drift + 0.2 once `least` sensitive terms were seen in the session. Whether a term
    was seen is a running maximum for each term, so no list grows. Turns weigh 0.7 to the power of their age.
    """
    w = _order(session, turn)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = turns.withColumns({f"_t{k}": F.max(c.cast("int")).over(upto) for k, c in enumerate(terms.values())})
    seen = sum((F.col(f"_t{k}") for k in range(len(terms))), F.lit(0))
    own = own.withColumn("seen", seen).withColumn("score", 0.4 * injection + 0.3 * drift + F.when(seen >= least, 0.2).otherwise(0.0))
    lags = [F.lag("score", k).over(w) for k in range(5)]
    top = sum((F.coalesce(x, F.lit(0.0)) * 0.7**k for k, x in enumerate(lags)), F.lit(0.0))
    base = sum((F.when(x.isNotNull(), 0.7**k).otherwise(0.0) for k, x in enumerate(lags)), F.lit(0.0))
    last = F.lag("score").over(w)
    risk = F.when((F.col("score") > 0.1) & (last > 0.1), 0.5 + 0.1 * (F.col("score") + last)).otherwise(top / base)
    return own.select(session, turn, "seen", F.round("score", 6).alias("score"), F.round(risk, 6).alias("risk"), (risk >= 0.25).alias("block"))


def slow_burn(turns: DataFrame, session: str, turn: str, score: Column, limit: float = 1.0) -> DataFrame:
    total = F.sum(score).over(_order(session, turn).rowsBetween(Window.unboundedPreceding, 0))
    return turns.select(session, turn, F.round(total, 6).alias("total"), (total >= limit).alias("burnt"))


def concept_escalation(turns: DataFrame, session: str, turn: str, stages: tuple[Column, Column, Column]) -> DataFrame:
    """Stages seen in the last five turns: all three 0.8, first and third 0.6, second and third 0.5; 0.6 triggers."""
    w = _order(session, turn).rowsBetween(-4, 0)
    a, b, c = (F.max(x.cast("int")).over(w) > 0 for x in stages)
    risk = F.when(a & b & c, 0.8).when(a & c, 0.6).when(b & c, 0.5).otherwise(0.0)
    return turns.select(session, turn, risk.alias("risk"), (risk >= 0.6).alias("triggered"))


def pleasing_drift(turns: DataFrame, session: str, turn: str, up: Column, limit: int = 2) -> DataFrame:
    """A counter that grows by 1 where `up` holds and else falls by 1, not below 0: running sum less its running minimum."""
    w = _order(session, turn).rowsBetween(Window.unboundedPreceding, 0)
    own = turns.select(session, turn, F.sum(F.when(up, 1).otherwise(-1)).over(w).alias("_s"))
    own = own.withColumn("counter", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    return own.select(session, turn, "counter", (F.col("counter") >= limit).alias("drift"))


def history_repeat(turns: DataFrame, session: str, turn: str, text: str, back: int = 5) -> DataFrame:
    """Share of a turn's different runs of three characters that the `back` turns before it have; 0 for shorter texts."""
    grams = F.coalesce(char_ngrams(F.lower(F.col(text)), 3), F.array().cast("array<string>"))
    own = turns.select(session, turn, grams.alias("_g"))
    before = F.flatten(F.collect_list("_g").over(_order(session, turn).rowsBetween(-back, -1)))
    return own.select(session, turn, F.round(F.when(F.size("_g") == 0, 0.0).otherwise(F.size(F.array_intersect("_g", before)) / F.size("_g")), 6).alias("repeat"))


def detect_self_contradiction(turns: DataFrame, session: str, turn: str, text: str, negation: tuple[str, ...] = ("not", "no", "never", "ne", "nicht", "kein"), least: float = 0.5) -> DataFrame:
    """Pairs of an earlier and a later turn of a session that share over `least` of the smaller word set and differ in negation.

    Turns meet on a word they share, so a long session isn't paired with itself; turns of one word set and negation are
    joined once and then listed again, so no pair is lost. Turns without words match none.
    """
    words = F.array_distinct(word_array(F.col(text)))
    own = turns.select(session, turn, words.alias("w")).where(F.size("w") > 0).withColumn("neg", F.arrays_overlap("w", F.array(*map(F.lit, negation))))
    own = own.withColumn("key", F.md5(F.concat_ws(" ", F.array_sort("w"))))
    sets = own.groupBy(session, "key", "neg").agg(F.first("w").alias("w"), F.collect_list(turn).alias("turns"))
    rows = sets.select(session, "key", "neg", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = rows.where("neg").alias("a"), rows.where("not neg").alias("b")
    both = a.join(b, (F.col(f"a.{session}") == F.col(f"b.{session}")) & (F.col("a.word") == F.col("b.word")))
    both = both.groupBy(F.col(f"a.{session}").alias(session), F.col("a.key").alias("p"), F.col("b.key").alias("q")).agg((F.count("*") / F.least(F.first("a.n"), F.first("b.n"))).alias("overlap")).where(F.col("overlap") > least)
    listed = lambda neg, key, name: sets.where("neg" if neg else "not neg").select(session, F.col("key").alias(key), F.explode("turns").alias(name))
    out = both.join(listed(True, "p", "x"), [session, "p"]).join(listed(False, "q", "y"), [session, "q"]).where("x <> y")
    return out.select(session, F.least("x", "y").alias("earlier"), F.greatest("x", "y").alias("later"), F.round("overlap", 6).alias("overlap"))


def conversation_report(turns: DataFrame, session: str, pressure: Column, flagged: Column) -> DataFrame:
    return turns.groupBy(session).agg(F.count("*").alias("n_turns"), F.round(F.avg(pressure), 6).alias("mean_pressure"), F.sum(flagged.cast("int")).alias("n_flagged"))


def split_stream_segments(tokens: DataFrame, session: str, position: str, token: str, ends: str = r"[.!?;]$", most: int = 20) -> DataFrame:
    """Text of each segment of a token stream; a segment ends after a token that ends a sentence, or after `most` tokens."""
    w = Window.partitionBy(session).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    own = tokens.withColumn("segment", F.coalesce(F.sum(F.col(token).rlike(ends).cast("int")).over(w), F.lit(0)))
    own = own.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(session, "segment").orderBy(position)) - 1) / most))
    words = F.array_sort(F.collect_list(F.struct(position, token)))
    return own.groupBy(session, "segment", "part").agg(F.concat_ws(" ", F.transform(words, lambda x: x[token])).alias("text"), F.count("*").alias("n_tokens"))
