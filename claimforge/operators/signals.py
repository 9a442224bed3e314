"""Signals about answers and requests: how sure a text sounds against what checks found, chains of words, kinds of names,
importance of memories, cached tokens, security logs, bursts of requests and segments of streamed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.text import char_ngrams, jaccard
from claimforge.operators import metrics

ABSOLUTE = ("always", "never", "certainly", "without doubt", "everyone", "no one", "completely", "must")
FACTUAL = (" is ", " was ", " are ", "invented", "founded", "discovered", "located", "belongs", "became")
LEVELS = (("critical", 0.5), ("high", 0.25), ("moderate", 0.05), ("low", -0.1))
SHARE_OF_VERDICT = {"contradicted": 1.0, "verified": 0.5}
KINDS = {
    "person": (r"\b(born|died) (in|on)? ?\d", r"\b(scientist|writer|poet|painter|president|king|queen)\b", r"\b(invented|discovered|proposed|wrote)\b", r"\b(mother|father|son|daughter|pupil) of\b"),
    "place": (r"\b(located|lies) (in|at|near)\b", r"\bcapital\b", r"\bbuilt (in|around) ?\d", r"\b(city|country|river|mountain|desert)\b"),
    "event": (r"\b(broke out|began|ended) (in|on)? ?\d", r"\b(war|revolution|battle|conference)\b"),
    "organization": (r"\b(company|institute|association|foundation)\b", r"\b(founded|registered) (in|on)? ?\d"),
}
RELEVANCE = {"architecture": 0.9, "decision": 0.85, "tool_usage": 0.6, "bug": 0.7, "performance": 0.65, "project": 0.7, "user": 0.5, "system": 0.95, "execution": 0.4}


def _held(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text has."""
    n = F.lit(0)
    for w in words:
        n = n + F.contains(text, F.lit(w)).cast("int")
    return n


def _millionths(x: Column) -> Column:
    return F.round(x * 1_000_000).cast("long")


def prior_intensity(df: DataFrame, session: str, turn: str, text: str, absolute: tuple[str, ...] = ABSOLUTE, factual: tuple[str, ...] = FACTUAL, back: int = 5) -> DataFrame:
    """`prior`: how sure each text sounds, 0.5 to 1: absolute words, density of factual verbs, and the mean share of its
    runs of three characters that each of the `back` texts before it in the session has.

    Windows go by session, so memory is bounded by `back` texts. A null text counts as empty.
    """
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(-back, -1)
    t = F.coalesce(F.col(text), F.lit(""))
    own = df.withColumn("_g", char_ngrams(t, 3))
    own = own.withColumn("_before", F.collect_list("_g").over(w))
    shared = F.aggregate("_before", F.lit(0).cast("long"), lambda n, g: n + F.size(F.array_intersect("_g", g)))
    repeat = shared / F.greatest(F.size("_g"), F.lit(1)) / F.greatest(F.size("_before"), F.lit(1))
    density = _held(F.lower(t), factual) / F.greatest(F.length(t), F.lit(1))
    score = 0.5 + F.least(0.08 * _held(F.lower(t), absolute), F.lit(0.3)) + F.least(15 * density, F.lit(0.15)) + F.least(0.15 * repeat, F.lit(0.15))
    return own.withColumn("prior", _millionths(F.least(score, F.lit(1.0))) / 1_000_000).drop("_g", "_before")


def sensory_precision(findings: DataFrame, key: str, verdict: str, confidence: str, source: str) -> DataFrame:
    """`precision` of a key's checks: 0.6 of their mean, 0.3 of the highest, and 0.05 for each source up to three.

    A contradiction counts with its confidence, a confirmation with half, anything else with a tenth of it.
    """
    share = F.coalesce(*(F.when(F.col(verdict) == v, s) for v, s in SHARE_OF_VERDICT.items()), F.lit(0.1))
    own = findings.withColumn("_x", F.coalesce(F.col(confidence), F.lit(0.0)) * share)
    bonus = F.least(0.05 * F.count_distinct(F.coalesce(F.col(source).cast("string"), F.lit(""))), F.lit(0.15))
    return own.groupBy(key).agg(F.round(F.least(0.6 * F.avg("_x") + 0.3 * F.max("_x") + bonus, F.lit(1.0)), 6).alias("precision"), F.count("*").alias("n_checks"))


def index_level(index: Column) -> Column:
    """The band of an index: prior less precision."""
    return F.coalesce(*(F.when(index > least, name) for name, least in LEVELS), F.lit("verified"))


def hallucination_report(findings: DataFrame, session: str, turn: str, text: str, verdict: str, confidence: str, **words: tuple[str, ...]) -> DataFrame:
    """Of each session: n, index (mean of prior less precision), level, and how many findings are in the worst three bands.

    Each finding is one check of one text; the texts before it in the session are its history. The mean is of millionths
    held as integers, so it doesn't depend on the order of the sum.
    """
    own = prior_intensity(findings, session, turn, text, **words)
    share = F.coalesce(*(F.when(F.col(verdict) == v, s) for v, s in SHARE_OF_VERDICT.items()), F.lit(0.1))
    x = F.coalesce(F.col(confidence), F.lit(0.0)) * share
    own = own.withColumn("_i", _millionths(F.col("prior")) - _millionths(F.least(0.9 * x + 0.05, F.lit(1.0))))
    own = own.withColumn("_l", index_level(F.col("_i") / 1_000_000))
    n = lambda level: F.sum((F.col("_l") == level).cast("int"))
    out = own.groupBy(session).agg(
        F.count("*").alias("n"), F.sum("_i").alias("_sum"),
        *(n(x).alias(f"n_{x}") for x in ("critical", "high", "moderate")),
    )
    level = F.when(F.col("n_critical") > 0, "critical").when(F.col("n_high") > 0, "high").when(F.col("n_moderate") > F.floor(F.col("n") / 2), "moderate").otherwise("low")
    return out.select(session, "n", (F.col("_sum") / F.col("n") / 1_000_000).alias("index"), level.alias("level"), "n_critical", "n_high", "n_moderate")


def fact_chain(facts: DataFrame, key: str, text: str, chains: dict[str, tuple[tuple[str, ...], float]], least: int = 2) -> DataFrame:
    """Keys whose facts, each harmless, together hold enough of a chain's words: the first such chain and the share it has.

    Each word is one flag of a partial aggregate, so the texts of a key are never put together. Keys with fewer than
    `least` facts have none. A word counts if it lies in one text.
    """
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    names = [(name, [F.max(F.contains(t, F.lit(w)).cast("int")).alias(f"_{k}_{j}") for j, w in enumerate(words)], len(words), limit) for k, (name, (words, limit)) in enumerate(chains.items())]
    own = facts.groupBy(key).agg(F.count("*").alias("n_facts"), *(c for _, flags, _, _ in names for c in flags))
    shares = []
    for k, (_, _, n, _) in enumerate(names):
        held = F.lit(0)
        for j in range(n):
            held = held + F.col(f"_{k}_{j}")
        shares.append(held / n)
    hits = [(shares[k] >= limit, name, shares[k]) for k, (name, _, _, limit) in enumerate(names)]
    chain, share = F.coalesce(*(F.when(ok, F.lit(name)) for ok, name, _ in hits)), F.coalesce(*(F.when(ok, s) for ok, _, s in hits))
    out = own.where(F.col("n_facts") >= least).select(key, "n_facts", chain.alias("chain"), F.round(share, 6).alias("share"))
    return out.where(F.col("chain").isNotNull())


def infer_entity_type(df: DataFrame, text: str, name: str, kinds: dict[str, tuple[str, ...]] = KINDS, around: int = 30) -> DataFrame:
    """`kind` and `kind_confidence` of a name from the text `around` characters about where it first occurs.

    The kind with most matching patterns wins, the earlier in `kinds` on ties; each pattern adds 0.2 to 0.35, 0.85 at
    most. Without a match a name of two characters or fewer is a concept (0.3), others are unknown (0.2); a name that
    isn't in the text is unknown (0).
    """
    place = F.position(F.lower(name), F.lower(text))
    start = F.greatest(place - around, F.lit(1))
    own = df.withColumn("_at", place)
    context = F.lower(F.substring(F.col(text), start, place + F.length(name) + around - start))
    scores = [sum((context.rlike(p).cast("int") for p in patterns), F.lit(0)) for patterns in kinds.values()]
    own = own.withColumn("_s", F.array(*scores))
    best = F.array_max("_s")
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.array_position("_s", best).cast("int"))
    short = F.length(name) <= 2
    missing = F.coalesce(F.col("_at"), F.lit(0)) == 0
    own = own.withColumn("kind", F.when(missing, "unknown").when(best > 0, kind).when(short, "concept").otherwise("unknown"))
    sure = F.when(missing, 0.0).when(best > 0, F.round(F.least(0.35 + 0.2 * best, F.lit(0.85)), 6)).when(short, 0.3).otherwise(0.2)
    return own.withColumn("kind_confidence", sure).drop("_at", "_s")


def score_importance(memories: DataFrame, session: str, turn: str, text: str, kind: str, confidence: Column, relevance: dict[str, float] = RELEVANCE, back: int = 10) -> DataFrame:
    """`importance` of each memory: 0.4 frequency, 0.3 recency, 0.2 relevance of its kind, 0.1 confidence.

    Frequency grows with how many of the `back` memories before it in the session share over 0.3 of their words (Jaccard);
    a session's first memory has 0.5.
    """
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(-back, -1)
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != ""))
    own = memories.withColumn("_w", words)
    own = own.withColumn("_before", F.collect_list("_w").over(w))
    alike = F.size(F.filter("_before", lambda b: jaccard(b, F.col("_w")) > 0.3))
    frequency = F.when(F.size("_before") == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.3 + 0.15 * alike))
    known = F.coalesce(*(F.when(F.col(kind) == k, v) for k, v in relevance.items()), F.lit(0.5))
    score = 0.4 * frequency + 0.3 * F.when(F.col(kind) == "system", 0.7).otherwise(0.5) + 0.2 * known + 0.1 * confidence
    return own.withColumn("importance", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)).drop("_w", "_before")


def dedupe_memories(memories: DataFrame, category: str, content: str, order: str, head: int = 80) -> DataFrame:
    """The first memory, by `order`, of each category and beginning of `head` characters; blank or under 3 characters: none.

    One partial aggregate; groups of copies of any size leave each task as one row.
    """
    t = F.trim(F.col(content))
    own = memories.where(F.length(t) >= 3).groupBy(F.coalesce(F.col(category), F.lit("")).alias(category), F.substring(t, 1, head).alias("head"))
    return own.agg(F.min(order).alias(order), F.count("*").alias("n_alike"))


def token_cache_stats(logs: DataFrame, by: str, body: str) -> DataFrame:
    """Of each `by`: rows, rows with usage, input, cached and output tokens, hit rate, rounds with a hit, billed input.

    Usage is the JSON object after "usage" in a log body; bodies without one, with broken JSON or without input don't count.
    """
    found = F.regexp_extract(F.col(body), r'"usage":\s*(\{(?:[^{}]|\{[^{}]*\})*\})', 1)
    usage = F.from_json(found, "input_tokens long, input_tokens_details struct<cached_tokens: long>, output_tokens long")
    own = logs.select(by, usage.alias("u"))
    ok = F.col("u.input_tokens") > 0
    value = lambda c: F.coalesce(F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0)))), F.lit(0))
    cached = "u.input_tokens_details.cached_tokens"
    out = own.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count(F.when(ok, 1)).alias("n_usage"), value("u.input_tokens").alias("input_tokens"), value(cached).alias("cached_tokens"),
        value("u.output_tokens").alias("output_tokens"), F.count(F.when(ok & (F.col(cached) > 0), 1)).alias("n_hits"),
    )
    rate = F.when(F.col("input_tokens") > 0, F.round(F.col("cached_tokens") / F.col("input_tokens"), 6))
    return out.withColumn("hit_rate", rate).withColumn("billed_input", F.col("input_tokens") - F.col("cached_tokens"))


def security_log_stats(log: DataFrame, by: str, address: str, key: str, status: str, millis: str) -> DataFrame:
    """Of each `by`: requests, different addresses and keys, rows of each status, mean and p95 of the time taken.

    p95 is the value of rank floor(0.95 n), counted from 0, or the last of ten or fewer. Statuses are an ordered list of
    "status:rows". The quantile is found by sorted ranges, so no task holds a group.
    """
    rank = lambda n: F.when(n > 10, F.floor(0.95 * n)).otherwise(n - 1)
    p = metrics.exact_quantiles(log, [by], millis, {"p95": rank}).select(F.col(by).alias("_p"), F.round("p95", 6).alias("p95"))
    counts = log.groupBy(by, status).agg(F.count("*").alias("_n"))  # as many rows as there are statuses
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce(F.col(status).cast("string"), F.lit("")), F.col("_n").cast("string")))), ",")
    spread = counts.groupBy(F.col(by).alias("_s")).agg(shown.alias("statuses"))
    own = log.groupBy(by).agg(F.count("*").alias("requests"), F.count_distinct(address).alias("addresses"), F.count_distinct(key).alias("keys"), F.round(F.avg(millis), 1).alias("mean"))
    return own.join(spread, F.col(by).eqNullSafe(F.col("_s"))).join(p, F.col(by).eqNullSafe(F.col("_p"))).drop("_s", "_p")


def rate_blocks(events: DataFrame, user: str, ts: str, order: str, most: int = 20, seconds: float = 1.0, block: float = 60.0, slab: int = 64) -> DataFrame:
    """Blocks of users: the request that makes more than `most` within `seconds`, of those made since the last block ended.

    A block lasts `block` seconds, in which requests don't count. Returns user, at (seconds), until. Time is cut into slabs
    of `slab` times `seconds`; a request also goes to the next slab if it lies in the last `seconds` of its own, so that
    the window is whole there and a user with very many requests is split. The blocks that take effect are found like
    alerts with a cooldown, by pointers in blocks of time.
    """
    length = slab * seconds
    own = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).alias("k"), F.col(ts).cast("double").alias("t"), F.col(order).alias("o"))
    own = own.withColumn("b", F.floor(F.col("t") / length))
    late = F.col("t") >= (F.col("b") + 1) * length - seconds
    own = own.withColumn("own", F.lit(True)).unionByName(own.where(late).withColumn("b", F.col("b") + 1).withColumn("own", F.lit(False)))
    first = F.lag("t", most).over(Window.partitionBy("k", "b").orderBy("t", "o"))
    bursts = own.withColumn("s", first).where(F.col("own") & (F.col("t") - F.col("s") < seconds)).select("k", "t", "s")
    fired = metrics.alert_cooldown(bursts, "k", "t", block, start="s")
    return fired.select(F.col("k").alias(user), F.col("t").alias("at"), (F.col("t") + block).alias("until"))


def segment_text(df: DataFrame, keys: list[str], text: str, ends: str = r"(?<=[.!?;])\s+|\n+", most: int = 20) -> DataFrame:
    """keys, segment (from 0), segment_text, n_tokens: a text's words as a stream, flushed where a sentence ends or after
    `most` words. All inside a row, without a shuffle. Null and blank texts have no segments."""
    words = lambda piece: F.filter(F.split(piece, r"\s+"), lambda w: w != "")
    runs = F.filter(F.transform(F.split(F.col(text), ends), words), lambda run: F.size(run) > 0)
    cut = F.flatten(F.transform(runs, lambda run: F.transform(F.sequence(F.lit(1), F.size(run), F.lit(most)), lambda i: F.slice(run, i, most))))
    own = df.select(*keys, F.posexplode(cut).alias("segment", "_w"))
    return own.select(*keys, "segment", F.array_join("_w", " ").alias("segment_text"), F.size("_w").alias("n_tokens"))
