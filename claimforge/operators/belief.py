"""Belief in facts, arbitration between them, evidence, consistency of a base, edits, laundering, zones and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.text import char_ngrams, jaccard
from claimforge.operators.graph import competitors

NEGATED = r"(?i)\b(is not|are not|was not|not|no|never|does not exist|fake)\b"


def belief(nodes: DataFrame, edges: DataFrame, drag: float = 0.3) -> DataFrame:
    """node, belief and its factors: confidence times age, use, contradictions, validations and source, less competitors' drag.

    nodes: node, confidence, state, validated_days (null: never), created_days, usage, adoption, contradictions, validators,
    reliability; edges as for graph.competitors. Half-lives are 90 days since a validation, 30 since creation without one.
    Archived and debunked nodes keep their confidence. Two passes over the edges' nodes; null counts are 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    age = F.when(F.col("validated_days").isNotNull(), F.pow(F.lit(0.5), F.least("validated_days", "created_days") / 90)).otherwise(F.pow(F.lit(0.5), n("created_days") / 30))
    use = F.when(n("usage") > 0, 1 + F.least(F.lit(0.2), F.log(n("usage") + 1) * 0.05) + F.when(n("adoption") > 0.5, 0.1).otherwise(0.0)).otherwise(1.0)
    doubt = F.when(n("contradictions") > 0, F.greatest(F.lit(0.3), 1 - n("contradictions") * 0.15)).otherwise(1.0)
    checked = 1 + F.least(F.lit(0.3), n("validators") * 0.08)
    own = nodes.withColumns({"age_factor": age, "use_factor": use, "doubt_factor": doubt, "check_factor": checked, "source_factor": 0.5 + n("reliability") * 0.5})
    product = F.col("confidence") * F.col("age_factor") * F.col("use_factor") * F.col("doubt_factor") * F.col("check_factor") * F.col("source_factor")
    own = own.join(competitors(edges, nodes).select("node", "mean_confidence"), "node", "left")
    over = F.greatest(F.lit(0.0), F.coalesce("mean_confidence", F.col("confidence")) - F.col("confidence"))
    alive = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)) - over * drag)
    out = own.withColumn("belief", F.when(F.col("state").isin("archived", "debunked"), F.col("confidence")).otherwise(alive))
    return out.select("node", F.round("belief", 6).alias("belief"), *(F.round(c, 6).alias(c) for c in ("age_factor", "use_factor", "doubt_factor", "check_factor", "source_factor")))


def rank_beliefs(beliefs: DataFrame, k: int) -> DataFrame:
    """The k strongest beliefs, ties by node."""
    return beliefs.orderBy(F.desc("belief"), "node").limit(k)


def arbitrate(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Which of two conflicting facts (a, b) wins: winner (null where scores are within 0.1), scores, confidence and action.

    records: fact, n_sources, n_checks, source_trust, days (since the last check, null: never), unresolved. A score is 0.1 a
    source up to 0.4, 0.05 a check up to 0.2, 0.2 times the source's trust, up to 0.1 for a late check, less 0.1 a conflict
    up to 0.3, and never below 0. Pairs with an unknown fact have no row.
    """
    fresh = F.when(F.col("days").isNotNull(), F.greatest(F.lit(0.0), 0.1 - F.col("days") * 0.001)).otherwise(0.0)
    score = F.least(F.lit(0.4), F.col("n_sources") * 0.1) + F.least(F.lit(0.2), F.col("n_checks") * 0.05) + F.col("source_trust") * 0.2 + fresh - F.least(F.lit(0.3), F.col("unresolved") * 0.1)
    rated = records.select("fact", F.round(F.greatest(F.lit(0.0), score), 6).alias("score"))
    own = pairs.select("a", "b").join(rated.toDF("a", "score_a"), "a").join(rated.toDF("b", "score_b"), "b")
    margin = F.round(F.abs(F.col("score_a") - F.col("score_b")), 6)
    even = margin < 0.1
    return own.select(
        "a", "b", "score_a", "score_b", F.when(~even, F.when(F.col("score_a") > F.col("score_b"), F.col("a")).otherwise(F.col("b"))).alias("winner"),
        F.when(even, 0.3).otherwise(F.round(F.least(F.lit(0.9), 0.5 + margin), 6)).alias("confidence"),
        F.when(even, "review").when(margin > 0.3, "downgrade_loser").otherwise("flag_both").alias("action"),
    )


def attach_evidence(facts: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """hash, verdict, sources (in order, each once), n_evidence, n_conflicts and entities of unresolved conflicts of each fact.

    facts: hash; evidence: hash, source, confidence; conflicts: hash_a, hash_b, entity, resolved. A fact with an unresolved
    conflict is contradicted, else supported if there is evidence, else unverified.
    """
    known = evidence.groupBy("hash").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_evidence"))
    still = conflicts.where(~F.coalesce("resolved", F.lit(False)))
    both = still.select(F.col("hash_a").alias("hash"), "entity").union(still.where("hash_a <> hash_b").select("hash_b", "entity"))
    against = both.groupBy("hash").agg(F.array_sort(F.collect_set("entity")).alias("entities"), F.count("*").alias("n_conflicts"))
    own = facts.select("hash").distinct().join(known, "hash", "left").join(against, "hash", "left")
    none = F.array().cast("array<string>")
    verdict = F.when(F.col("n_conflicts") > 0, "contradicted").when(F.col("n_evidence") > 0, "supported").otherwise("unverified")
    return own.select("hash", verdict.alias("verdict"), F.coalesce("sources", none).alias("sources"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), F.coalesce("entities", none).alias("entities"))


def _contradicts(a: Column, b: Column) -> Column:
    """One of two texts, of which exactly one is negated, denies the other: they begin alike or share enough characters."""
    chars = lambda t: F.array_distinct(F.split(t, ""))
    return (F.substring(a, 1, 2) == F.substring(b, 1, 2)) | (jaccard(char_ngrams(a, 2), char_ngrams(b, 2)) > 0.18) | (jaccard(chars(a), chars(b)) > 0.35)


def check_kb_consistency(new: DataFrame, kb: DataFrame, anchors: DataFrame, patterns: tuple[tuple[str, str], ...] = (), negated: str = NEGATED) -> DataFrame:
    """Each new fact (key, fact) with accepted and reasons: anchor, the names of patterns it matches, existing.

    A new fact is quarantined if it contradicts an anchor (which nothing changes) or a fact of the base of its key: exactly
    one of the two is negated, and they begin alike or are alike. Only facts of the other polarity are joined. Repeated
    new facts are one; null facts are left out.
    """
    is_negated = lambda c: F.col(c).rlike(negated)
    own = new.where("key is not null and fact is not null").select("key", "fact").distinct().withColumn("denies", is_negated("fact"))
    held = anchors.select("key", F.col("fact").alias("old"), F.lit("anchor").alias("kind")).union(kb.select("key", "fact", F.lit("existing"))).where("old is not null").distinct()
    held = held.withColumn("denies", ~is_negated("old"))
    hits = own.join(held, ["key", "denies"]).where(_contradicts(F.col("fact"), F.col("old"))).groupBy("key", "fact").agg(F.collect_set("kind").alias("kinds"))
    named = [F.when(F.col("fact").rlike(p), F.lit(name)) for name, p in patterns]
    reasons = F.array_sort(F.array_compact(F.concat(F.coalesce("kinds", F.array().cast("array<string>")), F.array(*named) if named else F.array().cast("array<string>"))))
    out = own.join(hits, ["key", "fact"], "left").withColumn("reasons", reasons)
    return out.select("key", "fact", (F.size("reasons") == 0).alias("accepted"), "reasons")


def edit_facts(kb: DataFrame, changes: DataFrame) -> DataFrame:
    """The base (key, fact) after changes (op: add or remove, key, fact): trimmed, each fact once, no keys with a leading _.

    What is both added and removed is removed. A key without facts is gone. Null keys and facts are left out.
    """
    tidy = changes.select("op", F.trim("key").alias("key"), F.trim("fact").alias("fact")).where("key is not null and fact is not null")
    added = tidy.where("op = 'add' and not startswith(key, '_') and fact <> ''").select("key", "fact")
    gone = tidy.where("op = 'remove'").select("key", "fact")
    return kb.select("key", "fact").where("key is not null and fact is not null").union(added).distinct().join(gone, ["key", "fact"], "left_anti")


def detect_laundering(records: DataFrame, untrusted: tuple[str, ...] = ("unknown", "user_input", "anonymous"), trusted: tuple[str, ...] = ("wiki", "official", "standards")) -> DataFrame:
    """content_id of records (content_id, original, sources) whose origin isn't trusted but which come from a trusted source."""
    holds = lambda text, names: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(text), n))
    origin = F.coalesce("original", F.lit(""))
    bad = ((origin == "") | holds(origin, untrusted)) & ~holds(origin, trusted)
    return records.where(bad & F.exists("sources", lambda s: holds(s, trusted))).select("content_id", "original")


def zone_flow_stats(flows: DataFrame, allowed: DataFrame) -> DataFrame:
    """n and n_tainted of each pair of zones (source, target) in flows (source, target, tainted), and whether it is allowed.

    allowed holds the pairs that may flow; zones are few, so it is the smaller side of a join on the summed-up pairs.
    """
    own = flows.groupBy("source", "target").agg(F.count("*").alias("n"), F.sum(F.when(F.col("tainted"), 1).otherwise(0)).alias("n_tainted"))
    return own.join(allowed.select("source", "target", F.lit(True).alias("ok")).distinct(), ["source", "target"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def panel_vote(ratings: DataFrame, item: str, member: str, rating: str, least: float = 0.5) -> DataFrame:
    """item, verdict and dissenters: veto where that share of the ratings vetoes, else flag where vetoes and flags do, else
    anchor where any rating is one, else pass. Dissenters are the members whose rating isn't the verdict, in order."""
    is_a = lambda *names: F.avg(F.col(rating).isin(*names).cast("double"))
    votes = F.array_sort(F.collect_set(F.struct(F.col(member).cast("string").alias("m"), F.col(rating).alias("r"))))
    own = ratings.where(F.col(rating).isNotNull()).groupBy(item).agg(is_a("veto").alias("v"), is_a("veto", "flag").alias("f"), is_a("anchor").alias("a"), votes.alias("votes"))
    verdict = F.when(F.col("v") >= least, "veto").when(F.col("f") >= least, "flag").when(F.col("a") > 0, "anchor").otherwise("pass")
    own = own.withColumn("verdict", verdict)
    return own.select(item, "verdict", F.array_distinct(F.transform(F.filter("votes", lambda x: x["r"] != F.col("verdict")), lambda x: x["m"])).alias("dissenters"))
