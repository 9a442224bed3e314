"""Registered queries of signals about answers and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators import signals
from claimforge.plans import truth
from claimforge.plans.base import query, spread, table
from claimforge.plans.more import line_votes
from claimforge.plans.oracles import VOTES

# Words that the tables' invented prose has.
ABSOLUTE, FACTUAL = ("all", "the", "les", "und"), ("is ", "was ", "est ", "er")
CHAINS = {"reach": (("the", "and", "with", "of", "on"), 0.9), "hide": (("le", "la", "un", "est"), 0.75), "tell": (("er", "en", "un", "ich", "ch"), 0.6)}
TWO = {"person": ("er ", " the "), "place": (" in ", " la ", "on "), "event": (" un ", " der ", "en ")}
held = lambda text, words: " + ".join(f"contains(lower({text}), '{w}')::INT" for w in words)
PRIOR = """tg AS (SELECT *, CASE WHEN length(x) >= 3 THEN list_distinct([substr(x, i, 3) for i in range(1, length(x) - 1)]) ELSE [] END gr FROM told),
th AS (SELECT *, row_number() OVER w - 1 back, {lags} FROM tg WINDOW w AS (PARTITION BY k ORDER BY o)),
prior AS (SELECT *, round(1000000 * least(1, 0.5 + least(0.08 * ({absolute}), 0.3) + least(15.0 * ({factual}) / greatest(length(x), 1), 0.15)
  + least(0.15 * (({shared})::DOUBLE / greatest(len(gr), 1) / greatest(least(back, 5), 1)), 0.15))::DOUBLE)::BIGINT p FROM th)""".format(
    lags=", ".join(f"lag(gr, {k}) OVER w g{k}" for k in range(1, 6)), absolute=held("x", ABSOLUTE), factual=held("x", FACTUAL), shared=" + ".join(f"coalesce(len(list_intersect(gr, g{k})), 0)" for k in range(1, 6))
)
SHARE = "CASE verdict WHEN 'contradicted' THEN 1.0 WHEN 'verified' THEN 0.5 ELSE 0.1 END::DOUBLE"


@query(f"""WITH told AS (SELECT conv_id k, turn o, coalesce(text, '') x FROM conversations), {PRIOR} SELECT k conv_id, o turn, p / 1000000 "prior" FROM prior""")
def prior_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each turn sounds, with the five turns before it."""
    own = signals.prior_intensity(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ABSOLUTE, FACTUAL)
    return own.select("conv_id", "turn", "prior")


@query(
    f"""WITH {VOTES} SELECT claim_id, round(least(1, 0.6 * avg(confidence * {SHARE}) + 0.3 * max(confidence * {SHARE}) + least(0.05 * count(DISTINCT checker), 0.15))::DOUBLE, 6) "precision", count(*) n_checks
FROM v GROUP BY 1"""
)
def sensory_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.sensory_precision(line_votes(spark, sf_dir), "claim_id", "verdict", "confidence", "checker")


@query(
    f"""WITH {truth.PAIRS}, {truth.VOTES}, {truth.JUDGED}, {truth.BEST}, {truth.RESULTS}, told AS (SELECT doc_id k, sent_no o, claim x, verdict, confidence FROM results), {PRIOR},
j AS (SELECT k, p - round(1000000 * least(1, 0.9 * (confidence * {SHARE}) + 0.05)::DOUBLE)::BIGINT s FROM prior), i AS (SELECT k, s, s / 1000000 i FROM j),
n AS (SELECT k doc_id, count(*) n, sum(s)::BIGINT s, count(*) FILTER (i > 0.5) n_critical, count(*) FILTER (i > 0.25 AND i <= 0.5) n_high, count(*) FILTER (i > 0.05 AND i <= 0.25) n_moderate FROM i GROUP BY 1)
SELECT doc_id, n, s / n / 1000000 "index", CASE WHEN n_critical > 0 THEN 'critical' WHEN n_high > 0 THEN 'high' WHEN n_moderate > n // 2 THEN 'moderate' ELSE 'low' END "level", n_critical, n_high, n_moderate FROM n"""
)
def hallucination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each document's sentences sound against what was found about them."""
    found = truth.evaluate_truth(spark, sf_dir)
    return signals.hallucination_report(found, "doc_id", "sent_no", "claim", "verdict", "confidence", absolute=ABSOLUTE, factual=FACTUAL)


def _chain_sql() -> str:
    shares = {name: (" + ".join(f"max(contains(lower(text), '{w}')::INT)" for w in words), len(words), limit) for name, (words, limit) in CHAINS.items()}
    flags = ", ".join(f"({held})::DOUBLE / {n} {name}" for name, (held, n, _) in shares.items())
    cases = lambda of: " ".join(f"WHEN {name} >= {limit} THEN {of(name)}" for name, (_, _, limit) in shares.items())
    return f"""WITH s AS (SELECT conv_id, count(*) n_facts, {flags} FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations) GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT conv_id, n_facts, CASE {cases("'{}'".format)} END chain, CASE {cases(str)} END AS share FROM s) SELECT conv_id, n_facts, chain, round(share, 6) AS share FROM c WHERE chain IS NOT NULL"""


@query(_chain_sql())
def fact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.fact_chain(table(spark, sf_dir, "conversations"), "conv_id", "text", CHAINS)


_score = lambda ps: " + ".join(f"regexp_matches(c, '{p}')::INT" for p in ps)


@query(
    f"""WITH n AS (SELECT doc_id, lower(text) t, CASE WHEN lang = 'en' THEN 'then' WHEN lang = 'fr' THEN 'le' ELSE 'ein' END "name" FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, strpos(t, "name") "at" FROM n), x AS (SELECT *, substr(t, greatest("at" - 30, 1), "at" + length("name") + 30 - greatest("at" - 30, 1)) c FROM p),
s AS (SELECT *, {', '.join(f'{_score(ps)} {k}' for k, ps in TWO.items())} FROM x), b AS (SELECT *, greatest({', '.join(TWO)}) b FROM s)
SELECT doc_id, "name", CASE WHEN "at" = 0 THEN 'unknown' WHEN b > 0 THEN CASE b {' '.join(f"WHEN {k} THEN '{k}'" for k in TWO)} END WHEN length("name") <= 2 THEN 'concept' ELSE 'unknown' END kind,
CASE WHEN "at" = 0 THEN 0 WHEN b > 0 THEN round(least(0.35 + 0.2 * b, 0.85), 6) WHEN length("name") <= 2 THEN 0.3 ELSE 0.2 END::DOUBLE kind_confidence FROM b"""
)
def infer_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a name of each document's language is, by the text about its first place."""
    docs = spread(table(spark, sf_dir, "documents").where("text is not null"))
    named = docs.withColumn("name", F.when(F.col("lang") == "en", "then").when(F.col("lang") == "fr", "le").otherwise("ein"))
    return signals.infer_entity_type(named, "text", "name", TWO).select("doc_id", "name", "kind", "kind_confidence")


@query(
    """WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) n FROM conversations),
j AS (SELECT a.conv_id, a.turn, count(*) FILTER (len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) > 0.3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) m
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 10 AND a.n - 1 GROUP BY 1, 2)
SELECT w.conv_id, w.turn, round(0.4 * CASE WHEN m IS NULL THEN 0.5 ELSE least(1, 0.3 + 0.15 * m) END + 0.3 * CASE role WHEN 'system' THEN 0.7 ELSE 0.5 END + 0.2 * CASE role WHEN 'system' THEN 0.95 ELSE 0.5 END + 0.1 * 0.8, 4)::DOUBLE importance
FROM w LEFT JOIN j ON w.conv_id = j.conv_id AND w.turn = j.turn"""
)
def score_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = signals.score_importance(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role", F.lit(0.8))
    return own.select("conv_id", "turn", "importance")


@query("SELECT coalesce(lang, '') lang, substr(trim(text), 1, 80) head, min(doc_id) doc_id, count(*) n_alike FROM documents WHERE length(trim(text)) >= 3 GROUP BY 1, 2")
def dedupe_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.dedupe_memories(table(spark, sf_dir, "documents"), "lang", "text", "doc_id")


BODY = """CASE event_type WHEN 'view' THEN 'no numbers' ELSE 'data: {"id": ' || event_id || ', "usage": {"input_tokens": ' || CAST(floor(value) AS BIGINT) || ', "input_tokens_details": {"cached_tokens": ' || CAST(floor(value / 3) AS BIGINT) * (event_id % 2) || '}, "output_tokens": ' || user_id || '}}' END"""


@query(
    """WITH u AS (SELECT event_type, floor(value)::BIGINT i, floor(value / 3)::BIGINT * (event_id % 2) c, user_id o, event_type <> 'view' AND floor(value) > 0 ok FROM events)
SELECT event_type, count(*) n_rows, count(*) FILTER (ok) n_usage, coalesce(sum(i) FILTER (ok), 0)::BIGINT input_tokens, coalesce(sum(c) FILTER (ok), 0)::BIGINT cached_tokens, coalesce(sum(o) FILTER (ok), 0)::BIGINT output_tokens,
count(*) FILTER (ok AND c > 0) n_hits, CASE WHEN sum(i) FILTER (ok) > 0 THEN round((sum(c) FILTER (ok)) / (sum(i) FILTER (ok)), 6) END hit_rate, (coalesce(sum(i) FILTER (ok), 0) - coalesce(sum(c) FILTER (ok), 0))::BIGINT billed_input FROM u GROUP BY 1"""
)
def token_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What log bodies, one an event, say of tokens."""
    return signals.token_cache_stats(table(spark, sf_dir, "events").withColumn("body", F.expr(BODY)), "event_type", "body")


@query(
    """WITH r AS (SELECT event_type, user_id, value, props, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 k, count(*) OVER (PARTITION BY event_type) n FROM events),
s AS (SELECT event_type, user_id % 3 status, count(*) c FROM events GROUP BY 1, 2), d AS (SELECT event_type, string_agg(status || ':' || c, ',' ORDER BY status) statuses FROM s GROUP BY 1)
SELECT event_type, count(*) requests, count(DISTINCT user_id) addresses, count(DISTINCT props) "keys", round(avg(value), 1) AS mean, statuses, max(value) FILTER (k = CASE WHEN n > 10 THEN floor(0.95 * n) ELSE n - 1 END) p95 FROM r JOIN d USING (event_type) GROUP BY event_type, statuses"""
)
def security_log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("status", F.col("user_id") % 3)
    return signals.security_log_stats(log, "event_type", "user_id", "props", "status", "value")


@query(
    """WITH RECURSIVE e AS (SELECT user_id u, epoch_us(ts) / 1e6 t, lag(epoch_us(ts) / 1e6, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM events),
x AS (SELECT u, s, t FROM e WHERE t - s < 43200), y AS (SELECT a.u, a.t, min(b.t) nx FROM x a LEFT JOIN x b ON b.u = a.u AND b.s - a.t >= 86400 GROUP BY 1, 2),
f AS (SELECT u, min(t) t FROM x GROUP BY 1 UNION ALL SELECT f.u, y.nx FROM f JOIN y ON y.u = f.u AND y.t = f.t WHERE y.nx IS NOT NULL)
SELECT u user_id, t "at", t + 86400 until FROM f"""
)
def rate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than three events in half a day block a user for a day."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return signals.rate_blocks(events, "user_id", "at", "event_id", most=3, seconds=43200.0, block=86400.0)


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) l FROM conversations),
w AS (SELECT conv_id, turn, l, unnest(string_split_regex(x, '\\s+')) w, generate_subscripts(string_split_regex(x, '\\s+'), 1) i FROM l),
r AS (SELECT *, coalesce(sum(regexp_matches(w, '[.!?;]$')::INT) OVER (PARTITION BY conv_id, turn, l ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) r FROM w WHERE w <> ''),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn, l, r ORDER BY i) - 1) // 20 p FROM r),
s AS (SELECT conv_id, turn, l, r, p, string_agg(w, ' ' ORDER BY i) segment_text, count(*)::INT n_tokens FROM p GROUP BY ALL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY l, r, p) - 1)::INT segment, segment_text, n_tokens FROM s"""
)
def segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as streams of words, flushed at ends of sentences and after 20 words."""
    return signals.segment_text(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
