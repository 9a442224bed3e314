"""Registered queries of votes side by side, fuzzy names, graphs from text, feedback, audit and bans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators import feedback, graph, metrics, similarity, votes
from claimforge.plans.base import in_order, query, table
from claimforge.plans.oracles import FOLDS, OF, VOTES


def line_votes(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Each line of an order is a vote on it."""
    verdict = F.when(F.col("l_returnflag") == "A", "contradicted").when(F.col("l_returnflag") == "N", "verified").otherwise("uncertain")
    own = in_order(spark, sf_dir, "lineitem") if ordered else table(spark, sf_dir, "lineitem")
    return own.select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("checker"), verdict.alias("verdict"), (F.col("l_discount") * 10).alias("confidence"), (1 - F.col("l_tax")).alias("weight"), *(["row"] if ordered else []))


WEIGHTED = """b AS (SELECT claim_id, verdict, sum(weight * confidence) s, sum(weight * confidence * confidence) c FROM v GROUP BY 1, 2),
o AS (SELECT claim_id, sum(s) al, first({'v': verdict, 's': s, 'c': c} ORDER BY -s, verdict) t FROM b GROUP BY 1),
weighted AS (SELECT claim_id, CASE WHEN al <= 0 THEN 'unverifiable' WHEN t.v = 'contradicted' AND t.c / t.s <= 0.4 THEN 'uncertain' ELSE t.v END verdict, round(CASE WHEN al > 0 THEN t.s / al ELSE 0 END, 6) AS share FROM o)"""
MAJORITY = f"""g AS (SELECT claim_id, count(*) n, sum(weight) al, {OF('contradicted', 'weight')} c, {OF('uncertain', 'weight')} u, {OF('unverifiable', 'weight')} x, {OF('verified', 'weight')} ok FROM v GROUP BY 1),
majority AS (SELECT claim_id, CASE WHEN n < 2 THEN 'unverifiable' WHEN greatest(c, u, x, ok) / al < 0.5 AND c > 0 THEN 'uncertain' WHEN c = greatest(c, u, x, ok) THEN 'contradicted' WHEN u = greatest(c, u, x, ok) THEN 'uncertain' WHEN x = greatest(c, u, x, ok) THEN 'unverifiable' ELSE 'verified' END verdict FROM g)"""
BORDA = """q AS (SELECT *, count(*) OVER (PARTITION BY claim_id) - row_number() OVER (PARTITION BY claim_id ORDER BY weight * confidence DESC, checker, verdict) + 1 p FROM v),
borda AS (SELECT claim_id, first(verdict ORDER BY p DESC, verdict) verdict FROM (SELECT claim_id, verdict, sum(p) p FROM q GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {VOTES}, {WEIGHTED} SELECT * FROM weighted")
def vote_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.vote_weighted(line_votes(spark, sf_dir, ordered=True), ["claim_id"], order="row")


@query(f"WITH {VOTES}, {WEIGHTED}, {MAJORITY}, {BORDA} SELECT claim_id, m.verdict majority, w.verdict weighted, b.verdict borda, m.verdict = w.verdict AND w.verdict = b.verdict agree FROM majority m JOIN weighted w USING (claim_id) JOIN borda b USING (claim_id)")
def compare_vote_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.compare_vote_modes(line_votes(spark, sf_dir, ordered=True), ["claim_id"], order="row")


# -- names: parts whose key is divisible by 20 ask, all parts are searched

GRAMS2 = "SELECT p_partkey id, p_name x, lower(regexp_replace(p_name, '\\s+', '', 'g')) z FROM part"


@query(
    rf"""WITH n AS ({GRAMS2}), u AS (SELECT id, unnest([substr(z, i, 2) for i in range(1, length(z))]) g FROM n), t AS (SELECT id, g, count(*) tf FROM u GROUP BY 1, 2), l AS (SELECT id, sqrt(sum(tf * tf)) l FROM t GROUP BY 1),
d AS (SELECT a.id a, b.id b, sum(a.tf * b.tf) s FROM t a JOIN t b USING (g) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY 1, 2), c AS (SELECT a, b, round(s / (x.l * y.l), 6) j FROM d JOIN l x ON x.id = a JOIN l y ON y.id = b)
SELECT a name_id, first(b ORDER BY j DESC, b) entity_id, max(j) similarity FROM c WHERE j >= 0.6 GROUP BY 1"""
)
def fuzzy_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return similarity.fuzzy_entity(parts.where("id % 20 = 0"), parts, others=True)


@query(
    rf"""WITH n AS ({GRAMS2}), t AS (SELECT id, lower(x) x, list_distinct([substr(z, i, 2) for i in range(1, length(z))]) g, list_distinct(string_split(lower(x), '')) ch FROM n),
c AS (SELECT a.id a, b.id b, a.x ax, b.x bx, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) j, len(list_intersect(a.ch, b.ch)) / len(a.ch) o FROM t a JOIN t b ON a.id % 20 = 0 AND a.id <> b.id),
s AS (SELECT a, b, ax, round(least(1.0, 0.65 * j + 0.35 * o + CASE WHEN contains(bx, ax) THEN 0.05 ELSE 0 END), 6) score FROM c WHERE j >= 0.3)
SELECT a claim_id, first(b ORDER BY score DESC, b) fact_id, max(score) score FROM s WHERE score >= CASE WHEN length(ax) < 10 THEN 0.6 ELSE 0.4 END GROUP BY 1"""
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return similarity.best_match(parts.where("id % 20 = 0"), parts, others=True)


# -- graphs from text: statements about suppliers, customers and parts, derived from the tables

STATED = """stated AS (SELECT s_suppkey k, s_name nm, n_name pl, n_nationkey nk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
facts AS (SELECT k, 'Supplier' || k subj, 'LOCATED_AT' rel, upper(substr(pl, 1, 1)) || lower(regexp_replace(substr(pl, 2), '[^A-Za-z]', '', 'g')) obj FROM stated UNION ALL SELECT k, 'Supplier' || k, 'BORN_IN', CAST(1800 + nk AS VARCHAR) FROM stated
UNION ALL SELECT s.k, 'Supplier' || s.k, 'NOT', upper(substr(n_name, 1, 1)) || lower(regexp_replace(substr(n_name, 2), '[^A-Za-z]', '', 'g')) FROM stated s JOIN nation n ON n.n_nationkey = (s.nk + 1) % 25
UNION ALL SELECT k, 'Supplier' || k, 'INVENTED', 'engine' || chr(CAST(97 + nk AS INTEGER)) FROM stated)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.regexp_replace(F.substring(F.col("n_name"), 2, 100), "[^A-Za-z]", ""))).alias("place"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    other = n.select(F.col("n_nationkey").alias("next"), F.col("place").alias("not_place"))
    s = s.join(other, F.col("next") == (F.col("s_nationkey") + 1) % 25)
    who = F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string"))
    text = F.concat(
        who, F.lit(" is located in "), "place", F.lit(". "), who, F.lit(" was born in "), (1800 + F.col("s_nationkey")).cast("string"), F.lit(". "),
        who, F.lit(" is not in "), "not_place", F.lit(". "), who, F.lit(" invented the engine"), F.char(97 + F.col("s_nationkey")), F.lit("."),
    )
    return s.select(F.col("s_suppkey").alias("k"), text.alias("text"))


@query(f"WITH {STATED} SELECT * FROM facts")
def extract_kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples read from four sentences about each supplier."""
    return graph.extract_kg_triples(_statements(spark, sf_dir), "k", "text")


def _nth(df: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """df with a column nth: its key modulo the number of rows of the other table, whose keys count from 0."""
    return df.crossJoin(F.broadcast(of.agg(F.count("*").alias("_n")))).withColumn("nth", F.col(key) % F.col("_n")).drop("_n")  # one row


CLAIMED = """claimed AS (SELECT c_custkey claim_id, 'Supplier' || s_suppkey subj, ['LOCATED_AT', 'ENDED_IN', 'INVENTED'][1 + c_custkey % 3] rel, CASE c_custkey % 3 WHEN 0 THEN upper(substr(n_name, 1, 1)) || lower(regexp_replace(substr(n_name, 2), '[^A-Za-z]', '', 'g'))
WHEN 1 THEN CAST(1805 + c_nationkey AS VARCHAR) ELSE 'engine' || chr(CAST(97 + c_nationkey AS INTEGER)) END obj FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = c_nationkey)"""


@query(
    f"""WITH {STATED}, {CLAIMED}, j AS (SELECT claim_id, CASE WHEN c.rel = 'ENDED_IN' AND f.rel = 'BORN_IN' AND TRY_CAST(c.obj AS INTEGER) < TRY_CAST(f.obj AS INTEGER) THEN {{'c': 0.85, 'r': 'born_later'}} WHEN c.rel IN ('LOCATED_AT', 'IN') AND f.rel = 'NOT' AND c.obj = f.obj THEN {{'c': 0.9, 'r': 'negated'}}
WHEN f.rel = 'NOT' AND (contains(c.obj, f.obj) OR contains(f.obj, c.obj)) AND least(length(c.obj), length(f.obj)) / greatest(length(c.obj), length(f.obj)) >= 0.8 THEN {{'c': 0.9, 'r': 'not_part'}} WHEN c.rel = 'LOCATED_AT' AND f.rel = 'LOCATED_AT' AND c.obj <> f.obj THEN {{'c': 0.8, 'r': 'other_place'}} END x
FROM claimed c JOIN (SELECT DISTINCT subj, rel, obj FROM facts) f USING (subj) UNION ALL SELECT claim_id, CASE WHEN c.obj = f.obj THEN {{'c': 0.8, 'r': 'other_maker'}} WHEN len(list_intersect(list_distinct([substr(c.obj, i, 2) for i in range(1, length(c.obj))]), list_distinct([substr(f.obj, i, 2) for i in range(1, length(f.obj))]))) /
len(list_distinct(list_concat([substr(c.obj, i, 2) for i in range(1, length(c.obj))], [substr(f.obj, i, 2) for i in range(1, length(f.obj))]))) >= 0.6 THEN {{'c': 0.75, 'r': 'other_maker'}} END FROM claimed c JOIN (SELECT DISTINCT subj, obj FROM facts WHERE rel = 'INVENTED') f ON c.rel = 'INVENTED' AND c.subj <> f.subj AND substr(c.obj, 1, 2) = substr(f.obj, 1, 2))
SELECT claim_id, b.r "rule", b.c::DOUBLE confidence FROM (SELECT claim_id, first(x ORDER BY x.c DESC, x.r DESC) b FROM j WHERE x IS NOT NULL GROUP BY 1)"""
)
def kg_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim about a supplier for each customer, against the triples read from text."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.regexp_replace(F.substring(F.col("n_name"), 2, 100), "[^A-Za-z]", ""))).alias("place"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    c = _nth(table(spark, sf_dir, "customer"), "c_custkey", s).join(s, F.col("s_suppkey") == F.col("nth")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    kind = F.col("c_custkey") % 3
    obj = F.when(kind == 0, F.col("place")).when(kind == 1, (1805 + F.col("c_nationkey")).cast("string")).otherwise(F.concat(F.lit("engine"), F.char(97 + F.col("c_nationkey"))))
    rel = F.when(kind == 0, "LOCATED_AT").when(kind == 1, "ENDED_IN").otherwise("INVENTED")
    claims = c.select(F.col("c_custkey").alias("claim_id"), F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string")).alias("subj"), rel.alias("rel"), obj.alias("obj"))
    return graph.kg_contradictions(claims, graph.extract_kg_triples(_statements(spark, sf_dir), "k", "text"))


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey src, o_custkey % (SELECT count(*) FROM supplier) dst, CASE l_returnflag WHEN 'R' THEN 'contradicts' WHEN 'A' THEN 'overrides' ELSE 'supports' END t FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
b AS (SELECT src a, dst b FROM e WHERE t <> 'supports' AND src <> dst UNION SELECT dst, src FROM e WHERE t <> 'supports' AND src <> dst) SELECT a node, count(*) n, round(avg(s_acctbal), 6) mean_confidence FROM b JOIN supplier ON s_suppkey = b GROUP BY 1"""
)
def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_returnflag") == "A", "overrides").otherwise("supports")
    o = _nth(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "supplier"))
    e = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("src"), F.col("nth").alias("dst"), kind.alias("type")).distinct()
    return graph.competitors(e, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("confidence")))


@query(
    f"""WITH {VOTES}, p AS (SELECT l_partkey f, l_suppkey s, CASE l_returnflag WHEN 'A' THEN 'contradicted' ELSE 'verified' END r FROM lineitem), g AS (SELECT f, count(DISTINCT s) a, count(*) b, count(*) FILTER (r = 'contradicted') c FROM p GROUP BY 1)
SELECT f p_partkey, a n_sources, b n_events, c n_conflicts, round(greatest(0, least(1, 0.5 + 0.1 * least(a, 5) - 0.15 * c - 0.02 * greatest(b - 3, 0))), 6) confidence, CASE WHEN c >= 2 THEN 'disputed' WHEN a >= 3 AND c = 0 THEN 'confirmed' ELSE 'open' END status FROM g"""
)
def provenance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.when(F.col("l_returnflag") == "A", "contradicted").otherwise("verified").alias("verdict"))
    return graph.provenance_score(own, "p_partkey", "l_suppkey", "verdict")


@query("WITH e AS (SELECT min(s_suppkey) e1, count(DISTINCT s_suppkey) k, s_nationkey f FROM supplier GROUP BY s_nationkey) SELECT c_custkey fact_id, e1 entity_id, k n_entities FROM customer JOIN e ON c_nationkey = f")
def link_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("fact"))
    return graph.link_entity_ids(s, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fact_id"), F.col("c_nationkey").alias("fact")))


@query("SELECT entity, fact_hash, pos::INTEGER pos FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fact_hash) pos FROM (SELECT DISTINCT l_suppkey entity, l_orderkey fact_hash FROM lineitem)) WHERE pos <= 200")
def entity_fact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_fact_map(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("fact_hash")))


@query(
    r"""WITH q0 AS (SELECT 'part ' || p_partkey query_id, p_name q FROM part UNION ALL SELECT 'supplier ' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'region ' || r_regionkey, r_name || ' and others' FROM region UNION ALL SELECT 'nation ' || n_nationkey, n_name FROM nation),
q AS (SELECT *, regexp_replace(lower(q), '\s+', '', 'g') qp FROM q0), e AS (SELECT 'supplier ' || s_suppkey entity_id, s_name n FROM supplier UNION ALL SELECT 'part ' || p_partkey, upper(p_name) FROM part UNION ALL SELECT 'region ' || r_regionkey, r_name FROM region),
a AS (SELECT n q, min(entity_id) e1 FROM e GROUP BY 1), b AS (SELECT regexp_replace(lower(n), '\s+', '', 'g') qp, min(entity_id) e2 FROM e GROUP BY 1), h AS (SELECT substr(regexp_replace(lower(n), '\s+', '', 'g'), 1, 3) qh, min(entity_id) e3 FROM e GROUP BY 1 HAVING count(*) = 1)
SELECT query_id, coalesce(e1, e2, e3) entity_id, CASE WHEN e1 IS NOT NULL THEN 'exact' WHEN e2 IS NOT NULL THEN 'plain' WHEN e3 IS NOT NULL THEN 'prefix' ELSE 'none' END stage FROM q LEFT JOIN a USING (q) LEFT JOIN b USING (qp) LEFT JOIN h ON qh = substr(qp, 1, 3)"""
)
def resolve_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, suppliers, nations and longer ones of regions, against a base of suppliers, parts in capitals and regions."""
    named = lambda t, kind, key, name: table(spark, sf_dir, t).select(F.concat(F.lit(f"{kind} "), F.col(key).cast("string")), name)
    suppliers = named("supplier", "supplier", "s_suppkey", F.col("s_name"))
    base = suppliers.union(named("part", "part", "p_partkey", F.upper("p_name"))).union(named("region", "region", "r_regionkey", F.col("r_name")))
    asked = suppliers.union(named("part", "part", "p_partkey", F.col("p_name"))).union(named("region", "region", "r_regionkey", F.concat("r_name", F.lit(" and others")))).union(named("nation", "nation", "n_nationkey", F.col("n_name")))
    return graph.resolve_entity(asked.toDF("query_id", "name"), base.toDF("entity_id", "name"))


# -- feedback, audit and logs: events as they are


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a user's word on a claim: what was found, and what the user says instead."""
    own = table(spark, sf_dir, "events")
    said = F.when(F.col("value") > 60, "contradicted").when(F.col("value") > 25, "verified").otherwise("uncertain")
    return own.select(F.concat(F.lit("claim "), F.col("user_id").cast("string")).alias("claim"), F.when(F.col("event_type") == "error", "contradicted").otherwise("verified").alias("detected_verdict"), said.alias("user_verdict"), F.when(F.col("value") > 40, F.col("event_type")).alias("correction"), "ts", "event_id")


FEEDBACK = "fb AS (SELECT 'claim ' || user_id claim, CASE event_type WHEN 'error' THEN 'contradicted' ELSE 'verified' END d, CASE WHEN value > 60 THEN 'contradicted' WHEN value > 25 THEN 'verified' ELSE 'uncertain' END u, CASE WHEN value > 40 THEN event_type END correction FROM events)"


@query(f"WITH {FEEDBACK} SELECT d detected_verdict, u user_verdict, count(*) n, round(avg(CASE WHEN d = u THEN 1.0 ELSE 0 END), 6) agreement, grouping(d, u)::INTEGER AS \"grouping\" FROM fb GROUP BY GROUPING SETS ((), (d), (d, u))")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_stats(_feedback(spark, sf_dir))


@query(f"WITH {FEEDBACK} SELECT DISTINCT claim FROM fb WHERE d <> u")
def disagreed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.disagreed_claims(_feedback(spark, sf_dir))


@query(f"WITH {FEEDBACK}, c AS (SELECT claim, correction, count(*) n FROM fb WHERE correction IS NOT NULL GROUP BY 1, 2) SELECT claim, first(correction ORDER BY n DESC, correction) correction, max(n) n, sum(n)::BIGINT n_all FROM c GROUP BY 1 HAVING sum(n) >= 2")
def approve_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.approve_corrections(_feedback(spark, sf_dir))


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def latest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.latest_record(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", "event_type")


@query(
    """WITH g AS (SELECT event_type, date_trunc('hour', ts) h, count(*) n, count(DISTINCT user_id) n_operators, grouping(event_type, date_trunc('hour', ts)) g FROM events GROUP BY GROUPING SETS ((), (event_type), (date_trunc('hour', ts))))
SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'kind' ELSE 'hour' END AS "section", event_type kind, h AS "hour", n, n_operators FROM g"""
)
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.compliance_report(table(spark, sf_dir, "events"), "event_type", "ts", "user_id")


@query(
    """WITH s AS (SELECT lang, text, quality = 0 actual, regexp_matches(text, '[#*$%&|]') predicted FROM documents JOIN labels USING (doc_id)), w AS (SELECT lang, CASE WHEN predicted THEN 'FP' ELSE 'FN' END kind, CASE WHEN length(text) < 200 THEN 'short' WHEN contains(text, '@') THEN 'address' WHEN regexp_matches(text, '[0-9]') THEN 'numbers' ELSE 'other' END cause FROM s WHERE predicted <> actual),
g AS (SELECT lang, kind, cause, count(*) n FROM w GROUP BY 1, 2, 3) SELECT lang, kind, cause, n, share FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share FROM g) WHERE n >= 3"""
)
def error_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with symbols taken as bad ones: where the labels disagree, and why."""
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "text", (F.col("quality") == 0).alias("actual"), F.col("text").rlike(r"[#*$%&|]").alias("predicted"))
    return feedback.error_root_causes(own, (("short", F.length("text") < 200), ("address", F.contains("text", F.lit("@"))), ("numbers", F.col("text").rlike("[0-9]"))), "lang")


@query(
    """WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, avg(value) score FROM events GROUP BY 1), w AS (SELECT *, max(score) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b, lag(score) OVER (ORDER BY day) l FROM d)
SELECT day, round(score, 6) score, round(b, 6) best_before, coalesce(score < 0.9 * b, false) degraded, CASE WHEN score > l THEN 'up' WHEN score < l THEN 'down' WHEN l IS NOT NULL THEN 'same' END trend FROM w"""
)
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("score"))
    return feedback.baseline_compare(daily, "day", "score")


@query("SELECT event_type, count(*) n, round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(avg(CASE WHEN value > 90 THEN 1.0 ELSE 0 END), 6) error_rate, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.99), 6) p99 FROM events GROUP BY 1")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.trace_summary(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") > 90)


@query(
    f"""WITH {VOTES}, b AS (SELECT checker, verdict, count(*) n, sum(confidence) c FROM v GROUP BY 1, 2), r AS (SELECT checker, count(DISTINCT claim_id) n_claims FROM v GROUP BY 1)
SELECT checker, sum(n)::BIGINT n, round(sum(c) / sum(n), 6) mean_confidence, string_agg(verdict || '=' || n, ',' ORDER BY verdict) verdicts, max(n_claims) n_claims FROM b JOIN r USING (checker) GROUP BY 1"""
)
def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.log_stats(line_votes(spark, sf_dir), "checker", "verdict", "confidence", "claim_id")


@query(f"WITH {VOTES} SELECT claim_id, checker, verdict, confidence, weight FROM v WHERE verdict = 'contradicted' AND confidence > 0.7")
def should_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.should_alert(line_votes(spark, sf_dir))


@query(FOLDS["exponential_ban"])
def exponential_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that ban a user: two within a day, for a day first and ten days at most."""
    own = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return metrics.exponential_ban(own, "user_id", "at", "event_id", 2, 86400, 86400, 864000).select("user_id", "event_id")
