"""Registered queries of belief, arbitration, evidence, consistency, edits, laundering, zones, panels and prime numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators import belief as B
from claimforge.operators import kb, votes
from claimforge.plans import truth
from claimforge.plans.base import query, table
from claimforge.plans.more import line_votes
from claimforge.plans.oracles import VOTES

FLAG = "CASE l_returnflag WHEN '{0}' THEN 1 ELSE 0 END"
NODES = """u AS (SELECT l_suppkey k, count(*) n, avg(CASE l_returnflag WHEN 'N' THEN 1.0 ELSE 0 END) ok, sum(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) bad, count(DISTINCT l_partkey) parts FROM lineitem GROUP BY 1),
nodes AS (SELECT s_suppkey node, greatest(0.0, s_acctbal / 10000) confidence, CASE s_suppkey % 9 WHEN 0 THEN 'archived' ELSE 'active' END state, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 120 END vd, s_suppkey % 200 cd, coalesce(n, 0) usage, coalesce(ok, 0) ok, coalesce(bad, 0) % 6 bad, coalesce(parts, 0) % 5 validators FROM supplier LEFT JOIN u ON k = s_suppkey)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as facts; what is known of them comes from their lines."""
    flag = lambda x: F.when(F.col("l_returnflag") == x, 1.0).otherwise(0.0)
    u = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(flag("N")).alias("ok"), F.sum(flag("R")).cast("long").alias("bad"), F.count_distinct("l_partkey").alias("parts"))
    s, key = table(spark, sf_dir, "supplier").join(u, F.col("l_suppkey") == F.col("s_suppkey"), "left"), F.col("s_suppkey")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return s.select(
        key.alias("node"), F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000).alias("confidence"), F.when(key % 9 == 0, "archived").otherwise("active").alias("state"),
        F.when(key % 4 != 0, key % 120).alias("validated_days"), (key % 200).alias("created_days"), n("n").alias("usage"), n("ok").alias("adoption"), (n("bad") % 6).alias("contradictions"),
        (n("parts") % 5).alias("validators"), n("ok").alias("reliability"),
    )


RIVALS = "e AS (SELECT a.s_suppkey src, b.s_suppkey dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey % 7 = 0 AND a.s_suppkey <> b.s_suppkey), rivals AS (SELECT src node, dst other FROM e UNION SELECT dst, src FROM e)"
BELIEFS = f"""{NODES}, {RIVALS}, c AS (SELECT rivals.node, round(avg(confidence), 6) m FROM rivals JOIN nodes ON nodes.node = other GROUP BY 1),
f AS (SELECT nodes.*, c.m, CASE WHEN vd IS NOT NULL THEN pow(0.5, least(vd, cd) / 90) ELSE pow(0.5, cd / 30) END age, CASE WHEN usage > 0 THEN 1 + least(0.2, ln(usage + 1) * 0.05) + CASE WHEN ok > 0.5 THEN 0.1 ELSE 0.0 END ELSE 1.0 END use,
CASE WHEN bad > 0 THEN greatest(0.3, 1 - bad * 0.15) ELSE 1.0 END doubt, 1 + least(0.3, validators * 0.08) checked, 0.5 + ok * 0.5 src FROM nodes LEFT JOIN c USING (node)),
beliefs AS (SELECT node, round(CASE WHEN state = 'archived' THEN confidence ELSE greatest(0.0, greatest(0.0, least(1.0, confidence * age * use * doubt * checked * src)) - greatest(0.0, coalesce(m, confidence) - confidence) * 0.3) END, 6) belief,
round(age, 6)::DOUBLE age_factor, round(use, 6)::DOUBLE use_factor, round(doubt, 6)::DOUBLE doubt_factor, round(checked, 6)::DOUBLE check_factor, round(src, 6)::DOUBLE source_factor FROM f)"""


def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rivals = s.where("s_suppkey % 7 = 0").toDF("dst", "s_nationkey")
    edges = s.join(rivals, "s_nationkey").where("s_suppkey <> dst").select(F.col("s_suppkey").alias("src"), "dst", F.lit("contradicts").alias("type"))
    return B.belief(_nodes(spark, sf_dir), edges)


@query(f"WITH {BELIEFS} SELECT * FROM beliefs")
def belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beliefs(spark, sf_dir)


@query(f"WITH {BELIEFS} SELECT * FROM beliefs ORDER BY belief DESC, node LIMIT 20")
def rank_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return B.rank_beliefs(_beliefs(spark, sf_dir), 20)


@query(
    f"""WITH {NODES}, r AS (SELECT node, round(greatest(0.0, least(0.4, validators * 0.1) + least(0.2, usage % 7 * 0.05) + ok * 0.2 + CASE WHEN vd IS NOT NULL THEN greatest(0.0, 0.1 - vd * 0.001) ELSE 0 END - least(0.3, bad * 0.1)), 6)::DOUBLE s FROM nodes),
p AS (SELECT s_suppkey a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) b FROM supplier), j AS (SELECT a, b, x.s sa, y.s sb, round(abs(x.s - y.s), 6) m FROM p JOIN r x ON x.node = a JOIN r y ON y.node = b)
SELECT a, b, sa score_a, sb score_b, CASE WHEN m >= 0.1 THEN CASE WHEN sa > sb THEN a ELSE b END END winner, CASE WHEN m < 0.1 THEN 0.3 ELSE round(least(0.9, 0.5 + m), 6) END::DOUBLE confidence, CASE WHEN m < 0.1 THEN 'review' WHEN m > 0.3 THEN 'downgrade_loser' ELSE 'flag_both' END AS "action" FROM j"""
)
def arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier against the next one of its nation."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    pairs = s.select(F.col("s_suppkey").alias("a"), F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("b")).where("b is not null")
    n = _nodes(spark, sf_dir)
    records = n.select(F.col("node").alias("fact"), F.col("validators").alias("n_sources"), (F.col("usage") % 7).alias("n_checks"), F.col("reliability").alias("source_trust"), F.col("validated_days").alias("days"), F.col("contradictions").alias("unresolved"))
    return B.arbitrate(pairs, records)


@query(
    """WITH ev AS (SELECT l_partkey hash, list_sort(list(DISTINCT 's' || l_suppkey)) s, count(*) n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), c AS (SELECT l_partkey hash, list_sort(list(DISTINCT 'o' || l_orderkey)) e, count(*) n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45 GROUP BY 1)
SELECT p_partkey hash, CASE WHEN c.n > 0 THEN 'contradicted' WHEN ev.n > 0 THEN 'supported' ELSE 'unverified' END verdict, coalesce(array_to_string(s, ','), '') sources, coalesce(ev.n, 0) n_evidence, coalesce(c.n, 0) n_conflicts, coalesce(array_to_string(e, ','), '') entities FROM part LEFT JOIN ev ON ev.hash = p_partkey LEFT JOIN c ON c.hash = p_partkey"""
)
def attach_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts: lines that weren't returned are evidence, large ones that were are conflicts."""
    own, part = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    evidence = own.where("l_returnflag <> 'R'").select(part.alias("hash"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.lit(0.5).alias("confidence"))
    conflicts = own.where("l_returnflag = 'R' AND l_linestatus = 'F'").select(part.alias("hash_a"), part.alias("hash_b"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("entity"), (F.col("l_quantity") <= 45).alias("resolved"))
    out = B.attach_evidence(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash")), evidence, conflicts)
    return out.withColumn("sources", F.concat_ws(",", "sources")).withColumn("entities", F.concat_ws(",", "entities"))


_GRAMS, _CHARS = "list_distinct([substr({0}, i, 2) for i in range(1, length({0}))])", "list_distinct(string_split({0}, ''))"
_SHARE = lambda x: f"(len(list_intersect({x.format('fact')}, {x.format('old')})) / len(list_distinct(list_concat({x.format('fact')}, {x.format('old')}))))"


@query(
    rf"""WITH n AS (SELECT DISTINCT 'nation ' || c_nationkey "key", c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN ' trade is not safe' WHEN c_custkey % 5 = 1 THEN ' trade can be ignored' ELSE ' trade is safe' END fact FROM customer),
h AS (SELECT 'nation ' || n_nationkey "key", 'BUILDING trade is safe' old, 'anchor' kind FROM nation UNION SELECT 'nation ' || s_nationkey, 'MACHINERY goods of ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ' are not known' ELSE ' are known' END, 'existing' FROM supplier),
d AS (SELECT *, regexp_matches(fact, '(?i)\b(is not|are not|was not|not|no|never|does not exist|fake)\b') d FROM n), x AS (SELECT *, regexp_matches(old, '(?i)\b(is not|are not|was not|not|no|never|does not exist|fake)\b') d FROM h),
hits AS (SELECT d.key, fact, list(DISTINCT kind) kinds FROM d JOIN x ON d.key = x.key AND d.d <> x.d WHERE substr(fact, 1, 2) = substr(old, 1, 2) OR {_SHARE(_GRAMS)} > 0.18 OR {_SHARE(_CHARS)} > 0.35 GROUP BY 1, 2),
r AS (SELECT d.key, d.fact, list_sort(list_concat(coalesce(kinds, []), CASE WHEN contains(d.fact, 'ignored') THEN ['ignore'] ELSE [] END)) r FROM d LEFT JOIN hits USING ("key", fact)) SELECT "key", fact, len(r) = 0 accepted, array_to_string(r, ',') reasons FROM r"""
)
def check_kb_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers say of their nation's trade, against anchors and what suppliers' rows say."""
    key = F.col("c_custkey") % 5
    nation = lambda c: F.concat(F.lit("nation "), F.col(c).cast("string")).alias("key")
    new = table(spark, sf_dir, "customer").select(nation("c_nationkey"), F.concat("c_mktsegment", F.when(key == 0, " trade is not safe").when(key == 1, " trade can be ignored").otherwise(" trade is safe")).alias("fact"))
    anchors = table(spark, sf_dir, "nation").select(nation("n_nationkey"), F.lit("BUILDING trade is safe").alias("fact"))
    held = table(spark, sf_dir, "supplier").select(nation("s_nationkey"), F.concat(F.lit("MACHINERY goods of "), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, " are not known").otherwise(" are known")).alias("fact"))
    return B.check_kb_consistency(new, held, anchors, (("ignore", "ignored"),)).withColumn("reasons", F.concat_ws(",", "reasons"))


@query("""SELECT DISTINCT 'n' || s_nationkey "key", s_name fact FROM supplier WHERE s_acctbal >= 0 UNION SELECT DISTINCT 'n' || c_nationkey, c_name FROM customer WHERE c_acctbal > 5000 AND NOT starts_with(c_mktsegment, 'B')""")
def edit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by nation: those of rich customers are added (under a reserved key for some segments), those of indebted suppliers removed."""
    key = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(key("s_nationkey").alias("key"), F.col("s_name").alias("fact"), "s_acctbal")
    reserved = F.when(F.startswith("c_mktsegment", F.lit("B")), "_").otherwise("")
    add = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.lit("add").alias("op"), F.concat(reserved, key("c_nationkey")).alias("key"), F.concat(F.lit(" "), "c_name").alias("fact"))
    return B.edit_facts(s.select("key", "fact"), add.union(s.where("s_acctbal < 0").select(F.lit("remove"), "key", "fact")))


@query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unknown ' || source WHEN 1 THEN '' WHEN 2 THEN 'wiki unknown' ELSE source END o, CASE WHEN lang = 'en' THEN ['web', 'wiki dump'] ELSE ['web'] END s FROM documents)
SELECT doc_id content_id, o original FROM p WHERE (o = '' OR contains(o, 'unknown')) AND NOT contains(o, 'wiki') AND NOT contains(o, 'official') AND list_contains(s, 'wiki dump')"""
)
def detect_laundering(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    origin = F.when(kind == 0, F.concat(F.lit("unknown "), "source")).when(kind == 1, "").when(kind == 2, "wiki unknown").otherwise(F.col("source"))
    sources = F.when(F.col("lang") == "en", F.array(F.lit("web"), F.lit("wiki dump"))).otherwise(F.array(F.lit("web")))
    return B.detect_laundering(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), origin.alias("original"), sources.alias("sources")))


@query(
    """WITH f AS (SELECT event_type source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) target, value > 50 t FROM events) SELECT source, target, count(*) n, sum(CASE WHEN t THEN 1 ELSE 0 END)::BIGINT n_tainted, source <= target ok FROM f WHERE target IS NOT NULL GROUP BY 1, 2"""
)
def zone_flow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's steps from one kind of event to the next; steps down the alphabet aren't allowed."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    step = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    flows = e.select(F.col("event_type").alias("source"), step.alias("target"), (F.col("value") > 50).alias("tainted")).where("target is not null")
    kinds = e.select("event_type").distinct()
    allowed = kinds.toDF("source").join(kinds.toDF("target"), F.col("source") <= F.col("target"))
    return B.zone_flow_stats(flows, allowed)


@query(
    """WITH r AS (SELECT l_orderkey, 'm' || l_linenumber m, CASE WHEN l_quantity > 40 THEN 'veto' WHEN l_quantity > 25 THEN 'flag' WHEN l_quantity < 4 THEN 'anchor' ELSE 'pass' END r FROM lineitem),
g AS (SELECT l_orderkey, CASE WHEN avg(CASE WHEN r = 'veto' THEN 1.0 ELSE 0 END) >= 0.5 THEN 'veto' WHEN avg(CASE WHEN r IN ('veto', 'flag') THEN 1.0 ELSE 0 END) >= 0.5 THEN 'flag' WHEN count(*) FILTER (r = 'anchor') > 0 THEN 'anchor' ELSE 'pass' END v, list({'m': m, 'r': r}) x FROM r GROUP BY 1)
SELECT l_orderkey, v verdict, array_to_string(list_sort(list_distinct([y.m for y in x if y.r <> v])), ',') dissenters FROM g"""
)
def panel_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines rate their order."""
    q = F.col("l_quantity")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("m"), F.when(q > 40, "veto").when(q > 25, "flag").when(q < 4, "anchor").otherwise("pass").alias("r"))
    return B.panel_vote(own, "l_orderkey", "m", "r").withColumn("dissenters", F.concat_ws(",", "dissenters"))


@query(
    """WITH n AS (SELECT CAST(range AS BIGINT) n FROM range(2, (SELECT max(p_partkey) + 1 FROM part))), c AS (SELECT DISTINCT a.n * b.n n FROM n a JOIN n b ON a.n <= b.n AND a.n * a.n <= (SELECT max(n) FROM n) AND a.n * b.n <= (SELECT max(n) FROM n)),
p AS (SELECT n FROM n WHERE n NOT IN (SELECT n FROM c)) SELECT n AS prime, lead(n) OVER (ORDER BY n) AS next FROM p QUALIFY next IS NOT NULL"""
)
def adjacent_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primes up to the largest part key, each with the next one."""
    top = table(spark, sf_dir, "part").agg(F.max("p_partkey")).head()[0] or 0  # one number
    return kb.adjacent_pairs(kb.primes_upto(spark, top), "prime")


@query(
    """WITH RECURSIVE e AS (SELECT s_nationkey src, n_nationkey dst, max(0.5 + (s_suppkey % 5) / 10.0) w FROM supplier JOIN nation ON n_nationkey IN ((s_nationkey * 3 + 1) % 25, (s_nationkey + s_suppkey % 3) % 25) WHERE n_nationkey <> s_nationkey GROUP BY 1, 2),
p(root, node, hops, trust, path) AS (SELECT src, dst, 1, w::DOUBLE, [src, dst] FROM e UNION ALL SELECT root, dst, hops + 1, trust * w::DOUBLE * 0.7::DOUBLE, list_append(path, dst) FROM p JOIN e ON src = node AND NOT list_contains(path, dst) WHERE hops < 3)
SELECT root, node, b.h hops, round(b.t, 6) trust, array_to_string(b.p, '>') path FROM (SELECT root, node, first({'h': hops, 't': trust, 'p': path} ORDER BY hops, trust DESC, path) b FROM p GROUP BY 1, 2)"""
)
def trust_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How trust gets from each nation to others along its suppliers' links."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    s, k = table(spark, sf_dir, "supplier"), F.col("s_nationkey")
    links = s.select(k.alias("src"), (0.5 + (F.col("s_suppkey") % 5) / 10).alias("weight"), F.explode(F.array((k * 3 + 1) % 25, (k + F.col("s_suppkey") % 3) % 25)).alias("dst"))
    links = links.join(n, F.col("n_nationkey") == F.col("dst")).select("src", "dst", "weight")
    return kb.trust_path(links, n.select(F.col("n_nationkey").alias("node"))).withColumn("path", F.concat_ws(">", "path"))


@query(
    f"""WITH {VOTES}, a AS ({truth.weighted_sql('v', 'claim_id')}), o AS (SELECT claim_id, max(row(CASE verdict WHEN 'verified' THEN 3 WHEN 'contradicted' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END, confidence)) m FROM v GROUP BY 1),
b AS (SELECT claim_id, CASE m[1] WHEN 3 THEN 'verified' WHEN 2 THEN 'contradicted' WHEN 1 THEN 'uncertain' END v, m[2] c FROM o), t AS (SELECT a.*, b.v, b.c, (a.verdict = 'uncertain' OR a.confidence < 0.6) AND b.c >= a.confidence t FROM a JOIN b USING (claim_id))
SELECT claim_id, CASE WHEN t THEN v ELSE verdict END verdict, CASE WHEN t THEN c ELSE confidence END confidence, CASE WHEN t THEN 'retrieval' ELSE 'first' END stage FROM t"""
)
def verify_with_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted decision on each order, with the best single vote put in where it is unsure."""
    own = line_votes(spark, sf_dir)
    return votes.verify_with_retrieval(votes.decide_weighted(own, ["claim_id"]), votes.aggregate_checks(own, "claim_id"), "claim_id")
