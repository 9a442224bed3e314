"""The registered queries: each takes (spark, sf_dir) and reads the tables there. SQL beside a query gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.functions import text as T
from claimforge.operators import claims, graph, kb, metrics, scan, sessions, similarity, votes
from claimforge.plans import oracles, truth
from claimforge.plans.base import HASH, ORACLE_SQL, QUERIES, SENTENCES, in_order, query, seed, sentences, spread, table
from claimforge.sources.staging import shared_path, staged
from claimforge.streaming import keyed, stream

FLAGSHIP = "document_report"


# -- claims and facts


@query(f"WITH {SENTENCES} SELECT doc_id, sent_no, sentence FROM sents")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir)


@query(
    f"""WITH {SENTENCES}, c AS (SELECT doc_id, sent_no, sentence, CASE WHEN regexp_matches(lower(sentence), '\\b(always|never|all|none|every)\\b') THEN 'absolute' WHEN regexp_matches(lower(sentence), '\\b(is|are|was|were) (a|an|the)\\b') THEN 'definition'
WHEN regexp_matches(lower(sentence), '[0-9]') THEN 'quantity' WHEN regexp_matches(lower(sentence), '\\b(of|from|with|by)\\b') THEN 'relation' END t FROM sents WHERE length(sentence) >= 5 AND NOT regexp_matches(lower(sentence), '^(ok|well|sure|yes|no|thanks|hello)\\b')),
e AS (SELECT *, list_concat(regexp_extract_all(sentence, '"([^"]+)"', 1), regexp_extract_all(sentence, '([A-Z][a-z]{{2,}})', 1)) w FROM c)
SELECT doc_id, sent_no, coalesce(t, 'other') claim_type, CASE WHEN t = 'absolute' THEN 0.7 ELSE 0.5 END::DOUBLE confidence, least(5, len(list_distinct(w)))::INTEGER n_entities FROM e WHERE t IS NOT NULL OR len(w) > 0"""
)
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.extract_claims(sentences(spark, sf_dir)).select("doc_id", "sent_no", "claim_type", "confidence", F.size("entities").alias("n_entities"))


@query(f"SELECT doc_id, {HASH.format('text')} hash, sha256(lang || chr(10) || text) content_id, length(sha256(lang)) AS n FROM documents")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_hash(F.col("text")).alias("hash"), T.content_id(F.col("text"), F.col("lang")).alias("content_id"), F.length(F.sha2("lang", 256)).cast("long").alias("n"))


@query("SELECT doc_id, substr(sha256(encode(text)[1:200]), 1, 16) fact_id FROM documents")
def fact_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fact_id(F.col("text")).alias("fact_id"))


@query(
    r"""WITH t AS (SELECT p_partkey, regexp_replace(p_name, '\s+', '', 'g') s FROM part)
SELECT p_partkey, CASE WHEN length(s) >= 3 THEN len(list_distinct([substr(s, i, 3) for i in range(1, length(s) - 1)])) ELSE 0 END::INTEGER n_trigrams FROM t"""
)
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.char_ngrams(T.squeeze(F.col("p_name")), 3)).alias("n_trigrams"))


@query(f"WITH {SENTENCES} SELECT {HASH.format('sentence')} hash, sentence fact, count(*) n, count(DISTINCT source) n_sources FROM sents JOIN documents USING (doc_id) GROUP BY sentence")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = claims.split_sentences(docs.select(F.struct("doc_id", "source").alias("k"), "text"), key="k").select("k.source", F.col("sentence").alias("fact"))
    return kb.dedupe_exact(own)


@query("SELECT lang, source, count(*) n, count(DISTINCT text) n_distinct FROM documents GROUP BY ROLLUP (lang, source)")
def fact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.fact_stats(table(spark, sf_dir, "documents").withColumnRenamed("text", "fact"), "lang", "source")


@query(f"WITH {SENTENCES} SELECT DISTINCT {HASH.format('fact')} hash, fact FROM seeds WHERE fact NOT IN (SELECT sentence FROM sents)")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.insert_new(sentences(spark, sf_dir).select(F.col("sentence").alias("fact")), seed(spark, sf_dir))


@query(
    f"""WITH {SENTENCES}, x AS (SELECT sentence, count(*) n, count(DISTINCT doc_id) n_sources FROM sents GROUP BY sentence)
SELECT sentence, n, n_sources, round(n / n_sources, 6) ratio, (n / n_sources > 5 AND n_sources < 3) suspicious FROM x"""
)
def source_pollution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.source_pollution(sentences(spark, sf_dir), "sentence", "doc_id")


@query(
    """WITH n AS (SELECT s_nationkey k, sha256(concat_ws('|', array_to_string(list_sort(list(DISTINCT s_name)), '|'), min('s'))) h FROM supplier GROUP BY 1),
o AS (SELECT s_nationkey k, sha256(concat_ws('|', array_to_string(list_sort(list(DISTINCT s_name)), '|'), min('s'))) h FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT coalesce(n.k, o.k) s_nationkey, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN n.h = o.h THEN 'unchanged' ELSE 'modified' END change FROM n FULL OUTER JOIN o ON n.k = o.k"""
)
def diff_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two versions of the base are all of a state's suppliers and those with a positive balance."""
    own = table(spark, sf_dir, "supplier").withColumn("src", F.lit("s"))
    return kb.diff_manifest(kb.manifest(own, "s_nationkey", "s_name", "src"), kb.manifest(own.where("s_acctbal > 0"), "s_nationkey", "s_name", "src"), "s_nationkey")


@query(
    """WITH u AS (SELECT s_nationkey k, s_name f, 0 b FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer), o AS (SELECT k, f, min(b) b FROM u GROUP BY 1, 2)
SELECT k AS key, CAST(row_number() OVER (PARTITION BY k ORDER BY b, f) - 1 AS INTEGER) pos, f fact FROM o"""
)
def merge_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("fact"))
    return kb.merge_kb([a, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("fact"))], "key", "fact")


@query(
    """WITH t AS (SELECT ps k, s n, min(l_orderkey * 10 + l_linenumber) h FROM (SELECT l_partkey ps, l_returnflag s, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2)
SELECT a.h hash_a, b.h hash_b, 'part ' || a.k subj, 'returned as' rel, 'value_conflict' conflict FROM t a JOIN t b ON a.k = b.k AND a.h < b.h"""
)
def find_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hash"), F.concat(F.lit("part "), "l_partkey").alias("subj"), F.lit("returned as").alias("rel"), F.col("l_returnflag").alias("obj"), F.lit(False).alias("negation"))
    return kb.find_conflicts(own)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("subj"), F.lit("LOCATED_AT").alias("rel"), F.col("n_name").alias("obj"))
    return s.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subj"), F.lit("IN").alias("rel"), F.col("r_name").alias("obj")))


TRIPLES = "triples AS (SELECT s_name subj, 'LOCATED_AT' rel, n_name obj FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'IN', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {TRIPLES} SELECT DISTINCT subj node, rel, obj other FROM triples UNION SELECT obj, '<-' || rel, subj FROM triples")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.neighbors(geography(spark, sf_dir))


@query(f"WITH {TRIPLES}, c AS (SELECT c_custkey claim_id, s_name subj, n_name obj FROM customer JOIN supplier ON s_suppkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT claim_id, c.subj, 0.8::DOUBLE confidence FROM c JOIN triples t ON c.subj = t.subj AND t.rel = 'LOCATED_AT' AND t.obj <> c.obj")
def kg_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    claimed = own.select(F.col("c_custkey").alias("claim_id"), F.col("s_name").alias("subj"), F.lit("LOCATED_AT").alias("rel"), F.col("n_name").alias("obj"))
    return graph.kg_contradictions(claimed, geography(spark, sf_dir)).join(claimed.select("claim_id", "subj"), "claim_id").select("claim_id", "subj", "confidence")


@query("SELECT s_name, s_name || ' is in ' || v.n_name fact, v.n_name = n.n_name AS label FROM supplier JOIN nation n ON s_nationkey = n_nationkey CROSS JOIN nation v")
def generate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name")
    return kb.generate_facts(own, "s_name", "is in", "n_name", n.select("n_name"))


@query("SELECT p_partkey, o.o AS \"offset\", regexp_replace(t, '[0-9]{1,9}', CAST(CAST(regexp_extract(t, '([0-9]{1,9})', 1) AS BIGINT) + o.o AS VARCHAR)) fact FROM (SELECT p_partkey, p_name || ' has size ' || p_size t FROM part) CROSS JOIN (SELECT unnest([-10, -1, 1, 10])::INTEGER o) o WHERE regexp_extract(t, '([0-9]{1,9})', 1) <> ''")
def perturb_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.perturb_numbers(table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" has size "), F.col("p_size").cast("string")).alias("t")), "p_partkey", "t")


@query(
    """SELECT n, n % 2 = 0 AS even, CAST(floor(sqrt(n)) AS BIGINT) * CAST(floor(sqrt(n)) AS BIGINT) = n AS square, n > 1 AND len([d for d in range(2, CAST(floor(sqrt(n)) AS BIGINT) + 1) if n % d = 0]) = 0 AS prime,
array_to_string([d for d in range(2, 10) if n % d = 0], ',') divisors, (n % 4 = 0 AND n % 100 <> 0) OR n % 400 = 0 AS leap_year, CASE WHEN n >= 1 THEN (n - 1) // 100 + 1 END AS "century" FROM (SELECT DISTINCT p_partkey n FROM part)"""
)
def number_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.number_facts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n")), "n")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 0 AND 10 THEN 'small' WHEN l_quantity BETWEEN 5 AND 30 THEN 'middle' WHEN l_quantity BETWEEN 31 AND 45 THEN 'large' END AS label FROM lineitem")
def range_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(0.0, 10.0, "small", 1), (5.0, 30.0, "middle", 2), (31.0, 45.0, "large", 3)], "start double, end double, label string, rank int")
    return kb.range_label(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", ranges).drop("l_quantity")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('7|' || doc_id)) r FROM labels) WHERE r <= 50")
def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 50 documents of each label."""
    return kb.sample_balanced(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 50)


# -- trust


@query("SELECT event_type, count(*) n, round((sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) + 1) / (count(*) + 2), 6) reputation FROM events GROUP BY 1")
def source_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.source_reputation(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50)


@query(oracles.FOLDS["trust_fold"])
def trust_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust of each user after all events in order: errors lower it, purchases raise it."""
    delta = F.when(F.col("event_type") == "error", -0.1).when(F.col("event_type") == "purchase", 0.05).otherwise(0.0)
    return kb.trust_fold(table(spark, sf_dir, "events").withColumn("delta", delta), "user_id", ["ts", "event_id"], "delta")


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY user_id")
def flow_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.flow_path(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT c_custkey, round(greatest(0.1, c_acctbal / 10000 * pow(0.5, (c_custkey % 90) / 30.0)), 6) trust_now, greatest(0.1, c_acctbal / 10000 * pow(0.5, (c_custkey % 90) / 30.0)) < 0.5 needs_reverify FROM customer")
def trust_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.trust_now(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") / 10000, F.col("c_custkey") % 90, F.lit(30.0), F.lit(0.1)).drop("c_acctbal")


@query(
    """WITH e AS (SELECT DISTINCT s_nationkey src, n_nationkey dst, 0.5 + (s_nationkey % 5) / 10.0 AS weight FROM supplier JOIN nation ON n_nationkey = (s_nationkey * 3 + 1) % 25 WHERE n_nationkey <> s_nationkey),
h1 AS (SELECT src root, dst node, max(weight) trust, 1 hops FROM e GROUP BY 1, 2),
s2 AS (SELECT root, dst node, max(trust * weight * 0.7) trust, 2 hops FROM h1 JOIN e ON node = src WHERE dst <> root GROUP BY 1, 2), h2 AS (SELECT * FROM s2 WHERE (root, node) NOT IN (SELECT root, node FROM h1)),
s3 AS (SELECT root, dst node, max(trust * weight * 0.7) trust, 3 hops FROM h2 JOIN e ON node = src WHERE dst <> root GROUP BY 1, 2), h3 AS (SELECT * FROM s3 WHERE (root, node) NOT IN (SELECT root, node FROM h1 UNION SELECT root, node FROM h2))
SELECT root, node, round(trust, 6) trust, hops::INTEGER hops FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"""
)
def propagate_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    e = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == (F.col("s_nationkey") * 3 + 1) % 25).where("n_nationkey <> s_nationkey")
    e = e.select(F.col("s_nationkey").alias("src"), F.col("n_nationkey").alias("dst"), (0.5 + (F.col("s_nationkey") % 5) / 10).alias("weight")).distinct()
    return kb.propagate_trust(e, n.select(F.col("n_nationkey").alias("node")))


# -- retrieval


@query(
    """WITH o AS (SELECT p_partkey AS key, regexp_replace(p_name, '\\s+', '', 'g') s FROM part), r AS (SELECT s, min(key) rep, count(*) n FROM o GROUP BY 1),
t AS (SELECT rep, list_distinct([substr(s, i, 3) for i in range(1, length(s) - 1)]) g FROM r WHERE length(s) >= 3), x AS (SELECT rep, len(g) n, unnest(g) g FROM t),
p AS (SELECT a.rep a, b.rep b, a.n an, b.n bn, count(*) c FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2, 3, 4), l AS (SELECT a, b, c / (an + bn - c) j FROM p WHERE c / (an + bn - c) >= 0.85)
SELECT key, r.rep, r.n n_alike, l.b other, round(j, 6) similarity, CASE WHEN j >= 0.95 THEN 'same' WHEN j IS NOT NULL THEN 'close' END band FROM o JOIN r USING (s) LEFT JOIN l ON l.a = r.rep"""
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with similar names; parts of one name are named by the smallest of them."""
    return similarity.near_duplicates(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(
    f"""WITH {SENTENCES}, x AS (SELECT DISTINCT 'f' s, sentence t FROM sents UNION SELECT 'q', fact FROM seeds), g AS (SELECT s, t, {HASH.format('t')} id, regexp_replace(t, '\\s+', '', 'g') z FROM x), k AS (SELECT s, id, list_distinct([substr(z, i, 3) for i in range(1, length(z) - 1)]) g FROM g WHERE length(z) >= 3),
u AS (SELECT s, id, len(g) n, unnest(g) g FROM k), p AS (SELECT q.id query_id, f.id fact_id, count(*) / (q.n + f.n - count(*)) j FROM u q JOIN u f ON q.s = 'q' AND f.s = 'f' AND q.g = f.g WHERE least(q.n, f.n) >= 0.5 * greatest(q.n, f.n) GROUP BY q.id, f.id, q.n, f.n)
SELECT query_id, fact_id, round(j, 6) similarity, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, fact_id)::INTEGER "rank" FROM p WHERE j >= 0.5) WHERE "rank" <= 10"""
)
def search_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark sentences are the queries, different document sentences the facts: a top-10 report for each query."""
    q = seed(spark, sf_dir).select(F.col("fact").alias("query")).distinct().withColumn("query_key", T.stable_hash(F.col("query")))
    f = spread(staged(sentences(spark, sf_dir).select("sentence").distinct(), "facts")).withColumn("fact_key", T.stable_hash(F.col("sentence")))
    return similarity.search_trigram(q, f, "query_key", "query", "fact_key", "sentence")


def _search_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Searches: every benchmark item asks, whole documents are searched."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def tfidf_sql(grams: str, source: str) -> str:
    """SQL of search_tfidf over a table expression with s ('d' or 'q'), id and x (the text)."""
    return rf"""own AS (SELECT s, id, string_split(regexp_replace(lower(x), '\s+', '', 'g'), '') z, [y for y in string_split_regex(lower(x), '[^\p{{L}}\p{{N}}]+') if y <> ''] y FROM ({source})), w AS (SELECT s, id, unnest({grams}) gram FROM own), t AS (SELECT s, id, gram, count(*) tf FROM w GROUP BY 1, 2, 3), n AS (SELECT count(*) n FROM ({source}) WHERE s = 'd'),
i AS (SELECT gram, ln((1 + n) / (1 + count(*))) + 1 idf FROM t, n WHERE s = 'd' GROUP BY gram, n), v AS (SELECT s, id, gram, tf * idf w FROM t JOIN i USING (gram)), l AS (SELECT s, id, sqrt(sum(w * w)) l FROM v GROUP BY 1, 2),
c AS (SELECT q.id q, d.id d, sum(q.w * d.w) x FROM v q JOIN v d ON q.s = 'q' AND d.s = 'd' AND q.gram = d.gram GROUP BY 1, 2), r AS (SELECT q query_id, d doc_id, round(x / (a.l * b.l), 6) score FROM c JOIN l a ON a.s = 'q' AND a.id = q JOIN l b ON b.s = 'd' AND b.id = d)"""


def bm25_sql(source: str) -> str:
    """SQL of search_bm25 over a table expression with s, id and x."""
    return rf"""bw AS (SELECT s, id, unnest([y for y in string_split_regex(lower(x), '[^\p{{L}}\p{{N}}]+') if y <> '']) gram FROM ({source})), bt AS (SELECT s, id, gram, count(*) tf FROM bw GROUP BY 1, 2, 3), z AS (SELECT id, sum(tf) len FROM bt WHERE s = 'd' GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM ({source}) WHERE s = 'd') n_docs, avg(len) al FROM z), bi AS (SELECT gram, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) idf, al FROM bt, st WHERE s = 'd' GROUP BY gram, n_docs, al),
br AS (SELECT q.id query_id, d.id doc_id, round(sum(idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * len / al))), 6) score FROM bt d JOIN bt q ON q.s = 'q' AND d.s = 'd' AND q.gram = d.gram JOIN bi ON bi.gram = d.gram JOIN z ON z.id = d.id GROUP BY 1, 2)"""


TOP = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER "rank" FROM {0} WHERE score >= {1}) WHERE "rank" <= {2}"""
ITEM_TEXTS = "SELECT 'd' s, doc_id id, text x FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark"
#: Grams of z (characters without white space) or y (words).
RUNS = "list_concat(list_transform(range(1, len(z)), lambda i: z[i] || z[i + 1]), list_transform(range(1, len(z) - 1), lambda i: z[i] || z[i + 1] || z[i + 2]))"
ONES = "list_concat(y, list_transform(range(1, len(y)), lambda i: y[i] || ' ' || y[i + 1]))"


@query(f"WITH {tfidf_sql(RUNS, ITEM_TEXTS)} {TOP.format('r', 0.15, 5)}")
def search_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.search_tfidf(*_search_sides(spark, sf_dir))


@query(f"WITH {tfidf_sql(ONES, ITEM_TEXTS)} {TOP.format('r', 0.1, 5)}")
def search_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine over words and pairs of words."""
    return similarity.search_tfidf(*_search_sides(spark, sf_dir), least=0.1, grams=similarity.word_runs)


@query(f"WITH {bm25_sql(ITEM_TEXTS)} {TOP.format('br', 0, 5)}")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.search_bm25(*_search_sides(spark, sf_dir))


@query(
    f"""WITH {tfidf_sql(RUNS, ITEM_TEXTS)}, {bm25_sql(ITEM_TEXTS)}, a AS ({TOP.format('r', 0.15, 20)}), b AS ({TOP.format('br', 0, 20)}),
x AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) s1 FROM a), y AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) s2 FROM b),
h AS (SELECT query_id, doc_id, round(0.4 * coalesce(s1, 0) + (1 - 0.4) * coalesce(s2, 0), 6) score FROM x FULL OUTER JOIN y USING (query_id, doc_id)) {TOP.format('h', 0.1, 5)}"""
)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = _search_sides(spark, sf_dir)
    return similarity.search_hybrid(similarity.search_tfidf(q, d, k=20), similarity.search_bm25(q, d, k=20))


# -- votes: each line of an order is a vote on it


def line_votes(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "A", "contradicted").when(F.col("l_returnflag") == "N", "verified").otherwise("uncertain")
    own = in_order(spark, sf_dir, "lineitem") if ordered else table(spark, sf_dir, "lineitem")
    return own.select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("checker"), verdict.alias("verdict"), (F.col("l_discount") * 10).alias("confidence"), (1 - F.col("l_tax")).alias("weight"), *(["row"] if ordered else []))


VOTES = "v AS (SELECT l_orderkey claim_id, 'c' || l_linenumber checker, CASE l_returnflag WHEN 'A' THEN 'contradicted' WHEN 'N' THEN 'verified' ELSE 'uncertain' END verdict, l_discount * 10 confidence, 1 - l_tax weight FROM lineitem)"
OF = lambda v, x: f"sum(CASE WHEN verdict = '{v}' THEN {x} ELSE 0 END)"


@query(f"WITH {VOTES} {truth.weighted_sql('v', 'claim_id')}")
def decide_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.decide_weighted(line_votes(spark, sf_dir), ["claim_id"])


@query(
    f"""WITH {VOTES}, g AS (SELECT claim_id, count(*) n, sum(weight) al, {OF('contradicted', 'weight')} c, {OF('uncertain', 'weight')} u, {OF('unverifiable', 'weight')} x, {OF('verified', 'weight')} ok FROM v GROUP BY 1)
SELECT claim_id, CASE WHEN n < 2 THEN 'unverifiable' WHEN greatest(c, u, x, ok) / al < 0.5 AND c > 0 THEN 'uncertain' WHEN c = greatest(c, u, x, ok) THEN 'contradicted' WHEN u = greatest(c, u, x, ok) THEN 'uncertain' WHEN x = greatest(c, u, x, ok) THEN 'unverifiable' ELSE 'verified' END verdict, round(greatest(c, u, x, ok) / al, 6) AS share FROM g"""
)
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.vote_majority(line_votes(spark, sf_dir, ordered=True), ["claim_id"], order="row")


@query(
    f"""WITH {VOTES}, r AS (SELECT *, count(*) OVER (PARTITION BY claim_id) n, count(*) OVER (PARTITION BY claim_id) - row_number() OVER (PARTITION BY claim_id ORDER BY weight * confidence DESC, checker, verdict) + 1 p FROM v),
b AS (SELECT claim_id, verdict, sum(p) p, max(n) n FROM r GROUP BY 1, 2)
SELECT claim_id, verdict, round(p / (n * (n + 1) / 2), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY p DESC, verdict) k FROM b) WHERE k = 1"""
)
def vote_borda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.vote_borda(line_votes(spark, sf_dir), ["claim_id"])


@query(oracles.SCORES["consensus_score"])
def consensus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.consensus_score(line_votes(spark, sf_dir, ordered=True), ["claim_id"], order="row")


@query(
    f"""WITH {VOTES}, o AS (SELECT claim_id, max(row(CASE verdict WHEN 'verified' THEN 3 WHEN 'contradicted' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END, confidence)) m FROM v GROUP BY 1)
SELECT claim_id, CASE m[1] WHEN 3 THEN 'verified' WHEN 2 THEN 'contradicted' WHEN 1 THEN 'uncertain' END verdict, m[2] confidence FROM o"""
)
def aggregate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.aggregate_checks(line_votes(spark, sf_dir), "claim_id")


@query(oracles.SCORES["truth_score"])
def truth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.truth_score(line_votes(spark, sf_dir).withColumn("retrieval", F.col("weight")), "claim_id")


@query(
    f"""WITH {VOTES}, a AS (SELECT *, claim_id % 3 = 0 actual FROM v), g AS (SELECT checker, sum(CASE WHEN verdict = 'contradicted' AND actual THEN 1 ELSE 0 END)::BIGINT tp, sum(CASE WHEN verdict = 'contradicted' AND NOT actual THEN 1 ELSE 0 END)::BIGINT fp,
sum(CASE WHEN verdict <> 'contradicted' AND actual THEN 1 ELSE 0 END)::BIGINT fn, sum(CASE WHEN verdict <> 'contradicted' AND NOT actual THEN 1 ELSE 0 END)::BIGINT tn FROM a GROUP BY 1)
SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) f1, round(greatest(0.3, least(0.95, 2 * tp / (2 * tp + fp + fn))), 6) weight FROM g"""
)
def checker_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.checker_performance(line_votes(spark, sf_dir).withColumn("actual", F.col("claim_id") % 3 == 0)).drop("mean_confidence")


@query(
    """WITH r AS (SELECT lang, source, quality = 0 actual, regexp_matches(text, '[#*$%&|]') predicted FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, source, sum(CASE WHEN predicted AND actual THEN 1 ELSE 0 END)::BIGINT tp, sum(CASE WHEN predicted AND NOT actual THEN 1 ELSE 0 END)::BIGINT fp, sum(CASE WHEN NOT predicted AND actual THEN 1 ELSE 0 END)::BIGINT fn, sum(CASE WHEN NOT predicted AND NOT actual THEN 1 ELSE 0 END)::BIGINT tn FROM r GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) f1, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy FROM g"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with symbols taken as bad ones, against the labels."""
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return votes.confusion_matrix(own.select("lang", "source", (F.col("quality") == 0).alias("actual"), F.col("text").rlike(r"[#*$%&|]").alias("predicted")), ["lang", "source"])


# -- scans


@query(oracles.SCANS["scan_leaks"])
def scan_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_leaks(table(spark, sf_dir, "documents")).select("doc_id", "category", "masked", "confidence")


@query(
    r"""WITH m AS (SELECT doc_id, 'insult' category, unnest(regexp_extract_all(lower(text), '\b(idiot|trash|worthless|clown|pathetic)\b', 1)) m, 'warn' a FROM documents UNION ALL SELECT doc_id, 'threat', unnest(regexp_extract_all(lower(text), '\b(kill|destroy)\b', 1)), 'block' FROM documents)
SELECT DISTINCT doc_id, category, substr(m, 1, 20) matched, a AS action FROM m"""
)
def scan_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_content(table(spark, sf_dir, "documents")).select("doc_id", "category", "matched", "action")


@query(oracles.SCANS["audit_text"])
def audit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.audit_text(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(oracles.SCANS["scan_injection"])
def scan_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would read: every turn of conversations, and pages with their markup."""
    said = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("page"), "page_id", F.lit(0).cast("long"), "html")
    return scan.scan_injection(said.union(pages), ["kind", "id", "part"])


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '[\x{200B}-\x{200F}\x{2060}\x{FEFF}]'))::INTEGER zero_width, len(regexp_extract_all(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]'))::INTEGER controls,
len(regexp_extract_all(html, '<(script|style|iframe)'))::INTEGER hidden_tags, len(regexp_extract_all(html, '<!--'))::INTEGER AS comments, len(regexp_extract_all(html, '[A-Za-z0-9+/]{40,}={0,2}'))::INTEGER encoded FROM pages"""
)
def detect_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.detect_hidden(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, CASE WHEN regexp_extract(url, '//([^/]+)', 1) LIKE '%example.org' THEN 3 WHEN regexp_extract(url, '//([^/]+)', 1) LIKE '%example.net' THEN 2 ELSE 1 END::INTEGER authority FROM pages")
def score_source_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    return scan.score_source_authority(own, "host", (("example.org", 3), ("example.net", 2)))


# -- sessions


@query("SELECT conv_id, turn, s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn)) AS counter, s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn)) >= 2 AS drift FROM (SELECT conv_id, turn, CAST(sum(CASE WHEN length(text) > 200 THEN 1 ELSE -1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) s FROM conversations)")
def pleasing_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.pleasing_drift(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") > 200)


@query(oracles.SESSIONS["session_drift"])
def session_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    terms = {w: F.contains(t, F.lit(w)) for w in oracles.TERMS}
    return sessions.session_drift(table(spark, sf_dir, "conversations"), "conv_id", "turn", t.rlike("ignore|system").cast("double"), (F.length("text") > 400).cast("double"), terms)


@query("SELECT conv_id, turn, round(sum(length(text) / 1000.0) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) total, sum(length(text) / 1000.0) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) >= 1 burnt FROM conversations")
def slow_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.slow_burn(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") / 1000)


@query("SELECT conv_id, count(*) n_turns, round(avg(length(text) / 1000.0), 6) mean_pressure, sum(CASE WHEN length(text) > 300 THEN 1 ELSE 0 END)::BIGINT n_flagged FROM conversations GROUP BY 1")
def conversation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.conversation_report(table(spark, sf_dir, "conversations"), "conv_id", F.length("text") / 1000, F.length("text") > 300)


@query(oracles.SESSIONS["self_contradiction"])
def self_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.detect_self_contradiction(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(oracles.SESSIONS["history_repeat"])
def history_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history_repeat(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# -- metrics


@query("SELECT event_type, count(*) n, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) error_rate FROM events GROUP BY 1")
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.snapshot(table(spark, sf_dir, "events"), "value", "event_type", ["event_type"])


@query("SELECT " + ", ".join(f"round(quantile_cont(value, {q}), 6) {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) + ", round(avg(value), 6) mean, round(stddev_samp(value), 6) std FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(table(spark, sf_dir, "events"), "value")


@query("SELECT date_trunc('hour', ts) AS hour, count(*) n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT errors, round(avg(value), 6) avg_value FROM events GROUP BY 1")
def hourly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hourly_trend(table(spark, sf_dir, "events"), "ts", "event_type", "value")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, hour(ts)::INTEGER AS hour, count(*) n FROM events GROUP BY ROLLUP (date_trunc('day', ts)::TIMESTAMP, hour(ts)::INTEGER)")
def day_hour_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.day_hour_rollup(table(spark, sf_dir, "events"), "ts")


@query("SELECT le, n FROM (SELECT '10.0' le, count(*) FILTER (value <= 10) n FROM events UNION ALL SELECT '50.0', count(*) FILTER (value <= 50) FROM events UNION ALL SELECT '100.0', count(*) FILTER (value <= 100) FROM events UNION ALL SELECT '+Inf', count(value) FROM events)")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_histogram(table(spark, sf_dir, "events"), "value", (10.0, 50.0, 100.0))


@query("SELECT user_id, n, round(g, 6) compliance, round((1 - g) / 0.2, 6) burn, CASE WHEN round((1 - g) / 0.2, 6) >= 2 THEN 'critical' WHEN round((1 - g) / 0.2, 6) >= 1 THEN 'warning' ELSE 'ok' END alert FROM (SELECT user_id, count(*) n, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) g FROM events GROUP BY 1)")
def slo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slo_report(table(spark, sf_dir, "events"), "event_type", "user_id", 0.8)


@query("SELECT e.event_id, round(count(*) / 3600, 6) per_second FROM events e JOIN events f ON e.user_id = f.user_id AND epoch(date_trunc('second', f.ts)) BETWEEN epoch(date_trunc('second', e.ts)) - 3600 AND epoch(date_trunc('second', e.ts)) GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.throughput(table(spark, sf_dir, "events"), "ts", "event_id", 3600)


@query(oracles.FOLDS["bot_rate"])
def bot_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bot_rate(table(spark, sf_dir, "events"), "ts", "user_id", 2, 3600)


@query("SELECT o_custkey, c_mktsegment, count(*) requests, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT tokens, greatest(0, 1000000 - sum(CAST(floor(o_totalprice) AS BIGINT)))::BIGINT remaining, sum(CAST(floor(o_totalprice) AS BIGINT)) > 1000000 AS over FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def usage_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    usage = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    plans = c.select("c_mktsegment").distinct().withColumn("quota", F.lit(1_000_000).cast("long"))
    return metrics.usage_billing(usage, "o_custkey", F.floor("o_totalprice"), plans, "c_mktsegment")


@query("SELECT d AS day, round(t / 1000 * 0.002 + 1, 6) AS cost, round(sum(t / 1000 * 0.002 + 1) OVER (ORDER BY d), 6) total, sum(t / 1000 * 0.002 + 1) OVER (ORDER BY d) >= 100 reached FROM (SELECT date_trunc('day', ts)::TIMESTAMP d, sum(value) t FROM events GROUP BY 1)")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("tokens"))
    return metrics.cost_projection(daily, "day", "tokens", 0.002, 1.0, 100.0)


@query(oracles.FOLDS["token_bucket"])
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return metrics.token_bucket(own, "user_id", "at", "event_id", 1 / 43200, 3.0).select("user_id", "event_id", "accepted")


@query(oracles.FOLDS["rate_limit"])
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return metrics.sliding_rate_limit(own, "user_id", "at", "event_id", 2, 86400).select("user_id", "event_id", "accepted")


@query(oracles.FOLDS["alert_cooldown"])
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").where("value > 50").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return metrics.alert_cooldown(own, "event_type", "at", 3600.0)


# -- streams over what a table holds now; each writes into a fresh folder of the shared ones


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. A stream's plain path must be a folder; a pattern takes one file as well as a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("SELECT date_trunc('hour', ts) AS hour, count(*) n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT errors, round(avg(value), 6) avg_value FROM events GROUP BY 1")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly trend as a stream; complete mode, so the hours still open are there too."""
    name = f"hourly_{uuid.uuid4().hex}"
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream.stream_hourly(events).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("hour", F.col("hour").cast("timestamp_ntz"))  # one row an hour


@query("SELECT event_id, user_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "stream")
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream.run_available(stream.stream_dedupe(events, "event_id", "ts", "30 days").select("event_id", "user_id"), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.schema("event_id long, user_id long").parquet(f"{path}/rows")


def _to_end(spark: SparkSession, make, source: DataFrame, ts: str) -> DataFrame:
    path = shared_path(spark, "keyed")
    keyed.run_to_end(make, source, ts, path, "1 day")
    out = make(source)
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query(oracles.SESSIONS["session_drift"])
def stream_session_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift of sessions as keyed state with timers: a turn a minute."""
    t = F.lower("text")
    terms = {w: F.contains(t, F.lit(w)) for w in oracles.TERMS}
    turns = _stream(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_seconds(1_000_000_000 + F.col("turn") * 60))
    make = lambda rows: keyed.stream_session_drift(rows, "conv_id", "turn", "ts", t.rlike("ignore|system").cast("double"), (F.length("text") > 400).cast("double"), terms, late="1 day", idle=None)
    out = _to_end(spark, make, turns, "ts")
    return out.withColumn("turn", F.col("turn").cast(table(spark, sf_dir, "conversations").schema["turn"].dataType))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(oracles.FOLDS["alert_cooldown"])
def stream_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_end(spark, lambda rows: keyed.stream_alert(rows.where("value > 50 OR value IS NULL"), "event_type", "ts", 3600.0, late="1 day"), _events(spark, sf_dir), "ts")


@query(oracles.FOLDS["exponential_ban"])
def stream_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that ban a user, as keyed state."""
    make = lambda rows: keyed.stream_ban(rows.where("event_type = 'error' OR event_type IS NULL"), "user_id", "ts", "event_id", 2, 86400, 86400, 864000, late="1 day")
    return _to_end(spark, make, _events(spark, sf_dir), "ts")


from claimforge.plans import memory, more, reason, signals, trust, truth  # noqa: E402, F401  their queries join the registry
