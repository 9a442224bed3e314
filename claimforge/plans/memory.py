"""Registered queries of memories and of the learned consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.operators import memory, similarity
from claimforge.plans.base import query, table
from claimforge.plans.more import line_votes

GRAMS = r"""parts AS (SELECT item_id, unnest(regexp_extract_all(lower(trim(text)), '([a-z0-9]+|[^a-z0-9]+)', 1)) p FROM benchmark),
cut AS (SELECT item_id, CASE WHEN regexp_matches(p, '^[a-z0-9]') THEN [substr(' ' || p || ' ', i, 3) for i in range(1, length(p) + 1)] ELSE list_concat([c for c in string_split(regexp_replace(p, '\s', '', 'g'), '') if c <> ''],
[substr(regexp_replace(p, '\s', '', 'g'), i, 2) for i in range(1, length(regexp_replace(p, '\s', '', 'g')))]) END g FROM parts), tf AS (SELECT item_id, gram, count(*) tf FROM (SELECT item_id, unnest(g) gram FROM cut) GROUP BY 1, 2)"""


@query(
    rf"""WITH RECURSIVE {GRAMS}, hashed(gram, i, h) AS (SELECT DISTINCT gram, 0, 2166136261::HUGEINT FROM tf UNION ALL SELECT gram, i + 1, (xor(h::BIGINT, unicode(substr(gram, i + 1, 1))::BIGINT)::HUGEINT * 16777619) % 4294967296 FROM hashed WHERE i < length(gram)),
drawn(gram, n, s) AS (SELECT gram, 0, h FROM hashed WHERE i = length(gram) UNION ALL SELECT gram, n + 1, (s * 1103515245 + 12345) % 2147483648 FROM drawn WHERE n < 12),
signs AS (SELECT gram, (s % 256)::INTEGER place, arg_max(CASE WHEN s >= 1073741824 THEN 1.0 ELSE -1.0 END, n) sign FROM drawn WHERE n > 0 GROUP BY 1, 2),
sums AS (SELECT item_id, place, sum(tf * sign)::DOUBLE v FROM tf JOIN signs USING (gram) GROUP BY 1, 2 HAVING sum(tf * sign) <> 0)
SELECT item_id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS "value" FROM sums"""
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.embed_text(table(spark, sf_dir, "benchmark"), "item_id", "text")


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is a memory; importance, age, decay and tags follow from its key."""
    key = F.col("vec_id")
    tags = F.array(F.concat(F.lit("t"), (key % 3).cast("string")), F.concat(F.lit("u"), (key % 2).cast("string")))
    return table(spark, sf_dir, "embeddings").select(key.alias("id"), F.col("label").alias("type"), F.col("embedding").alias("vector"), tags.alias("tags"), (key % 100 / 100).alias("importance"), (key % 365).alias("age_days"), ((1 + key % 5) / 100).alias("decay"))


UNIT = "unit AS (SELECT vec_id id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) v FROM embeddings)"


@query(
    f"""WITH {UNIT}, s AS (SELECT q.id query_id, m.id, floor((0.6 * list_dot_product(q.v, m.v) + (0.3 * ((m.id % 100) / 100) + 0.1 / (1 + m.id % 365))) * 1e6 + 0.5) / 1e6 score, floor(list_dot_product(q.v, m.v) * 1e6 + 0.5) / 1e6 similarity
FROM unit q JOIN unit m ON q.id % 20 = 0 AND q.id <> m.id WHERE (m.id % 100) / 100 >= 0.2 AND m.id % 3 = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS "rank", id, score, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5"""
)
def recall_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every memory whose id is divisible by 20 its five best among all others of a tag and of some importance."""
    own = _memories(spark, sf_dir)
    return memory.recall(own.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), own, tags=("t1",), least=0.2)


LEAST = 0.45  # the tables' vectors have few closer neighbours of one label
CLUSTERS = f"""WITH RECURSIVE {UNIT}, e AS (SELECT a.id a, b.id b FROM unit a JOIN unit b ON a.label = b.label AND a.id <> b.id WHERE list_dot_product(a.v, b.v) >= {LEAST}),
reach(id, other) AS (SELECT id, id FROM unit UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other), c AS (SELECT id, min(other) AS "cluster" FROM reach GROUP BY 1)"""


@query(f'{CLUSTERS} SELECT id, "cluster", count(*) OVER (PARTITION BY "cluster") n FROM c')
def cluster_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.cluster_memories(_memories(spark, sf_dir), LEAST, recall_wanted=1)


@query(
    f"""{CLUSTERS}, m AS (SELECT c.id, c."cluster", label, ['t' || (c.id % 3), 'u' || (c.id % 2)] tags, (c.id % 100) / 100 imp, (1 + c.id % 5) / 100 decay FROM c JOIN unit USING (id))
SELECT "cluster", first(id ORDER BY imp DESC, id) id, first(label ORDER BY imp DESC, id) AS "type", array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') tags, round(avg(imp), 3) importance, max(decay) decay, count(*) n FROM m GROUP BY 1"""
)
def merge_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _memories(spark, sf_dir)
    return memory.merge_memories(own, memory.cluster_memories(own, LEAST, recall_wanted=1)).withColumn("tags", F.concat_ws(",", "tags"))


@query("SELECT vec_id id, round((vec_id % 100) / 100 * exp(-((1 + vec_id % 5) / 100) * (vec_id % 365)), 6) importance_now, (vec_id % 100) / 100 * exp(-((1 + vec_id % 5) / 100) * (vec_id % 365)) < 0.05 archived FROM embeddings")
def apply_forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.apply_forgetting(_memories(spark, sf_dir), F.col("age_days")).select("id", "importance_now", "archived")


VOTERS = [f"c{k}" for k in range(1, 8)]


@query()
def learned_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on orders weighed by a logistic regression on whether the order is late in its status; no SQL fits one."""
    features = memory.vote_features(line_votes(spark, sf_dir), "claim_id", VOTERS)
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderstatus") == "F").cast("double").alias("actual"))
    own = features.join(status, "claim_id")
    weights, bias = memory.fit_consensus(own, VOTERS, "actual")
    return memory.score_consensus(own, VOTERS, weights, bias).select("claim_id", "actual", "probability")


# -- a dictionary: the words that two benchmark items have

WORDS = r"words AS (SELECT w AS name FROM (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) w FROM benchmark) WHERE w <> '' GROUP BY 1 HAVING count(*) >= 2)"


def _dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    words = items.select("item_id", F.explode(F.split("text", " ")).alias("name")).distinct().where("name <> ''").groupBy("name").count().where("count >= 2")
    return items, words.select("name")


@query(
    f"""WITH RECURSIVE {WORDS}, lens AS (SELECT DISTINCT length(name) n FROM words), m AS (SELECT item_id, p.p, max(n) n FROM benchmark, lens, (SELECT unnest(range(1, (SELECT max(length(text)) + 1 FROM benchmark))) p) p WHERE p.p + n - 1 <= length(text) AND substr(text, p.p, n) IN (SELECT name FROM words) GROUP BY 1, 2),
s(item_id, pos, spot, n) AS (SELECT item_id, 0, 1, coalesce((SELECT n FROM m WHERE m.item_id = b.item_id AND m.p = 1), 1) FROM benchmark b WHERE length(text) > 0 UNION ALL
SELECT s.item_id, s.pos + 1, s.spot + s.n, coalesce(m.n, 1) FROM s JOIN benchmark b ON b.item_id = s.item_id AND s.spot + s.n <= length(text) LEFT JOIN m ON m.item_id = s.item_id AND m.p = s.spot + s.n)
SELECT item_id, pos::INTEGER pos, substr(text, spot, n) token FROM s JOIN benchmark USING (item_id)"""
)
def segment_max_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.segment_max_match(*_dictionary(spark, sf_dir), "item_id", "text")


@query(f"WITH {WORDS}, lens AS (SELECT DISTINCT length(name) n FROM words), p AS (SELECT unnest(range(1, (SELECT max(length(text)) + 1 FROM benchmark))) p) SELECT item_id, (p.p - 1)::INTEGER AS start, n::INTEGER AS length FROM benchmark, lens, p WHERE p.p + n - 1 <= length(text) AND substr(text, p.p, n) IN (SELECT name FROM words)")
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.dictionary_matches(*_dictionary(spark, sf_dir), "item_id", "text")
