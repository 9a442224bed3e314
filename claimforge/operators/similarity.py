"""Exact set-similarity joins on grams, gram index search, TF-IDF, BM25 and hybrid retrieval, dictionary matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.text import char_ngrams, char_overlap, let, squeeze, word_array
from claimforge.sources.staging import staged


def _prefixes(sets: DataFrame, ranks: DataFrame, least: float, name: str) -> DataFrame:
    """(gram, id, n, place, rest) for the rarest grams of each set, one of which any similar set must share; grams are hashes
    and rest are those after it. Grams that ranks doesn't hold come first and are left out: no set of the right side has them."""
    rows = sets.select("id", F.explode(F.transform("grams", lambda g: F.xxhash64(g))).alias("gram")).join(ranks, "gram", "left")
    order = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("order"))
    n = F.size("order")
    own = order.select("id", n.alias("n"), F.slice("order", 1, n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1).alias("prefix"), F.col("order.gram").alias("grams"))
    own = own.select("id", "n", "grams", F.posexplode("prefix").alias("at", "x")).where("x.df > 0")
    rest = F.slice("grams", F.col("at") + 2, F.col("n"))
    return own.select(F.col("x.gram").alias("gram"), F.col("id").alias(name), F.col("n").alias(f"{name}_n"), (F.col("at") + 1).alias(f"{name}_at"), rest.alias(f"{name}_rest"))


def similar_pairs(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """All pairs (left_id, right_id, similarity) of sets (id, grams) whose Jaccard similarity is `least` or more.

    Sets share one of their rarest grams or can't be similar enough; the first that they share stands early in both, and
    their sizes are close. The join on these grams carries hashes of the grams that follow in each set and counts how many are
    common, so what it gives are the similar pairs (and those of equal hashes, told by the grams at the end), not candidates.
    Common grams stand last in every set and are hardly ever joined.
    With right None these are the pairs inside left, the smaller id first. Ids name a set; empty sets match nothing.
    """
    other = left if right is None else right
    ranks = other.select(F.explode(F.transform("grams", lambda g: F.xxhash64(g))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    ranks = ranks if right is not None else ranks.where("df > 1")  # inside one table a gram of one set joins nothing
    a, b = _prefixes(left, ranks, least, "left_id"), _prefixes(other, ranks, least, "right_id")
    n, m = F.col("left_id_n"), F.col("right_id_n")
    needed = (n + m) * least / (1 + least) - 1e-9
    fits = (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (1 + F.least(n - F.col("left_id_at"), m - F.col("right_id_at")) >= needed)
    fits = fits if right is not None else fits & (F.col("left_id") < F.col("right_id"))
    alike = F.when(fits, 1 + F.size(F.array_intersect("left_id_rest", "right_id_rest")) >= needed).otherwise(False)
    pairs = a.join(b, "gram").where(alike).select("left_id", "right_id").distinct()
    pairs = pairs.join(left.select(F.col("id").alias("left_id"), F.col("grams").alias("_x")), "left_id").join(other.select(F.col("id").alias("right_id"), F.col("grams").alias("_y")), "right_id")
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.withColumn("similarity", both / (F.size("_x") + F.size("_y") - both)).where(F.col("similarity") >= least).select("left_id", "right_id", "similarity")


def gram_sets(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    return df.select(F.col(key).alias("id"), char_ngrams(squeeze(F.col(text)), n).alias("grams")).where(F.size("grams") > 0)


def search_trigram(queries: DataFrame, facts: DataFrame, query_key: str, query_text: str, fact_key: str, fact_text: str, k: int = 10, least: float = 0.5) -> DataFrame:
    """The k facts most similar to each query by trigram Jaccard; ties go to the smaller fact key."""
    pairs = similar_pairs(gram_sets(queries, query_key, query_text), gram_sets(facts, fact_key, fact_text), least)
    order = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("fact_id"), F.round("similarity", 6).alias("similarity"), "rank")


def near_duplicates(facts: DataFrame, key: str, text: str, least: float = 0.85, band: float = 0.95) -> DataFrame:
    """Near-duplicate facts by trigram Jaccard: one row per fact and similar other text, with the two texts' smallest keys.

    Columns: key, rep (the smallest key of the facts with the same text but for white space), n_alike (how many these
    are), other (rep of a similar, different text; null if there is none), similarity and band of the two texts. Equal
    texts are compared once, so copies aren't expanded into pairs. Null texts and those of fewer than three characters
    are like no other. An empty table gives an empty result.
    """
    own = facts.select(F.col(key).alias("key"), squeeze(F.col(text)).alias("_t"))
    reps = own.where("_t is not null").groupBy("_t").agg(F.min("key").alias("rep"), F.count("*").alias("n_alike"))
    sets = reps.select(F.col("rep").alias("id"), char_ngrams(F.col("_t"), 3).alias("grams")).where(F.size("grams") > 0)
    pairs = similar_pairs(sets, None, least)
    links = pairs.select(F.col("left_id").alias("rep"), F.col("right_id").alias("other"), "similarity").union(pairs.select("right_id", "left_id", "similarity"))
    rows = own.join(reps, "_t", "left").withColumn("rep", F.coalesce("rep", "key")).withColumn("n_alike", F.coalesce("n_alike", F.lit(1)))
    return rows.join(links, "rep", "left").select("key", "rep", "n_alike", "other", F.round("similarity", 6).alias("similarity"), F.when(F.col("similarity") >= band, "same").when(F.col("similarity").isNotNull(), "close").alias("band"))


def term_rows(docs: DataFrame, key: str, grams: Column) -> DataFrame:
    """(key, gram, tf), sparse."""
    return docs.select(F.col(key).alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


def build_idf(terms: DataFrame, n_docs: Column) -> DataFrame:
    return terms.groupBy("gram").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)


def gram_array(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All runs of so many characters of a lower-case text without white space, repeated ones too; a shorter text has none."""

    def runs(chars: Column, n: int) -> Column:
        if n == 1:
            return chars
        count = F.greatest(F.size(chars) - n + 1, F.lit(0))
        return F.zip_with(F.slice(runs(chars, n - 1), F.lit(1), count), F.slice(chars, F.lit(n), count), lambda a, b: F.concat(a, b))

    return let(F.split(squeeze(F.lower(text)), ""), lambda chars: F.concat(*(runs(chars, n) for n in sizes)))


def word_runs(text: Column) -> Column:
    """Words and pairs of words that follow each other, repeated ones too."""

    def runs(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))

    return let(word_array(text), runs)


#: Queries of a pass over the documents, and numbers in a table of queries and grams at most; what is broadcast is bounded by them.
QUERIES, CELLS = 1024, 1 << 23
SCORED = "query_id long, doc_id long, score double"


def search_tfidf(queries: DataFrame, docs: DataFrame, k: int = 5, least: float = 0.15, grams=gram_array) -> DataFrame:
    """Cosine of TF-IDF vectors over runs of two and three characters; queries and docs have id (a number) and text.

    Grams are counted and weighed by joins. Common grams are in most texts, so a join of queries with documents on them
    would have nearly a row for each pair and gram; instead queries are taken in blocks of bounded size, each document
    is one row with its norm and its weights of the block's grams, and tasks multiply documents with the block and send
    each query's k best. Empty and null texts have no vector and match nothing. Ties go to the smaller doc_id.
    """
    spark = docs.sparkSession
    own, asked = term_rows(docs, "id", grams(F.col("text"))), term_rows(queries, "id", grams(F.col("text")))
    own = staged(own, "grams")
    n = docs.agg(F.count("*").alias("n_docs"))
    idf = own.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    idf = staged(idf.select("gram", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    d, q = (x.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf")) for x in (own, asked))

    def score(block: list, numbers: dict[str, int]) -> DataFrame:
        table = np.zeros((len(numbers), len(block)))
        for j, r in enumerate(block):
            for x in r["v"]:
                table[numbers[x["gram"]], j] = x["w"] / r["norm"]
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in block], np.int64), table))
        names = spark.createDataFrame(list(numbers.items()), "gram string, no int")  # a block's grams
        mine = d.join(F.broadcast(names), "gram", "left").groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "w"))).alias("v"))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, table = shared.value
            best = pd.DataFrame({"q": [], "doc_id": [], "score": []})
            rows = max(1, CELLS // max(1, len(table)))
            for batch in batches:
                for at in range(0, batch.num_rows, min(rows, 256)):
                    ids, norm, no, w = (c.slice(at, min(rows, 256)) for c in batch.columns)
                    sizes = no.value_lengths().to_numpy(zero_copy_only=False)
                    dense = np.zeros((len(ids), len(table)))
                    dense[np.repeat(np.arange(len(ids)), sizes), no.flatten().to_numpy()] = w.flatten().to_numpy()
                    found = np.round((dense @ table) / norm.to_numpy(zero_copy_only=False)[:, None], 6)
                    x, j = np.nonzero(found >= least)
                    best = pd.concat([best, pd.DataFrame({"q": j, "doc_id": ids.to_numpy()[x], "score": found[x, j]})]) if len(x) else best
                    if len(best) > 50_000:
                        best = best.sort_values(["score", "doc_id"], ascending=[False, True]).groupby("q").head(k)
            best = best.sort_values(["score", "doc_id"], ascending=[False, True]).groupby("q").head(k)
            if len(best):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[best["q"].to_numpy().astype(np.int64)]), pa.array(best["doc_id"].to_numpy().astype(np.int64)), pa.array(best["score"].to_numpy().astype(float))], names=["query_id", "doc_id", "score"])

        found = mine.select(F.col("id").cast("long"), "norm", "v.no", "v.w").mapInArrow(scan, SCORED)
        return staged(top_k(found, "query_id", k, F.desc("score"), F.col("doc_id")), "scored")

    out = spark.createDataFrame([], f"{SCORED}, rank int")
    block, numbers = [], {}
    vectors = q.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("gram", "w")).alias("v"))
    for r in vectors.toLocalIterator(prefetchPartitions=True):
        new = {x["gram"] for x in r["v"]} - numbers.keys()
        if block and (len(block) == QUERIES or (len(numbers) + len(new)) * (len(block) + 1) > CELLS):
            out, block, numbers = out.union(score(block, numbers)), [], {}
            new = {x["gram"] for x in r["v"]}
        for g in sorted(new):
            numbers[g] = len(numbers)
        block.append(r)
    return out.union(score(block, numbers)) if block else out


def bm25_tokens(text: Column) -> Column:
    """Words of letters and digits in lower case, and for runs of Han characters their pairs."""
    han = r"\p{IsHan}"
    words = F.filter(F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}]+|(?<={han})(?!{han})|(?<!{han})(?={han})"), lambda w: w != "")
    pairs = lambda w: F.when(w.rlike(han) & (F.length(w) > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, 2))).otherwise(F.array(w))
    return F.flatten(F.transform(words, pairs))


def search_bm25(queries: DataFrame, docs: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, tokens=bm25_tokens) -> DataFrame:
    """BM25 over words and pairs of Han characters; queries and docs have id and text.

    Only words of some query are counted and shuffled; a document's length needs no shuffle. Empty and null texts match
    nothing but count as documents. Ties go to the smaller doc_id.
    """
    split = docs.select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    asked = queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("gram"))
    stats = split.agg(F.count("*").alias("n_docs"), F.avg(F.when(F.size("t") > 0, F.size("t"))).alias("avg_len"))
    own = split.select("id", F.size("t").alias("len"), F.explode("t").alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    own = own.groupBy("id", "len", "gram").agg(F.count("*").alias("tf"))
    idf = own.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = idf.select("gram", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")
    rows = own.join(asked.join(idf, "gram"), "gram")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    score = rows.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(score, "query_id", k, F.desc("score"), F.col("doc_id"))


def same_text(rows: DataFrame) -> DataFrame:
    """text, id, ids: each different text of rows (id and text) once, with its smallest id and its two smallest ids."""
    low = rows.where("text is not null").groupBy("text", "id").agg(F.lit(1).alias("_"))
    first = low.withColumn("_r", F.row_number().over(Window.partitionBy("text").orderBy("id"))).where("_r <= 2")
    return first.groupBy("text").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))


def _pick(names: DataFrame, ranked: DataFrame, others: bool, name: str, other: str, value: str) -> DataFrame:
    """name, other, value: for each row of names (id, text) the first of its text's best (array<struct<down, id>>) that isn't itself."""
    own = names.where("text is not null").join(ranked, "text")
    best = F.filter("best", lambda x: x["id"] != F.col("id")) if others else F.col("best")
    own = own.select(F.col("id").alias(name), F.get(best, F.lit(0)).alias("b")).where("b is not null")
    return own.select(name, F.col("b.id").alias(other), (-F.col("b.down")).alias(value))


def _two_best(pairs: DataFrame, value: str) -> DataFrame:
    """text, best: of pairs (text, ids, value) the two best ids of each text, by value and then the smaller id.

    One of the two at most is the asking row's own, so more are not needed.
    """
    some = pairs.select("text", F.explode(F.transform("ids", lambda i: F.struct((-F.col(value)).alias("down"), i.alias("id")))).alias("x")).select("text", "x.*")
    top = some.withColumn("_r", F.row_number().over(Window.partitionBy("text").orderBy("down", "id"))).where("_r <= 2")
    return top.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("down", "id"))).alias("best"))


def best_match(claims: DataFrame, facts: DataFrame, least: float = 0.3, others: bool = False) -> DataFrame:
    """The best fact for each claim: 0.65 bigram Jaccard + 0.35 character overlap, 0.05 more where a fact holds the claim.

    claims and facts have id and text. Candidates are all pairs whose bigram Jaccard is `least` or more. A short claim
    (under 10 characters) must score 0.6, others 0.4. Ties go to the smaller fact id. Null and one-letter texts match nothing.
    With others, ids are of one table and none matches itself. Equal texts are compared once.
    """
    grams = lambda x: x.select("id", char_ngrams(squeeze(F.lower(F.col("text"))), 2).alias("grams")).where(F.size("grams") > 0)
    asked, held = staged(same_text(claims), "claims"), staged(same_text(facts), "facts")
    pairs = similar_pairs(grams(asked), grams(held), least)
    own = pairs.join(asked.select(F.col("id").alias("left_id"), "text"), "left_id").join(held.select(F.col("id").alias("right_id"), F.col("text").alias("fact"), "ids"), "right_id")
    score = F.least(F.lit(1.0), 0.65 * F.col("similarity") + 0.35 * char_overlap(F.lower("text"), F.lower("fact")) + F.when(F.contains(F.lower("fact"), F.lower("text")), 0.05).otherwise(0.0))
    own = own.withColumn("score", F.round(score, 6)).where(F.col("score") >= F.when(F.length("text") < 10, 0.6).otherwise(0.4))
    return _pick(claims.select("id", "text"), _two_best(own, "score"), others, "claim_id", "fact_id", "score")


def _vectors(names: DataFrame, n: int = 2) -> DataFrame:
    """id, grams: the counts of runs of n characters of each name, array<struct<gram, tf>>."""
    return term_rows(names, "id", gram_array(F.col("text"), (n,))).groupBy("id").agg(F.collect_list(F.struct("gram", "tf")).alias("grams"))


def _norm(grams: Column) -> Column:
    return F.sqrt(F.aggregate(grams, F.lit(0.0), lambda s, x: s + x["tf"] * x["tf"]))


def fuzzy_entity(names: DataFrame, candidates: DataFrame, least: float = 0.6, others: bool = False, stages: tuple[float, ...] = (0.9, 0.75)) -> DataFrame:
    """For each name the candidate of most similar bigram counts (cosine), if `least` or more; both have id and text.

    An exact prefix join: with grams in the order of their rarity, two vectors of a cosine of t or more share a gram among
    the first of each, after which what is left of a vector is shorter than t times the whole. Names are looked for at the
    high thresholds of `stages` first, where few and rare grams are joined; only those without a match go on to the next.
    Ties go to the smaller candidate id. Names of one character or none match nothing. With others, ids are of one table
    and none matches itself. Equal texts are compared once.
    """
    asked, held = staged(same_text(names), "asked"), staged(same_text(candidates), "held")
    own, base = _vectors(asked), _vectors(held)
    rare = base.select(F.explode("grams.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def ordered(x: DataFrame) -> DataFrame:
        rows = x.select("id", F.explode("grams").alias("g")).select("id", "g.*").join(rare, "gram", "left")
        sized = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "tf"))).alias("grams"))
        return sized.withColumn("norm", _norm(F.col("grams")))

    def first(x: DataFrame, t: float) -> DataFrame:
        left = F.transform("grams", lambda g, i: F.struct(g["gram"], _norm(F.slice("grams", i + 1, F.size("grams"))).alias("rest")))
        return x.select("id", F.explode(F.filter(left, lambda p: p["rest"] >= t * F.col("norm") - 1e-9)).alias("p")).select("id", "p.gram")

    own, base, found = staged(ordered(own), "names"), staged(ordered(base), "names"), None
    for t in (*[x for x in stages if x > least], least):
        ask = own if found is None else own.join(found.select(F.col("name_id").alias("id")), "id", "left_anti")
        pairs = first(ask, t).toDF("name_id", "gram").join(first(base, t).toDF("entity_id", "gram"), "gram").select("name_id", "entity_id").distinct()
        own_side = ask.select(F.col("id").alias("name_id"), F.col("grams").alias("x"), F.col("norm").alias("p"))
        pairs = pairs.join(own_side, "name_id").join(base.select(F.col("id").alias("entity_id"), F.col("grams").alias("y"), F.col("norm").alias("q")), "entity_id")
        counts = F.map_from_arrays("y.gram", "y.tf")
        dot = F.aggregate("x", F.lit(0.0), lambda s, g: s + g["tf"] * F.coalesce(F.try_element_at(F.col("counts"), g["gram"]), F.lit(0)))
        pairs = pairs.withColumn("counts", counts).withColumn("similarity", F.round(dot / (F.col("p") * F.col("q")), 6)).where(F.col("similarity") >= t)
        pairs = pairs.select("name_id", "entity_id", "similarity").join(asked.select(F.col("id").alias("name_id"), "text"), "name_id")
        pairs = pairs.join(held.select(F.col("id").alias("entity_id"), F.col("text").alias("other"), "ids"), "entity_id")
        pairs = pairs.where((F.col("text") != F.col("other")) | (F.size("ids") > 1)) if others else pairs  # a name that only the asking row has
        best = staged(_two_best(pairs, "similarity").join(asked.select("text", F.col("id").alias("name_id")), "text"), "nearest")
        found = best if found is None else found.union(best)
    return _pick(names.select("id", "text"), found.select("text", "best"), others, "name_id", "entity_id", "similarity")


def search_hybrid(tfidf: DataFrame, bm25: DataFrame, k: int = 5, weight: float = 0.4, least: float = 0.1) -> DataFrame:
    """Two rankings scaled by their best score for the query and added with a weight; a fact's best score counts."""
    by = Window.partitionBy("query_id")
    scaled = lambda x, name: x.select("query_id", "doc_id", (F.col("score") / F.max("score").over(by)).alias(name))
    both = scaled(tfidf, "s1").join(scaled(bm25, "s2"), ["query_id", "doc_id"], "full_outer")
    score = both.select("query_id", "doc_id", F.round(weight * F.coalesce("s1", F.lit(0.0)) + (1 - weight) * F.coalesce("s2", F.lit(0.0)), 6).alias("score"))
    return top_k(score.where(F.col("score") >= least), "query_id", k, F.desc("score"), F.col("doc_id"))


def top_k(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def dictionary_matches(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, start (code points from 0), length: every place in a text where a name of the dictionary (column name) stands.

    Places whose first two characters begin no name are left out by a join on these heads; what is left is joined with the
    names by equality, once for each length that names have. So neither texts nor names are bounded by a task's memory.
    """
    words = staged(names.select("name").where("name is not null and name <> ''").distinct().withColumn("n", F.length("name")), "names")
    sizes = sorted(r["n"] for r in words.select("n").distinct().collect())  # different lengths only
    spark = texts.sparkSession
    if not sizes:
        return spark.createDataFrame([], f"{key} {dict(texts.dtypes)[key]}, start int, length int")
    heads = words.select(F.substring("name", 1, 2).alias("head")).distinct()
    cut = let(F.split(F.col(text), ""), lambda chars: F.transform(chars, lambda _, i: F.concat_ws("", F.slice(chars, i + 1, F.lit(sizes[-1])))))
    rows = texts.where(F.length(text) > 0).select(F.col(key), F.posexplode(cut).alias("start", "window"))
    short = heads.where("length(head) = 1").select(F.col("head").alias("one"))
    two = rows.withColumn("head", F.substring("window", 1, 2)).join(heads, "head", "left_semi").select(key, "start", "window")
    one = rows.withColumn("one", F.substring("window", 1, 1)).join(short, "one", "left_semi").select(key, "start", "window") if sizes[0] == 1 else None
    parts = [two.select(key, "start", F.explode(F.array(*(F.when(F.length("window") >= n, F.substring("window", 1, n)) for n in sizes if n > 1))).alias("name"))] if sizes[-1] > 1 else []
    if one is not None:
        parts.append(one.select(key, "start", F.substring("window", 1, 1).alias("name")))
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return found.join(words, "name").select(key, "start", F.col("n").alias("length"))


def _by_text(texts: DataFrame, names: DataFrame, key: str, text: str, pick, schema: str, columns: list[str]) -> DataFrame:
    """pick(text, its matches as (start, length)) for each text, one row per tuple that it gives."""
    found = dictionary_matches(texts, names, key, text).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("found"))
    own = texts.select(key, text).join(found, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, t, f in zip(batch[key], batch[text], batch["found"], strict=True) if t for r in pick(t, [(x["start"], x["length"]) for x in f] if f is not None else [])]
            yield pd.DataFrame(rows, columns=[key, *columns])

    return own.mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, {schema}")


def match_entities(texts: DataFrame, names: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """Occurrences of dictionary names (column name), longest first and not overlapping: key, name, start (code points).

    Keys are unique. Of overlapping occurrences of one length the first counts. Null and empty texts have none.
    """

    def pick(t: str, found: list[tuple[int, int]]) -> list[tuple]:
        taken, free = [], bytearray(len(t))
        for start, n in sorted(found, key=lambda x: (-x[1], x[0])):
            if not any(free[start : start + n]):
                free[start : start + n] = b"\1" * n
                taken.append((t[start : start + n], start))
        return sorted(taken, key=lambda x: x[1])

    return _by_text(texts, names.where(F.length("name") >= least), key, text, pick, "name string, start int", ["name", "start"])


def segment_max_match(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, token: each text cut from the left, at each place the longest name of the dictionary, else one character."""

    def pick(t: str, found: list[tuple[int, int]]) -> list[tuple]:
        longest: dict[int, int] = {}
        for start, n in found:
            longest[start] = max(n, longest.get(start, 1))
        at, out = 0, []
        while at < len(t):
            n = longest.get(at, 1)
            out.append((len(out), t[at : at + n]))
            at += n
        return out

    return _by_text(texts, names, key, text, pick, "pos int, token string", ["pos", "token"])


def facts_for_entities(entities: DataFrame, bridge: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """Active facts of each entity over the bridge (entity, fact_hash), at most k, the most confident first."""
    own = entities.select("entity").distinct().join(bridge.distinct(), "entity").join(facts.where("active").withColumnRenamed("hash", "fact_hash"), "fact_hash")
    return top_k(own.select("entity", "fact_hash", "fact", "confidence"), "entity", k, F.desc("confidence"), F.col("fact_hash"))


def filter_by_topic(pairs: DataFrame, query: str = "query", fact: str = "fact", entity: str = "entity") -> DataFrame:
    """Pairs whose fact holds a word of the query besides the entity's name."""
    words = F.filter(word_array(F.replace(F.col(query), F.col(entity), F.lit(" "))), lambda w: F.length(w) >= 3)
    return pairs.where(F.exists(words, lambda w: F.contains(F.lower(F.col(fact)), w)))
