"""Knowledge graphs from text: triples, the rules they contradict, evidence links, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.sources.staging import staged

#: Relation and pattern with subject and object groups; own small defaults, meant to be replaced.
RELATIONS = (
    ("IS_A", r"([A-Z]\w+(?: [A-Z]\w+)*) is an? ([a-z]+)"), ("BORN_IN", r"([A-Z]\w+(?: [A-Z]\w+)*) was born in ([0-9]{3,4})"), ("DIED_IN", r"([A-Z]\w+(?: [A-Z]\w+)*) died in ([0-9]{3,4})"),
    ("INVENTED", r"([A-Z]\w+(?: [A-Z]\w+)*) invented the ([a-z]+)"), ("FOUNDED_IN", r"([A-Z]\w+(?: [A-Z]\w+)*) was founded in ([0-9]{3,4})"),
    ("LOCATED_AT", r"([A-Z]\w+(?: [A-Z]\w+)*) is located in ([A-Z]\w+)"), ("NOT", r"([A-Z]\w+(?: [A-Z]\w+)*) is not in ([A-Z]\w+)"), ("IN", r"([A-Z]\w+(?: [A-Z]\w+)*) lies in ([A-Z]\w+)"),
)


def extract_kg_triples(df: DataFrame, key: str, text: str, relations=RELATIONS) -> DataFrame:
    """key, subj, rel, obj for every match of the patterns; nulls and texts without a match give none."""
    t = F.col(text)
    found = []
    for rel, pattern in relations:
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), 1).alias("subj"), F.regexp_extract_all(t, F.lit(pattern), 2).alias("obj"))
        found.append(F.transform(pairs, _with_relation(rel)))
    return df.where(t.isNotNull()).select(key, F.explode(F.concat(*found)).alias("x")).select(key, "x.*")


def _with_relation(rel: str):
    return lambda p: F.struct(p["subj"], F.lit(rel).alias("rel"), p["obj"])


def kg_contradictions(claims: DataFrame, triples: DataFrame, fuzzy: float = 0.6) -> DataFrame:
    """Claims (claim_id, subj, rel, obj) that the graph contradicts, with rule and confidence; the strongest counts.

    Rules: born_later (0.85): an event of a person ends before the person's birth, a claim (person, ENDED_IN, year) against
    BORN_IN. not_part (0.9): a person NOT part of what the claim names, one text in the other and at least 0.8 as long.
    other_maker (0.8): INVENTED the same thing as another subject; 0.75 where the things are only alike by `fuzzy` bigram
    Jaccard and begin alike. negated (0.9): LOCATED_AT or IN what the graph says it is NOT in. other_place (0.8): another
    object for LOCATED_AT. Joins on the subject or the thing's first two letters; the rest is a filter. Ids are ascending
    for ties. Null parts match nothing; empty tables give none.
    """
    from claimforge.functions.text import char_ngrams, jaccard

    c = claims.select("claim_id", "subj", "rel", "obj")
    t = triples.select(F.col("subj").alias("t_subj"), F.col("rel").alias("t_rel"), F.col("obj").alias("t_obj")).distinct()
    own = c.join(t, F.col("subj") == F.col("t_subj"))
    year = lambda x: F.col(x).try_cast("int")
    ratio = F.least(F.length("obj"), F.length("t_obj")) / F.greatest(F.length("obj"), F.length("t_obj"))
    within = (F.contains("obj", F.col("t_obj")) | F.contains("t_obj", F.col("obj"))) & (ratio >= 0.8)
    rule = (
        F.when((F.col("rel") == "ENDED_IN") & (F.col("t_rel") == "BORN_IN") & (year("obj") < year("t_obj")), F.struct(F.lit(0.85).alias("confidence"), F.lit("born_later").alias("rule")))
        .when(F.col("rel").isin("LOCATED_AT", "IN") & (F.col("t_rel") == "NOT") & (F.col("obj") == F.col("t_obj")), F.struct(F.lit(0.9).alias("confidence"), F.lit("negated").alias("rule")))
        .when((F.col("t_rel") == "NOT") & within, F.struct(F.lit(0.9).alias("confidence"), F.lit("not_part").alias("rule")))
        .when((F.col("rel") == "LOCATED_AT") & (F.col("t_rel") == "LOCATED_AT") & (F.col("obj") != F.col("t_obj")), F.struct(F.lit(0.8).alias("confidence"), F.lit("other_place").alias("rule")))
    )
    by_subject = own.select("claim_id", rule.alias("r")).where("r is not null")
    # different things are compared once; another subject made a thing if the least or the greatest of its subjects is another
    made = t.where("t_rel = 'INVENTED' AND t_subj IS NOT NULL").groupBy("t_obj").agg(F.min("t_subj").alias("low"), F.max("t_subj").alias("high")).withColumn("head", F.substring(F.lower("t_obj"), 1, 2))
    asked = c.where("rel = 'INVENTED'").select("obj").distinct().withColumn("head", F.substring(F.lower("obj"), 1, 2)).join(made, "head")
    alike = jaccard(char_ngrams(F.lower("obj"), 2), char_ngrams(F.lower("t_obj"), 2)) >= fuzzy
    sure = F.when(F.col("obj") == F.col("t_obj"), 0.8).when(alike, 0.75)
    sides = asked.withColumn("sure", sure).where("sure is not null").groupBy("obj", "sure").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    maker = F.struct(F.col("sure").alias("confidence"), F.lit("other_maker").alias("rule"))
    things = c.where("rel = 'INVENTED'").join(sides, "obj").where("subj <> low OR subj <> high")
    every = by_subject.union(things.select("claim_id", maker.alias("r")))
    return every.groupBy("claim_id").agg(F.max("r").alias("r")).select("claim_id", "r.rule", "r.confidence")


def kg_contradictions_fuzzy(claims: DataFrame, triples: DataFrame, aliases: DataFrame | None = None, least: float = 0.6, less: float = 0.1) -> DataFrame:
    """Contradicted claims (claim_id, subj, rel, obj), names that the graph doesn't know replaced by ones that it does.

    Stages, of which a claim takes the first that contradicts it: alias (subject or object is an alias of the table aliases,
    alias and name: the rules of kg_contradictions on the names), exact (on the claim as it stands), subject and object (the
    one replaced by the graph's most similar name, by bigrams at `least` or more, if that is another; confidence is `less`
    lower). Columns: claim_id, stage, rule, confidence, used (the name put in). Names are resolved once each, and only
    those of claims that are left. Of an alias's names the smallest counts. Empty tables give none.
    """
    from claimforge.operators.similarity import fuzzy_entity

    own, triples = staged(claims.select("claim_id", "subj", "rel", "obj"), "claims"), staged(triples.select("subj", "rel", "obj").distinct(), "triples")

    def judged(rows: DataFrame, stage: str) -> DataFrame:
        """rows: claims with the column used."""
        hit = kg_contradictions(rows, triples).join(rows.select("claim_id", "used"), "claim_id")
        lower = less if stage in ("subject", "object") else 0.0
        return staged(hit.select("claim_id", F.lit(stage).alias("stage"), "rule", F.round(F.col("confidence") - lower, 6).alias("confidence"), "used"), "judged")

    out = []
    left = own
    if aliases is not None:
        names = aliases.where("alias is not null and name is not null").groupBy("alias").agg(F.min("name").alias("name"))
        linked = own.join(names.toDF("subj", "s_name"), "subj", "left").join(names.toDF("obj", "o_name"), "obj", "left").where("s_name is not null or o_name is not null")
        linked = linked.select("claim_id", F.coalesce("s_name", "subj").alias("subj"), "rel", F.coalesce("o_name", "obj").alias("obj"), F.concat_ws(", ", "s_name", "o_name").alias("used"))
        out.append(judged(linked, "alias"))
        left = left.join(out[-1], "claim_id", "left_anti")
    out.append(judged(left.withColumn("used", F.lit(None).cast("string")), "exact"))
    nodes = triples.select("subj").union(triples.select("obj")).where("subj is not null").distinct().select(F.col("subj").alias("id"), F.col("subj").alias("text"))
    for stage, part in (("subject", "subj"), ("object", "obj")):
        left = left.join(out[-1], "claim_id", "left_anti")
        left = staged(left, "left")
        asked = left.where(F.col(part).isNotNull()).select(F.col(part).alias("id"), F.col(part).alias("text")).distinct()
        best = fuzzy_entity(asked, nodes, least).select(F.col("name_id").alias(part), F.col("entity_id").alias("used")).where(F.col(part) != F.col("used"))
        swapped = left.join(best, part)
        out.append(judged(swapped.select("claim_id", *(F.col("used").alias(c) if c == part else F.col(c) for c in ("subj", "rel", "obj")), "used"), stage))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every


def graph_votes(pairs: DataFrame, keys: list[str], triples: DataFrame, aliases: DataFrame | None = None, claim: str = "claim", fact: str = "fact", narrative: str = r"(?i)\b(story|legend|tale|rumou?r) (of|that)\b") -> DataFrame:
    """Votes of the graph on pairs: keys, checker, verdict, confidence, weight, as run_checkers gives them.

    A claim whose triples the graph contradicts is contradicted, with the highest confidence of its triples; not where more
    than half of the larger text's different characters are common to claim and fact, and not in narrative about a story.
    """
    from claimforge.functions.text import stable_hash

    told = pairs.select(stable_hash(F.col(claim)).alias("text_id"), F.col(claim).alias("text")).distinct().where(~F.col("text").rlike(narrative))
    found = extract_kg_triples(told, "text_id", "text").distinct().withColumn("claim_id", F.concat_ws("|", F.col("text_id").cast("string"), "subj", "rel", "obj"))
    hits = kg_contradictions_fuzzy(found.select("claim_id", "subj", "rel", "obj"), triples, aliases)
    best = hits.join(found.select("claim_id", "text_id"), "claim_id").groupBy("text_id").agg(F.max("confidence").alias("confidence"))
    chars = lambda x: F.array_distinct(F.split(F.col(x), ""))
    share = F.size(F.array_intersect(chars(claim), chars(fact))) / F.greatest(F.size(chars(claim)), F.size(chars(fact)))
    own = pairs.where(share <= 0.5).withColumn("text_id", stable_hash(F.col(claim))).join(best, "text_id")
    return own.select(*keys, F.lit("graph").alias("checker"), F.lit("contradicted").alias("verdict"), "confidence", F.lit(0.78).alias("weight"))


def competitors(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("contradicts", "overrides")) -> DataFrame:
    """For each node the nodes that edges (src, dst, type) of such kinds link it to either way, and their mean confidence.

    nodes has node and confidence. A link that exists both ways counts once; a node isn't its own competitor.
    """
    own = edges.where(F.col("type").isin(*kinds) & (F.col("src") != F.col("dst")))
    both = own.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(own.select("dst", "src")).distinct()
    rated = both.join(nodes.select(F.col("node").alias("other"), "confidence"), "other")
    return rated.groupBy("node").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def provenance_score(events: DataFrame, fact: str, source: str, verdict: str) -> DataFrame:
    """Independent sources, events and conflicts of each fact, its confidence and status.

    Confidence is 0.5, 0.1 more for each source up to five, 0.15 less for each conflict and 0.02 less for each event
    beyond three, in [0, 1]. Two conflicts make it disputed, three sources without one confirmed.
    """
    own = events.groupBy(fact).agg(F.count_distinct(source).alias("n_sources"), F.count("*").alias("n_events"), F.sum(F.when(F.col(verdict) == "contradicted", 1).otherwise(0)).alias("n_conflicts"))
    score = 0.5 + 0.1 * F.least("n_sources", F.lit(5)) - 0.15 * F.col("n_conflicts") - 0.02 * F.greatest(F.col("n_events") - 3, F.lit(0))
    status = F.when(F.col("n_conflicts") >= 2, "disputed").when((F.col("n_sources") >= 3) & (F.col("n_conflicts") == 0), "confirmed").otherwise("open")
    return own.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)).withColumn("status", status)


def link_entity_ids(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (fact_id, fact) that an entity (entity_id, fact) of the base states, with its smallest id and how many state it."""
    known = entities.groupBy("fact").agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("n_entities"))
    return facts.join(known, "fact").select("fact_id", "entity_id", "n_entities")


def entity_fact_map(mentions: DataFrame, k: int = 200) -> DataFrame:
    """(entity, fact_hash) for facts that mention an entity, the first k by hash for each: a top-k bridge table."""
    own = mentions.select("entity", "fact_hash").distinct()
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("entity").orderBy("fact_hash"))).where(F.col("pos") <= k)


def resolve_entity(queries: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """Each query (query_id, name) resolved to an entity (entity_id, name): equal, else equal without case and white space,
    else by the first three letters if only one entity begins so; stage tells which. Unresolved queries have no entity."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    q = queries.select("query_id", F.col(name).alias("q"), plain(F.col(name)).alias("qp"), F.substring(plain(F.col(name)), 1, 3).alias("qh"))
    exact = entities.groupBy(F.col(name).alias("q")).agg(F.min("entity_id").alias("e1"))
    loose = entities.groupBy(plain(F.col(name)).alias("qp")).agg(F.min("entity_id").alias("e2"))
    head = entities.groupBy(F.substring(plain(F.col(name)), 1, 3).alias("qh")).agg(F.min("entity_id").alias("e3"), F.count("*").alias("k")).where("k = 1")
    own = q.join(exact, "q", "left").join(loose, "qp", "left").join(head, "qh", "left")
    return own.select("query_id", F.coalesce("e1", "e2", "e3").alias("entity_id"), F.when(F.col("e1").isNotNull(), "exact").when(F.col("e2").isNotNull(), "plain").when(F.col("e3").isNotNull(), "prefix").otherwise("none").alias("stage"))
