"""Fuzzy names, graph checks and keyed streams against plain loops."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimforge.operators import graph, metrics, sessions, similarity
from claimforge.plans import reason, registry
from claimforge.sources.staging import shared_path
from claimforge.streaming import keyed

SF = "/root/testdata/sf0.001"


def cosine(a, b):
    x, y = (Counter("".join(t.lower().split())[i : i + 2] for i in range(len("".join(t.lower().split())) - 1)) for t in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return round(sum(v * y[g] for g, v in x.items()) / norm, 6) if norm else 0.0


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_fuzzy_entity_equals_loops(spark, least):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(120)] + ["Supplier1", "Supplier11", "aaaa", "aa", "", None, "x"]
    ask = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(80)] + ["Suplier1", "aaa", "", None, "x", "zzz", base[3]]
    names, candidates = ([(i, t) for i, t in enumerate(x)] for x in (ask, base))
    want = {}
    for i, a in names:
        found = sorted((-cosine(a, b), j) for j, b in candidates if a and b and cosine(a, b) >= least)
        if found:
            want[i] = (found[0][1], -found[0][0])
    schema = "id long, text string"
    got = similarity.fuzzy_entity(spark.createDataFrame(names, schema), spark.createDataFrame(candidates, schema), least)
    assert {r.name_id: (r.entity_id, r.similarity) for r in got.collect()} == want and len(want) > 20
    assert similarity.fuzzy_entity(spark.createDataFrame([], schema), spark.createDataFrame(candidates, schema)).count() == 0


def test_graph_takes_the_first_stage_that_contradicts(spark):
    triples = spark.createDataFrame([("Supplier1", "LOCATED_AT", "France"), ("Supplier2", "LOCATED_AT", "Peru"), ("Supplier1", "NOT", "Germany"), (None, None, None)], "subj string, rel string, obj string")
    claims = [
        (1, "Supplier1", "LOCATED_AT", "Peru"), (2, "S#1", "LOCATED_AT", "Peru"), (3, "Suplier1", "LOCATED_AT", "Peru"), (4, "Supplier1", "IN", "Gemany"), (5, "Supplier1", "LOCATED_AT", "France"),
        (6, "Nobody", "LOCATED_AT", "Peru"), (7, None, None, None), (8, "Suplier2", "LOCATED_AT", "Peru"), (9, "Supplier1", "IN", "Germany"), (9, "Supplier1", "IN", "Germany"),
    ]
    aliases = spark.createDataFrame([("S#1", "Supplier1"), ("S#1", "Supplier9"), (None, "x")], "alias string, name string")
    frame = spark.createDataFrame(claims, "claim_id long, subj string, rel string, obj string")
    got = {r.claim_id: (r.stage, r.rule, r.confidence, r.used) for r in graph.kg_contradictions_fuzzy(frame, triples, aliases).collect()}
    assert got == {1: ("exact", "other_place", 0.8, None), 2: ("alias", "other_place", 0.8, "Supplier1"), 3: ("subject", "other_place", 0.7, "Supplier1"), 4: ("object", "negated", 0.8, "Germany"), 9: ("exact", "negated", 0.9, None)}
    assert graph.kg_contradictions_fuzzy(frame.limit(0), triples).count() == 0 == graph.kg_contradictions_fuzzy(frame, triples.limit(0)).count()


def test_every_checker_and_stage_fires(spark):
    votes = Counter(r.checker for r in reason.check_statements(spark, SF).collect())
    assert set(votes) == {"years", "numeric", "comparative", "duration", "negation", "infinity", "entity_swap", "myth", "attribution", "causal", "superlative", "overlap"}
    assert min(votes.values()) >= 5
    assert {r.checker for r in reason.check_graph(spark, SF).collect()} == {"graph"}
    assert {r.stage for r in reason.kg_rules_fuzzy(spark, SF).collect()} == {"alias", "exact", "subject", "object"}


def _feed(spark, rows, schema, files, late, make):
    """Rows in `files` files, one taken in a batch, in the order of the list; the result of run_to_end."""
    path, frame = shared_path(spark, "feed"), spark.createDataFrame(rows, schema)
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    keyed.run_to_end(make, source, "ts", f"{path}-out", late)
    return spark.read.schema(make(source).schema).parquet(f"{path}-out/rows"), frame


def test_streams_equal_batches_with_late_rows_and_restarts(spark):
    rng, begin = random.Random(1), dt.datetime(2024, 1, 1)
    events = [(k, begin + dt.timedelta(seconds=rng.randint(0, 20) + 60 * i, microseconds=rng.randint(0, 999_999)), i) for i in range(150) for k in ("hot", "hot", "b", f"k{i % 7}")]
    events = [(k, t, 10 * i + j) for j, (k, t, i) in enumerate(events)]
    rng.shuffle(blocks := [events[i : i + 40] for i in range(0, len(events), 40)])  # late by more than an hour
    rows = [e for b in blocks for e in b] + [(None, begin, 1), ("b", None, 2), ("b", begin, None)]
    schema = "key string, ts timestamp, ord long"
    got, frame = _feed(spark, rows, schema, 5, "1 day", lambda s: keyed.stream_alert(s, "key", "ts", 300.0, "1 day"))
    clean = frame.where("key is not null and ts is not null").withColumn("at", F.unix_micros("ts") / 1e6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, metrics.alert_cooldown(clean, "key", "at", 300.0).select("key", "at").collect()))
    got, _ = _feed(spark, rows, schema, 5, "1 day", lambda s: keyed.stream_ban(s, "key", "ts", "ord", 3, 300, 300, 3600, "1 day"))
    want = metrics.exponential_ban(clean.where("ord is not null"), "key", "at", "ord", 3, 300, 300, 3600).select("key", "ord").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want


def test_stream_drift_equals_the_windows(spark):
    rng, begin = random.Random(2), dt.datetime(2024, 1, 1)
    turns = [(s, i, begin + dt.timedelta(minutes=i), float(rng.random() < 0.3), float(rng.random() < 0.3), rng.random() < 0.2, rng.random() < 0.2) for s in range(6) for i in range(30)]
    rng.shuffle(turns)
    schema = "s long, turn long, ts timestamp, i double, d double, a boolean, b boolean"
    terms = {"a": F.col("a"), "b": F.col("b")}
    got, frame = _feed(spark, turns, schema, 4, "1 day", lambda x: keyed.stream_session_drift(x, "s", "turn", "ts", F.col("i"), F.col("d"), terms, least=2, late="1 day", idle=None))
    want = sessions.session_drift(frame, "s", "turn", F.col("i"), F.col("d"), terms, least=2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    quiet = [(1, 0, begin, 1.0, 0.0, True, False), (1, 1, begin + dt.timedelta(hours=3), 0.0, 0.0, False, True)]
    got, _ = _feed(spark, quiet, schema, 1, "1 minute", lambda x: keyed.stream_session_drift(x, "s", "turn", "ts", F.col("i"), F.col("d"), terms, least=2, late="1 minute", idle=1800))
    assert {r.turn: (r.seen, r.score, r.risk) for r in got.collect()} == {0: (1, 0.4, 0.4), 1: (1, 0.0, 0.0)}  # begun anew after the pause


def test_registered_stream_names():
    assert {"stream_alert", "stream_ban", "stream_session_drift", "check_statements", "check_graph", "kg_rules_fuzzy"} <= set(registry.QUERIES)


def test_streams_read_folders_of_files(spark, tmp_path):
    """A table that is a folder of part files gives the stream the same rows as one file."""
    turns = spark.createDataFrame([(c, t, "user", f"the {c} ignore {t}") for c in range(3) for t in range(4)], "conv_id long, turn long, role string, text string")
    turns.repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    assert registry.QUERIES["stream_session_drift"](spark, f"{tmp_path}/many").count() == 12


def test_makers_are_joined_by_different_things(spark):
    """Many subjects that made a few things: a claim meets each thing once, not each maker."""
    made = [(f"S{i}", "INVENTED", f"engine{'abc'[i % 3]}") for i in range(300)] + [("S900", "INVENTED", "wheel")]
    triples = spark.createDataFrame(made, "subj string, rel string, obj string")
    claims = spark.createDataFrame([(1, "S0", "INVENTED", "enginea"), (2, "S900", "INVENTED", "wheel"), (3, "S1", "INVENTED", "wheel"), (4, "S3", "INVENTED", "engined"), (5, None, "INVENTED", "wheel")], "claim_id int, subj string, rel string, obj string")
    out = graph.kg_contradictions(claims, triples)
    assert {r.claim_id: r.confidence for r in out.collect()} == {1: 0.8, 3: 0.8, 4: 0.75}
    asked = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" in asked and "max(" in asked  # the makers of a thing are one row
