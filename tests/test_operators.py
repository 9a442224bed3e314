"""Operators on small frames: the rules themselves, edge rows, and brute force."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from claimforge.functions import text as T
from claimforge.operators import checkers, claims, graph, kb, metrics, scan, sessions, similarity, votes
from claimforge.sources import io
from claimforge.streaming import stream


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


TEXTS = ["", "ab", "abc", "Zürich 😀", "x" * 500, None]


def test_hashes_match_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.stable_hash(F.col("t")).alias("h"), T.fact_id(F.col("t")).alias("f"))
    for r in df.collect():
        if r.t is None:
            assert r.h is None and r.f is None
        else:
            assert r.h == int(hashlib.sha256(r.t.encode()).hexdigest()[:16], 16) & T.TOP_BIT_CLEAR
            assert r.f == hashlib.sha256(r.t.encode()[:200]).hexdigest()[:16]


def test_ngrams_and_jaccard(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("ab", "abc"), ("", "abc"), (None, "abc")], "a string, b string")
    a, b = T.char_ngrams(F.col("a"), 3), T.char_ngrams(F.col("b"), 3)
    assert [r.j for r in df.select(T.jaccard(a, b).alias("j")).collect()][:3] == [pytest.approx(1 / 3), 0.0, 0.0]
    assert df.select(F.size(T.char_ngrams(F.col("a"), 3, keep_short=True)).alias("n")).collect()[1].n == 1


def test_similar_pairs_equal_brute_force(spark):
    data = [(i, f"{'abcdefgh'[i % 8]}{i % 13} the quick brown fox {i % 5} jumps {i % 3}") for i in range(120)] + [(200, ""), (201, None), (202, "zz")]
    df = spark.createDataFrame(data, "k long, t string")
    sets = {k: {t.replace(" ", "")[i : i + 3] for i in range(len(t.replace(" ", "")) - 2)} for k, t in data if t}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]))
    got = similarity.near_duplicates(df, "k", "t", 0.7)
    same = {k: min(j for j, u in data if (u or f"null {j}").replace(" ", "") == (t or f"null {k}").replace(" ", "")) for k, t in data}
    assert {(r.key, r.rep) for r in got.collect()} == set(same.items())
    links = {(r.rep, r.other) for r in got.where("other is not null").collect()}
    assert links == {(same[x], same[y]) for a, b in want for x, y in ((a, b), (b, a)) if same[x] != same[y]}


def test_entities_longest_first_without_overlap(spark):
    df = spark.createDataFrame([(1, "New York City and York"), (2, None), (3, "")], "k long, t string")
    assert rows(similarity.match_entities(df, spark.createDataFrame([("York",), ("New York",), ("New York City",), (None,), ("",), ("a",)], "name string"), "k", "t")) == [(1, "New York City", 0), (1, "York", 18)]


def test_lookup_prefers_the_store(spark):
    c = spark.createDataFrame([("a fact",), ("seeded",), ("new",), (None,)], "claim string")
    f = spark.createDataFrame([("a fact", 0.8, "wiki"), ("a fact", 0.8, "wiki")], "fact string, confidence double, source string")
    s = spark.createDataFrame([("seeded",), ("a fact",)], "fact string")
    got = {r.claim: (r.verdict, r.confidence, r.found_in) for r in claims.lookup_facts(c, f, s).collect()}
    assert got == {"a fact": ("supported", 0.8, "wiki"), "seeded": ("supported", 0.9, "seed"), "new": ("not_found", 0.0, None), None: ("not_found", 0.0, None)}


def test_subclaims_keep_thousands(spark):
    df = spark.createDataFrame([("It has 1,000 people, and a river",), ("one thing and another thing",)], "t string")
    assert rows(claims.split_subclaims(df, "t"), "part") == [("It has 1000 people",), ("and a river",), ("another thing",), ("one thing",)]


@pytest.mark.parametrize(
    "claim,fact,checker",
    [
        ("The bridge opened in 1920", "The bridge opened in 1937", "years"),
        ("The tower is 500 metres tall", "The tower is 300 metres tall", "numeric"),
        ("The lake is not deep at all", "The lake is deep at all times", "negation"),
        ("Fewer than, under 50 people live there", "There live 80 people", "comparative"),
        ("Space is infinite", "Space is finite", "infinity"),
    ],
)
def test_checkers_fire(spark, claim, fact, checker):
    df = spark.createDataFrame([(1, claim, fact), (2, None, fact), (3, "", "")], "k long, claim string, fact string")
    got = checkers.run_checkers(df, ["k"]).collect()
    assert (1, checker, "contradicted") in {(r.k, r.checker, r.verdict) for r in got}
    assert {r.k for r in got} == {1}


def test_votes(spark):
    v = spark.createDataFrame([(1, "a", "contradicted", 0.9, 0.9), (1, "b", "verified", 0.7, 0.55), (2, "a", "contradicted", 0.6, 0.5), (3, "a", "verified", 0.9, 0.9)], "k long, checker string, verdict string, confidence double, weight double")
    got = {r.k: (r.verdict, r.confidence) for r in votes.decide_weighted(v, ["k"]).collect()}
    assert got == {1: ("contradicted", 0.9), 2: ("uncertain", 0.5), 3: ("verified", 0.9)}
    assert {r.k: r.verdict for r in votes.vote_majority(v, ["k"]).collect()}[3] == "unverifiable"


def test_leaks_are_masked_and_checked(spark):
    df = spark.createDataFrame([(1, "4111111111111111 and 4111111111111112, a.b@c.org, 10.0.0.300"), (2, None)], "doc_id long, text string")
    got = scan.scan_leaks(df).collect()
    assert {(r.category, r.masked) for r in got} == {("card", "411*********1111"), ("email", "a.b**.org")}


def test_pleasing_counter_equals_a_loop(spark):
    import random

    rnd = random.Random(3)
    data = [(s, t, rnd.random() < 0.5) for s in range(5) for t in range(40)]
    got = {(r.s, r.t): r.counter for r in sessions.pleasing_drift(spark.createDataFrame(data, "s long, t long, up boolean"), "s", "t", F.col("up")).collect()}
    for s in range(5):
        c = 0
        for _, t, up in (x for x in data if x[0] == s):
            c = c + 1 if up else max(0, c - 1)
            assert got[s, t] == c


def test_trust_fold_equals_a_loop(spark):
    data = [(k, t, ((t * 7 + k) % 5 - 2) / 4) for k in range(4) for t in range(30)]
    got = {r.k: r.score for r in kb.trust_fold(spark.createDataFrame(data, "k long, t long, d double"), "k", ["t"], "d").collect()}
    for k in range(4):
        s = 0.5
        for _, _, d in (x for x in data if x[0] == k):
            s = max(0, min(1, s + d))
        assert got[k] == pytest.approx(s, abs=1e-6)


def test_chain_reports_broken_rows(spark):
    data, prev = [], "start"
    for i in range(50):
        payload = f"event {i}"
        h = hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()
        data.append([i, payload, h, prev])
        prev = h
    schema = "id long, payload string, hash string, prev_hash string"
    assert metrics.verify_chain(spark.createDataFrame(data, schema)).count() == 0
    data[20][1] = "changed"
    assert rows(metrics.verify_chain(spark.createDataFrame(data, schema)), "id") == [(20,)]


def test_rate_limits_with_ties_and_edges(spark):
    e = spark.createDataFrame([("a", 0.0, 1), ("a", 0.0, 2), ("a", 0.0, 3), ("a", 60.0, 4), ("b", 5.0, 5)], "k string, t double, id long")
    assert rows(metrics.sliding_rate_limit(e, "k", "t", "id", 2), "id", "accepted") == [(1, True), (2, True), (3, False), (4, True), (5, True)]
    assert rows(metrics.token_bucket(e, "k", "t", "id", 1.0, 2.0), "id", "accepted") == [(1, True), (2, True), (3, False), (4, True), (5, True)]


def test_kb_json_and_jsonl(spark, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps({"sun": {"facts": ["It is hot", "It is big"], "source": "x"}, "moon": {"fact": "It is cold", "category": "c"}, "_meta": {"facts": ["no"]}}))
    assert rows(io.read_kb_json(spark, str(tmp_path / "kb.json"))) == [("moon", 0, "It is cold", None), ("sun", 0, "It is hot", "x"), ("sun", 1, "It is big", "x")]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert rows(io.read_jsonl(spark, str(tmp_path / "log.jsonl"), "a int")) == [(1,), (2,)]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([("a", 1000.0 + i, i) for i in range(20)], "k string, s double, id long").withColumn("ts", F.timestamp_seconds("s"))
    e.select("k", "ts", "id").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, ts timestamp, id long").parquet(str(tmp_path / "in"))
    stream.run_available(stream.stream_token_bucket(source, "k", "ts", "id", 0.5, 2.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = metrics.token_bucket(e, "k", "s", "id", 0.5, 2.0)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "accepted") == rows(batch, "id", "accepted")


def test_hot_key_and_empty_tables(spark):
    hot = spark.createDataFrame([(i, "same text here" if i % 3 else f"text {i}") for i in range(300)], "k long, fact string").withColumn("source", F.lit("s"))
    assert kb.dedupe_exact(hot).agg(F.max("n")).first()[0] == 200
    none = hot.limit(0)
    assert kb.dedupe_exact(none).count() == 0 and similarity.near_duplicates(none, "k", "fact").count() == 0
    assert kb.insert_new(hot, hot).count() == 0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k in ("a", "b", None) for v in [*rng.exponential(10, 301), 5.0, 5.0]] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.p, r.q) for r in metrics.exact_quantiles(df, ["g"], "v", {"p": 0.5, "q": 0.99}).collect()}
    for g in ("a", "b", None, "c"):
        own = [v for k, v in data if k == g]
        assert got[g] == (pytest.approx(np.quantile(own, 0.5)), pytest.approx(np.quantile(own, 0.99)))
    assert got["d"] == (None, None)
    assert metrics.exact_quantiles(df.limit(0), ["g"], "v", {"p": 0.5}).count() == 0


def test_perturb_moves_the_first_number_only(spark):
    df = spark.createDataFrame([(1, "from 10 to 25"), (2, "none"), (3, None), (4, "7")], "k long, t string")
    assert rows(kb.perturb_numbers(df, "k", "t", (1,)), "fact") == [("8",), ("from 11 to 25",)]


def test_weighted_ties_go_to_the_smaller_name(spark):
    v = spark.createDataFrame([(1, "z", "contradicted", 0.9, 0.9), (1, "a", "verified", 0.9, 0.9)], "k long, checker string, verdict string, confidence double, weight double")
    assert votes.decide_weighted(v, ["k"]).first().verdict == "verified"
    modes = votes.compare_vote_modes(v, ["k"]).first()
    assert (modes.majority, modes.weighted, modes.borda, modes.agree) == ("contradicted", "contradicted", "verified", False)


def test_checkers_with_units_lists_and_makers(spark):
    df = spark.createDataFrame(
        [(1, "The road is 5 km long here", "The road is 5000 m long here"), (2, "The road is 5 km long here", "The road is 9 km long here"), (3, "The engine was invented by smith", "The engine was invented by jones")],
        "k long, claim string, fact string",
    )
    got = {(r.k, r.checker) for r in checkers.run_checkers(df, ["k"]).where("verdict = 'contradicted'").collect()}
    assert (1, "numeric") not in got and (2, "numeric") in got and (3, "attribution") in got
    more = (
        checkers.Checker("places", 0.85, checkers.lookup_conflict({"Tower": ("Paris",)}, ("Paris", "Rome"))),
        checkers.Checker("eras", 0.8, checkers.temporal_order({"Tang": (618, 907), "Song": (960, 1279)}, {"Li Bai": "Tang"})),
    )
    df = spark.createDataFrame([(1, "The Tower in Rome", "x"), (2, "The Tower in Paris", "x"), (3, "Li Bai of the Song", "x"), (4, "Li Bai in 1850", "x"), (5, "Li Bai of the Tang", "x")], "k long, claim string, fact string")
    assert {(r.k, r.checker) for r in checkers.run_checkers(df, ["k"], checkers=more).collect()} == {(1, "places"), (3, "eras"), (4, "eras")}
    numbers = spark.createDataFrame([("it cost 1,250 thousand",), ("5 km away",), ("none",), (None,)], "t string").select(checkers.parse_number(F.col("t")).alias("n"))
    assert [r.n and tuple(r.n) for r in numbers.collect()] == [(1250000.0, None), (5.0, "km"), None, None]


def test_kg_rules(spark):
    text = spark.createDataFrame([(1, "Ada Byron was born in 1815. Ada Byron invented the program. The Louvre is located in Paris. The Louvre is not in Rome."), (2, None), (3, "")], "k long, t string")
    triples = graph.extract_kg_triples(text, "k", "t")
    assert {(r.subj, r.rel, r.obj) for r in triples.collect()} == {("Ada Byron", "BORN_IN", "1815"), ("Ada Byron", "INVENTED", "program"), ("The Louvre", "LOCATED_AT", "Paris"), ("The Louvre", "NOT", "Rome")}
    claimed = spark.createDataFrame([(1, "Ada Byron", "ENDED_IN", "1800"), (2, "Bob", "INVENTED", "program"), (3, "Bob", "INVENTED", "programs"), (4, "The Louvre", "IN", "Rome"), (5, "The Louvre", "LOCATED_AT", "Nice"), (6, "The Louvre", "LOCATED_AT", "Paris")], "claim_id long, subj string, rel string, obj string")
    got = {r.claim_id: (r.rule, r.confidence) for r in graph.kg_contradictions(claimed, triples).collect()}
    assert got == {1: ("born_later", 0.85), 2: ("other_maker", 0.8), 3: ("other_maker", 0.75), 4: ("negated", 0.9), 5: ("other_place", 0.8)}


def test_self_contradiction_lists_every_pair(spark):
    data = [(1, 1, "the door is open"), (1, 2, "the door is not open"), (1, 3, "open is the door"), (1, 4, "door not open the is"), (2, 1, "the door is not open"), (1, 5, None), (1, 6, "")]
    got = sessions.detect_self_contradiction(spark.createDataFrame(data, "s long, t long, x string"), "s", "t", "x")
    assert {(r.s, r.earlier, r.later) for r in got.collect()} == {(1, 1, 2), (1, 2, 3), (1, 1, 4), (1, 3, 4)}


def test_streams_of_state_do_not_depend_on_partitions(spark):
    data = [(k, float(t * 100), t) for k in range(3) for t in range(20)]
    df = spark.createDataFrame(data, "u long, at double, id long").repartition(5)
    banned = {(r.u, r.id) for r in metrics.exponential_ban(df, "u", "at", "id", 3, 300, 300, 1800).select("u", "id").collect()}
    until, n, held, want = {}, {}, {}, set()
    for u, t, i in data:
        if t < until.get(u, 0):
            continue
        held[u] = [x for x in held.get(u, []) if x > t - 300] + [t]
        if len(held[u]) >= 3:
            want.add((u, i))
            until[u], n[u], held[u] = t + min(1800, 300 * 6 ** n.get(u, 0)), n.get(u, 0) + 1, []
    assert banned == want


def test_word_edges_are_those_of_sql(spark):
    """Letters outside ASCII end a word, as in SQL's patterns: the filler 'no' of 'Noël', and 'all' of 'allée'."""
    df = spark.createDataFrame([("Noël Marchand speaks",), ("the Tallé allée",), ("Nobody waits here",)], "sentence string")
    got = {r.sentence: r.claim_type for r in claims.extract_claims(df).collect()}
    assert got == {"the Tallé allée": "absolute", "Nobody waits here": "other"}


def test_weighted_votes_are_added_in_the_order_given(spark):
    """0.1 + 0.2 + 0.3 is more than 0.6 in doubles and 0.3 + 0.2 + 0.1 is not, so the order decides a tie, not the partitions."""
    one = [(1, "verified", 0.1, 1), (1, "verified", 0.2, 2), (1, "verified", 0.3, 3), (1, "contradicted", 0.6, 4)]
    two = [(2, v, w, 5 - o) for _, v, w, o in one]
    v = spark.createDataFrame([(k, v, w, 1.0, o) for k, v, w, o in one + two], "k int, verdict string, weight double, confidence double, o int")
    for n in (1, 5, 8):
        assert {r.k: r.verdict for r in votes.vote_weighted(v.repartition(n, "o"), ["k"], "o").collect()} == {1: "verified", 2: "contradicted"}


def test_names_that_many_rows_have_are_compared_once(spark):
    """5 names of 4,000 rows: the pairs that are joined are those of names; each row's best is the smallest other id."""
    names = ["large ring", "hot bolt", "large rings", "cold bolt", "zinc nut"]
    parts = spark.createDataFrame([(i, names[i % 5] if i else "lone name here") for i in range(4000)], "id long, text string")
    for operator, key, found in ((similarity.best_match, "claim_id", "fact_id"), (similarity.fuzzy_entity, "name_id", "entity_id")):
        out = operator(parts.where("id % 20 < 4"), parts, others=True)
        got = {r[key]: r[found] for r in out.collect()}
        assert 0 not in got  # nothing is like the lone name but itself
        first = {1: 1, 2: 2, 3: 3, 0: 5}
        for k, v in got.items():
            assert v == (first[k % 5] if k != first[k % 5] else first[k % 5] + 5)
        assert len(got) == 799
    assert {r.text: list(r.ids) for r in similarity.same_text(parts).collect()}["hot bolt"] == [1, 6]


def test_similar_pairs_join_makes_no_candidates(spark):
    """Sets that share a rare gram and little else don't leave the join; the pairs equal brute force, with one side and with two."""
    rng = __import__("random").Random(5)
    sets = {i: sorted({f"g{rng.randrange(60)}" for _ in range(rng.randint(1, 14))} | {"common"}) for i in range(120)}
    frame = spark.createDataFrame(list(sets.items()), "id long, grams array<string>")
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    for least in (0.3, 0.5, 0.8):
        got = {(r.left_id, r.right_id) for r in similarity.similar_pairs(frame.where("id < 60"), frame, least).collect()}
        assert got == {(a, b) for a in range(60) for b in sets if share(a, b) >= least}
        assert {(r.left_id, r.right_id) for r in similarity.similar_pairs(frame, None, least).collect()} == {(a, b) for a, b in itertools.combinations(sets, 2) if share(a, b) >= least}
    plan = similarity.similar_pairs(frame, frame, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect(left_id_rest" in "".join(line for line in plan.splitlines() if "Join" in line)
