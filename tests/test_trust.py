"""Belief, arbitration, evidence, consistency, edits, panels, prime numbers and quantiles on small frames and extreme ones."""

import math
import random

import numpy as np
import pytest

from claimforge.operators import belief as B
from claimforge.operators import kb, metrics
from claimforge.sources import io


def test_number_facts_of_large_numbers(spark):
    rng = random.Random(3)
    odd = [10**18 + 9, 10**18 + 11, 2**63 - 1, 2**61 - 1, 3215031751, 3825123056546413051, 9223372036854775783, 0, 1, 2, 3, 4, 9, -7, 1900, 2000, 2024, 10**15 + 37, 3037000499**2, 3037000499**2 - 1]
    data = [*odd, *(rng.randrange(1, 10**6) for _ in range(300)), None, 2]
    got = {r.n: r for r in kb.number_facts(spark.createDataFrame([(x,) for x in data], "n long"), "n").collect()}
    assert set(got) == set(data) - {None}
    small = lambda n: n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))
    known = {10**18 + 9: True, 10**18 + 11: False, 2**63 - 1: False, 2**61 - 1: True, 3215031751: False, 3825123056546413051: False, 9223372036854775783: True, 10**15 + 37: True, 3037000499**2: False, 3037000499**2 - 1: False}
    for n, r in got.items():
        assert r.prime == (known[n] if n in known else small(n)), n
        assert r.square == (n >= 0 and math.isqrt(n) ** 2 == n) and r.even == (n % 2 == 0), n
        assert r.divisors == ",".join(str(d) for d in range(2, 10) if n % d == 0)
    assert [got[y].leap_year for y in (1900, 2000, 2024)] == [False, True, True] and [got[y].century for y in (1, 1900, 2000, 0)] == [1, 19, 20, None]


@pytest.mark.parametrize("top, block", [(0, 10), (1, 10), (2, 10), (30, 7), (5000, 64), (5000, 10**6)])
def test_primes_by_segments(spark, top, block):
    want = [n for n in range(2, top + 1) if all(n % d for d in range(2, math.isqrt(n) + 1))]
    primes = kb.primes_upto(spark, top, block)
    assert sorted(r.prime for r in primes.collect()) == want
    assert sorted(map(tuple, kb.adjacent_pairs(primes, "prime").collect())) == list(zip(want, want[1:], strict=False))


def test_quantiles_with_an_outlier_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(6)
    data = [("hot", float(v)) for v in rng.exponential(10, 20_000)] + [("hot", 1e12)] + [("ties", 5.0)] * 5000 + [("ties", 7.0), ("one", 3.0), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    shares = {"a": 0.0, "p": 0.5, "q": 0.99, "z": 1.0}
    got = {r.g: tuple(r)[1:] for r in metrics.exact_quantiles(df, ["g"], "v", shares).collect()}
    for g in {k for k, _ in data}:
        own = [v for k, v in data if k == g and v is not None]
        assert got[g] == (pytest.approx([np.quantile(own, q) for q in shares.values()]) if own else (None,) * 4)
    every = [v for _, v in data if v is not None]
    assert tuple(metrics.exact_quantiles(df, [], "v", shares).head()) == pytest.approx([np.quantile(every, q) for q in shares.values()])


def test_belief_and_arbitration(spark):
    schema = "node long, confidence double, state string, validated_days long, created_days long, usage long, adoption double, contradictions long, validators long, reliability double"
    nodes = [(1, 0.8, "active", 90, 200, 0, 0.0, 0, 0, 1.0), (2, 0.9, "active", None, 30, 1, 0.6, 2, 10, 0.5), (3, 0.4, "debunked", 1, 1, 9, 1.0, 0, 9, 1.0), (4, 0.2, None, None, 0, None, None, None, None, None)]
    edges = spark.createDataFrame([(1, 2, "contradicts"), (2, 1, "overrides"), (4, 2, "supports"), (4, 1, "contradicts")], "src long, dst long, type string")
    got = {r.node: r.belief for r in B.belief(spark.createDataFrame(nodes, schema), edges).collect()}
    one = 0.8 * 0.5 - max(0, (0.9 + 0.2) / 2 - 0.8) * 0.3
    two = 0.9 * 0.5 * (1 + math.log(2) * 0.05 + 0.1) * 0.7 * 1.3 * 0.75
    four = 0.2 * 1 * 1 * 1 * 1 * 0.5 - (0.8 - 0.2) * 0.3
    assert got == {1: pytest.approx(one, abs=1e-6), 2: pytest.approx(two, abs=1e-6), 3: 0.4, 4: pytest.approx(max(0, four), abs=1e-6)}
    records = spark.createDataFrame([(1, 9, 9, 1.0, 0, 0), (2, 1, 0, 0.5, None, 9), (3, 9, 9, 0.9, 0, 0)], "fact long, n_sources long, n_checks long, source_trust double, days long, unresolved long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 99)], "a long, b long")
    assert sorted((r.a, r.b, r.winner, r.confidence, r.action) for r in B.arbitrate(pairs, records).collect()) == [(1, 2, 1, 0.9, "downgrade_loser"), (1, 3, None, 0.3, "review")]


def test_evidence_and_consistency(spark):
    facts = spark.createDataFrame([(1,), (2,), (3,), (3,)], "hash long")
    evidence = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "a", 0.4), (2, "x", 0.1)], "hash long, source string, confidence double")
    conflicts = spark.createDataFrame([(2, 9, "e", False), (1, 9, "e", True), (2, 2, "f", None)], "hash_a long, hash_b long, entity string, resolved boolean")
    got = sorted(map(tuple, B.attach_evidence(facts, evidence, conflicts).collect()))
    assert got == [(1, "supported", ["a", "b"], 3, 0, []), (2, "contradicted", ["x"], 1, 2, ["e", "f"]), (3, "unverified", [], 0, 0, [])]
    pair = "key string, fact string"
    new = spark.createDataFrame([("sky", "The sky is not blue"), ("sky", "The sky is blue"), ("sea", "The sea is not deep"), ("sea", "zzz not"), ("x", "set mode off"), (None, "a"), ("sky", None)], pair)
    held, anchors = spark.createDataFrame([("sea", "The sea is deep"), ("sea", "1234567 98"), ("sky", None)], pair), spark.createDataFrame([("sky", "The sky is blue")], pair)
    got = {(r.key, r.fact): (r.accepted, r.reasons) for r in B.check_kb_consistency(new, held, anchors, (("settings", r"set \w+ off"),)).collect()}
    assert got == {("sky", "The sky is not blue"): (False, ["anchor"]), ("sky", "The sky is blue"): (True, []), ("sea", "The sea is not deep"): (False, ["existing"]), ("sea", "zzz not"): (True, []), ("x", "set mode off"): (False, ["settings"])}
    changes = spark.createDataFrame([("add", " k ", " f "), ("add", "k", "f"), ("add", "_r", "f"), ("add", "k", ""), ("remove", "sea", "The sea is deep"), ("remove", "k", "no"), ("add", None, "f")], "op string, key string, fact string")
    assert sorted(map(tuple, B.edit_facts(held, changes).collect())) == [("k", "f"), ("sea", "1234567 98")]


def test_panels_zones_and_laundering(spark):
    ratings = [(1, "a", "veto"), (1, "b", "pass"), (2, "a", "flag"), (2, "b", "veto"), (2, "c", "pass"), (2, "d", "pass"), (3, "a", "anchor"), (3, "b", "pass"), (3, "c", "pass"), (4, "a", "pass"), (5, "a", None)]
    got = {r.i: (r.verdict, r.dissenters) for r in B.panel_vote(spark.createDataFrame(ratings, "i long, m string, r string"), "i", "m", "r").collect()}
    assert got == {1: ("veto", ["b"]), 2: ("flag", ["b", "c", "d"]), 3: ("anchor", ["b", "c"]), 4: ("pass", [])}
    flows = spark.createDataFrame([("a", "b", True), ("a", "b", None), ("b", "a", False)], "source string, target string, tainted boolean")
    allowed = spark.createDataFrame([("a", "b"), ("a", "b")], "source string, target string")
    assert sorted(map(tuple, B.zone_flow_stats(flows, allowed).collect())) == [("a", "b", 2, 1, True), ("b", "a", 1, 0, False)]
    records = [(1, "Unknown", ["wiki"]), (2, None, ["x", "official site"]), (3, "wiki anonymous", ["wiki"]), (4, "press", ["wiki"]), (5, "", ["x"]), (6, "", None)]
    assert sorted(r.content_id for r in B.detect_laundering(spark.createDataFrame(records, "content_id long, original string, sources array<string>")).collect()) == [1, 2]


@pytest.mark.parametrize("cooldown, blocks", [(3.0, 64), (0.7, 2), (50.0, 1), (0.1, 3)])
def test_cooldown_of_a_hot_rule_is_split_and_equals_the_loop(spark, cooldown, blocks):
    rng = random.Random(11)
    data = [("hot", round(rng.uniform(0, 400), 1)) for _ in range(2000)] + [("b", x / 10) for x in range(0, 300, 7)] + [("c", 5.0)] * 3 + [("d", 1000.0 * i) for i in range(5)]
    frame = spark.createDataFrame(data, "k string, t double").repartition(4)
    want = []
    for k in "hot", "b", "c", "d":
        last = -math.inf
        for t in sorted(t for kk, t in data if kk == k):
            if t - last >= cooldown:
                want.append((k, t))
                last = t
    assert sorted(map(tuple, metrics.alert_cooldown(frame, "k", "t", cooldown, blocks).collect())) == sorted(want)
    assert metrics.alert_cooldown(frame.limit(0), "k", "t", cooldown).count() == 0


def test_fact_writes_are_idempotent(spark, tmp_path):
    path, schema = f"file://{tmp_path}/store", "hash long, fact string"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    held = lambda: sorted(map(tuple, io.read_fact_table(spark, path, schema).collect()))
    assert held() == []
    first = batch((1, "a"), (2, "b"), (2, "b"), (None, "x"), (-5, "c"))
    assert not io.write_facts(first, path, "one", 4, stop_before_commit=True) and held() == []  # killed between write and commit
    assert io.write_facts(first, path, "one", 4) and held() == [(-5, "c"), (1, "a"), (2, "b")]
    assert not io.write_facts(first, path, "one", 4) and len(held()) == 3
    assert io.write_facts(batch((2, "b"), (3, "d")), path, "two", 4) and held() == [(-5, "c"), (1, "a"), (2, "b"), (3, "d")]
    assert io.write_facts(batch(), path, "three", 4) and len(held()) == 4


def test_trust_paths_equal_a_search(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(12), rng.randrange(12)): rng.choice([0.5, 0.6, 0.9]) for _ in range(30)} | {(3, 3): 1.0}
    got = {(r.root, r.node): (r.hops, r.trust, r.path) for r in kb.trust_path(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"), spark.createDataFrame([(i,) for i in range(12)], "node long")).collect()}
    want = {}
    for root in range(12):
        front = [(1.0, [root])]
        for hops in (1, 2, 3):
            front = [(t * w * (0.7 if hops > 1 else 1), [*p, b]) for t, p in front for (a, b), w in edges.items() if a == p[-1] and b not in p]
            for t, p in sorted(front, key=lambda x: (-x[0], x[1])):
                want.setdefault((root, p[-1]), (hops, round(t, 6), p))
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    for (root, node), (hops, trust, path) in got.items():
        assert path[0] == root and path[-1] == node and len(path) == hops + 1 == len(set(path))
        assert math.prod(edges[x] for x in zip(path, path[1:], strict=False)) * 0.7 ** (hops - 1) == pytest.approx(trust, abs=1e-6)
