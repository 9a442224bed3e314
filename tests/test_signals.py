"""Signals about answers and requests against plain loops, with edge rows and hot keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claimforge.operators import sessions, signals


def grams(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


def test_prior_intensity_and_report(spark):
    turns = [("a", k, t) for k, t in enumerate(["He is always right", "He is always right", "", None, "It was founded here and never closed", "He is right", "certainly everyone must, always and never, without doubt"])]
    turns += [("b", 0, "He is always right")]
    got = {(r.s, r.t): r.prior for r in signals.prior_intensity(spark.createDataFrame(turns, "s string, t int, x string"), "s", "t", "x").collect()}
    for s, k, text in turns:
        x = text or ""
        before = [grams(v or "") for a, j, v in turns if a == s and k - 5 <= j < k]
        repeat = sum(len(grams(x) & b) for b in before) / max(len(grams(x)), 1) / max(len(before), 1)
        n = sum(w in x.lower() for w in signals.ABSOLUTE)
        verbs = sum(w in x.lower() for w in signals.FACTUAL)
        want = 0.5 + min(0.08 * n, 0.3) + min(15 * verbs / max(len(x), 1), 0.15) + min(0.15 * repeat, 0.15)
        assert got[s, k] == pytest.approx(min(want, 1), abs=2e-6)
    found = [("d", k, t, v, c) for k, (t, v, c) in enumerate([("It is always so", "contradicted", 0.9), ("It is so", "verified", 0.9), ("x", None, None)])] + [("e", 0, "always never certainly everyone must", "unverifiable", 0.0)]
    report = {r.s: r for r in signals.hallucination_report(spark.createDataFrame(found, "s string, t int, x string, v string, c double"), "s", "t", "x", "v", "c").collect()}
    assert report["d"].n == 3 and report["e"].level == "critical" and report["e"].n_critical == 1
    assert report["e"]["index"] == pytest.approx(0.8 - 0.05, abs=1e-6)


def test_sensory_precision(spark):
    rows = [("a", "contradicted", 0.8, "x"), ("a", "verified", 0.6, "y"), ("a", None, 0.5, None), ("b", "uncertain", None, "x"), (None, "contradicted", 1.0, "x")]
    got = {r.k: r.precision for r in signals.sensory_precision(spark.createDataFrame(rows, "k string, v string, c double, s string"), "k", "v", "c", "s").collect()}
    assert got["a"] == pytest.approx(0.6 * (0.8 + 0.3 + 0.05) / 3 + 0.3 * 0.8 + 0.15) and got["b"] == pytest.approx(0.05) and got[None] == pytest.approx(0.95)


def test_fact_chain(spark):
    chains = {"steal": (("audit", "config", "internal"), 0.6), "open": (("filter", "off"), 1.0)}
    rows = [("a", "The audit is due"), ("a", "A CONFIG file"), ("b", "audit config internal"), ("c", "filter"), ("c", None), ("c", "off"), ("d", "audit"), ("d", "off")]
    got = {r.k: (r.n_facts, r.chain, r.share) for r in signals.fact_chain(spark.createDataFrame(rows, "k string, x string"), "k", "x", chains).collect()}
    assert got == {"a": (2, "steal", 0.666667), "c": (3, "open", 1.0)}  # one fact alone is no chain


def test_infer_entity_type(spark):
    cases = [
        ("Ada was born in 1815 and wrote notes", "Ada", "person", 0.75), ("Lima lies in Peru, a capital city", "Lima", "place", 0.85), ("x " * 40 + "Ada" + " y" * 40 + " born in 1815", "Ada", "unknown", 0.2),
        ("The Zed company was founded 1901", "Zed", "organization", 0.75), ("no name", "Ada", "unknown", 0.0), ("pi goes on", "pi", "concept", 0.3), (None, "Ada", "unknown", 0.0), ("", "Ada", "unknown", 0.0),
    ]
    df = spark.createDataFrame([(k, t, n) for k, (t, n, _, _) in enumerate(cases)], "k int, x string, name string")
    got = {r.k: (r.kind, r.kind_confidence) for r in signals.infer_entity_type(df, "x", "name").collect()}
    assert got == {k: (kind, sure) for k, (_, _, kind, sure) in enumerate(cases)}


def test_score_importance(spark):
    rng = random.Random(4)
    words = "one two three four five six".split()
    rows = [(s, k, " ".join(rng.choices(words, k=rng.randrange(0, 4))), rng.choice(["bug", "system", "odd"])) for s in "ab" for k in range(25)] + [("c", 0, None, None)]
    got = {(r.s, r.t): r.importance for r in signals.score_importance(spark.createDataFrame(rows, "s string, t int, x string, kind string"), "s", "t", "x", "kind", F.lit(0.7)).collect()}
    sets = {(s, k): set((x or "").split()) for s, k, x, _ in rows}
    for s, k, _, kind in rows:
        before = [sets[s, j] for j in range(max(0, k - 10), k)]
        own = sets[s, k]
        n = sum(bool(own and b) and len(own & b) / len(own | b) > 0.3 for b in before)
        frequency = min(1, 0.3 + 0.15 * n) if before else 0.5
        assert got[s, k] == pytest.approx(0.4 * frequency + 0.3 * (0.7 if kind == "system" else 0.5) + 0.2 * signals.RELEVANCE.get(kind, 0.5) + 0.07, abs=6e-5)


def test_dedupe_memories(spark):
    rows = [("u", "same text" + "x" * 80 + "1", 5), ("u", " same text" + "x" * 80 + "2", 3), ("v", "same text", 1), (None, "same text", 9), (None, "same text", 9), ("u", "  ", 0), ("u", None, 0), ("u", "ab", 0)]
    got = {(r.c, r.head): (r.o, r.n_alike) for r in signals.dedupe_memories(spark.createDataFrame(rows, "c string, x string, o int"), "c", "x", "o").collect()}
    assert got == {("u", ("same text" + "x" * 80)[:80]): (3, 2), ("v", "same text"): (1, 1), ("", "same text"): (9, 2)}


def test_token_cache_stats(spark):
    usage = '{"a": 1, "usage": {"input_tokens": %d, "input_tokens_details": {"cached_tokens": %d}, "output_tokens": %d}, "z": {"y": 2}}'
    rows = [("m", "event: " + usage % (100, 40, 7)), ("m", usage % (50, 0, 3)), ("m", '"usage": {"input_tokens": 10}'), ("m", '"usage": {"input_tokens": }'), ("m", '"usage": {"input_tokens": 0}'), ("m", "none"), ("m", None), ("n", "")]
    got = {r.k: r for r in signals.token_cache_stats(spark.createDataFrame(rows, "k string, body string"), "k", "body").collect()}
    m = got["m"]
    assert (m.n_rows, m.n_usage, m.input_tokens, m.cached_tokens, m.output_tokens, m.n_hits, m.hit_rate, m.billed_input) == (7, 3, 160, 40, 10, 1, 0.25, 120)
    assert (got["n"].n_usage, got["n"].input_tokens, got["n"].hit_rate) == (0, 0, None)


def test_security_log_stats(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(9), rng.randrange(5), rng.choice([200, 403]), rng.random() * 100) for g, n in (("big", 3000), ("ten", 10), ("eleven", 11), ("one", 1), (None, 4)) for _ in range(n)]
    got = {r.g: r for r in signals.security_log_stats(spark.createDataFrame(rows, "g string, ip int, k int, s int, ms double").repartition(7), "g", "ip", "k", "s", "ms").collect()}
    for g in got:
        own = [r for r in rows if r[0] == g]
        times = sorted(r[4] for r in own)
        assert got[g].p95 == pytest.approx(times[int(len(times) * 0.95)] if len(times) > 10 else times[-1], abs=1e-6)
        assert (got[g].requests, got[g].addresses, got[g]["keys"]) == (len(own), len({r[1] for r in own}), len({r[2] for r in own}))
        assert got[g].statuses == ",".join(f"{s}:{n}" for s in (200, 403) if (n := sum(r[3] == s for r in own)))


@pytest.mark.parametrize("most, seconds, block, slab", [(3, 1.0, 60.0, 64), (1, 5.0, 5.0, 1), (5, 2.0, 7.0, 3)])
def test_rate_blocks(spark, most, seconds, block, slab):
    """A hot user with most of the rows in bursts, ties, quiet users: the same blocks as one pass over each user."""
    rng = random.Random(6)
    rows, t = [], 1000.0
    for k in range(3000):
        t += rng.choice([0, 0.125, 0.25, 0.5, 4, 30]) if rng.random() < 0.97 else 200
        rows.append(("hot", t, k))
    rows += [("quiet", 1000.0 + 90 * k, 5000 + k) for k in range(20)] + [("ties", 77.0, 6000 + k) for k in range(9)] + [(None, 1.0, 1), ("hot", None, 2)]
    want = set()
    for user in ("hot", "quiet", "ties"):
        until, recent = -1.0, []
        for at in sorted(x for u, x, _ in rows if u == user and x is not None):
            if at < until:
                continue
            recent = [x for x in recent if at - x < seconds] + [at]
            if len(recent) > most:
                until, recent = at + block, []
                want.add((user, at, until))
    frame = spark.createDataFrame(rows, "u string, t double, o long").repartition(5)
    assert {tuple(r) for r in signals.rate_blocks(frame, "u", "t", "o", most, seconds, block, slab).collect()} == want and len(want) > 10
    assert signals.rate_blocks(frame.limit(0), "u", "t", "o").count() == 0


def test_segments(spark):
    texts = {0: "One two. three\nfour; " + "w " * 45 + "end! tail", 1: "", 2: None, 3: "  \n ", 4: "a" * 5000, 5: "x " * 20 + "y", 6: "Wait... what? no"}

    def cut(text):
        out = []
        for line in (text or "").split("\n"):
            run = []
            for w in line.split():
                run.append(w)
                if len(run) == 20 or re.search(r"[.!?;]$", w):
                    out.append(" ".join(run))
                    run = []
            if run:
                out.append(" ".join(run))
        return out

    df = spark.createDataFrame(list(texts.items()), "k int, x string")
    got = {}
    for r in sorted(signals.segment_text(df, ["k"], "x").collect(), key=lambda r: (r.k, r.segment)):
        assert r.segment == len(got.setdefault(r.k, [])) and r.n_tokens == len(r.segment_text.split())
        got[r.k].append(r.segment_text)
    assert got == {k: cut(t) for k, t in texts.items() if cut(t)}
    line = texts[5] + " end. " + "z " * 41
    tokens = spark.createDataFrame([("s", i, w) for i, w in enumerate(line.split())], "s string, i int, w string")
    assert sorted(r.text for r in sessions.split_stream_segments(tokens, "s", "i", "w").collect()) == sorted(cut(line))
