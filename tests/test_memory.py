"""Memories against plain loops: vectors of text, recall, clusters, components, learned consensus."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.operators import memory

VECTORS = "id long, type string, vector array<double>, tags array<string>, importance double, age_days long, decay double"


def test_text_vectors_follow_the_published_hashes(spark):
    def signs(gram, dim=64, sparse=12):
        h = 2166136261
        for c in gram:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        out = {}
        for _ in range(sparse):
            h = (h * 1103515245 + 12345) % 2**31
            out[h % dim] = 1.0 if h >> 30 else -1.0
        return out

    texts = {1: "Ab c1", 2: "日本 é!", 3: "", 4: None, 5: "   ", 6: "Ab c1 Ab", 7: "x"}
    grams = {1: [" ab", "ab ", " c1", "c1 "], 2: ["日", "日本", "本", "本é", "é", "é!", "!"], 6: [" ab", "ab ", " c1", "c1 ", " ab", "ab "], 7: [" x "]}
    got = {}
    for r in memory.embed_text(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", "t", 64).collect():
        got.setdefault(r.k, {})[r.place] = r.value
    for k, own in grams.items():
        sums = {}
        for g in own:
            for place, s in signs(g).items():
                sums[place] = sums.get(place, 0) + s
        norm = math.sqrt(sum(v * v for v in sums.values()))
        assert got[k] == {p: round(v / norm, 6) for p, v in sums.items() if v}
    assert set(got) == set(grams)
    entries = memory.embed_text(spark.createDataFrame([(1, "Ab c1")], "k long, t string"), "k", "t", 64)
    dense = memory.dense_vectors(entries, "k", 64).head().vector
    assert len(dense) == 64 and sum(x * x for x in dense) == pytest.approx(1, abs=1e-4)


def rows(n, rng, dim=16, types=3):
    base = rng.normal(size=(n // 4, dim))
    out = [(i, str(i % types), (base[i % len(base)] + rng.normal(size=dim) * 0.35).tolist(), [f"t{i % 2}"], (i % 10) / 10, i % 30, 0.01) for i in range(n)]
    same = out[0][2]
    return out + [(n + i, "0", same, ["t0"], 0.5, 0, 0.01) for i in range(n // 2)] + [(9000, "0", [0.0] * dim, None, None, None, None), (9001, "0", None, None, 0.3, 1, 0.1), (None, "0", same, None, 0.3, 1, 0.1), (9002, None, same, [], 0.1, 2, 0.2), (9003, "1", [], ["t1"], 0.9, 1, 0.1)]


def unit(v, dim=16):
    x = np.zeros(dim)
    x[: len(v or [])] = v or []
    return x / np.linalg.norm(x) if np.linalg.norm(x) > 0 else x


@pytest.mark.parametrize("chunk", [3, 4096])
def test_recall_equals_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(memory, "CHUNK", chunk)
    data = rows(200, np.random.default_rng(1))
    frame = spark.createDataFrame(data, VECTORS).repartition(3)
    asked = [(0, data[0][2]), (5, data[5][2]), (-1, None), (-2, [0.0] * 16), (250, data[250][2]), (None, data[1][2])]
    got = memory.recall(spark.createDataFrame(asked, "query_id long, vector array<double>"), frame, k=4, tags=("t0",), least=0.1).collect()
    want = []
    for q, v in asked[:-1]:
        found = []
        for i, _, x, tags, importance, age, _ in data:
            if i is not None and i != q and tags and "t0" in tags and (importance or 0) >= 0.1:
                found.append((-math.floor((0.6 * float(unit(v) @ unit(x)) + 0.3 * importance + 0.1 / (1 + age)) * 1e6 + 0.5) / 1e6, i))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:4], 1)]
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == sorted(want)
    empty = spark.createDataFrame([], VECTORS)
    assert memory.recall(spark.createDataFrame([], "query_id long, vector array<double>"), frame).count() == 0 == memory.recall(spark.createDataFrame(asked, "query_id long, vector array<double>"), empty).count()


def close(data, least):
    own = [(i, t, unit(v)) for i, t, v, *_ in data if i is not None and t is not None and v is not None and any(v)]
    return {(min(a[0], b[0]), max(a[0], b[0])) for x, a in enumerate(own) for b in own[:x] if a[1] == b[1] and a[0] != b[0] and a[2] @ b[2] >= least}


def closure(ids, pairs):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_clusters_are_exact_where_a_type_fits_a_block(spark):
    data = rows(160, np.random.default_rng(2))
    frame = spark.createDataFrame(data, VECTORS).repartition(3)
    label = closure([d[0] for d in data if d[0] is not None], close(data, 0.6))
    got = {r.id: (r.cluster, r.n) for r in memory.cluster_memories(frame, 0.6).collect()}
    assert {i: c for i, (c, _) in got.items()} == label
    assert all(n == list(label.values()).count(c) for c, n in got.values())
    merged = {r.cluster: r for r in memory.merge_memories(frame, memory.cluster_memories(frame, 0.6)).collect()}
    assert sum(r.n for r in merged.values()) == len(label) and set(merged) == set(label.values())
    big = max(merged.values(), key=lambda r: r.n)
    own = [d for d in data if label.get(d[0]) == big.cluster]
    assert big.tags == sorted({t for d in own for t in d[3] or []}) and big.importance == pytest.approx(np.mean([0.5 if d[4] is None else d[4] for d in own]), abs=1e-3)


def test_buckets_find_the_wanted_share(spark):
    """Types larger than a block are dealt by signs: no false pair, and the wanted recall of the pairs there are."""
    data = rows(900, np.random.default_rng(3), types=1)
    frame = spark.createDataFrame(data, VECTORS).repartition(3)
    distinct = [d for d in data if d[0] is None or d[0] < 900 or d[0] >= 9000]
    want = close(distinct, 0.8)
    found = memory.similar_memories(frame, 0.8, 0.95, block=128)
    got = {(r.a, r.b) for r in found.where("b < 900").collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 500
    label = {r.id: r.cluster for r in memory.components(frame.where("id is not null").select("id"), found).collect()}
    assert {label[900 + i] for i in range(450)} == {label[0]}  # a third of the rows are one vector


def test_components_of_long_chains(spark):
    ids = list(range(400))
    edges = [(i, i + 1) for i in range(0, 299)] + [(300, 300), (350, 301)]
    got = {r.id: r.cluster for r in memory.components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i < 300 else 301 if i == 350 else i for i in ids}
    assert memory.components(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_consensus_equals_a_newton_fit(spark):
    rng = np.random.default_rng(4)
    names, votes, labels = ["a", "b", "c"], [], []
    for i in range(400):
        y = int(rng.random() < 0.5)
        labels.append((i, y))
        for c in names[: 2 + i % 2]:
            says = "contradicted" if rng.random() < (0.75 if y else 0.3) else "verified" if rng.random() < 0.7 else "uncertain"
            votes.append((i, c, says, float(rng.integers(1, 10)) / 10))
    features = memory.vote_features(spark.createDataFrame(votes, "k long, checker string, verdict string, confidence double"), "k", names)
    own = features.join(spark.createDataFrame(labels, "k long, y int"), "k")
    weights, bias = memory.fit_consensus(own, names, "y", 0.01)
    data = own.collect()
    x, y = np.array([[r.a, r.b, r.c, 1.0] for r in data]), np.array([r.y for r in data])
    w, ridge = np.zeros(4), np.diag([0.01, 0.01, 0.01, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
    assert [*weights, bias] == pytest.approx(w.tolist(), abs=1e-4)
    scored = memory.score_consensus(own, names, weights, bias).collect()
    assert [r.probability for r in scored] == pytest.approx([1 / (1 + math.exp(-(r.a * w[0] + r.b * w[1] + r.c * w[2] + w[3]))) for r in scored], abs=2e-4)
    assert np.mean([(r.probability > 0.5) == r.y for r in scored]) > 0.6


def test_forgetting(spark):
    frame = spark.createDataFrame([(1, 1.0, 0.1, 10), (2, 0.5, 0.5, 10), (3, None, 0.5, 1)], "id long, importance double, decay double, d long")
    got = {r.id: (r.importance_now, r.archived) for r in memory.apply_forgetting(frame, F.col("d")).collect()}
    assert got == {1: (round(math.exp(-1), 6), False), 2: (round(0.5 * math.exp(-5), 6), True), 3: (None, None)}


def test_exact_clusters_and_means_in_order(spark):
    """With recall_wanted 1 every pair is found however large a type is, and a mean at a rounding edge is that of the ids' order."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 8))
    frame = spark.createDataFrame([(i, "a", [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, type string, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.8))}
    assert {(r.a, r.b) for r in memory.similar_memories(frame, 0.8, 1, block=64).collect()} == want
    weights = [k % 100 / 100 for k in range(1, 41)]
    total = 0.0
    for w in weights:
        total += w
    rows = spark.createDataFrame([(i, 0, [], w, 0.1) for i, w in enumerate(weights)], "id long, type int, tags array<string>, importance double, decay double").repartition(7)
    clusters = rows.select("id", F.lit(0).cast("long").alias("cluster"))
    assert memory.merge_memories(rows, clusters).first().importance == pytest.approx(round(total / len(weights), 3), abs=1e-12)
