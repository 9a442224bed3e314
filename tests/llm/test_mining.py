"""Hard negatives, windows and ranked search against brute force, with null, empty, long, tied and repeated rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimforge.llm import ball_search, hard_negatives, windows

JSON = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<double>, label int, score string, anchor string"


def score(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=False))


def mined(rows):
    """Hard negatives by plain loops over the rows that take part."""
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = set()
    for a_id, a, a_label in {(r[0], tuple(r[1]), r[2]) for r in ok if r[0] % 100 == 0}:
        found = {(-score(a, r[1]), r[0], r[2]) for r in ok if r[0] != a_id}
        for p, p_id, _ in sorted(x for x in found if x[2] == a_label)[:5]:
            fits = sorted({x[:2] for x in found if x[2] != a_label and 80 * -p <= 100 * -x[0] <= 100 * -p})[:5]
            out |= {(a_id, p_id, k, n_id, -p, -n) for k, (n, n_id) in enumerate(fits, 1)}
    return out


def got(spark, rows, schema=VECTORS):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(3)
    return [tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def test_hard_negatives_equal_loops(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)  # several passes
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + rng.normal(size=8) * 0.05).tolist(), i % 3) for i in range(1000)]
    same = base[0].tolist()
    rows += [(i, same, i % 2) for i in range(1000, 1400)]  # one vector on a third of the rows: ties
    rows += [(1500, None, 1), (1600, [1.0, None] * 4, 1), (1601, [math.nan] * 8, 0), (1602, [math.inf] + [0.0] * 7, 0), (None, same, 1), (1700, same, None)]
    rows += [(1800, [], 1), (1801, [0.5, 0.5], 0), (1802, same + [3.0], 1), (1000, same, 0), (1000, same, 0), (1001, same, 1)]
    out = got(spark, rows)
    assert len(out) == len(set(out)) and set(out) == mined(rows) and len(out) > 100


def test_hard_negatives_of_large_and_negative_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 6)).tolist(), i % 2) for i in range(0, 2000, 10)]
    assert set(got(spark, rows)) == mined(rows)
    rows = [(0, [-1.0, -1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 0), (100, [0.0], 0), (101, [0.0], 1)]  # scores of 0 and below
    assert set(got(spark, rows)) == mined(rows)
    huge = [(0, [1e300], 1), (1, [1e300], 1), (2, [9e299], 0)]
    assert got(spark, huge) == [(0, 1, 1, 2, 2**63 - 2, 2**63 - 2)]
    for none in ([], [(1, [1.0], 0)], [(0, [1.0], 0)], [(0, None, None)]):
        assert got(spark, none) == []


@pytest.mark.parametrize("bits", [3, 12, 20, 30, 70])
def test_packed_scores_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = (np.array([[float(int(x)) for x in row] for row in rng.uniform(-(2.0**bits), 2.0**bits, (n, 7))]) for n in (9, 23))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert hard_negatives.packed_scores(a, b).tolist() == [[max(-(2**63) + 2, min(2**63 - 2, x)) for x in row] for row in want]
    top = np.full((2, 64), 2.0**bits - 1)
    assert hard_negatives.packed_scores(top, np.concatenate([top, -top]))[0].tolist() == [min(2**63 - 2, s * 64 * (2**bits - 1) ** 2) if s > 0 else max(-(2**63) + 2, -64 * (2**bits - 1) ** 2) for s in (1, 1, -1, -1)]


TEXTS = ["", None, "a  b\n\nc\td ", "it's 42 é 日本\n", "word " * 7000, "one two three", "one two three", "x" * 3000, *("the river runs to the sea " * k for k in range(60))]


def encoded():
    t = Tokenizer.from_file(JSON)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in TEXTS]


@pytest.mark.parametrize("capacity", [1024, 100, 1])
def test_windows_hold_every_id_once(spark, capacity):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, begin string, n_tokens long").repartition(5)
    stream = windows.encode_stream(docs, JSON)
    pieces, ids = windows.pack_windows(stream, capacity).collect(), encoded()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length and p.length > 0 and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    assert set(by_doc) == set(range(len(TEXTS)))
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    sizes, made = {}, {r.sequence_id: r.ids for r in windows.window_ids(stream, capacity).collect()}
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            assert made[s][at : at + p.length] == ids[p.doc_id][p.start : p.start + p.length].tolist()
            at += p.length
        sizes[s] = at
    assert {s: len(x) for s, x in made.items()} == sizes
    total = sum(map(len, ids))
    assert [sizes[s] for s in range(total // capacity)] == [capacity] * (total // capacity)
    rest = [sizes[s] for s in range(total // capacity, len(sizes))]
    assert sum(rest) == total % capacity and all(x & (x - 1) == 0 for x in rest) and len(set(rest)) == len(rest)


def test_windows_of_nothing_and_of_nulls(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert windows.concat_and_cut(docs, JSON).count() == 0
    assert windows.window_ids(windows.encode_stream(docs, JSON)).count() == 0
    rows = windows.concat_and_cut(spark.createDataFrame([(None, None)], "doc_id long, text string"), JSON).collect()
    assert [tuple(r) for r in rows] == [(None, 0, 1, zlib.crc32(bytes(4)), 1, 0, 0)]


def ranked(docs, items, k=20):
    """Ranked search by plain loops."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n_docs, length, df = len(own), sum(sum(c.values()) for _, c in own), Counter(t for _, c in own for t in c)
    out = set()
    for item, text in set(items):
        found = []
        for d, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out |= {(item, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:k], 1)}
    return out


def test_ranked_search_equals_loops(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(150)] + ["Été", "日本", "A1", "x_y", "don't"]
    chance = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=chance / chance.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(700)] + [(700 + i, "w1 w2 w3 same text for many") for i in range(350)]
    docs += [(2000, None), (2001, ""), (2002, " .\n\t!"), (2003, "w5 " * 30000), (None, "w1 w2 w3 same text for many"), (5, docs[5][1]), (2004, "ZZ\x00zz \x7fzz")]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(30)] + [(30, None), (31, ""), (32, "no such term at all"), (33, "same text for many"), (33, "same text for many"), (33, "ZZ zz w7 w7"), (34, docs[9][1])]
    want = ranked(docs, items)
    frames = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, n string, score long").repartition(3), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    assert {tuple(r) for r in ball_search.search_ranked(*frames).collect()} == want
    monkeypatch.setattr(ball_search, "BLOCK_TERMS", 40)  # several blocks of queries
    assert {tuple(r) for r in ball_search.search_ranked(*frames).collect()} == want
    for none in (frames[0].limit(0), frames[1]), (frames[0], frames[1].limit(0)), (frames[0].where("doc_id IN (2000, 2001)"), frames[1]):
        assert ball_search.search_ranked(*none).count() == 0


def test_bounds_hold_and_prune():
    """No row of a ball scores above its bound, and the search leaves most rows out."""
    rng = np.random.default_rng(2)
    width, topics = 400, [rng.choice(400, 12, replace=False) for _ in range(40)]
    rows = [np.unique(np.concatenate([rng.choice(topics[i % 40], 8), rng.choice(width, 2)])) for i in range(2000)]
    begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    data = ball_search.Rows(begins, np.concatenate(rows), rng.integers(1, 10**9, begins[-1]))
    tree, n_scored = ball_search.BallTree(data, np.arange(width) % 64), 0
    for _ in range(20):
        numbers, counts, query = rng.choice(topics[int(rng.integers(40))], 10, replace=False), rng.integers(1, 4, 10), np.zeros(width, np.int64)
        query[numbers] = counts
        scores = data.dot(query)
        for node, bound in enumerate(tree.bounds(numbers, counts)):
            assert scores[tree.order[tree.first[node] : tree.end[node]]].max() <= bound
        best = []
        n_scored += tree.search(numbers, counts, query, np.arange(2000), best, 20)
        assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:20]
    assert n_scored < 0.35 * 20 * 2000
