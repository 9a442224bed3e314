"""Dictionary matches and segmentation against plain loops."""

import random

from claimforge.operators import similarity


def test_matches_and_segments_equal_loops(spark):
    rng = random.Random(7)
    names = {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 5))) for _ in range(40)} | {"x", "New York"}
    texts = {i: "".join(rng.choice("abcé日 x") for _ in range(rng.randint(0, 60))) for i in range(60)} | {100: None, 101: "", 102: "x", 103: "New York" * 400, 104: "qqq"}
    frame, words = spark.createDataFrame(list(texts.items()), "k long, t string"), spark.createDataFrame([(n,) for n in [*names, *names, None, ""]], "name string")
    want = {(k, i, n) for k, t in texts.items() if t for i in range(len(t)) for n in range(1, 9) if i + n <= len(t) and t[i : i + n] in names}
    got = similarity.dictionary_matches(frame, words, "k", "t").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    tokens = {}
    for r in sorted(similarity.segment_max_match(frame, words, "k", "t").collect()):
        tokens.setdefault(r.k, []).append(r.token)
    for k, t in texts.items():
        out, at = [], 0
        while t and at < len(t):
            n = next((n for n in range(8, 0, -1) if t[at : at + n] in names and at + n <= len(t)), 1)
            out.append(t[at : at + n])
            at += n
        assert tokens.get(k, []) == out
    found = {}
    for r in similarity.match_entities(frame, words, "k", "t").collect():
        found.setdefault(r.k, []).append((r.start, r.name))
    for k, t in texts.items():
        taken = []
        for start, n in sorted(((i, n) for kk, i, n in want if kk == k and n >= 2), key=lambda x: (-x[1], x[0])):
            if all(start >= e or start + n <= s for s, e in taken):
                taken.append((start, start + n))
        assert sorted(found.get(k, [])) == sorted((s, t[s:e]) for s, e in taken)
    for one in ("x", "ab"):
        only = spark.createDataFrame([(one,)], "name string")
        assert {tuple(r) for r in similarity.dictionary_matches(frame, only, "k", "t").collect()} == {(k, i, len(one)) for k, t in texts.items() if t for i in range(len(t)) if t[i : i + len(one)] == one}
    assert similarity.segment_max_match(frame, words.limit(0), "k", "t").where("k = 104").count() == 3
