"""The training-data operators against brute force on small tables with null, empty, long, tied and repeated rows."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimforge.llm import bpe, html_text, line_dup, media, near_dup, packing, pictures, pii, quality, sharding, token_files, tokens, words
from claimforge.llm import queries as llm_queries
from claimforge.llm.common import new_path

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
BASE = "The river runs from the high hills to the sea and many small towns stand along its banks where people fish and trade"
TEXTS = [BASE, BASE, BASE + " today", "", None, "a  b\n\nc\td ", "it's 42 é 日本 <|endoftext|>\n", "word " * 6000, "one two\nthree four five six\n" + BASE, "😀 tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(0, BASE, "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, shard long")


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(JSON)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in TEXTS]


def test_encoder_equals_the_library(ids):
    encoder = tokens.Encoder(JSON, most=500)
    for _ in range(2):
        assert encoder.encode(pa.array(TEXTS)) == [x[:-1].tobytes() for x in ids]
    library = Tokenizer.from_file(JSON)
    rng, parts = np.random.default_rng(4), ["a", "the", " ", " ", "\n", "\n", "\t", "'s", ".", "!", "é", "日本", "23", "<|endoftext|>", "\u00a0", "\r\n", "  ", "_"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(2000)]
    for plain in (False, True):
        library.encode_special_tokens = plain
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert tokens.Encoder(JSON, specials_as_text=plain).encode(pa.array(texts)) == want


def test_bpe_model_equals_tiktoken(spark, docs):
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_bpe(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].ids == own.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode_bpe(docs.limit(0), RANKS, public_tokenizers.PATTERN, digest=True).count() == 0


@pytest.mark.parametrize("ids", [np.zeros(0, "<u4"), np.arange(1000, dtype="<u4"), np.array([7] * 300 + [2**32 - 1], "<u4"), np.random.default_rng(1).integers(0, 50257, 5000).astype("<u4")])
def test_token_file_round_trip(ids):
    data = token_files.file_bytes([5, None], [len(ids) // 2, len(ids) - len(ids) // 2], ids, step=2)
    back = list(token_files.parse_file(data, step=3))
    assert [d for d, _ in back] == [5, None]
    assert (np.concatenate([x for _, x in back]) == ids).all()


def test_token_files(spark, docs, ids):
    path = new_path(spark, "files")
    manifest = token_files.write_token_files(docs, path, JSON, file_tokens=500)
    got = sorted(token_files.read_token_files(manifest, path, token_files.crc_of_ids, "ids_crc32 long").collect(), key=lambda r: r.start)
    order, start = [0, 0, *range(1, len(TEXTS))], 0
    assert [r.doc_id for r in got] == order
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens


def test_packing(spark, docs, ids):
    got = packing.pack_best_fit(docs, JSON).collect()
    bins = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) == sum(map(len, ids)) + len(ids[0])
    assert packing.pack_best_fit(docs.limit(0), JSON).count() == 0


def test_plan_is_as_good_as_item_by_item():
    rng = np.random.default_rng(2)
    histogram = dict(Counter(rng.integers(1, 60, 500).tolist()))
    used, place = defaultdict(int), defaultdict(list)
    for length, low, high, first, offset in packing.plan_best_fit(histogram, 100):
        for k in range(high - low):
            used[first + k] += length
            place[first + k].append((offset, length))
    assert max(used.values()) <= 100 and sum(used.values()) == sum(k * v for k, v in histogram.items())
    assert all(sum(n for _, n in own) == max(o + n for o, n in own) for own in place.values())
    bins: list[int] = []
    for length in sorted(Counter(histogram).elements(), reverse=True):
        fits = [(b, k) for k, b in enumerate(bins) if b >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(100 - length)
    assert len(used) <= len(bins)


def test_sharding(spark, docs):
    got = sorted(sharding.assign_shards(docs, 3).collect(), key=lambda r: (r.doc_id, r.shard, r.slot))
    assert [(r.size, r.text_crc32) for r in got] == [(16 + len((TEXTS[r.doc_id] or "").encode()), zlib.crc32((TEXTS[r.doc_id] or "").encode())) for r in got]
    assert [(r.shard, r.slot) for r in got] == sorted((r.shard, r.slot) for r in got)
    for own in (sorted(r.slot for r in got if r.shard == s) for s in range(3)):
        assert own == list(range(len(own)))
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def brute_stats(t):
    w = [x for x in t.encode().split()]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(inside)


def test_quality(spark, docs):
    junk = [(100 + i, f"Bad{i}### text$$$ with&&& signs%%% on*** all### of$$$ its&&& words%%% here***", "x", 0) for i in range(20)]
    fine = [(200 + i, f"{BASE} number {i} of the set", "x", 0) for i in range(200)]
    every = docs.unionByName(spark.createDataFrame(junk + fine, docs.schema))
    got = {r.doc_id: r for r in quality.score_quality(every).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_repeat_words) == brute_stats(t or "")
    assert not any(got[r[0]].kept for r in junk) and all(got[r[0]].kept for r in fine)
    assert got[7].base_failed and got[3].base_failed and got[4].base_failed
    kept = quality.filter_quality(every)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *(d for d, r in got.items() if r.kept)]) and kept.columns == docs.columns
    assert quality.score_quality(docs.limit(0)).count() == 0 and quality.filter_quality(docs.limit(0)).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home, page</a></nav>
<div class="cookie-notice">We use cookies, really, all of them, always.</div><div id="main"><article><h1>Head &amp; line</h1><p>First para,   with&nbsp;commas,
and <b>bold</b> text.<p>Second one<br>broken.<div class="ad">Buy, now, here</div><script>var x="</p>";</script><ul><li>item one<li>item two</ul></article>
<div class="comments"><p>Nice, very nice, thanks, bye</p></div></div><aside>side</aside><form><p>a, b, c</p></form><footer>&copy; x</footer>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE).split("\n\n") == ["Head & line", "First para, with commas, and bold text.", "Second one broken.", "item one", "item two"]
    assert html_text.main_text("<body><div><p>Only a short one.</p></div><div class=sidebar>x</div></body>") == "Only a short one."
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2), (3, "u", "", 3), (4, "u", "<", 4)], "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html_text.extract_main_text(pages).collect()}
    assert got[2].text == "" and got[3].n_chars == 0 and got[1].n_chars == len(got[1].text)


def copies(most=5, groups=12):
    rng = np.random.default_rng(5)
    pool = [f"w{k}" for k in range(4000)]
    out = {}
    for g in range(groups):
        base = rng.choice(pool, 80).tolist()
        for k in range(most):
            own = list(base)
            for at in rng.integers(0, 80, k):
                own[at] = f"x{rng.integers(1e9)}"
            out[g * 10 + k] = " ".join(own)
    return out


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def linked(a, b, least=0.8):
    """Whether two texts are copies, said in the plainest way."""
    x, y = a.encode().split(), b.encode().split()
    return a == b or bool(x and y) and min(len(x), len(y)) >= least * max(len(x), len(y)) and plain_lcs(x, y) >= least * max(len(x), len(y)) - 1e-9


def brute_classes(texts):
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if top(a) != top(b) and linked(texts[a] or "", texts[b] or ""):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rng = np.random.default_rng(9)
    texts = copies(9) | {500: "", 501: None, 502: "short", 503: "short", 504: BASE, 505: BASE + " today", 506: " \n"}
    # documents that share a passage and little else, some of them copies of each other
    for k in range(30):
        own = " ".join(f"q{x}" for x in rng.integers(0, 10**6, 50))
        texts |= {600 + 2 * k: f"{own} {passage}", 601 + 2 * k: f"{own} {passage} and more" if k % 3 == 0 else f"{passage} {own[::-1]}"}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()] + [(504, BASE, 1, 2), (None, BASE, 3, 4)], "doc_id long, text string, key int, doc int")
    want = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(df).collect()}
    assert got == want | {None: want[504]}
    kept = near_dup.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == df.columns
    assert near_dup.near_duplicate_classes(df.limit(0)).count() == 0 and near_dup.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def edited():
    """Copies of one text, some edited so much that they are hardly alike, behind a passage that they share."""
    rng, base, passage = np.random.default_rng(12), [f"b{k}" for k in range(150)], [f"p{k}" for k in range(40)]
    texts = {}
    for i in range(90):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(8, 60)), replace=False):
            own[at] = f"e{rng.integers(10**6)}"
        texts[i] = " ".join(passage + own if i % 3 else own)
    return texts


@pytest.mark.parametrize("crowd", [4096, 12])
def test_near_duplicates_in_large_buckets_equal_brute_force(spark, monkeypatch, edited, crowd):
    """In buckets that are compared in tasks and in those that are dealt to chunks and joined; few other pairs are made."""
    monkeypatch.setattr(near_dup, "CROWD", crowd, raising=False)
    made, verified = [], near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda pairs, *a, **b: (made.append(pairs.count()), verified(pairs, *a, **b))[1])
    df = spark.createDataFrame(list(edited.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(df).collect()}
    found = words.batch_words(pa.array(list(edited.values())))
    sketches, ends = near_dup.order_sketches(found, 32, 2), np.searchsorted(found.text, np.arange(91))
    want, fit = {i: i for i in edited}, 0  # the smallest text of each class
    for i, j in itertools.combinations(edited, 2):
        x, y = (found.hashes[ends[k] : ends[k + 1]] for k in (i, j))
        fit += (Counter(x.tolist()) & Counter(y.tolist())).total() >= 0.8 * max(len(x), len(y))
        if (sketches[i] == sketches[j]).any() and near_dup.alignment_similarity(x, y, 0.8):
            low, high = sorted((want[i], want[j]))
            want = {k: low if v == high else v for k, v in want.items()}
    assert got == want
    assert sum(made) <= fit, (made, fit)


def test_open_pairs_equal_brute_force(monkeypatch, edited):
    monkeypatch.setattr(near_dup, "CELLS", 4096)
    found = words.batch_words(pa.array(list(edited.values())))
    mark, n, part = near_dup.word_marks(found).view(np.uint64), np.bincount(found.text), np.arange(90) % 7
    want = {}
    for i, j in itertools.combinations(range(90), 2):
        differ = sum(int(x).bit_count() for x in mark[i] ^ mark[j])
        if part[i] != part[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-6 and differ <= n[i] + n[j] - 1.6 * max(n[i], n[j]) + 2e-6:
            want[i, j] = differ
    got = [(a, b, d) for x in near_dup.open_pairs(part, n, mark, 0.8) for a, b, d in zip(*map(np.ndarray.tolist, x), strict=True)]
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want and want
    assert not list(near_dup.open_pairs(part[:0], n[:0], mark[:0], 0.8))


def test_alignment_equals_plain_lcs():
    a = np.arange(100, dtype=np.uint64)
    assert near_dup.alignment_similarity(a, a, 0.8) == 1
    assert near_dup.alignment_similarity(a, np.concatenate([a[50:], a[:50]]), 0.8) == 0
    assert near_dup.alignment_similarity(a, np.concatenate([a[:45], a[55:]]), 0.8) == pytest.approx(0.9)
    rng = np.random.default_rng(7)
    for _ in range(400):
        x = rng.integers(0, rng.integers(2, 40), rng.integers(1, 60)).astype(np.uint64)
        y = x.copy()
        for _ in range(rng.integers(0, 12)):
            at = rng.integers(0, max(1, len(y)))
            y = [np.delete(y, at), np.insert(y, at, rng.integers(0, 40)), np.concatenate([y[at:], y[:at]])][rng.integers(0, 3)] if len(y) > 1 else y
        share = plain_lcs(x.tolist(), y.tolist()) / max(len(x), len(y))
        got = near_dup.alignment_similarity(x, y, 0.8)
        assert got == (pytest.approx(share) if share >= 0.8 - 1e-9 else 0)


def test_order_sketches_find_edited_copies():
    """Random one-word edits: of pairs at 0.9 at least 0.97 share a sketch; texts of few words have one as well."""
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(200):
        a = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        b = list(a)
        for at in rng.choice(200, 20, replace=False):
            b[at] = f"y{rng.integers(10**6)}"
        s = near_dup.order_sketches(words.batch_words(pa.array([" ".join(a), " ".join(b)])), 32, 2)
        met += (s[0] == s[1]).any()
    assert met >= 194
    few = near_dup.order_sketches(words.batch_words(pa.array(["one", "one", "one two three", None])), 4, 2)
    assert (few[0] == few[1]).all() and (few[0] != few[2]).all() and not few[3].any()


def test_words_equal_split():
    rng, parts = np.random.default_rng(1), ["a", "b", " ", "\n", "\t", "é", "x" * 300, "日", "\r", "\x0b", ""]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(500)] + [None, "", "z" * 700_000 + " z " + "ab " * 200_000]
    got, known, k, lines = words.batch_words(pa.array(texts)), {}, 0, 0
    for i, t in enumerate(texts):
        assert got.first_line[i] == lines
        for line in (t or "").encode().split(b"\n"):
            for w in line.split():
                assert (got.text[k], got.line[k]) == (i, lines) and known.setdefault(w, got.hashes[k]) == got.hashes[k]
                k += 1
            lines += 1
    assert k == len(got.hashes) and len(set(known.values())) == len(known)


def test_repeated_lines_equal_brute_force(spark):
    lines = [*(f"{t}" for t in copies().values()), "a b c d e f g h i j", "j i h g f e d c b a", "short line", "short line", ""]
    texts = {i: "\n".join(lines[i::7]) for i in range(7)} | {7: None, 8: "", 9: lines[3] + "\n" + BASE}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, line int")
    seen, want = [], {}
    for i in sorted(texts):
        for k, x in enumerate((texts[i] or "").split("\n")):
            w = set(x.split())
            if len(w) >= 5:
                match = next((at for at, v in seen if len(w & v) >= 0.8 * len(w | v) - 1e-9), None)
                if match:
                    want[i, k] = match
                seen.append(((i, k), w))
    got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line) for r in line_dup.repeated_lines(df, min_words=5).collect()}
    assert got.keys() == want.keys() and all(m < at for at, m in got.items())
    kept = {r.doc_id: r.text for r in line_dup.drop_repeated_lines(df, min_words=5).collect()}
    assert kept[7] is None and kept[8] == "" and kept[9] == BASE
    assert line_dup.repeated_lines(df.limit(0)).count() == 0


def test_short_repeated_lines_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pool = [f"w{k}" for k in range(7)]
    lines = [" ".join(rng.choice(pool, rng.integers(0, 9))) for _ in range(300)] + ["short line", "line short", "x", "x", "", "a b c d", "a b c d e", "a b c", BASE, BASE]
    texts = {i: "\n".join(lines[i::6]) for i in range(6)} | {6: None, 7: "", 8: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for least in (0.8, 0.5):
        seen, want = [], set()
        for i in sorted(texts):
            for k, x in enumerate((texts[i] or "").split("\n")):
                if w := set(x.split()):
                    if any(len(w & v) >= least * len(w | v) - 1e-9 for v in seen):
                        want.add((i, k))
                    seen.append(w)
        got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line) for r in line_dup.repeated_lines(df, least=least, min_words=1).collect()}
        assert got.keys() == want and all(m < at for at, m in got.items())
    monkeypatch.setattr(llm_queries, "_table", lambda *_: df)
    query = {(r.doc_id, r.line) for r in llm_queries.op10_line_dedup(spark, "").collect()}
    assert {(8, 0)} < query  # lines of one word are in the query's result
    assert 8 not in {r.doc_id for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}


def test_crowded_lines_equal_brute_force(spark):
    """Words that more lines share than are compared at once: variants of one line, and lines alike in a few words only."""
    rng = np.random.default_rng(6)
    base = [f"b{k}" for k in range(20)]
    lines = []
    for k in range(160):
        own = list(base)
        for at in rng.integers(0, 20, rng.integers(0, 5)):
            own[at] = f"x{rng.integers(200)}"
        lines.append(" ".join(own))
    lines += [" ".join(["shared", "pair", *(f"r{x}" for x in rng.integers(0, 40, 4))]) for _ in range(160)]
    rng.shuffle(lines)
    texts = {i - 1: "\n".join(lines[i::9]) for i in range(9)}
    df = spark.createDataFrame([(i if i >= 0 else None, t) for i, t in texts.items()], "doc_id long, text string")
    seen, want = [], set()
    for i in sorted(texts):
        for k, x in enumerate(texts[i].split("\n")):
            w = set(x.split())
            if any(len(w & v) >= 0.8 * len(w | v) - 1e-9 for v in seen):
                want.add((i if i >= 0 else None, k))
            seen.append(w)
    assert {(r.doc_id, r.line) for r in line_dup.repeated_lines(df).collect()} == want


def test_pii(spark):
    text = "Mail a.b@mail.example.com or call +1 (243) 555-5526. Card 4111 1111 1111 1111, not 4111111111111112x; ip 10.0.0.1 and 10.0.0.999"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "a.b@mail.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (243) 555-5526")]
    df = spark.createDataFrame([(i, f"{text} again 243-555-5526 and {i}", 1) for i in range(40)] + [(90, "plain 12 words", 1), (91, None, 1), (92, "", 1)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((got[i].spans, got[i].base_sha256) == ("", empty) for i in (90, 91, 92))
    assert got[0].n_phone == 1 and got[0].spans.count("phone") >= 1
    assert "a.b@mail" not in pii.redact_pii(df).where("doc_id = 3").first().text
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_base_equals_the_patterns():
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    digits = lambda x: "".join(c for c in x if c in "0123456789")
    good = [
        lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), lambda x: 13 <= len(digits(x)) <= 19 and pii.luhn(digits(x)), lambda x: 9 <= len(digits(x)) <= 15,
    ]
    rng, parts = np.random.default_rng(12), ["a", "b.c", "@", "x.org", ".", "-", " ", "+", "1", "42", "255", "4111 1111 1111 1111", "10.0.0.1", "(", ")", "é", "\n", "+1 243 555 5526"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        want = sorted((k, m.start(), m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if good[k](m[0]))
        assert sorted(pii.base_spans(text)) == want, text


def test_field_marginals_equal_enumeration():
    """On chains and trees of skip links message passing is exact; entities found by the patterns are observed."""
    rng, n = np.random.default_rng(13), len(pii.LABELS)
    for same, labels in (([], [-1, -1, -1]), ([(0, 1)], [2, -1]), ([], [-1, 3, -1, -1])):
        count = len(labels)
        field = pii.Field(rng.normal(0, 1, (pii.N_FEATURES, n)), rng.normal(0, 1, (n, n)), np.array([2.0, 1.0]))
        u = pii.Units([(k, k + 1) for k in range(count)], labels, rng.integers(1, 2**pii.N_FEATURES, count).tolist(), same, [])
        own = pii._bits(u.features) @ field.unary
        total = np.zeros((count, n))
        for x in itertools.product(range(n), repeat=count):
            if all(k < 0 or k == y for k, y in zip(labels, x)):
                score = sum(own[i, y] if labels[i] < 0 else 0 for i, y in enumerate(x)) + sum(field.chain[x[i], x[i + 1]] for i in range(count - 1)) + sum(field.skip[0] * (x[a] == x[b]) for a, b in same)
                for i, y in enumerate(x):
                    total[i, y] += np.exp(score)
        want = total / total.sum(1, keepdims=True)
        assert np.abs(pii.marginals(u, field, rounds=60) - want).max() < (1e-4 if not same else 0.2)


def test_long_and_broken_texts_take_seconds():
    field, began = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), np.array([3.0, 2.0])), time.process_time()
    for text in ("A1" * 500_000, "a@" * 300_000, "1 " * 300_000, "+1(" * 200_000, "1." * 300_000, "a@b.cd 10.0.0.1 " + "x9" * 400_000):
        pii.find_spans(text, field)
    for page in ("<a " * 100_000, "<div>" * 100_000 + "x, y", "<b>" * 50_000 + "</i>" * 50_000, '<a "' * 100_000, "<p>a, b" * 50_000, "<!--" * 100_000, "<table><td>" + "<div>" * 50_000):
        html_text.main_text(page)
    assert time.process_time() - began < 90


def test_articles_stay_inside_named_containers():
    body = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i}, with commas, and enough words to be read as text.</p>" for i in range(5))
    for own in ('<div id="page" class="site has-sidebar">%s</div>', '<div class="entry no-comments">%s</div>', '<div class="share-of-mind story">%s</div>'):
        text = html_text.main_text(f"<body><div class='main-menu'><a href=/>home</a></div>{own % body}<div class='comments'>{'<p>Readers say, long and often.</p>' * 50}</div></body>")
        assert text.startswith("Title\n\nParagraph 0,") and text.count("Paragraph") == 5 and "Readers" not in text and "home" not in text


def test_media(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist()) for i in range(30)] + [(31, None)], "vec_id long, embedding array<double>")
    table = pictures.media_table(vectors, every=10)
    table = table.unionByName(spark.createDataFrame([(99, b"broken", False), (98, None, False)], table.schema)).withColumn("key", F.lit(1))
    found = media.find_copies(table.where("not is_edited"), table.where("is_edited")).collect()
    assert {(-1 - r.query_id, r.media_id) for r in found} == {(0, 0), (10, 10), (20, 20)}


def test_hamming_tables_are_complete():
    rng = np.random.default_rng(4)
    v = rng.integers(-(2**31), 2**31, (300, media.WORDS)).astype("<i4")
    w = v[rng.integers(0, 300, 500)].copy()
    for k in range(500):
        for bit in rng.integers(0, media.BITS, rng.integers(0, 30)):
            w[k, bit // 32] ^= np.int32(np.uint32(1 << (bit % 32)).view(np.int32))
    differ = np.bitwise_count((v[:, None, :] ^ w[None]).view(np.uint32)).sum(2)
    for far in (3, 15, 20):
        got = {(i, j) for a, b in media.hamming_pairs(v, w, far) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(differ <= far)), strict=True))


def test_media_equals_brute_force_with_stronger_edits(spark):
    rng = np.random.default_rng(11)
    drawn = [pictures.draw(rng.normal(0, 1, 8).tolist()) for _ in range(33)]
    mosaic = np.vstack([np.hstack(drawn[24 + 3 * k : 27 + 3 * k]) for k in range(3)])  # nine times the area of the others
    images = {i: g for i, g in enumerate(drawn[:24])} | {50: mosaic}
    edits = {i: g + rng.normal(0, 9, g.shape) for i, g in enumerate(drawn[:20])} | {20 + k: np.rot90(drawn[20 + k], k + 1) for k in range(3)} | {50: mosaic[100:200, 100:200]}
    media_rows, query_rows = ([(i, media.encode_pgm(g)) for i, g in x.items()] for x in (images, edits))
    described = [{i: media.describe(media.decode_netpbm(b)) for i, b in rows} for rows in (media_rows, query_rows)]
    near = lambda v, w: (np.bitwise_count((v[:, None, :] ^ w[None]).view(np.uint32)).sum(2) <= 15).any(1).sum()
    want = {(i, j): media.agreement(p, v, q, w, 30) for i, (p, v) in described[1].items() for j, (q, w) in described[0].items() if i != j and near(v, w) >= 2}
    want = {k: n for k, n in want.items() if n >= 6}
    schema = "media_id long, image binary"
    table, asked = spark.createDataFrame(media_rows, schema), spark.createDataFrame([(-1 - i, b) for i, b in query_rows], schema)
    got = {(-1 - r.query_id, r.media_id): r.n_agree for r in media.find_copies(table, asked).collect()}
    assert {k: n for k, n in got.items() if k[0] != k[1]} == want
    assert all((i, i) in got and got[i, i] == media.agreement(*described[1][i], *described[0][i], 30) for i in edits)


def test_media_recall_on_planted_copies(spark):
    """At least 95 of 100 edited copies are found among pictures, and no other pair."""
    rng = np.random.default_rng(12)
    vectors = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist()) for i in range(100)], "vec_id long, embedding array<double>")
    table = pictures.media_table(vectors, every=1)
    found = {(-1 - r.query_id, r.media_id) for r in media.find_copies(table.where("not is_edited"), table.where("is_edited")).collect()}
    assert all(i == j for i, j in found) and len(found) >= 95
    assert media.find_copies(table.limit(0), table.where("is_edited")).count() == media.find_copies(table, table.limit(0)).count() == 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """All stages in order on a small table with nulls, empty, long, tied and repeated rows and columns of clashing names."""
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    shared = prose(14)
    texts = {i: f"{prose(30)}\n{prose(25)}" for i in range(40)}
    texts |= {40: texts[3], 41: texts[4].replace("w", "w", 1) + " tail", 42: None, 43: "", 44: "too short", 45: "same " * 400}
    texts |= {46: f"{prose(20)}\n{shared}", 47: f"{shared} x\n{prose(20)}", 48: shared, 49: f"{prose(12)} mail a.b@mail.example.org or call +1 243 555 5526 {prose(12)}"}
    texts |= {50: " ".join(texts[5].split()[:52] + ["other"] * 3), 51: prose(9000), None: prose(40)}
    rows = [(i, t, "x", i or 0, 1, "r") for i, t in texts.items()] + [(7, texts[7], "x", 7, 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, key int, row string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, docs, "").collect())
    assert not any(d in (42, 43, 44, 45) for d, _ in kept) and sum(kept.values()) == len(rows) - 4  # base rules; clean texts stay

    def stage(frame, name):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    own = stage(corpus_pipeline.keep_quality(spark, docs, ""), "1")
    seen, want = [], Counter()
    order = sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0))
    for d, text in order:
        lines = []
        for x in text.split("\n"):
            w = set(x.split())
            if not any(len(w & v) >= 0.8 * len(w | v) - 1e-9 for v in seen):
                lines.append(x)
            seen.append(w)
        if lines:
            want["\n".join(lines), d] += kept[d, text]
    own = stage(corpus_pipeline.dedup_lines(spark, own, ""), "2")
    assert Counter((r.text, r.doc_id) for r in own.collect()) == want and own.columns == docs.columns

    left = {d: t for t, d in want}
    numbered = {(10**9 if d is None else d): t for d, t in left.items()}
    classes = brute_classes(numbered)
    own = stage(corpus_pipeline.drop_near_duplicates(spark, own, ""), "3")
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in own.collect()) == sorted(set(classes.values())) and own.columns == docs.columns

    own = stage(corpus_pipeline.redact(spark, own, ""), "4")
    after = {r.doc_id: r.text for r in own.collect()}
    assert own.columns == docs.columns and after[49] == left[49].replace("a.b@mail.example.org", "[EMAIL]").replace("+1 243 555 5526", "[PHONE]")
    assert all(after[d] == left[d] for d in after if d != 49)

    library, bins, total = Tokenizer.from_file(JSON), defaultdict(list), 0
    for r in corpus_pipeline.pack(spark, own, "").collect():
        ids = np.array([*library.encode(after[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in after.values())
    for pieces in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, "").count() == 0


def test_pipeline_stages_use_small_batches(spark, docs):
    """A Python worker gets BATCH rows at once; a lower number that was set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for was, want in (("10000", 1000), ("0", 1000), ("70", 70)):
        for _, f in corpus_pipeline.STAGES[:1]:
            spark.conf.set(key, was)
            f(spark, docs, "")
            assert int(spark.conf.get(key)) == want
    spark.conf.unset(key)


def test_shards_are_cut_by_bytes(spark):
    """Cuts stand where running sizes pass equal targets, so sizes are equal but for a document."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 900, 700))], "doc_id long, text string")
    got = sorted(sharding.assign_shards(df, 7).collect(), key=lambda r: r.doc_id)
    total, before, sizes = sum(r.size for r in got), 0, Counter()
    for r in got:
        sizes[r.shard] += r.size
        assert r.shard in ((before * 7) // total, ((before + r.size - 1) * 7) // total)
        before += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got) and len(sizes) == 7


def test_shards_are_written_whole(spark, docs, tmp_path):
    given = sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    text = lambda x: (x or "")
    assert Counter((r.doc_id, zlib.crc32(text(r.text).encode()), r.shard) for r in back.collect()) == Counter((r.doc_id, r.text_crc32, r.shard) for r in given.collect())


def test_quality_em_separates_planted_kinds():
    """Junk with one bad sign or several is found, whatever the rules that see it; clean patterns stay."""
    n = len(quality.RULES)
    all_good = sum(quality.GOOD * 3**k for k in range(n))
    one_bad = [all_good + (quality.BAD - quality.GOOD) * 3**k for k in range(5)]
    several = all_good + sum((quality.BAD - quality.GOOD) * 3**k for k in range(3))
    q = quality.fit_posteriors({all_good: 10_000, several: 200} | dict.fromkeys(one_bad, 500))
    assert q[all_good] > 0.9 and q[several] < 0.1 and all(q[c] < 0.5 for c in one_bad)
