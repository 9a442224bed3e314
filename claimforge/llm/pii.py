"""Personal data: exact patterns, and a skip-chain conditional random field that carries labels to repeated tokens."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents that are looked at for each one of the sample, since not every one with a cue has a token.
OVER = 8
Span = tuple[int, int, int]  # place in KINDS, start, end

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What can be a node of the field besides a found entity: a token with an at sign, or elsewhere a run of digits with separators.
TOKEN = re.compile(r"\S+")
DIGITS = re.compile(r"\+?\(?[0-9](?:[ ().\-]{0,2}[0-9])*")
CUE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and not overlapping inside a kind; failing ones are dropped without a retry."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass
class Units:
    """Nodes of a document's field in text order: spans, labels (-1 unknown: not a found entity), features, skip links."""

    spans: list[tuple[int, int]]
    labels: list[int]
    features: list[int]
    same: list[tuple[int, int]]
    near: list[tuple[int, int]]


N_FEATURES = 16


def _features(text: str, start: int, end: int) -> int:
    """A bit for each property of a token's shape and place."""
    own = text[start:end]
    digits = sum(c.isdigit() for c in own)
    parts = own.split(".")
    flags = (
        True, "@" in own, "@" in own and "." in own.rpartition("@")[2], own.startswith("+"), "(" in own, " " in own, "-" in own,
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts), digits < 7, 7 <= digits < 9, 9 <= digits < 13, 13 <= digits < 16,
        16 <= digits < 20, digits > 19, 13 <= digits <= 19 and luhn("".join(c for c in own if c in "0123456789")),
        text[start - 1 : start].isalnum() or text[end : end + 1].isalnum(),
    )
    return sum(1 << k for k, x in enumerate(flags) if x)


def _digits(own: str) -> str:
    return "".join(c for c in own if c in "0123456789")


def _unit_places(text: str) -> Iterator[tuple[int, int]]:
    """Places of tokens with an at sign and of runs of digits between them, in one pass whatever the text."""
    at = 0
    for m in TOKEN.finditer(text) if "@" in text else ():
        if "@" in m[0]:
            yield from (d.span() for d in DIGITS.finditer(text, at, m.start()))
            yield m.span()
            at = m.end()
    yield from (d.span() for d in DIGITS.finditer(text, at))


def find_units(text: str, base: list[Span]) -> Units:
    taken = sorted((s, e, k) for k, s, e in base)
    spans, at = [(s, e, k + 1) for s, e, k in taken], 0
    for start, end in _unit_places(text):
        end = start + len(text[start:end].rstrip(".,;:!?()\"'-"))
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if end > start and not any(s < end and start < e for s, e, _ in taken[at : at + 4]):
            spans.append((start, end, -1))
    spans.sort()
    keys: dict[str, list[int]] = defaultdict(list)
    like: dict[str, list[int]] = defaultdict(list)
    for i, (start, end, _) in enumerate(spans):
        own = text[start:end]
        if "@" in own:
            keys[own.lower()].append(i)
            like[own.lower().partition("@")[0]].append(i)
        elif len(digits := _digits(own)) >= 7:
            keys[digits].append(i)
            like[f"tail {digits[-7:]}"].append(i)
            if 9 <= len(digits) <= 19:  # equal but for one digit
                for k in range(len(digits)):
                    like[f"{digits[:k]}*{digits[k + 1 :]}"].append(i)
    pairs = lambda groups: sorted({(a, b) for x in groups.values() for a, b in zip(x, x[1:], strict=False) if a != b})
    same = pairs(keys)
    return Units([(s, e) for s, e, _ in spans], [k for _, _, k in spans], [_features(text, s, e) for s, e, _ in spans], same, sorted(set(pairs(like)) - set(same)))


@dataclass
class Field:
    """Weights of the field: features by label, neighbours by label and label, and agreement across the two skip links."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray  # same token, similar token


def _bits(features: list[int]) -> np.ndarray:
    return (np.array(features, np.int64)[:, None] >> np.arange(N_FEATURES) & 1).astype(float)


def fit_field(sample: list[Units], rounds: int = 300, rate: float = 0.5) -> Field:
    """Pseudo-likelihood fit on found entities (a token that is none has the label `other`).

    Tokens with skip links are seen a second time without their telling features, so that the field learns how far a
    linked token's label carries. Weights shrink to priors: 0, and for agreement 3 (same token) and 2 (similar token).
    """
    n = len(LABELS)
    field = Field(np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.array([3.0, 2.0]))
    x, y, left, right, same, near = [], [], [], [], [], []
    for u in sample:
        if not u.spans:
            continue
        own = np.maximum(u.labels, 0)
        hot = np.eye(n)[own]
        bits, zero = _bits(u.features), np.zeros((1, n))
        by = []
        for links in (u.same, u.near):
            m = np.zeros((len(own), n))
            for a, b in links:
                m[a] += hot[b]
                m[b] += hot[a]
            by.append(m)
        linked = (by[0].sum(1) + by[1].sum(1)) > 0
        plain = bits[linked].copy()
        plain[:, 1:] = 0
        for whole, part in ((x, [bits, plain]), (y, [hot, hot[linked]]), (left, [v := np.vstack([zero, hot[:-1]]), v[linked]]), (right, [v := np.vstack([hot[1:], zero]), v[linked]]), (same, [by[0], by[0][linked]]), (near, [by[1], by[1][linked]])):
            whole += part
    if not x:
        return field
    x, y, left, right, same, near = map(np.vstack, (x, y, left, right, same, near))
    for _ in range(rounds):
        score = x @ field.unary + left @ field.chain + right @ field.chain.T + field.skip[0] * same + field.skip[1] * near
        p = np.exp(score - score.max(1, keepdims=True))
        off = (y - p / p.sum(1, keepdims=True)) / len(y)
        field.unary += rate * (x.T @ off - 1e-4 * field.unary)
        field.chain += rate * (left.T @ off + (right.T @ off).T - 1e-3 * field.chain)
        field.skip += rate * (np.array([(same * off).sum(), (near * off).sum()]) - 1e-2 * (field.skip - [3.0, 2.0]))
    return field


def marginals(u: Units, field: Field, rounds: int = 10, damping: float = 0.5) -> np.ndarray:
    """Loopy sum-product over neighbours and skip links: label probabilities of every token. Found entities are observed."""
    n, count = len(LABELS), len(u.spans)
    own = _bits(u.features) @ field.unary
    seen = np.array(u.labels) > 0
    own[seen] = np.where(np.eye(n)[np.array(u.labels)[seen]] > 0, 0.0, -30.0)
    edges = [(i, i + 1) for i in range(count - 1)] + u.same + u.near
    if not edges:
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a, b = np.array(edges).T
    table = np.concatenate([np.repeat(field.chain[None], count - 1, 0), np.repeat(np.eye(n)[None] * field.skip[0], len(u.same), 0), np.repeat(np.eye(n)[None] * field.skip[1], len(u.near), 0)])
    forth, back = np.zeros((len(edges), n)), np.zeros((len(edges), n))  # messages to b and to a
    norm = lambda m: m - (m.max(1, keepdims=True) + np.log(np.exp(m - m.max(1, keepdims=True)).sum(1, keepdims=True)))
    total = own
    for _ in range(rounds):
        total = own.copy()
        np.add.at(total, b, forth)
        np.add.at(total, a, back)
        to_b = (total[a] - back)[:, :, None] + table
        to_a = (total[b] - forth)[:, None, :] + table
        new_forth = norm(to_b.max(1) + np.log(np.exp(to_b - to_b.max(1, keepdims=True)).sum(1)))
        new_back = norm(to_a.max(2) + np.log(np.exp(to_a - to_a.max(2, keepdims=True)).sum(2)))
        forth, back = damping * forth + (1 - damping) * new_forth, damping * back + (1 - damping) * new_back
    total = own.copy()
    np.add.at(total, b, forth)
    np.add.at(total, a, back)
    return np.exp(norm(total))


def find_spans(text: str | None, field: Field, sure: float = 0.5) -> tuple[list[Span], list[Span]]:
    """Found entities, and all spans: also tokens that take an entity's label over skip links with probability `sure`.

    Both are in the order of KINDS, then start. A token that no chain of links joins to an entity of its label is never
    added, so a document without entities is left alone.
    """
    if not text or not CUE.search(text):
        return [], []
    base = sorted(base_spans(text))
    if not base:
        return [], []
    u = find_units(text, base)
    if len(u.spans) == len(base) or not (u.same or u.near):
        return base, base
    reach = {i: i for i in range(len(u.spans))}

    def top(i: int) -> int:
        while reach[i] != i:
            reach[i] = reach[reach[i]]
            i = reach[i]
        return i

    for a, b in (*u.same, *u.near):
        reach[top(a)] = top(b)
    known = {(top(i), k) for i, k in enumerate(u.labels) if k > 0}
    if not any(k < 0 and any((top(i), x) in known for x in range(1, len(LABELS))) for i, k in enumerate(u.labels)):
        return base, base
    p = marginals(u, field)
    more = [(int(k) - 1, *u.spans[i]) for i, k in enumerate(p.argmax(1)) if u.labels[i] < 0 and k > 0 and p[i, k] >= sure and (top(i), int(k)) in known]
    return base, sorted(base + more)


def train_field(docs: DataFrame, text_col: str = "text", sample_docs: int = 2000, sample_units: int = 200) -> Field:
    """Fits the field on at most sample_docs documents with cues, those of lowest text hash, and their first sample_units tokens.

    The bounds hold whatever the corpus: documents with cues are counted, a share of their hashes is taken that gives
    some OVER times the sample, and of these the lowest go to the driver, as token shapes and links, not texts. Null and
    empty texts have no cues; an empty table gives the priors.
    """
    kinds = "struct<labels:array<int>,features:array<int>,same:array<int>,near:array<int>>"

    @F.arrow_udf(kinds)
    def shapes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for at in range(0, len(batch), SLICE):
                for text in batch.slice(at, SLICE).to_pylist():
                    u = find_units(text, sorted(base_spans(text))) if text and CUE.search(text) else Units([], [], [], [], [])
                    short = [[x for a, b in links if b < sample_units for x in (a, b)] for links in (u.same, u.near)]
                    rows.append({"labels": u.labels[:sample_units], "features": u.features[:sample_units], "same": short[0], "near": short[1]})
            yield pa.array(rows, pa.struct([(n, pa.list_(pa.int32())) for n in ("labels", "features", "same", "near")]))

    text = F.col(text_col)
    cued = docs.where(text.rlike("[0-9@]")).select(text.alias("text"), F.xxhash64(text).bitwiseAND(2**62 - 1).alias("h"))
    share = min(1.0, OVER * sample_docs / max(1, cued.count()))
    rows = cued.where(F.col("h") < int(share * 2**62)).select("h", shapes(F.col("text")).alias("u")).where(F.size("u.labels") > 0)
    found = rows.orderBy("h", F.to_json("u")).limit(sample_docs).collect()
    pairs = lambda x: list(zip(x[::2], x[1::2], strict=True))
    return fit_field([Units([(0, 0)] * len(r["u"]["labels"]), r["u"]["labels"], r["u"]["features"], pairs(r["u"]["same"]), pairs(r["u"]["near"])) for r in found])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the four kinds' numbers of found entities, base_sha256 and all spans.

    Starts and ends are code points, ends exclusive. A null or empty text has no spans. Repeated rows give repeated rows,
    an empty table an empty result. field defaults to train_field(docs). Other columns are not read; nothing is shuffled.
    """
    field = field or train_field(docs, text_col)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            rows = []
            for d, text in zip(ids, texts, strict=True):
                base, spans = find_spans(text, field)
                rows.append((d, *(sum(s[0] == k for s in base) for k in range(len(KINDS))), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(text.rlike("[0-9@]"), text).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def redacted(text: Column, field: Field) -> Column:
    """The text column with every span replaced; a null stays null."""

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if t is None else redact_text(t, find_spans(t, field)[1]) for at in range(0, len(batch), SLICE) for t in batch.slice(at, SLICE).to_pylist()], pa.string())

    return F.when(text.rlike("[0-9@]"), run(text)).otherwise(text)


def redact_pii(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with personal data in the text replaced; null, empty and repeated rows stay as they are.

    Columns may have any names. Nothing is shuffled; an empty table gives an empty result.
    """
    field = field or train_field(docs, text_col)
    return docs.withColumn(text_col, redacted(F.col(text_col), field))
