"""Words of whole texts as 64-bit hashes, for a batch of texts at once.

Words are runs of bytes without ASCII white space, as bytes.split() cuts them. A word's hash is a polynomial of its
bytes modulo 2**64, taken as a difference of running sums, and mixed; words longer than LONG bytes are hashed one by
one, since such polynomials can be led astray by long words made for it. Hashes are alike on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONG = 256
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SPAN = 1 << 18  # bytes whose sums are held at once
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _powers(base: int) -> np.ndarray:
    steps = np.full(SPAN + 2 * LONG, base, np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(steps)


_POWER, _INVERSE = _powers(BASE), _powers(pow(BASE, -1, 2**64))


def _hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the words from starts to stops in data, a span of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(stops - starts > LONG)
    whole, stops = stops, np.minimum(stops, starts + LONG)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + SPAN, SPAN))
    with np.errstate(over="ignore"):
        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if i < j:
                base = k * SPAN
                own = data[base : int(stops[j - 1])]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[own] * _POWER[: len(own)])])
                out[i:j] = (sums[stops[i:j] - base] - sums[starts[i:j] - base]) * _INVERSE[starts[i:j] - base]
    out = mix(out)
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : whole[k]].tobytes(), seed=1)
    return out


@dataclass
class Words:
    """Hashes of all words of a batch in order; text and line (of all lines of the batch) that each stands in, ascending.

    first_line: for each text the number of its first line, and the number of all lines at the end. A line feed ends a line.
    """

    hashes: np.ndarray
    text: np.ndarray
    line: np.ndarray
    first_line: np.ndarray


def batch_words(texts: pa.Array) -> Words:
    """The words of every text; a null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.arange(len(texts) + 1))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    edges = ends[1:-1][ends[1:-1] < len(data)]
    before[edges] = False  # a text begins
    after = np.concatenate([before[1:], [False]])  # the byte belongs to a word that goes on
    after[:-1] &= word[1:]
    starts = np.flatnonzero(word & ~before)
    stops = np.flatnonzero(word & ~after) + 1
    hashes = _hashes(data, starts, stops)
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends)))
    feeds = np.cumsum(data == 10, dtype=np.int64)
    counts = np.concatenate([[0], feeds])[ends]
    first_line = counts + np.arange(len(texts) + 1)
    return Words(hashes, text, feeds[starts] + text, first_line)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words in text order, and the text of each; a text of fewer words is one run, one of none has none."""
    h, text = words.hashes, words.text
    n = np.bincount(text, minlength=len(words.first_line) - 1)
    place = np.arange(len(h)) - (np.cumsum(n) - n)[text]
    with np.errstate(over="ignore"):
        out = h * _ODD[0]
        for j in range(1, k):
            out[:-j] += np.where(text[j:] == text[:-j], h[j:] * _ODD[j % len(_ODD)], np.uint64(0))
    keep = place <= np.maximum(n[text] - k, 0)
    return mix(out[keep]), text[keep]


def labelled(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Hashes with the number of their earlier occurrences in the group worked in: a multiset becomes a set."""
    with np.errstate(over="ignore"):
        own = mix(h + group.astype(np.uint64) * np.uint64(BASE))
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        if not len(again):
            return h
        nth = np.zeros(len(h), np.uint64)
        run = np.diff(again, prepend=again[0] - 2) != 1  # a new run of equal ones begins
        first = np.maximum.accumulate(np.where(run, np.arange(len(again)), 0))
        nth[order[again]] = (np.arange(len(again)) - first + 1).astype(np.uint64)
        return np.where(nth > 0, mix(h + nth * np.uint64(BASE)), h)
