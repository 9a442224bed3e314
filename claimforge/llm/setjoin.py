"""Candidates of an exact set-similarity join: a prefix join on rare tokens with length, positional and parity filters.

A set's tokens are ordered from rare to frequent, alike for all sets. Sets that overlap enough share a token of their
prefixes; what is left to check is whether two sets at one token can still overlap enough. The parity of a set is 128
bits, in two words, with the bit of each token flipped once, so two sets differ in at least as many tokens as their
parities in bits. For sets of some 200 tokens and fewer that tells unlike sets from similar ones nearly always.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage_table

POSTING = ("token", "x", "y", "part", "n", "place", "odd", "even")
#: Sets at one token that a task compares with each other; a token of more goes through a join in Spark.
CROWD = 4096
#: Postings that a task looks at together.
ROWS = 150_000
_EPS = 1e-6
#: Sets of so many tokens or fewer have their parity in one word, and others are folded to one against them.
SMALL = 48
#: The part of sets that may be compared with all others.
ALL = -1


@dataclass(frozen=True)
class Overlap:
    """How many tokens sets of n and m tokens must share, for arrays and for columns alike."""

    least: float
    jaccard: bool

    def need(self, n, m, greatest):
        return self.least / (1 + self.least) * (n + m) if self.jaccard else self.least * greatest(n, m)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Length of the prefix of a set of n tokens that every similar set's prefix meets."""
        return n - np.ceil(self.least * n - _EPS).astype(np.int64) + 1

    def fits(self, n, m, i, j, differ, least, greatest):
        """Whether sets that share their first common token at places i and j can be similar."""
        need = self.need(n, m, greatest)
        spare = n + m - 2 * need + _EPS
        return (least(n, m) >= need - _EPS) & (i + j <= spare) & (differ <= spare)


def parity(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words of each set's parity; first holds the place of each set's first token, and no set is empty."""
    bit, side = np.uint64(1) << (tokens & np.uint64(63)), (tokens >> np.uint64(6)) & np.uint64(1)
    odd, even = (np.bitwise_xor.reduceat(np.where(side == k, bit, np.uint64(0)), first).view(np.int64) for k in (1, 0))
    small = np.diff(np.append(first, len(tokens))) <= SMALL  # one word does, which spares a number in every posting
    return np.where(small, odd ^ even, odd), np.where(small, 0, even)


def _near(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, rule: Overlap) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows a and b those that can be similar, the later set first."""
    n, m = rows["n"][a], rows["n"][b]
    near = rows["place"][a] + rows["place"][b] <= n + m - 2 * rule.need(n, m, np.maximum) + _EPS
    a, b = a[near], b[near]
    odd, even = (rows[c][a] ^ rows[c][b] for c in ("odd", "even"))
    fold = np.minimum(rows["n"][a], rows["n"][b]) <= SMALL
    differ = sum(np.bitwise_count(x.view(np.uint64)).astype(np.int64) for x in (np.where(fold, odd ^ even, odd), np.where(fold, 0, even)))
    keep = rule.fits(rows["n"][a], rows["n"][b], rows["place"][a], rows["place"][b], differ, np.minimum, np.maximum)
    x, y, part = rows["x"], rows["y"], rows["part"]
    keep &= ((part[a] != part[b]) | (part[a] == ALL)) & ((x[a] != x[b]) | (y[a] != y[b]))
    a, b = a[keep], b[keep]
    later = (x[a] > x[b]) | ((x[a] == x[b]) & (y[a] > y[b]))
    return np.where(later, a, b), np.where(later, b, a)


def _pairs(rows: dict[str, np.ndarray], size: np.ndarray, rule: Overlap) -> tuple[np.ndarray, np.ndarray]:
    """All pairs at each token; a token's sets stand together, small ones first, so that a set is compared with fitting ones only."""
    start = np.repeat(np.cumsum(size) - size, size)
    n, at, d, found = rows["n"], np.flatnonzero(np.repeat(size > 1, size)), 1, []
    while len(at):
        at = at[at - d >= start[at]]
        at = at[n[at - d] >= rule.least * n[at] - _EPS]
        found.append(_near(rows, at, at - d, rule))
        d += 1
    a, b = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return a, b


def candidates(postings: DataFrame, rule: Overlap, first_only: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y, bx, by) of sets that may be similar, the later set first, and postings that are left to crowded().

    postings has the columns of POSTING: a set is named by (x, y), which also order the sets; sets of one part are not
    compared, unless it is ALL or the column isn't there. With first_only a set is paired with the earliest fitting set of each token only, and the
    postings of tokens where it has others are left over; without it with all. At a token of more than CROWD sets these
    are compared with the first one (first_only) or none, and all are left over. A token's postings are read as a
    stream, so a frequent token takes no more memory than CROWD sets. Pairs that share several tokens may come repeatedly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # rows of the last tokens so far, or only the token's first if `over`
        over = False

        def emit(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = {c: np.concatenate([rows[c][a], rows[c][left]]) for c in POSTING}
            bx, by = (np.concatenate([rows[c][b], np.zeros(len(left), np.int64)]) for c in ("x", "y"))
            columns = [pa.array(np.arange(len(bx)) < len(a)), pa.array(bx), pa.array(by), *(pa.array(out[c]) for c in POSTING)]
            whole = pa.RecordBatch.from_arrays(columns, names=["pair", "bx", "by", *POSTING])
            for k in range(0, whole.num_rows, 10_000):
                yield whole.slice(k, 10_000)

        def done(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Rows of whole tokens of up to CROWD sets."""
            order = np.lexsort((rows["n"], rows["token"]))
            rows = {c: v[order] for c, v in rows.items()}
            edge = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1])) if len(order) else np.zeros(0, np.int64)
            a, b = _pairs(rows, np.diff(np.append(edge, len(order))), rule)
            left = np.zeros(0, np.int64)
            if first_only and len(a):
                rank = np.lexsort((rows["y"][b], rows["x"][b], a))
                first = np.append(True, np.diff(a[rank]) != 0)
                crowd = np.unique(rows["token"][a[rank[~first]]])  # tokens where a set has several partners
                both = np.unique(np.concatenate([a, b]))
                left = both[np.isin(rows["token"][both], crowd)]
                a, b = a[rank[first]], b[rank[first]]
            yield from emit(rows, a, b, left)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.schema.names}
            size = rows.pop("size")
            rows |= {"n": size >> 32, "place": size & 0xFFFFFFFF}
            rows.setdefault("part", np.full(batch.num_rows, ALL, np.int64))
            if over:  # the rest of a crowded token
                same = int(np.searchsorted(rows["token"] != held["token"][0], True))
                own = {c: np.concatenate([held[c], v[:same]]) for c, v in rows.items()}
                at = np.arange(1, same + 1)
                yield from emit(own, *(_near(own, at, np.zeros(same, np.int64), rule) if first_only else (at[:0], at[:0])), at)
                if same == batch.num_rows:
                    continue
                rows, held, over = {c: v[same:] for c, v in rows.items()}, None, False
            if held is not None:
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            last = int(np.searchsorted(rows["token"], rows["token"][-1]))
            if len(rows["token"]) - last > CROWD:
                yield from done({c: v[:last] for c, v in rows.items()})
                own = {c: v[last:] for c, v in rows.items()}
                at = np.arange(len(own["token"]))
                yield from emit(own, *(_near(own, at[1:], np.zeros(len(at) - 1, np.int64), rule) if first_only else (at[:0], at[:0])), at)
                held, over = {c: v[:1] for c, v in own.items()}, True
            elif last >= ROWS:
                yield from done({c: v[:last] for c, v in rows.items()})
                held = {c: v[last:] for c, v in rows.items()}
            else:
                held = rows
        if held is not None and not over:
            yield from done(held)

    # a row that is shuffled holds the size and the place in one number
    both = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("size")
    kept = [c for c in ("token", "x", "y", "part", "odd", "even") if c in postings.columns]
    dealt = postings.select(*kept, both).repartition(partitions(postings.sparkSession), "token").sortWithinPartitions("token", "x", "y")
    kinds = ", ".join(["pair boolean", "bx long", "by long", *(f"{c} long" for c in POSTING)])
    found = stage_table(dealt.mapInArrow(run, kinds), "candidates")
    return found.where("pair").select("x", "y", "bx", "by").distinct(), found.where("not pair").select(*POSTING)


def crowded(crowd: DataFrame, rule: Overlap, asked: DataFrame | None = None) -> DataFrame:
    """Pairs (x, y, bx, by) of all sets at crowded tokens that may be similar; with asked (x, y) only those of these sets.

    With asked, (bx, by) is the earlier set. Without it the sets of a pair are in any order, each pair once.
    """
    b = crowd.select(*(F.col(c).alias(f"b{c}") for c in POSTING))
    a = crowd if asked is None else crowd.join(asked, ["x", "y"], "left_semi")
    before = (F.col("bx") < F.col("x")) | ((F.col("bx") == F.col("x")) & (F.col("by") < F.col("y")))
    odd, even = F.col("odd").bitwiseXOR(F.col("bodd")), F.col("even").bitwiseXOR(F.col("beven"))
    differ = F.when(F.least("n", "bn") <= SMALL, F.bit_count(odd.bitwiseXOR(even))).otherwise(F.bit_count(odd) + F.bit_count(even))
    fits: Column = rule.fits(F.col("n"), F.col("bn"), F.col("place"), F.col("bplace"), differ, F.least, F.greatest)
    pairs = a.join(b, (F.col("token") == F.col("btoken")) & before & ((F.col("part") != F.col("bpart")) | (F.col("part") == ALL)) & fits)
    return pairs.select("x", "y", "bx", "by").distinct()


def ordered_tokens(hashes: np.ndarray, group: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of distinct hashes of each group, a group's hashes standing together: their groups, sizes, hashes and tokens.

    Hashes and tokens come back group by group and rare ones first; a token is the level and most of the hash.
    """
    token = (level.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
    local = np.cumsum(np.diff(group, prepend=group[:1]) != 0).astype(np.uint64)
    order = np.argsort((local << np.uint64(42)) | (token >> np.uint64(22)) if len(local) and local[-1] < 1 << 22 else token, kind="stable")
    if len(local) and local[-1] >= 1 << 22:
        order = order[np.argsort(local[order], kind="stable")]
    h, token, own = hashes[order], token[order], local[order]
    if ((own[1:] == own[:-1]) & (token[1:] < token[:-1])).any():  # alike in all the bits that were sorted
        order = np.lexsort((token, own))
        h, token, own = h[order], token[order], own[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, bool)
    h, token, own = h[new], token[new], own[new]
    first = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
    groups = group[np.flatnonzero(np.diff(local.astype(np.int64), prepend=-1))]
    return groups, np.diff(np.append(first, len(h))), h, token
