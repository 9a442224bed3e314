"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, stage_table

GOOD, BAD, ABSTAIN = 1, 2, 0
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus's languages, for one of the rules.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was with be by on not he as you this are at have from or had an they which one we "
    "le la les de des du et en un une que qui pour dans sur pas par au avec est ou ce il ne se plus "
    "der die das und zu den von mit sich des auf ein eine dem nicht als auch es an er so dass im ist für "
    "el los las y del se por con para una su al lo como más pero sus o".split()
)


@dataclass(frozen=True)
class Rule:
    """Votes on a ratio of two statistics: bad above `bad`, good below `good`, none between or where the statistic is unknown."""

    name: str
    value: str
    per: str
    good: float
    bad: float
    alone: bool = True  # a bad vote can be the only sign of a bad text


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.03, 0.1),
    Rule("capitals", "n_capitals", "n_letters", 0.15, 0.3),
    Rule("exclamations", "n_exclaimed", "n_words", 0.05, 0.2),
    Rule("repetition", "n_repeat_words", "n_words", 0.05, 0.2),
    Rule("stutter", "n_stuttered", "n_words", 0.05, 0.2),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.1, 0.4, False),
    Rule("long words", "n_long_words", "n_words", 0.02, 0.2, False),
    Rule("letters missing", "n_other_chars", "word_chars", 0.15, 0.4, False),
    Rule("function words missing", "n_content_words", "n_words", 0.9, 1.01, False),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_exclaimed", "n_stuttered", "n_long_words", "n_other_chars", "n_content_words")
STRUCT = f"struct<{', '.join(f'{s}:long' for s in STATS)}>"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: np.ndarray, window: int = 5) -> int:
    """Words inside a window of `window` words that occurs twice or more; words are 64-bit hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = sum((words[k : k + n] * _MIX[k] for k in range(1, window)), words[:n] * _MIX[0])
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for a whole text; a null text counts as empty. Words are runs without ASCII white space."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    word_chars = len(text) - sum(map(text.count, SPACE))
    lines, seen, dup = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(raw.translate(None, _NOT_LETTERS))
    capitals = len(raw.translate(None, _NOT_CAPITALS)) if text.isascii() else sum(map(str.isupper, text))
    return (
        n, word_chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(hashes), lines, letters, capitals, text.count("!"),
        int(np.count_nonzero(hashes[1:] == hashes[:-1])), int(np.count_nonzero(np.fromiter(map(len, words), np.int64, n) > 40)),
        word_chars - letters, n - sum(map(_FUNCTION.__contains__, text.lower().encode("utf-8", "surrogatepass").split())),
    )


_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)
_CAPITALS = bytes(range(65, 91))
_NOT_CAPITALS = bytes(b for b in range(256) if b not in _CAPITALS)
_NOT_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)


def stats_column(text: Column) -> Column:
    @F.arrow_udf(STRUCT)
    def stats(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [text_stats(t) for at in range(0, len(batch), SLICE) for t in batch.slice(at, SLICE).to_pylist()]
            columns = zip(*rows, strict=True) if rows else ([] for _ in STATS)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(STATS))

    return stats(text)


def vote(rule: Rule, stats: Column) -> Column:
    """GOOD, BAD or ABSTAIN as a number; no base to divide by is an abstention."""
    value, per = stats[rule.value], stats[rule.per]
    return F.when(per <= 0, ABSTAIN).when(value > per * rule.bad, BAD).when(value < per * rule.good, GOOD).otherwise(ABSTAIN)


def pattern(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All votes as one number in base 3."""
    return sum((vote(r, stats) * 3**k for k, r in enumerate(rules)), F.lit(0)).cast("int")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def fit_posteriors(counts: dict[int, int], rules: tuple[Rule, ...] = RULES, rounds: int = 200, prior: float = 0.01, false_alarm: float = 0.01) -> dict[int, float]:
    """Expectation-maximisation over vote patterns and their numbers: the probability of good quality for each pattern.

    A document is good, or bad in one of several ways: one for each rule marked `alone`, since a text that is bad in one
    way often looks fine to the other rules. A rule abstains alike on all of them; where it votes, it is right with a
    probability of its own on good documents and on each kind of bad ones. These and the shares of the kinds are
    estimated, with priors that weigh `prior` of all documents, whatever their number. A rule marked `alone` is taken to
    be wrong on `false_alarm` of the good documents it votes on at most, and none to be worse than chance, so a pattern without a bad vote never lowers the probability. Work depends on the number of patterns,
    at most 3 ** len(rules).
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes.tolist()], float)
    weight /= weight.sum()
    votes = codes[:, None] // 3 ** np.arange(len(rules)) % 3
    good, bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    kinds = [k for k, r in enumerate(rules) if r.alone]
    # row 0: good documents; then the kinds of bad ones. The chance of a bad vote where the rule votes
    start = np.full((len(kinds) + 1, len(rules)), 0.05)
    start[0] = 0.005
    start[range(1, len(kinds) + 1), kinds] = 0.95
    wrong = start.copy()
    share0 = share = np.array([1 - 0.03 * len(kinds), *[0.03] * len(kinds)])
    for _ in range(rounds):
        log = np.log(share) + bad @ np.log(wrong).T + good @ np.log(1 - wrong).T
        q = np.exp(log - log.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        own = weight[:, None] * q
        share = (own.sum(0) + prior * share0) / (1 + prior)
        wrong = (own.T @ bad + prior * start) / (own.T @ (good + bad) + prior)
        wrong = np.clip(wrong, 1e-4, 1 - 1e-4)
        wrong[0, kinds] = np.minimum(wrong[0, kinds], false_alarm)
        wrong[1:] = np.maximum(wrong[1:], wrong[0])
    return dict(zip(codes.tolist(), q[:, 0].tolist(), strict=True))


def _fit(patterns: DataFrame) -> dict[int, float]:
    return fit_posteriors({r["pattern"]: r["count"] for r in patterns.groupBy("pattern").count().collect()})  # at most 3 ** rules rows


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the statistics of its whole text, pattern, quality (probability), base_failed, kept.

    A document with fewer than 10 words, or with over a fifth of its words in repeated five-word windows, fails the base
    and isn't kept. Others are kept if the posterior probability of good quality is `threshold` or more. The posterior
    is fitted on the vote patterns of all documents of 10 words or more. A null text counts as empty. Repeated rows give
    repeated rows; an empty table gives an empty result. Other columns are not read.

    Texts are read once; statistics go to a narrow stage table. What the driver gets is one count per pattern.
    """
    rows = stage_table(docs.select(F.col(id_col).alias("doc_id"), stats_column(F.col(text_col)).alias("stats")).select("doc_id", "stats", pattern(F.col("stats")).alias("pattern")), "quality")
    found = _fit(rows.where(F.col("stats.n_words") >= 10))
    table = docs.sparkSession.createDataFrame(list(found.items()), "pattern int, quality double")
    failed = base_failed(F.col("stats"))
    out = rows.join(F.broadcast(table), "pattern", "left")  # at most 3 ** rules rows
    kept = F.when(failed, False).otherwise(F.coalesce(F.col("quality") >= threshold, F.lit(False)))
    return out.select("doc_id", "stats.*", "pattern", "quality", failed.alias("base_failed"), kept.alias("kept"))


def filter_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score_quality keeps, with all their columns; texts are read twice rather than shuffled.

    Null and empty texts fail the base and go; repeated rows stay repeated; columns may have any names; an empty table
    gives an empty result.
    """
    found = _fit(docs.select(stats_column(F.col(text_col)).alias("stats")).where(F.col("stats.n_words") >= 10).select(pattern(F.col("stats")).alias("pattern")))
    good = [p for p, q in found.items() if q >= threshold]  # at most 3 ** rules numbers
    own = docs.select(F.struct(*docs.columns).alias("row"), stats_column(F.col(text_col)).alias("stats"))
    own = own.where(~base_failed(F.col("stats")) & pattern(F.col("stats")).isin(good))
    return own.select(*(F.col("row")[c].alias(c) for c in docs.columns))
