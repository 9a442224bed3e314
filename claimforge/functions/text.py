"""Column expressions over text: hashes, n-grams, set and vector similarity, masks. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP_BIT_CLEAR = 0x7FFFFFFFFFFFFFFF


def stable_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 as a long without its top bit."""
    high, low = (F.conv(F.substring(F.sha2(text, 256), k, 8), 16, 10).cast("long") for k in (1, 9))
    return F.shiftleft(high.bitwiseAND(0x7FFFFFFF), 32).bitwiseOR(low)


def content_id(text: Column, meta: Column) -> Column:
    return F.sha2(F.concat(meta, F.lit("\n"), text), 256)


def fact_id(text: Column) -> Column:
    """SHA-256 of the first 200 bytes, 16 hex digits."""
    return F.substring(F.sha2(F.substring(F.encode(text, "UTF-8"), 1, 200), 256), 1, 16)


def squeeze(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"\s+", "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_ngrams(text: Column, n: int, keep_short: bool = False) -> Column:
    """Distinct runs of n characters; a shorter text has none, or is one itself with keep_short."""
    none = F.array().cast("array<string>")

    def grams(t: Column) -> Column:
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n)))
        short = F.when(F.length(t) > 0, F.array(t)).otherwise(none) if keep_short else none
        return F.when(F.length(t) >= n, runs).when(t.isNotNull(), short)

    return let(text, grams)


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def char_overlap(a: Column, b: Column) -> Column:
    """Share of a's different characters that b has."""
    own, other = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def strip_markdown(text: Column) -> Column:
    for pattern, by in ((r"\*\*([^*]+)\*\*", "$1"), (r"`([^`]*)`", "$1"), (r"(?m)^#+\s*", ""), (r"(?m)^[-*]\s+", ""), (r" +", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def mask(value: Column, head: int = 3, tail: int = 4) -> Column:
    """The first and last characters with stars between; a short value is all stars."""
    n = F.length(value)
    return F.when(n > head + tail, F.concat(F.substring(value, 1, head), F.repeat(F.lit("*"), n - head - tail), F.substring(value, F.lit(0) - tail, F.lit(tail)))).otherwise(F.repeat(F.lit("*"), n))


def half_life(value: Column, days: Column, half: Column) -> Column:
    """value halved every `half` days; 0 where the half-life isn't above 0."""
    return F.when(half > 0, value * F.pow(F.lit(0.5), days / half)).otherwise(0.0)


def exp_decay(importance: Column, rate: Column, days: Column) -> Column:
    return importance * F.exp(-rate * days)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3).cast("long")


def marker_share(text: Column, weights: dict[str, float], most: float = 1.0) -> Column:
    """Weights of the markers that a text holds, added up to `most`."""
    total = sum((F.when(F.contains(F.lower(text), F.lit(k)), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.least(F.lit(most), total)
