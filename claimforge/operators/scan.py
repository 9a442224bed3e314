"""Rule scans of texts: leaks, content, bias, injection, hidden characters, request filters. Rules are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.functions.text import mask, word_array


@dataclass(frozen=True)
class ScanRule:
    """A pattern with one group, the matched text. Patterns should be linear: no lookaround, no nested repetition."""

    name: str
    category: str
    pattern: str
    severity: str = "low"
    confidence: float = 0.5
    cue: str = ""  # a plain string without which the pattern can't match: a cheap filter


SEVERITY = {"low": 1, "medium": 2, "high": 3}
#: Own small default lists; production lists are passed in.
LEAK_RULES = (
    ScanRule("email", "email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+)", "medium", 0.9, "@"),
    ScanRule("ip", "ip", r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b", "low", 0.7, "."),
    ScanRule("card", "card", r"\b([0-9]{16})\b", "high", 0.95),
    ScanRule("secret", "secret", r"\b([0-9a-f]{32,})\b", "high", 0.9),
    ScanRule("phone", "phone", r"(\+[0-9][0-9 ()-]{7,16}[0-9])", "medium", 0.85, "+"),
)
CONTENT_RULES = (ScanRule("insult", "insult", r"\b(idiot|trash|worthless|clown|pathetic)\b", "medium", 0.8), ScanRule("threat", "threat", r"\b(kill|destroy)\b", "high", 0.8))
BIAS_RULES = (ScanRule("absolute", "generalisation", r"\b(always|never|everyone|nobody)\b", "low", 0.5), ScanRule("group", "group", r"\b(those people|they all)\b", "high", 0.7))
INJECTION_RULES = (
    ScanRule("override", "override", r"\b(ignore (?:all |the )?(?:previous|above)|disregard)\b", "high", 0.9),
    ScanRule("prompt leak", "leak", r"\b(system prompt|your instructions)\b", "high", 0.8),
    ScanRule("role", "jailbreak", r"\b(you are now|pretend to be|act as)\b", "medium", 0.7),
    ScanRule("hidden markup", "hidden", r"(<!--|display: ?none|visibility: ?hidden)", "medium", 0.6), ScanRule("active markup", "active", r"(<script|<iframe|javascript:)", "medium", 0.5),
)
WAF_RULES = (("bot", r"(?i)(curl|bot|crawler|spider)"), ("sqli", r"(?i)(union select|or 1=1|drop table)"), ("xss", r"(?i)(<script|javascript:|onerror=)"), ("traversal", r"(\.\./|%2e%2e)"))


def _finding(r: ScanRule):
    return lambda m: F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), m.alias("matched"))


def scan_rules(df: DataFrame, text: str, rules: tuple[ScanRule, ...], lower: bool = False) -> DataFrame:
    """One row per match: the columns of df but the text, rule, category, severity, confidence, matched.

    All rules are expressions of one projection, so a text is read once and nothing is shuffled.
    """
    t = F.lower(F.col(text)) if lower else F.col(text)
    found = []
    for r in rules:
        hits = F.regexp_extract_all(t, F.lit(r.pattern), 1)
        hits = F.when(F.contains(t, F.lit(r.cue)), hits) if r.cue else hits
        found.append(F.transform(F.coalesce(hits, F.array().cast("array<string>")), _finding(r)))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(F.concat(*found)).alias("f")).select(*rest, "f.*")


def scan_leaks(df: DataFrame, key: str = "doc_id", text: str = "text", rules=LEAK_RULES) -> DataFrame:
    """Different leaks of each document, masked. Card numbers must pass the Luhn check, address parts stay under 256."""
    own = scan_rules(df.select(key, text), text, rules)
    parts = F.forall(F.transform(F.split("matched", r"\."), lambda p: F.try_to_number(p, F.lit("999"))), lambda p: p <= 255)
    ok = F.when(F.col("category") == "card", F.expr("luhn_check(matched)")).when(F.col("category") == "ip", parts).otherwise(True)
    return own.where(ok).dropDuplicates([key, "category", "matched"]).withColumn("masked", mask(F.col("matched")))


def scan_content(df: DataFrame, key: str = "doc_id", text: str = "text", rules=CONTENT_RULES) -> DataFrame:
    """Findings by category and the first 20 characters of the match, with the action: block if severe, else warn."""
    own = scan_rules(df.select(key, text), text, rules, lower=True).withColumn("matched", F.substring("matched", 1, 20))
    return own.dropDuplicates([key, "category", "matched"]).withColumn("action", F.when(F.col("severity") == "high", "block").otherwise("warn"))


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), severity)


def scan_bias(df: DataFrame, key: str = "doc_id", text: str = "text", rules=BIAS_RULES) -> DataFrame:
    """The most severe finding for each matched text and category."""
    own = scan_rules(df.select(key, text), text, rules, lower=True).withColumn("matched", F.substring("matched", 1, 30))
    order = Window.partitionBy(key, "matched", "category").orderBy(F.desc(severity_rank(F.col("severity"))), "rule")
    return own.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def scan_injection(df: DataFrame, keys: list[str], text: str = "text", rules=INJECTION_RULES) -> DataFrame:
    """Texts with signs of injection: the reasons joined and the highest confidence."""
    own = scan_rules(df.select(*keys, text), text, rules, lower=True)
    return own.groupBy(*keys).agg(F.concat_ws(",", F.array_sort(F.collect_set("category"))).alias("reasons"), F.max("confidence").alias("confidence"))


def sanitize_text(text: Column) -> Column:
    """Without zero-width and control characters, comments and hidden elements marked, full-width forms as ASCII."""
    out = F.regexp_replace(text, r"[​-‏⁠﻿]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "[comment]")
    out = F.regexp_replace(out, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "[hidden]")
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(out, wide + "　", "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def detect_hidden(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text)
    n = lambda p: F.regexp_count(t, F.lit(p))
    return df.select(
        key, n(r"[​-‏⁠﻿]").alias("zero_width"), n(r"[\x00-\x08\x0b\x0c\x0e-\x1f]").alias("controls"), n(r"<(script|style|iframe)").alias("hidden_tags"),
        n(r"<!--").alias("comments"), n(r"[A-Za-z0-9+/]{40,}={0,2}").alias("encoded"),
    )


def scan_unicode_tricks(df: DataFrame, key: str, text: str, homoglyphs: str = "аеорсхіѕ", plain: str = "aeopcxis") -> DataFrame:
    """Direction controls, look-alike letters and zero-width characters, a risk level and the cleaned text."""
    t = F.col(text)
    bidi, zero = F.regexp_count(t, F.lit(r"[‪-‮⁦-⁩]")), F.regexp_count(t, F.lit(r"[​-‏﻿]"))
    alike = F.length(t) - F.length(F.translate(t, homoglyphs, ""))
    clean = F.regexp_replace(F.translate(t, homoglyphs, plain), r"[‪-‮⁦-⁩​-‏﻿]", "")
    risk = F.when(bidi > 0, "high").when((alike > 0) & (zero > 0), "high").when((alike > 0) | (zero > 0), "medium").otherwise("none")
    return df.select(key, bidi.alias("bidi"), alike.alias("homoglyphs"), zero.alias("zero_width"), risk.alias("risk"), clean.alias("cleaned"))


def scan_waf(df: DataFrame, text: str, rules=WAF_RULES, most: int = 1_000_000) -> DataFrame:
    """The first reason to block a request, or null: a pattern in order, or a body over `most` characters."""
    reason = F.coalesce(*(F.when(F.col(text).rlike(p), F.lit(name)) for name, p in rules), F.when(F.length(text) > most, F.lit("size")))
    return df.withColumn("block_reason", reason)


def classify_fact_statement(df: DataFrame, text: str, verbs: str = r"^(ignore|send|delete|run|click|buy|tell)\b", modal: str = r"\b(must|should|shall)\b") -> DataFrame:
    t = F.lower(F.trim(F.col(text)))
    kind = F.when(t.rlike(verbs) | t.rlike(modal), "instruction").when(F.length(t) >= 4, "fact").otherwise("unknown")
    return df.withColumn("statement", kind).withColumn("safe_for_kb", kind == "fact")


def validate_kb_entries(df: DataFrame, key: str, text: str, bad=INJECTION_RULES, most_key: int = 60) -> DataFrame:
    """The first failing reason of each entry, null for a good one."""
    t = F.lower(F.col(text))
    reasons = [F.when(~F.col(key).rlike(r"^[\p{L}\p{N}_ -]+$"), "key characters"), F.when(F.length(key) > most_key, "key length"), *(F.when(t.rlike(r.pattern), F.lit(r.category)) for r in bad), F.when(F.length(F.trim(t)) < 4, "too short")]
    return df.withColumn("reject_reason", F.coalesce(*reasons))


def score_source_authority(df: DataFrame, domain: str, tiers: tuple[tuple[str, int], ...]) -> DataFrame:
    """The score of the first tier whose suffix the domain has; 1 for unknown ones, -1 is forbidden."""
    return df.withColumn("authority", F.coalesce(*(F.when(F.endswith(F.col(domain), F.lit(s)), F.lit(v)) for s, v in tiers), F.lit(1)))


def audit_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """blocked, warning or ok for each document, from its leaks, content and bias."""
    leaks = scan_leaks(df, key, text).groupBy(key).agg(F.count("*").alias("n_leaks"), F.max("confidence").alias("leak_conf"))
    content = scan_content(df, key, text).groupBy(key).agg(F.count("*").alias("n_content"), F.max(severity_rank(F.col("severity"))).alias("content_rank"))
    bias = scan_bias(df, key, text).groupBy(key).agg(F.count("*").alias("n_bias"), F.max(severity_rank(F.col("severity"))).alias("bias_rank"))
    out = df.select(key).join(leaks, key, "left").join(content, key, "left").join(bias, key, "left").fillna(0)
    status = F.when((F.col("leak_conf") >= 0.9) | (F.col("content_rank") >= 3), "blocked").when((F.col("bias_rank") >= 3) | (F.col("n_leaks") + F.col("n_content") > 0), "warning").otherwise("ok")
    return out.select(key, "n_leaks", "n_content", "n_bias", status.alias("status"))


def guard_retrieved(facts: DataFrame, text: str, relevance: str, query: str) -> DataFrame:
    """Safety of each retrieved fact (1 - 0.6 imperative - 0.8 injected - 0.7 encoded, 0 at least), effective relevance, use."""
    t = F.lower(F.col(text))
    imperative, injected, encoded = (c.cast("int") for c in (t.rlike(r"^(ignore|send|delete|run|click)\b"), F.lit(False) | t.rlike("|".join(r.pattern for r in INJECTION_RULES)), F.col(text).rlike(r"[A-Za-z0-9+/]{40,}")))
    safety = F.greatest(F.lit(0.0), 1 - 0.6 * imperative - 0.8 * injected - 0.7 * encoded)
    out = facts.withColumn("safety", F.round(safety, 6)).withColumn("effective", F.round(F.col(relevance) * safety, 6))
    return out.withColumn("use", F.when(F.col("effective") <= 0, "drop").when(F.col("effective") < 0.3, "downgrade").otherwise("keep"))


def semantic_drift(df: DataFrame, asked: str, answered: str, signals: tuple[str, ...], least: float = 0.2) -> DataFrame:
    """Whether an answer has signal words that the question lacks, or shares too few words with it."""
    q, a = F.array_distinct(word_array(F.col(asked))), F.array_distinct(word_array(F.col(answered)))
    new = F.array_intersect(F.array_except(a, q), F.array(*map(F.lit, signals)))
    overlap = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, a)) / F.size(q))
    return df.withColumn("overlap", F.round(overlap, 6)).withColumn("new_signals", F.size(new)).withColumn("drifted", (F.size(new) > 0) | (overlap < least))


def flag_segments(df: DataFrame, text: str, markers: dict[str, str]) -> DataFrame:
    """Names of the marker patterns that a segment matches, in the order given."""
    t = F.lower(F.col(text))
    return df.withColumn("flags", F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, p in markers.items()))))


def parse_wiki_extract(df: DataFrame, title: str, text: str) -> DataFrame:
    """Key and up to eight sentences of the first 800 characters, citations and brackets removed."""
    pieces = F.transform(F.split(F.substring(F.col(text), 1, 800), r"[.!?\n]+"), lambda p: F.trim(F.regexp_replace(p, r"\[[^\]]*\]|\([^)]*\)", "")))
    return df.select(F.substring(F.regexp_replace(F.col(title), r"[^\p{L}\p{N}]+", "_"), 1, 80).alias("key"), F.slice(F.filter(pieces, lambda p: F.length(p) >= 10), 1, 8).alias("facts"))


def parse_entity(df: DataFrame, title: str, text: str) -> DataFrame:
    """Birth and death as the first and last year from 500 to 2025, and the first sentence."""
    years = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\b([0-9]{3,4})\b"), 1), lambda y: y.cast("int")), lambda y: y.between(500, 2025))))
    return df.select(title, F.array_min(years).alias("birth"), F.when(F.size(years) > 1, F.array_max(years)).alias("death"), F.trim(F.substring_index(F.col(text), ".", 1)).alias("first_sentence"))
