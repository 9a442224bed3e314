"""SQL of queries whose folds, scans and scores need more than a line."""

from __future__ import annotations

from claimforge.operators import scan

VOTES = "v AS (SELECT l_orderkey claim_id, 'c' || l_linenumber checker, CASE l_returnflag WHEN 'A' THEN 'contradicted' WHEN 'N' THEN 'verified' ELSE 'uncertain' END verdict, l_discount * 10 confidence, 1 - l_tax weight FROM lineitem)"
OF = lambda v, x: f"sum(CASE WHEN verdict = '{v}' THEN {x} ELSE 0 END)"
#: Events of each user in order: u, n (from 1), t (seconds), event_id.
EVENTS = "o AS (SELECT user_id u, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n, epoch_us(ts) / 1e6 t FROM events)"

FOLDS = {
    "trust_fold": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT DISTINCT u, 0::BIGINT n, 0.5::DOUBLE s FROM o UNION ALL
SELECT f.u, o.n, greatest(0, least(1, s + CASE event_type WHEN 'error' THEN -0.1 WHEN 'purchase' THEN 0.05 ELSE 0 END))::DOUBLE FROM f JOIN o ON o.u = f.u AND o.n = f.n + 1)
SELECT u user_id, round(arg_max(s, n), 6) score, max(n) n_events FROM f GROUP BY 1""",
    "token_bucket": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT u, n, event_id, 2.0::DOUBLE k, t, true ok FROM o WHERE n = 1 UNION ALL
SELECT o.u, o.n, o.event_id, CASE WHEN least(3.0, f.k + (o.t - f.t) / 43200) >= 1 THEN least(3.0, f.k + (o.t - f.t) / 43200) - 1 ELSE least(3.0, f.k + (o.t - f.t) / 43200) END, o.t, least(3.0, f.k + (o.t - f.t) / 43200) >= 1
FROM f JOIN o ON o.u = f.u AND o.n = f.n + 1) SELECT u user_id, event_id, ok accepted FROM f""",
    "rate_limit": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT u, n, event_id, [t] h, true ok FROM o WHERE n = 1 UNION ALL
SELECT o.u, o.n, o.event_id, CASE WHEN len([x for x in f.h if x > o.t - 86400]) < 2 THEN list_append([x for x in f.h if x > o.t - 86400], o.t) ELSE [x for x in f.h if x > o.t - 86400] END, len([x for x in f.h if x > o.t - 86400]) < 2
FROM f JOIN o ON o.u = f.u AND o.n = f.n + 1) SELECT u user_id, event_id, ok accepted FROM f""",
    "alert_cooldown": """WITH RECURSIVE o AS (SELECT event_type r, epoch_us(ts) / 1e6 t, row_number() OVER (PARTITION BY event_type ORDER BY ts) n FROM events WHERE value > 50),
f AS (SELECT r, t, n FROM o WHERE n = 1 UNION ALL SELECT r, t, n FROM (SELECT o.r, o.t, o.n, row_number() OVER (PARTITION BY o.r ORDER BY o.n) k FROM f JOIN o ON o.r = f.r AND o.n > f.n AND o.t - f.t >= 3600) WHERE k = 1)
SELECT r event_type, t AS "at" FROM f""",
    "exponential_ban": """WITH RECURSIVE o AS (SELECT user_id u, event_id, epoch_us(ts) / 1e6 t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events WHERE event_type = 'error'),
f AS (SELECT u, n, event_id, t, [t] h, 0 k, -1e18::DOUBLE til, false ban FROM o WHERE n = 1 UNION ALL
SELECT u, n, event_id, t, CASE WHEN off THEN h WHEN len(x) >= 2 THEN []::DOUBLE[] ELSE x END, CASE WHEN NOT off AND len(x) >= 2 THEN k + 1 ELSE k END, CASE WHEN NOT off AND len(x) >= 2 THEN t + least(864000, 86400 * pow(6, k)) ELSE til END, NOT off AND len(x) >= 2
FROM (SELECT o.u, o.n, o.event_id, o.t, f.h, f.k, f.til, o.t < f.til off, list_append([y for y in f.h if y > o.t - 86400], o.t) x FROM f JOIN o ON o.u = f.u AND o.n = f.n + 1)) SELECT u user_id, event_id FROM f WHERE ban""",
    "bot_rate": """WITH e AS (SELECT user_id u, CAST(floor(epoch(ts)) AS BIGINT) s FROM events), c AS (SELECT a.u, a.s, count(*) n FROM (SELECT DISTINCT u, s FROM e) a JOIN e b ON a.u = b.u AND b.s BETWEEN a.s - 3599 AND a.s GROUP BY 1, 2)
SELECT u user_id, max(n) peak FROM c GROUP BY 1 HAVING max(n) > 2""",
}
SCORES = {
    "consensus_score": f"""WITH {VOTES}, s AS (SELECT claim_id, greatest(0, least(1, ({OF('contradicted', 'weight * confidence')} - 0.5 * {OF('verified', 'weight * confidence')}) / greatest(sum(weight), 1))) s FROM v GROUP BY 1)
SELECT claim_id, round(s, 6) score, CASE WHEN s >= 0.6 THEN 'contradicted' WHEN s >= 0.3 THEN 'likely_contradicted' WHEN s >= 0.1 THEN 'uncertain' ELSE 'verified' END band FROM s""",
    "truth_score": f"""WITH {VOTES}, b AS (SELECT claim_id, verdict, count(*) n, sum(confidence) c, max(weight) r FROM v GROUP BY 1, 2), o AS (SELECT claim_id, sum(n) n, max(n) top, count(*) kinds, sum(c) c, max(r) r FROM b GROUP BY 1),
s AS (SELECT claim_id, round(0.4 * r + 0.3 * c / n + 0.3 * CASE WHEN kinds = 1 THEN 0.9 WHEN kinds = n THEN 0.3 ELSE 0.3 + 0.6 * top / n END, 6) score FROM o)
SELECT claim_id, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END "level" FROM s""",
}


def _mask(x: str) -> str:
    return f"CASE WHEN length({x}) > 7 THEN substr({x}, 1, 3) || repeat('*', length({x}) - 7) || right({x}, 4) ELSE repeat('*', length({x})) END"


def found(rules: tuple[scan.ScanRule, ...], source: str, keys: str, text: str) -> str:
    """Rows of scan_rules: keys, rule, category, severity, confidence, matched."""
    return " UNION ALL ".join(f"SELECT {keys}, '{r.name}' rule, '{r.category}' category, '{r.severity}' severity, {r.confidence}::DOUBLE confidence, unnest(regexp_extract_all({text}, '{r.pattern}', 1)) matched FROM {source}" for r in rules)


def luhn(x: str) -> str:
    digits = f"[CAST(substr({x}, length({x}) - i, 1) AS INTEGER) * (1 + i % 2) for i in range(0, length({x}))]"
    return f"(list_sum([CASE WHEN d > 9 THEN d - 9 ELSE d END for d in {digits}]) % 10 = 0)"


RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
LEAKS = f"""leaks AS (SELECT DISTINCT doc_id, category, matched, confidence FROM ({found(scan.LEAK_RULES, 'documents', 'doc_id', 'text')})
WHERE CASE category WHEN 'card' THEN {luhn('matched')} WHEN 'ip' THEN len([p for p in string_split(matched, '.') if CAST(p AS INTEGER) > 255]) = 0 ELSE true END)"""
CONTENT = f"content AS (SELECT doc_id, category, substr(matched, 1, 20) m, max({RANK}) r FROM ({found(scan.CONTENT_RULES, 'documents', 'doc_id', 'lower(text)')}) GROUP BY 1, 2, 3)"
BIAS = f"bias AS (SELECT doc_id, category, substr(matched, 1, 30) m, max({RANK}) r FROM ({found(scan.BIAS_RULES, 'documents', 'doc_id', 'lower(text)')}) GROUP BY 1, 2, 3)"
SCANS = {
    "scan_leaks": f"WITH {LEAKS} SELECT doc_id, category, {_mask('matched')} masked, confidence FROM leaks",
    "audit_text": f"""WITH {LEAKS}, {CONTENT}, {BIAS}, l AS (SELECT doc_id, count(*) n, max(confidence) c FROM leaks GROUP BY 1), c AS (SELECT doc_id, count(*) n, max(r) r FROM content GROUP BY 1), b AS (SELECT doc_id, count(*) n, max(r) r FROM bias GROUP BY 1)
SELECT doc_id, coalesce(l.n, 0) n_leaks, coalesce(c.n, 0) n_content, coalesce(b.n, 0) n_bias, CASE WHEN coalesce(l.c, 0) >= 0.9 OR coalesce(c.r, 0) >= 3 THEN 'blocked' WHEN coalesce(b.r, 0) >= 3 OR coalesce(l.n, 0) + coalesce(c.n, 0) > 0 THEN 'warning' ELSE 'ok' END status
FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)""",
    "scan_injection": f"""WITH turns AS (SELECT 'turn' kind, conv_id id, CAST(turn AS BIGINT) part, text said FROM conversations UNION ALL SELECT 'page', page_id, 0, html FROM pages), f AS ({found(scan.INJECTION_RULES, 'turns', 'kind, id, part', 'lower(said)')})
SELECT kind, id, part, array_to_string(list_sort(list(DISTINCT category)), ',') reasons, max(confidence) confidence FROM f GROUP BY 1, 2, 3""",
}
TERMS = ("de", "la", "the", "die", "und", "of")
_SEEN = " + ".join(f"max(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END) OVER w" for w in TERMS)
_AGES = [f"lag(s, {k}) OVER p" for k in range(5)]
WORD_LIST = r"[x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> '']"
SESSIONS = {
    "session_drift": f"""WITH a AS (SELECT conv_id, turn, ({_SEEN})::INTEGER seen, CASE WHEN contains(lower(text), 'ignore') OR contains(lower(text), 'system') THEN 1.0 ELSE 0.0 END i, CASE WHEN length(text) > 400 THEN 1.0 ELSE 0.0 END d FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, (0.4 * i + 0.3 * d + CASE WHEN seen >= 4 THEN 0.2 ELSE 0.0 END)::DOUBLE s FROM a),
c AS (SELECT *, lag(s) OVER p l, ({' + '.join(f'coalesce({x}, 0) * {0.7**k!r}' for k, x in enumerate(_AGES))}) t, ({' + '.join(f'CASE WHEN {x} IS NOT NULL THEN {0.7**k!r} ELSE 0 END' for k, x in enumerate(_AGES))}) n FROM b WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, CASE WHEN s > 0.1 AND l > 0.1 THEN 0.5 + 0.1 * (s + l) ELSE t / n END r FROM c) SELECT conv_id, turn, seen, round(s, 6) score, round(r, 6) risk, r >= 0.25 block FROM e""",
    "history_repeat": """WITH g AS (SELECT conv_id, turn, CASE WHEN length(text) >= 3 THEN list_distinct([substr(lower(text), i, 3) for i in range(1, length(text) - 1)]) ELSE [] END g FROM conversations),
b AS (SELECT a.conv_id, a.turn, a.g, flatten(list(b.g)) h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) k FROM g) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) k FROM g) b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 5 AND a.k - 1 GROUP BY 1, 2, 3)
SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 0 ELSE coalesce(len(list_intersect(g, list_distinct(h))), 0) / len(g) END, 6) AS "repeat" FROM b""",
    "self_contradiction": f"""WITH t AS (SELECT conv_id, turn, list_distinct({WORD_LIST}) w FROM conversations), n AS (SELECT *, list_has_any(w, ['not', 'no', 'never', 'ne', 'nicht', 'kein']) neg FROM t WHERE len(w) > 0)
SELECT a.conv_id, a.turn earlier, b.turn later, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) "overlap" FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.neg <> b.neg WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) > 0.5""",
}
