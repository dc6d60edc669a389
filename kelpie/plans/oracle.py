"""DuckDB SQL that states the regex mode's rules a second time, for comparison with the queries.

RE2 has no look-around, so boundaries are tested on the neighbouring characters of a match.
"""

from __future__ import annotations

from ..functions.taxonomy import CATEGORY_OF, HIGH_RISK
from ..operators.spans import FIELDS

W = r"[\p{L}\p{N}_]"
SHAPES = [
    (100, "secret", "regex", r"sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    (101, "email", "regex", r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"),
    (102, "payment_card", "regex", r"\b(?:[0-9][ -]?){12,18}[0-9]\b"),
]
LABELS = [(200 + i, kind, "field-regex", rf"(?i)\b(?:{label})\b\s*(?::|=|is|-)?\s+([^\s,;]+(?:[ -][0-9]{{2,}}){{0,3}})") for i, (label, kind) in enumerate(FIELDS)]


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def hits(rules: list[tuple[int, str, str, str]], source: str = "d") -> str:
    parts = []
    for seq, kind, detector, p in rules:
        q = quoted(p)
        parts.append(f"SELECT rn, {seq} AS seq, '{kind}' AS type, '{detector}' AS detector, unnest(range(1, len(regexp_extract_all(text, '{q}')) + 2)) AS i, unnest(string_split_regex(text, '{q}')) AS g, unnest(regexp_extract_all(text, '{q}')) AS m, {'unnest(regexp_extract_all(text, ' + chr(39) + q + chr(39) + ', 1))' if seq >= 200 else 'NULL::VARCHAR'} AS v FROM {source}")
    return " UNION ALL ".join(parts)


LUHN = "list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * substr(reverse(n), i, 1)::INT) // 10 + (2 * substr(reverse(n), i, 1)::INT) % 10 ELSE substr(reverse(n), i, 1)::INT END)) % 10 = 0"
SECRETS = ", ".join(f"'{t}'" for t, c in CATEGORY_OF.items() if c == "secret")
CATEGORY = "CASE type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in CATEGORY_OF.items() if t != c) + " ELSE type END"
HIGH = ", ".join(f"'{c}'" for c in HIGH_RISK)


def findings(source: str, rules: list[tuple[int, str, str, str]] | None = None) -> str:
    """CTEs d(rn, ...), all_found and kept(rn, a, b, type, detector, value, n): resolved findings of the relation `source`, which has the columns rn and text."""
    rules = SHAPES + LABELS if rules is None else rules
    return rf"""
d AS MATERIALIZED ({source}),
hits AS ({hits(rules)}),
placed AS (SELECT rn, seq, type, detector, m, v, (sum(length(g)) OVER o + sum(coalesce(length(m), 0)) OVER o)::BIGINT AS e FROM hits WINDOW o AS (PARTITION BY rn, seq ORDER BY i)),
spans AS (
  SELECT rn, seq, type, detector, e - length(m) AS a, e AS b, m AS value, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM placed WHERE m IS NOT NULL AND seq < 200
  UNION ALL SELECT rn, seq, type, detector, e - length(v), e - length(v) + length(rtrim(v, '.:!?''")]}}>')), rtrim(v, '.:!?''")]}}>'), '' FROM placed WHERE m IS NOT NULL AND seq >= 200),
good AS (
  SELECT s.* FROM spans s JOIN d USING (rn) WHERE CASE
    WHEN seq >= 200 AND type IN ({SECRETS}) THEN length(value) >= 6 AND lower(value) NOT IN ('closed', 'expired', 'reset')
    WHEN seq >= 200 THEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4
    WHEN type = 'payment_card' THEN ({LUHN}) AND NOT regexp_matches(substr(d.text, b + 1, 1), '{W}') AND NOT (a > 0 AND regexp_matches(substr(d.text, a, 1), '{W}'))
    WHEN type = 'secret' THEN NOT (a > 0 AND regexp_matches(substr(d.text, a, 1), '{W}')) ELSE true END),
swept AS (SELECT rn, list_reduce(list_transform(list({{'a': a, 'b': b, 'type': type, 'detector': detector, 'value': value}} ORDER BY a, a - b, seq), lambda x: [x]), lambda acc, x: CASE WHEN x[1].a < acc[-1].b THEN acc ELSE acc || x END) AS f FROM good GROUP BY rn),
kept AS (SELECT rn, x.a AS a, x.b AS b, x.type AS type, x.detector AS detector, x.value AS value, n FROM (SELECT rn, len(f)::INT AS n, unnest(f) AS x FROM swept))"""


def rewritten(replacement: str) -> str:
    """CTE rewritten(rn, text), after findings(); replacement: SQL over the columns of kept."""
    return f"""
gaps AS (SELECT k.*, d.text, coalesce(lag(b) OVER o, 0) AS before, lead(a) OVER o IS NULL AS last FROM kept k JOIN d USING (rn) WINDOW o AS (PARTITION BY k.rn ORDER BY k.a)),
rewritten AS (SELECT rn, string_agg(substr(text, before + 1, a - before) || ({replacement}) || CASE WHEN last THEN substr(text, b + 1) ELSE '' END, '' ORDER BY a) AS text FROM gaps GROUP BY rn)"""


def token(key: bytes) -> str:
    """SQL for the keyed token of value and type (keys up to 64 bytes)."""
    padded = key.ljust(64, b"\0")
    inner, outer = ("".join(f"{b ^ x:02X}" for b in padded) for x in (0x36, 0x5C))
    return f"'<' || upper(type) || '_' || substr(sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode(value)))))), 1, 12) || '>'"


RISK = f"CASE WHEN count(*) FILTER (({CATEGORY}) IN ({HIGH})) > 0 THEN 'high' WHEN count(*) > 1 THEN 'medium' ELSE 'low' END"
