"""Secret scans by multipart credential linking, by DataFrame functions only.

Base spans (kinds assign, access, hex) are always reported. Parts of credentials are weak on
their own: an access identifier, a secret (a mixed run of 24 characters or more) and an
endpoint. They are joined by intervals within scopes of SCOPE code points inside a text, and
a weak part is reported only where complementary parts co-occur: a secret near an identifier
or an endpoint, an identifier near a secret, an endpoint near a secret and an identifier.
Base spans take part: access as an identifier, assign and hex as secrets. Weak parts that
overlap base spans aren't reported again.

All is computed inside each row, so nothing is shuffled.

Defined cases: a null or empty text has no spans (its digest is that of no bytes); equal
starts are ordered by kind; repeated rows each get their row; an empty table gives an empty
result. Parts that overlap don't complement each other (a long mixed path of a URL is no secret
near an endpoint). `scan` reads only id and text; `redact` keeps all columns, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import apart_from, found, marked, near, ordered, replaced, written

SCOPE = 200
# The base kinds' patterns, in the order of kinds.
KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = KEYWORD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
# Parts: shapes without a boundary look-around, so that they mean the same in any engine.
IDENTIFIER = r"""(?i:user|user_?name|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
SECRET = r"[A-Za-z0-9+/]{24,}={0,2}"
ENDPOINT = r"""(?:https?|ftps?|sftp|s3|amqps?|mysql|postgres(?:ql)?|mongodb|redis|jdbc:[a-z]+)://[^\x00-\x20"'<>]+"""
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]


def spans_of(docs: DataFrame, text: Column) -> DataFrame:
    """docs, whose columns the caller has named, with __base and __all: arrays of structs (k1, k2, kind, start, end), ordered."""
    pairs = text.contains("=") | text.contains(":")
    assign = F.filter(found(text, ASSIGN, pairs), lambda s: F.length(F.regexp_replace(s["value"], "^" + KEYWORD, "")) >= 8)
    access = F.filter(found(text, ACCESS, text.contains("AKIA")), lambda s: F.length(s["value"]) >= 16)
    out = docs.withColumn("__assign", assign).withColumn("__access", access).withColumn("__hex", found(text, "(?<![0-9a-f])" + HEX, text.rlike("[0-9a-f]{32}")))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    alone = F.filter(found(text, "(?<![A-Za-z0-9+/])" + SECRET, text.rlike("[A-Za-z0-9+/]{24}")), mixed)
    out = out.withColumn("__sec", alone).withColumn("__id", found(text, IDENTIFIER, pairs)).withColumn("__end", found(text, ENDPOINT, text.contains("://")))
    base = F.concat("__assign", "__access", "__hex")
    ids, secrets, ends = F.concat("__id", "__access"), F.concat("__sec", "__assign", "__hex"), F.col("__end")
    linked = [near(F.col("__id"), secrets, SCOPE), near(F.col("__sec"), F.concat(ids, ends), SCOPE), near(near(ends, secrets, SCOPE), ids, SCOPE)]
    own = [marked(F.col(c), KINDS[i], i) for i, c in enumerate(("__assign", "__access", "__hex"))]
    weak = [marked(apart_from(x, base), KINDS[3 + i], 3 + i) for i, x in enumerate(linked)]
    return out.withColumn("__base", ordered(*own)).withColumn("__all", ordered(F.col("__base"), *weak)).drop("__sec", "__id", "__end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = spans_of(own, F.col("text"))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced in the text; all other columns as they are."""
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = spans_of(own, F.col("text"))
    clean = F.when(F.size("__all") > 0, replaced(F.col("text"), F.col("__all"), by)).otherwise(F.col("row")[text])
    return out.withColumn("text", clean).select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def _hits(kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT rn, '{kind}' AS kind, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 2)) AS i, unnest(string_split_regex(text, '{p}')) AS g, unnest(regexp_extract_all(text, '{p}')) AS m FROM d"


_NEAR = f"s.rn = o.rn AND s.a <= o.b + {SCOPE} AND o.a <= s.b + {SCOPE} AND (o.b <= s.a OR o.a >= s.b)"
_KW = KEYWORD.replace("'", "''")
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_hits(k, p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT)))}),
placed AS (SELECT rn, kind, m, b - length(m) AS a, b FROM (SELECT *, (sum(length(g)) OVER o + sum(coalesce(length(m), 0)) OVER o)::BIGINT AS b FROM hits WINDOW o AS (PARTITION BY rn, kind ORDER BY i)) WHERE m IS NOT NULL),
parts AS (SELECT *, list_position({KINDS}, kind) AS r FROM placed WHERE CASE kind
  WHEN 'assign' THEN length(regexp_replace(m, '^{_KW}', '')) >= 8 WHEN 'access' THEN length(m) >= 16
  WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') ELSE true END),
base AS (SELECT * FROM parts WHERE r <= 3),
weak AS (SELECT * FROM parts s WHERE r > 3 AND NOT EXISTS (SELECT 1 FROM base o WHERE s.rn = o.rn AND s.a < o.b AND o.a < s.b) AND CASE kind
  WHEN 'identifier' THEN EXISTS (SELECT 1 FROM parts o WHERE o.kind IN ('secret', 'assign', 'hex') AND {_NEAR})
  WHEN 'secret' THEN EXISTS (SELECT 1 FROM parts o WHERE o.kind IN ('identifier', 'access', 'endpoint') AND {_NEAR})
  ELSE EXISTS (SELECT 1 FROM parts o WHERE o.kind IN ('secret', 'assign', 'hex') AND {_NEAR}) AND EXISTS (SELECT 1 FROM parts o WHERE o.kind IN ('identifier', 'access') AND {_NEAR}) END),
sums AS (SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) AS s FROM base GROUP BY rn),
alls AS (SELECT rn, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) AS s FROM (FROM base UNION ALL FROM weak) GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(sums.s, '')) AS base_sha256, coalesce(alls.s, '') AS spans
FROM d LEFT JOIN sums USING (rn) LEFT JOIN alls USING (rn)
"""
