"""Registered queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import category_of, is_high_risk, reason_codes
from ..functions.typing import classify, guess_type, luhn_valid
from ..operators import chat, corpus, evaluate, propose, score, spans
from ..sources import readers
from . import oracle, policy, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
REGEX = {"detector_mode": "regex"}
TEXTS = ("documents", "pages")
KEY = b"a fixed key of the queries"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is read by fewer tasks than there are cores is dealt out anew (only small tables are)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


DOCS = "SELECT doc_id AS rn, doc_id, coalesce(text, '') AS text, lang, source FROM documents"
LEADS = ["Name", "account number", "sort code", "upi id", "otp", "password", "api key", "user id", "PAN", "passport no", "driver's license", "mrn", "policy number", "employee id", "ssn", "national id", "ip address", "mac", "date of birth", "phone"]


_CASES = " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(LEADS))
#: A text with one label for each customer, by its key; the same in both engines.
_TEXT = f"'Note for ' || c_name || '; ' || CASE c_custkey % {len(LEADS)} {_CASES} END || ': ' || c_custkey || '-' || (c_custkey * 7919 + 100000) || ', segment ' || c_mktsegment || '.'"


def one_kind(generator: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.explode_outer(generator(F.col("text"))).alias("d")).where("d.start IS NOT NULL").select("doc_id", F.col("d.start").cast("long").alias("start"), F.col("d.end").cast("long").alias("end"), "d.type")


for _name, _f, _rule in (("secret_findings", spans.secrets, 0), ("email_findings", spans.emails, 1), ("card_findings_luhn", spans.cards, 2)):
    query(_name, f"WITH {oracle.findings(DOCS, [oracle.SHAPES[_rule]])} SELECT rn AS doc_id, a::BIGINT AS start, b::BIGINT AS \"end\", type FROM kept")(partial(one_kind, _f))


@query("token_field_findings", f"WITH {oracle.findings(DOCS, oracle.LABELS)} SELECT rn AS doc_id, a::BIGINT AS start, b::BIGINT AS \"end\", type FROM good")
def token_field_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_kind(spans.fields, spark, sf_dir)


def rows_of(df: DataFrame, key: str) -> DataFrame:
    return scan.findings(df, key).select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "type", "category", "action", "detector")


def findings_sql(source: str, key: str, action: str) -> str:
    return f"WITH {oracle.findings(source)} SELECT rn AS {key}, a::BIGINT AS start, b::BIGINT AS \"end\", type, {oracle.CATEGORY} AS category, '{action}' AS action, detector FROM kept"


@query("document_findings", findings_sql(DOCS, "doc_id", "log"))
def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(scan.audit(table(spark, sf_dir, "documents"), config=REGEX), "doc_id")


@query("field_findings_synthetic", findings_sql(f"SELECT c_custkey AS rn, {_TEXT} AS text FROM customer", "c_custkey", "redact"))
def field_findings_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(scan.redact(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TEXT.replace("''", "\\'")).alias("text")), config=REGEX), "c_custkey")


@query("page_findings", findings_sql("SELECT page_id AS rn, coalesce(html, '') AS text FROM pages", "page_id", "log"))
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(scan.audit(table(spark, sf_dir, "pages"), "html", config=REGEX), "page_id")


def acted(operation: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.scan(table(spark, sf_dir, "documents"), "text", operation, REGEX, KEY)
    r = F.col("result")
    return out.select("doc_id", r["decision"].alias("decision"), r["risk"].alias("risk"), r["metadata"]["finding_count"].cast("long").alias("finding_count"), r["metadata"]["applied_action"].alias("applied_action"), F.array_join(r["reason_codes"], ",").alias("reason_codes"), scan.protected(out).alias("text"))


def acted_sql(operation: str) -> str:
    action = "redact" if operation == "detect" else operation
    replacement = {"redact": "'[' || upper(type) || ']'", "mask": "repeat('*', (b - a)::INT)", "tokenize": oracle.token(KEY)}.get(action, "value")
    extra = " || ',PII_PRESENT_BLOCKED'" if operation == "block" else ""
    return f"""WITH {oracle.findings("SELECT doc_id AS rn, doc_id, text FROM documents")}, {oracle.rewritten(replacement)},
codes AS (SELECT rn, string_agg(code, ',' ORDER BY code){extra} AS codes FROM (SELECT DISTINCT rn, unnest(['PII_' || upper(type), 'PII_' || upper({oracle.CATEGORY})]) AS code FROM kept) GROUP BY rn),
risks AS (SELECT rn, count(*) AS n, {oracle.RISK} AS risk FROM kept GROUP BY rn)
SELECT doc_id, CASE WHEN n > 0 THEN '{policy.DECISIONS[action]}' ELSE 'allow' END AS decision, coalesce(risk, 'none') AS risk, coalesce(n, 0)::BIGINT AS finding_count, CASE WHEN n > 0 THEN '{action}' ELSE 'detect' END AS applied_action,
  coalesce(codes, '') AS reason_codes, coalesce(w.text, d.text) AS text FROM d LEFT JOIN risks USING (rn) LEFT JOIN codes USING (rn) LEFT JOIN rewritten w USING (rn)"""


for _op in policy.OPERATIONS:
    query("detect_default" if _op == "detect" else f"{_op}_documents", acted_sql(_op))(partial(acted, _op))


def kept(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return scan.findings(scan.audit(table(spark, sf_dir, "documents"), config=REGEX), *columns)


@query("findings_by_type", f"WITH {oracle.findings(DOCS)} SELECT type, {oracle.CATEGORY} AS category, count(*) AS n, count(DISTINCT rn) AS docs FROM kept GROUP BY ALL")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "doc_id").groupBy("type", "category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("category_by_lang", f"WITH {oracle.findings(DOCS)} SELECT lang, {oracle.CATEGORY} AS category, count(*) AS n FROM kept JOIN d USING (rn) GROUP BY ALL")
def category_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "doc_id", "lang").groupBy("lang", "category").agg(F.count("*").alias("n"))


@query("risk_by_source", f"WITH {oracle.findings(DOCS)}, r AS (SELECT rn, {oracle.RISK} AS risk FROM kept GROUP BY rn) SELECT source, coalesce(risk, 'none') AS risk, count(*) AS docs FROM d LEFT JOIN r USING (rn) GROUP BY ALL")
def risk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.audit(table(spark, sf_dir, "documents").select("source", "text"), config=REGEX)
    return out.groupBy("source", F.col("result.risk").alias("risk")).agg(F.count("*").alias("docs"))


@query("reason_code_counts", f"WITH {oracle.findings(DOCS)} SELECT code, count(*) AS docs FROM (SELECT DISTINCT rn, unnest(['PII_' || upper(type), 'PII_' || upper({oracle.CATEGORY})]) AS code FROM kept) GROUP BY code")
def reason_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.audit(table(spark, sf_dir, "documents").select("text"), config=REGEX)
    return corpus.counts(out, "result.reason_codes", "code").withColumnRenamed("n", "docs")


@query("pii_by_label", f"WITH {oracle.findings(DOCS)}, n AS (SELECT rn, count(*) AS n FROM kept GROUP BY rn) SELECT quality, toxic, count(*) AS docs, sum(coalesce(n, 0))::BIGINT AS findings FROM labels l JOIN d ON l.doc_id = d.doc_id LEFT JOIN n USING (rn) GROUP BY ALL")
def pii_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    # findings are counted before the join, so no text is shuffled
    counted = scan.audit(table(spark, sf_dir, "documents").select("doc_id", "text"), config=REGEX).select("doc_id", F.size("result.findings").cast("long").alias("n"))
    return table(spark, sf_dir, "labels").join(counted, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.sum("n").alias("findings"))


@query("policy_matches", f"WITH {oracle.findings(DOCS)} SELECT rn AS doc_id FROM kept GROUP BY rn HAVING count(*) FILTER (type IN ('api_key', 'financial') OR ({oracle.CATEGORY}) IN ('api_key', 'financial')) > 0")
def policy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.audit(table(spark, sf_dir, "documents").select("doc_id", "text"), config=REGEX)
    return out.where(scan.policy_matches(out, ["api_key", "financial"])).select("doc_id")


@query("props_scan", f"WITH {oracle.findings('SELECT event_id AS rn, event_type, coalesce(props, ' + chr(39) * 2 + ') AS text FROM events')}, n AS (SELECT rn, count(*) AS n FROM kept GROUP BY rn) SELECT event_type, count(*) AS events, sum(coalesce(n, 0))::BIGINT AS findings FROM d LEFT JOIN n USING (rn) GROUP BY ALL")
def props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.audit(table(spark, sf_dir, "events").select("event_type", "props"), "props", config=REGEX)
    return out.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.size("result.findings")).cast("long").alias("findings"))


PATTERNS = [{"name": "part_brand", "pattern": r"Brand#(?P<value>[0-9]{2})", "category": "personal_data"}, {"name": "steel_goods", "pattern": r"[a-z]+ steel", "ignore_case": True, "category": "government_id", "confidence": 0.4}]


@query("custom_pattern_findings")
def custom_pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return rows_of(scan.redact(parts, config=REGEX | {"custom_patterns": PATTERNS}), "p_partkey")


SQL["custom_pattern_findings"] = r"""
WITH d AS (SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part),
hits AS (SELECT p_partkey, 0 AS seq, 'part_brand' AS type, 'personal_data' AS category, unnest(range(1, len(regexp_extract_all(text, 'Brand#[0-9]{2}')) + 2)) AS i, unnest(string_split_regex(text, 'Brand#[0-9]{2}')) AS g, unnest(regexp_extract_all(text, 'Brand#[0-9]{2}')) AS m FROM d
  UNION ALL SELECT p_partkey, 1, 'steel_goods', 'government_id', unnest(range(1, len(regexp_extract_all(text, '(?i)[a-z]+ steel')) + 2)), unnest(string_split_regex(text, '(?i)[a-z]+ steel')), unnest(regexp_extract_all(text, '(?i)[a-z]+ steel')) FROM d),
placed AS (SELECT p_partkey, seq, type, category, m, sum(length(g)) OVER o + sum(coalesce(length(m), 0)) OVER o AS e FROM hits WINDOW o AS (PARTITION BY p_partkey, seq ORDER BY i))
SELECT p_partkey, (e - CASE seq WHEN 0 THEN 2 ELSE length(m) END)::BIGINT AS start, e::BIGINT AS "end", type, category, 'redact' AS action, 'custom-regex' AS detector FROM placed WHERE m IS NOT NULL
"""

VALUES = {
    "name@site.org": ("email", "email"), "joe.b@okbank": ("upi_id", "email"), "10.2.33.4": ("ip_address", "network"), "aa:bb:cc:dd:ee:0f": ("mac_address", "network"),
    "sk-12345678ab": ("api_key", "secret"), "eyJhbGciOi.x": ("jwt", "secret"), "pass_w0rd!": ("password", "secret"), "3/4/1999": ("date_of_birth", "date"), "12 June 1980": ("date_of_birth", "date"),
    "ABCDE1234F": ("pan", "id"), "123-45-6789": ("ssn", "id"), "K1234567": ("passport", "id"), "MRN-778": ("medical_record", "person"), "Polly Smith": ("health_insurance", "person"), "EMP 99": ("employee_id", "person"), "DL-0042": ("driver_license", "id"),
    "+44 20 7946 0958": ("phone", "phone"), "1234 5678 9012": ("aadhaar", "financial"), "9876543210": ("phone", "financial"), "4155550132": ("financial", "financial"), "4111111111111111": ("payment_card", "financial"), "4111111111111112": ("financial", "financial"),
    "560001": ("postal_code", "address"), "742 Evergreen Terrace": ("address", "address"), "Flat 4": ("address", "address"), "Zoë": ("person_name", "person"), "##": ("personal_data", "secret"), "": ("personal_data", "id"), "1234567": ("personal_data", "id"),
}


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the shapes above, and account balances as text."""
    fixed = spark.createDataFrame([(v,) for v in VALUES], "value string")
    return fixed.select("value", classify(F.col("value")).alias("type"), guess_type(F.col("value")).alias("guess"), category_of(classify(F.col("value"))).alias("category"))


query("classify_values", "SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{a}', '{b}', '{oracle.CATEGORY_OF[a]}')" for v, (a, b) in VALUES.items()) + ") t(value, type, guess, category)")(typed_values)

_D = "(o_orderkey * 7919 + o_custkey * 104729 + 4000000000000)::VARCHAR"


@query("classify_order_numbers", f"SELECT kind AS type, count(*) AS n, sum(valid::INT)::BIGINT AS luhn FROM (SELECT CASE WHEN ({oracle.LUHN}) THEN 'payment_card' ELSE 'financial' END AS kind, ({oracle.LUHN}) AS valid FROM (SELECT {_D} AS n FROM orders)) GROUP BY ALL")
def classify_order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729 + F.lit(4000000000000)).cast("string")
    return table(spark, sf_dir, "orders").select(classify(n).alias("type"), luhn_valid(n).cast("long").alias("v")).groupBy("type").agg(F.count("*").alias("n"), F.sum("v").alias("luhn"))


@query("taxonomy", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', {str(c in oracle.HIGH_RISK).lower()}, 'PII_{t.upper()}{'' if t == c else ',PII_' + c.upper()}')" for t, c in [*oracle.CATEGORY_OF.items(), ("own_kind", "own_kind")]) + ") t(type, category, high_risk, codes)")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("type")
    return spark.createDataFrame([(x,) for x in [*oracle.CATEGORY_OF, "own_kind"]], "type string").select("type", category_of(t).alias("category"), is_high_risk(t).alias("high_risk"), F.array_join(reason_codes(t), ",").alias("codes"))


_TURN = "text || ' Mail me at user' || conv_id || '.' || turn || '@mail.example.com today.'"


@query("latest_user_turn", f"""WITH t AS (SELECT conv_id, turn, role, {_TURN} AS text, role = 'user' AND turn = max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn, role, CASE WHEN last THEN replace(text, 'user' || conv_id || '.' || turn || '@mail.example.com', '[EMAIL]') ELSE text END AS text, coalesce(CASE WHEN last THEN 'redact' END, '-') AS decision FROM t""")
def latest_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.expr(_TURN))
    return chat.guard_turns(turns, config=REGEX).select("conv_id", "turn", "role", "text", F.coalesce("result.decision", F.lit("-")).alias("decision"))


_EVENT = """CASE event_id % 6 WHEN 0 THEN '{"session_id":"s' || user_id || '","prompt":"mail u' || event_id || '@mail.example.com"}' WHEN 1 THEN '{"session_id":"s' || user_id || '","user_input":"hello"}' WHEN 2 THEN '{"session_id":"s' || user_id || '"}' WHEN 3 THEN '{"prompt":7}' WHEN 4 THEN 'not json' ELSE '{"prompt":"","user_input":"mail u@mail.example.com"}' END"""


@query("prompt_guard", """SELECT event_id, CASE WHEN k IN (1, 5) THEN 'allow' ELSE 'block' END AS would_decision, CASE k WHEN 0 THEN 'PII_EMAIL' WHEN 2 THEN 'HOOK_NO_PROMPT_FIELD' WHEN 3 THEN 'HOOK_PROMPT_FIELD_WRONG_TYPE' WHEN 4 THEN 'HOOK_MALFORMED_EVENT' ELSE '' END AS codes, CASE k WHEN 0 THEN 'low' ELSE 'none' END AS risk, CASE WHEN k < 3 THEN 's' || user_id END AS session_id, CASE k WHEN 0 THEN 6 + length(event_id::VARCHAR) + 17 WHEN 1 THEN 5 ELSE 0 END::BIGINT AS content_bytes FROM (SELECT *, event_id % 6 AS k FROM events)""")
def prompt_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.expr(_EVENT).alias("value"))
    out = chat.guard_prompts(events, config=REGEX)
    return out.select("event_id", "would_decision", F.array_join("reason_codes", ",").alias("codes"), "risk", "session_id", F.col("content_bytes").cast("long").alias("content_bytes"))


@query("json_requests", f"""WITH {oracle.findings("SELECT doc_id AS rn, coalesce(text, '') AS text FROM documents")}, n AS (SELECT rn, count(*) AS n FROM kept GROUP BY rn)
SELECT rn::VARCHAR AS request_id, CASE WHEN rn % 5 = 4 THEN 400 ELSE 200 END AS status, CASE WHEN rn % 5 = 4 THEN NULL WHEN n > 0 THEN CASE rn % 5 WHEN 0 THEN 'redact' WHEN 1 THEN 'mask' WHEN 2 THEN 'block' ELSE 'log' END ELSE 'allow' END AS decision, CASE WHEN rn % 5 <> 4 THEN coalesce(n, 0) END::BIGINT AS findings FROM d LEFT JOIN n USING (rn)""")
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    operation = F.get(F.array(*[F.lit(x) for x in ("redact", "mask", "block", "audit", "shred")]), (F.col("doc_id") % 5).cast("int"))
    asked = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("request_id"), operation.alias("operation"), F.col("text").alias("content"))).alias("value"))
    done = scan.execute_json(asked, config=REGEX, key=KEY)
    found = F.from_json("value", "struct<decision:string,findings:array<struct<type:string>>>")
    return done.select("request_id", "status", found["decision"].alias("decision"), F.size(found["findings"]).cast("long").alias("findings"))


# Evaluation: labelled values are first words of benchmark texts, candidates are words of at least eight letters.
_WORDS = "SELECT item_id, text, regexp_extract(text, '[A-Za-z]+', 0) AS value FROM benchmark"


@query("spans_of_values", f"""WITH v AS ({_WORDS}) SELECT item_id, i::BIGINT AS start, (i + length(value))::BIGINT AS "end" FROM (SELECT item_id, text, value, unnest(range(0, length(text))) AS i FROM v WHERE value <> '') WHERE lower(substr(text, i + 1, length(value))) = lower(value)""")
def spans_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark").select("item_id", "text", F.regexp_extract("text", "[A-Za-z]+", 0).alias("value"))
    return own.select("item_id", F.explode(spans.occurrences(F.col("text"), F.col("value"))).alias("s")).select("item_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts with word candidates, a score from each word's length, and gold spans."""
    text = F.col("text")
    words = spans.find_spans(text, "[A-Za-z]{3,}", F.lit(True))
    own = table(spark, sf_dir, "benchmark").select("item_id", "text", F.array(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("pii")).withColumn("spans", words)
    return own.withColumn("scores", F.transform("spans", lambda s: F.least(F.lit(1.0), (s["end"] - s["start"]) / 12.0))).withColumn("gold", evaluate.gold_spans(text, F.col("pii")))


_SCORED = f"""
v AS ({_WORDS}),
hits AS (SELECT item_id, unnest(range(1, len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) + 2)) AS i, unnest(string_split_regex(text, '[A-Za-z]{{3,}}')) AS g, unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS m FROM v),
pieces AS (SELECT item_id, e - length(m) AS a, e AS b, least(1.0::DOUBLE, length(m) / 12.0::DOUBLE) AS p FROM (SELECT *, sum(length(g)) OVER o + sum(coalesce(length(m), 0)) OVER o AS e FROM hits WINDOW o AS (PARTITION BY item_id ORDER BY i)) WHERE m IS NOT NULL),
gold AS (SELECT item_id, i AS a, i + length(value) AS b FROM (SELECT item_id, text, value, unnest(range(0, length(text))) AS i FROM v WHERE value <> '') WHERE lower(substr(text, i + 1, length(value))) = lower(value)),
judged AS (SELECT *, EXISTS (SELECT 1 FROM gold g WHERE g.item_id = p.item_id AND p.a < g.b AND g.a < p.b) AS truth FROM pieces p)"""
_PRF = """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM (%s))"""
_COUNTS = "count(*) FILTER (p >= t AND truth) AS tp, count(*) FILTER (p >= t AND NOT truth) AS fp, count(*) FILTER (p < t AND truth) AS fn, count(*) FILTER (p < t AND NOT truth) AS tn"


@query("piece_metrics", f"WITH {_SCORED} " + _PRF % f"SELECT {_COUNTS} FROM judged, (SELECT 0.5::DOUBLE AS t)")
def piece_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.piece_metrics(evaluate.scored_pieces(scored(spark, sf_dir), ["item_id"]))


@query("threshold_sweep", f"WITH {_SCORED} " + _PRF % f"SELECT t AS threshold, {_COUNTS} FROM judged, (SELECT unnest({evaluate.THRESHOLDS})::DOUBLE AS t) GROUP BY t")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(evaluate.scored_pieces(scored(spark, sf_dir), ["item_id"]))


@query("candidate_recall", f"WITH {_SCORED} SELECT count(*) AS gold, sum(c)::BIGINT AS covered, (count(*) - sum(c))::BIGINT AS n_missed, sum(c) / count(*)::DOUBLE AS recall FROM (SELECT item_id, EXISTS (SELECT 1 FROM gold g JOIN pieces p ON p.item_id = g.item_id AND p.a < g.b AND g.a < p.b WHERE g.item_id = v.item_id)::INT AS c FROM v)")
def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidate_recall(scored(spark, sf_dir))


@query("candidate_overlap_antijoin", f"WITH {_SCORED} SELECT item_id, count(*) AS n FROM judged WHERE NOT truth GROUP BY item_id")
def candidate_overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored(spark, sf_dir).select("item_id", F.size(spans.without(F.col("spans"), F.col("gold"))).cast("long").alias("n"))
    return own.where("n > 0")


@query("value_metrics", f"""WITH {_SCORED}, taken AS (SELECT item_id, a, b, coalesce(lag(b) OVER o, 0) AS before, lead(a) OVER o IS NULL AS last FROM pieces WHERE p >= 0.5 WINDOW o AS (PARTITION BY item_id ORDER BY a)),
m AS (SELECT v.*, coalesce(t, text) AS masked FROM v LEFT JOIN (SELECT item_id, string_agg(substr(text, (before + 1)::BIGINT, (a - before)::BIGINT) || '[PII]' || CASE WHEN last THEN substr(text, (b + 1)::BIGINT) ELSE '' END, '' ORDER BY a) AS t FROM taken JOIN v USING (item_id) GROUP BY item_id) USING (item_id)) """ + _PRF % """SELECT count(*) FILTER (NOT contains(lower(masked), lower(value))) AS tp, 0::BIGINT AS fp, count(*) FILTER (contains(lower(masked), lower(value))) AS fn, 0::BIGINT AS tn, 0::BIGINT AS clean_inputs_touched, 0::BIGINT AS clean_inputs FROM m""")
def value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scored(spark, sf_dir).withColumn("masked", evaluate.masked(F.col("text"), F.col("spans"), F.col("scores"), 0.5)).withColumn("keep", F.array().cast("array<string>"))
    return evaluate.value_metrics(own)


def cheap_spans(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    own = evaluate.scored_pieces(scored(spark, sf_dir), ["item_id"])
    return own.where((F.col("end") - F.col("start")) % 5 != int(share * 10)).select("item_id", "start", "end", (F.col("p") * (1 - share / 10)).alias("p"))


@query("detector_diff", f"""WITH {_SCORED}, a AS (SELECT item_id, a, b, p * (1 - 0.1::DOUBLE / 10) AS p FROM pieces WHERE (b - a) %% 5 <> 1), b AS (SELECT item_id, a, b, p * (1 - 0.2::DOUBLE / 10) AS p FROM pieces WHERE (b - a) %% 5 <> 2)
SELECT CASE WHEN b.p IS NULL THEN 'only_a' WHEN a.p IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS n, round(max(abs(a.p - b.p)), 6) AS max_delta FROM a FULL JOIN b USING (item_id, a, b) GROUP BY ALL""".replace("%%", "%"))
def detector_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = evaluate.compare_detectors(cheap_spans(spark, sf_dir, 0.1), cheap_spans(spark, sf_dir, 0.2), ["item_id", "start", "end"])
    return both.groupBy("side").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("p_a") - F.col("p_b"))), 6).alias("max_delta"))


# Corpora: documents as labelled examples, with labels by their language and source.
_LABELS = ["ipv4", "company_name", "first_name", "date", "age", "url", "postcode", "city", "shoe_size", "phone_number"]
_EX = f"""SELECT doc_id, source, lang, CASE doc_id % 4 WHEN 0 THEN 'intl' ELSE 'us' END AS locale, [{', '.join(repr(x) for x in _LABELS)}][(doc_id % 10 + 1)::INT] AS l1, [{', '.join(repr(x) for x in _LABELS)}][(doc_id // 10 % 10 + 1)::INT] AS l2, md5('20261003|' || doc_id) AS tie FROM documents"""
_IN = lambda x, labels: f"{x} IN ({', '.join(repr(y) for y in labels)})"
_ADOPT = [x for labels in corpus.ADOPT.values() for x in labels]
_BUCKET = lambda x: f"CASE WHEN {_IN(x, _ADOPT)} THEN 'adopt' WHEN {_IN(x, corpus.NEGATIVE)} THEN 'negative' WHEN {_IN(x, corpus.SENSITIVE_LABELS)} THEN 'sensitive' WHEN {_IN(x, corpus.SKIP)} THEN 'skip' ELSE 'unmapped' END"


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, locale, spans): two labelled spans at the start of each text, the second with a wrong offset for every seventh document."""
    labels = F.array(*[F.lit(x) for x in _LABELS])
    value = lambda a, n: F.substring("text", a + 1, n)
    off = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    one = F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), value(0, 2).alias("text"), F.get(labels, (F.col("doc_id") % 10).cast("int")).alias("label"))
    two = F.struct(F.lit(2).alias("start"), (F.lit(4) + off).alias("end"), value(2, 2).alias("text"), F.get(labels, F.expr("doc_id div 10 % 10").cast("int")).alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "intl").otherwise("us").alias("locale"), F.array(one, two).alias("spans"))


_KEEPS = f"""e AS ({_EX}), d2 AS (SELECT e.*, length(d.text) AS len, substr(d.text, 3, 2) AS v2, substr(d.text, 3, CASE WHEN e.doc_id % 7 = 0 THEN 3 ELSE 2 END) = substr(d.text, 3, 2) AS fits FROM e JOIN documents d USING (doc_id)),
c AS (SELECT *, ({_BUCKET('l1')}) AS b1, CASE WHEN fits THEN ({_BUCKET('l2')}) ELSE 'gone' END AS b2 FROM d2),
x AS (SELECT *, (b1 IN ('adopt', 'sensitive'))::INT + (b2 IN ('adopt', 'sensitive'))::INT AS pos, (b1 = 'negative')::INT + (b2 = 'negative')::INT AS neg FROM c)"""
_SCORE = f"""(3 * (CASE WHEN b1 = 'adopt' AND {_IN('l1', corpus.MISSED)} THEN 1 ELSE 0 END + CASE WHEN b2 = 'adopt' AND {_IN('l2', corpus.MISSED)} AND NOT (l2 = l1 AND b1 = 'adopt') THEN 1 ELSE 0 END) + CASE WHEN neg > 0 THEN 14 ELSE 0 END + 2 * least(neg, 4) + CASE WHEN locale = 'intl' THEN 1 ELSE 0 END)"""


@query("convert_examples", f"WITH {_KEEPS} SELECT doc_id, pos::BIGINT AS positives, neg::BIGINT AS negatives, {_SCORE}::BIGINT AS score FROM x WHERE pos + neg > 0 AND len > 0")
def convert_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus.convert(examples(spark, sf_dir))
    points = corpus.example_score(F.col("source_labels"), F.col("keep"), F.col("locale"))
    return own.select("doc_id", F.size("pii_spans").cast("long").alias("positives"), F.size("keep").cast("long").alias("negatives"), points.cast("long").alias("score"))


@query("label_report", f"WITH e AS ({_EX}) SELECT label, ({_BUCKET('label')}) AS bucket, count(*) AS n FROM (SELECT unnest([l1, l2]) AS label FROM e) GROUP BY label")
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.label_report(examples(spark, sf_dir)).select("label", "bucket", "n")


@query("unseen_labels", f"WITH e AS ({_EX}), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b, _ in corpus.label_map()) + ") t(label, bucket)) SELECT * FROM m WHERE label NOT IN (SELECT unnest([l1, l2]) FROM e)")
def unseen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.unseen_labels(examples(spark, sf_dir).select(F.explode("spans.label").alias("label"))).select("label", "bucket")


@query("label_buckets_disjoint", "SELECT 'x' AS label, 0::BIGINT AS buckets WHERE false")
def label_buckets_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.label_overlaps(corpus.label_table(spark))


@query("locale_counts", f"WITH {_KEEPS} SELECT locale, count(*) AS n, sum(neg)::BIGINT AS negatives FROM x WHERE pos + neg > 0 GROUP BY locale")
def locale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.convert(examples(spark, sf_dir)).groupBy("locale").agg(F.count("*").alias("n"), F.sum(F.size("keep")).cast("long").alias("negatives"))


@query("stratified_quota")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stratified(corpus.convert(examples(spark, sf_dir)), "doc_id", 300).select("doc_id", F.col("score").cast("long").alias("score"))


def _quota_sql(n: int = 300) -> str:
    floor = max(20, n // len(corpus.MISSED) // 4)
    has = lambda label: f"((l1 = '{label}' AND b1 = 'adopt') OR (l2 = '{label}' AND b2 = 'adopt'))"
    parts, taken = [], []
    for i, label in enumerate(corpus.MISSED):
        no = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM q{j})" for j in taken)
        parts.append(f"q{i} AS (SELECT doc_id, score FROM s WHERE {has(label)}{no} ORDER BY score DESC, tie LIMIT {floor})")
        taken.append(i)
    every = " UNION ALL ".join(f"SELECT doc_id, score FROM q{j}" for j in taken)
    dated = "((l1 = 'date' AND b1 IN ('adopt', 'sensitive'))::INT + (l2 = 'date' AND b2 IN ('adopt', 'sensitive'))::INT) * 2 > pos"
    return f"""WITH {_KEEPS}, s AS (SELECT *, {_SCORE} AS score FROM x WHERE pos + neg > 0 AND len > 0), {", ".join(parts)}, q AS ({every}),
r AS (SELECT *, ({dated}) AS dated FROM s WHERE doc_id NOT IN (SELECT doc_id FROM q)),
f AS (FROM (SELECT doc_id, score, tie FROM r WHERE NOT dated ORDER BY score DESC, tie LIMIT {n}) UNION ALL FROM (SELECT doc_id, score, tie FROM r WHERE dated ORDER BY score DESC, tie LIMIT {int(n * 0.2)}))
SELECT doc_id, score::BIGINT AS score FROM q UNION ALL SELECT doc_id, score::BIGINT FROM (SELECT * FROM f ORDER BY score DESC, tie LIMIT {n} - (SELECT count(*) FROM q))"""


SQL["stratified_quota"] = _quota_sql()


@query("parity_split", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'test' ELSE 'fit' END AS part FROM documents")
def parity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus.parity_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return own.select("doc_id", F.when(F.col("split") == "test", "test").otherwise("fit").alias("part"))


@query("systematic_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r BETWEEN 0 AND 9 OR r BETWEEN 200 AND 209 OR r BETWEEN 1000 AND 1009")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.systematic(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [0, 200, 1000], 10)


@query("vault_round_trip", "SELECT doc_id, text FROM documents")
def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts tokenized and restored from the vault are the texts."""
    own = scan.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), config=REGEX, key=KEY, vault_column="vault")
    safe = own.select("doc_id", scan.protected(own).alias("text"))
    return scan.detokenize(safe, "text", scan.vault_rows(own, "doc_id"), ["doc_id"]).select("doc_id", F.col("text_restored").alias("text"))


@query("candidates_proposed")
def candidates_proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", propose.candidates(F.col("text")).alias("spans"))
    return own.select("doc_id", F.size("spans").alias("n"))


@query("hybrid_stub")
def hybrid_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scan.audit(table(spark, sf_dir, "documents").select("doc_id", "text"), scorer=score.ShapeScorer())
    return scan.findings(own, "doc_id").groupBy("type", "detector").agg(F.count("*").alias("n"))


@query("trained_scorer")
def trained_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the linear scorer on generated texts it wasn't fitted to (another seed)."""
    pieces = lambda df: df.withColumn("pieces", propose.training_pieces(F.col("text"), F.col("pii_spans")))
    scorer = score.fit_linear(pieces(readers.generate(spark, 1500, 1)))
    held = readers.generate(spark, 1000, 2).withColumn("spans", propose.candidates(F.col("text")))
    held = held.withColumn("scores", score.scores(F.col("text"), F.col("spans"), scorer)).withColumnRenamed("pii_spans", "gold")
    return evaluate.piece_metrics(evaluate.scored_pieces(held, ["index"]))


@query("health", "SELECT 'degraded' AS status, 'kelpie' AS extension, '1.0' AS version, '1.0' AS contract_version")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.health(spark)
