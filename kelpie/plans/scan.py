"""Scanning a text column: detections, decisions and rewritten texts for whole tables."""

from __future__ import annotations

import json
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rewrite import detokenized, rewritten, token_key, vault
from ..functions.taxonomy import category_of
from ..functions.typing import classify
from ..operators import custom, propose, score
from ..operators.pure import find_all, rewrite_all
from ..operators.spans import DETECTION, cards, emails, fields, resolved, secrets, without
from . import policy

NONE = f"array<{DETECTION}>"
KEEP = "__kelpie_"


def deterministic(text: Column) -> Column:
    """Detections by shape and by label; built-in functions only."""
    return F.concat(secrets(text), emails(text), cards(text), fields(text))


@lru_cache(maxsize=8)
def _native(name: str, context: str) -> Column:
    """deterministic() of a column, built once a Spark context: the expression is large, and each of its parts is a call to the JVM."""
    return deterministic(F.col(name))


def native(df: DataFrame, name: str) -> Column:
    return _native(name, df.sparkSession.sparkContext.applicationId)


def detections(df: DataFrame, text: str, settings: policy.Settings, scorer: score.Scorer | None = None, edges: frozenset[str] | None = None) -> DataFrame:
    """df with __kelpie_found (resolved detections), __kelpie_error and __kelpie_text (null texts as empty).

    In regex mode without patterns no Python runs. A pattern that runs out of time puts its message in __kelpie_error.
    """
    out = df.withColumn(f"{KEEP}text", F.coalesce(F.col(text), F.lit("")))
    value = F.col(f"{KEEP}text")
    if settings.patterns:
        out = out.withColumn(f"{KEEP}custom", custom.detections(value, settings.patterns))
        out = out.withColumn(f"{KEEP}error", F.col(f"{KEEP}custom.error")).withColumn(f"{KEEP}all", F.concat(F.col(f"{KEEP}custom.found"), native(df, f"{KEEP}text"))).drop(f"{KEEP}custom")
    else:
        out = out.withColumn(f"{KEEP}error", F.lit(None).cast("string")).withColumn(f"{KEEP}all", native(df, f"{KEEP}text"))
    found = F.col(f"{KEEP}all")
    if settings.detector_mode == "hybrid":
        if scorer is None:
            raise policy.ScorerMissing("hybrid mode takes a scorer; regex mode needs none")
        out = out.withColumn(f"{KEEP}spans", propose.candidates(value, edges))
        out = out.withColumn(f"{KEEP}open", without(F.col(f"{KEEP}spans"), found))
        out = out.withColumn(f"{KEEP}scores", score.scores(value, F.col(f"{KEEP}open"), scorer))
        scored = F.arrays_zip(F.col(f"{KEEP}open").alias("span"), F.col(f"{KEEP}scores").alias("p"))
        kept = F.filter(scored, lambda s: s["p"] >= settings.threshold)

        def judged(s: Column) -> Column:
            kind = classify(F.substring(value, s["span"]["start"] + 1, s["span"]["end"] - s["span"]["start"]))
            return F.struct(s["span"]["start"].alias("start"), s["span"]["end"].alias("end"), kind.alias("type"), F.round(s["p"], 4).alias("confidence"), F.lit("scorer").alias("detector"), category_of(kind).alias("category"), F.lit(300).alias("seq"))

        out = out.withColumn(f"{KEEP}all", F.concat(found, F.transform(kept, judged))).drop(f"{KEEP}spans", f"{KEEP}open", f"{KEEP}scores")
    final = resolved(F.col(f"{KEEP}all"))
    if settings.min_confidence > 0:
        final = F.filter(final, lambda d: d["confidence"] >= settings.min_confidence)
    return out.withColumn(f"{KEEP}found", final).drop(f"{KEEP}all")


def outcome(settings: policy.Settings, operation: str, key: bytes, value: Column, found: Column, error: Column) -> Column:
    """The result struct of an operation on texts whose detections are known."""
    action = policy.action_of(operation, settings)
    fine = error.isNull()
    decided = F.when(fine, policy.decision(found, action))
    finding = F.transform(found, lambda d: F.struct(d["type"].alias("type"), d["category"].alias("category"), d["start"].alias("start"), d["end"].alias("end"), F.lit(policy.DECISIONS[action]).alias("action"), d["confidence"].alias("confidence"), d["detector"].alias("detector")))
    content = F.when(fine & (F.size(found) > 0), rewritten(value, found, action, key)) if action in policy.REWRITES else F.lit(None).cast("string")
    matches = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda d: d["detector"] == "custom-regex"), lambda d: d["type"])))
    metadata = F.struct(
        F.lit(settings.detector_mode).alias("detector_mode"), F.lit(settings.threshold).alias("threshold"), F.when(F.size(found) > 0, action).otherwise("detect").alias("applied_action"),
        F.size(found).alias("finding_count"), F.lit(len(settings.patterns)).alias("custom_patterns"), matches.alias("custom_matches"),
    )
    return F.struct(decided.alias("decision"), F.when(fine, policy.risk(found)).alias("risk"), finding.alias("findings"), content.alias("transformed_content"), policy.codes(found, operation).alias("reason_codes"), metadata.alias("metadata"), error.alias("error"))


def scan(df: DataFrame, text: str = "text", operation: str = "detect", config: dict[str, Any] | None = None, key: bytes | None = None, scorer: score.Scorer | None = None, output: str = "result", vault_column: str | None = None, edges: frozenset[str] | None = None) -> DataFrame:
    """df with a result struct: decision, risk, findings, transformed_content, reason_codes, metadata and error.

    Findings never hold the matched text. A null text has the decision allow and no transformed content. A text on which
    a custom pattern ran out of time has an error, no decision and no content. vault_column: also an array of
    (token, value) for the tokenize action; keep it apart from results.
    """
    settings = policy.resolve_config(config)
    action = policy.action_of(operation, settings)
    key = key if key is not None else token_key()
    out = detections(df, text, settings, scorer, edges)
    value, found, error = F.col(f"{KEEP}text"), F.col(f"{KEEP}found"), F.col(f"{KEEP}error")
    out = out.withColumn(output, outcome(settings, operation, key, value, found, error))
    if vault_column:
        entries = vault(value, found, key) if action == "tokenize" else F.array().cast("array<struct<token:string,value:string>>")
        out = out.withColumn(vault_column, entries)
    return out.drop(f"{KEEP}text", f"{KEEP}found", f"{KEEP}error")


def of(operation: str) -> Any:
    def run(df: DataFrame, text: str = "text", **options: Any) -> DataFrame:
        return scan(df, text, operation, **options)

    run.__name__, run.__doc__ = operation, f"scan() with the operation {operation}."
    return run


detect, redact, mask, tokenize, block, audit = map(of, policy.OPERATIONS)


def findings(scanned: DataFrame, *keys: str, output: str = "result") -> DataFrame:
    """One row for each finding, after the key columns.

    The outer form: from the inner one the optimizer infers a filter on the array's size, below which all of it is computed twice.
    """
    return scanned.select(*keys, F.explode_outer(f"{output}.findings").alias("f")).where("f.start IS NOT NULL").select(*keys, "f.*")


def vault_rows(scanned: DataFrame, *keys: str, column: str = "vault") -> DataFrame:
    return scanned.select(*keys, F.explode(column).alias("v")).select(*keys, "v.token", "v.value")


def detokenize(df: DataFrame, text: str, vaults: DataFrame, keys: list[str], output: str = "text_restored") -> DataFrame:
    """df with the tokens of each row replaced by the values of the vault rows with equal keys. An empty vault is an error of the caller's."""
    if vaults.isEmpty():
        raise ValueError("there is no vault to restore from")
    entries = vaults.groupBy(*keys).agg(F.collect_list(F.struct("token", "value")).alias(f"{KEEP}entries"))
    none = F.array().cast("array<struct<token:string,value:string>>")
    return df.join(entries, keys, "left").withColumn(output, detokenized(F.col(text), F.coalesce(f"{KEEP}entries", none))).drop(f"{KEEP}entries")


def protected(scanned: DataFrame, text: str = "text", output: str = "result") -> Column:
    """The rewritten text, or the original where nothing was rewritten."""
    return F.coalesce(scanned[output]["transformed_content"], scanned[text])


def summary(scanned: DataFrame, *keys: str, output: str = "result") -> DataFrame:
    """What a tool reports of each row: decision, risk, found, types, reason codes, mode, and the text or a note that there is none."""
    r = F.col(output)
    return scanned.select(
        *keys, r["decision"].alias("decision"), r["risk"].alias("risk"), (F.size(r["findings"]) > 0).alias("found"),
        F.array_sort(F.array_distinct(F.transform(r["findings"], lambda f: f["type"]))).alias("types"), r["reason_codes"].alias("reason_codes"),
        r["metadata"]["detector_mode"].alias("mode"), F.coalesce(r["transformed_content"], F.lit("No personal data was found.")).alias("text"),
        (r["decision"] == "block").alias("blocked"),
    )


def policy_matches(scanned: DataFrame, wanted: list[str], output: str = "result") -> Column:
    """Whether a rule that names types or categories applies to a row."""
    names = F.array(*[F.lit(w) for w in wanted])
    return F.exists(scanned[output]["findings"], lambda f: F.array_contains(names, f["type"]) | F.array_contains(names, f["category"]))


REQUEST = "request_id string, user_id string, extension string, operation string, content string, source string, agent_id string, session_id string, config map<string,string>, metadata map<string,string>, payload map<string,string>"
SOURCES = ["user_prompt", "llm_response", "tool_call", "tool_result", "memory_read", "memory_write", "rag_document", "file", "api"]


def execute_json(df: DataFrame, value: str = "value", config: dict[str, Any] | None = None, key: bytes | None = None, version: str | None = None) -> DataFrame:
    """(request_id, status, value): JSON requests to JSON results, for batches and streams.

    Status 200, or 400 for a request that is not JSON or has an unknown operation. Only the major part of a contract
    version has to be 1; none passes. Vaults never leave. All requests of a job share its config. The requests are read and
    scanned once, whatever their operations.
    """
    if version is not None and version.split(".")[0] != "1":
        raise ValueError("the contract's major version is 1")
    settings, key = policy.resolve_config(config), key if key is not None else token_key()
    asked = df.select(F.from_json(F.col(value), REQUEST).alias("q")).select("q.*")
    known = F.col("operation").isin(policy.OPERATIONS)
    own = detections(asked.select("request_id", F.when(known, F.col("operation")).alias("operation"), F.when(known, F.col("content")).alias("content")), "content", settings)
    body = F.lit(None).cast("string")
    for operation in policy.OPERATIONS:
        done = outcome(settings, operation, key, F.col(f"{KEEP}text"), F.col(f"{KEEP}found"), F.col(f"{KEEP}error"))
        body = F.when(F.col("operation") == operation, F.to_json(done)).otherwise(body)
    return own.select("request_id", F.when(F.col("operation").isNull(), 400).otherwise(200).alias("status"), body.alias("value"))


def health(spark: SparkSession, scorer: score.Scorer | None = None) -> DataFrame:
    """One row: ok with a scorer, else degraded."""
    return spark.createDataFrame([("ok" if scorer else "degraded", "kelpie", "1.0", "1.0")], "status string, extension string, version string, contract_version string")


def register_sql(spark: SparkSession, key: bytes | None = None) -> None:
    """SQL functions pii_redact, pii_mask, pii_tokenize and pii_detect (JSON of findings) in regex mode.

    They run the plain Python model of the engine in Arrow batches; the DataFrame functions, which stay in the JVM, are
    the main way.
    """
    key = key if key is not None else token_key()
    for action in policy.REWRITES:
        spark.udf.register(f"pii_{action}", F.udf(lambda t, a=action: rewrite_all(t, a, key), "string", useArrow=True))
    spark.udf.register("pii_detect", F.udf(lambda t: None if t is None else json.dumps([{"start": a, "end": b, "type": k} for a, b, k in find_all(t)]), "string", useArrow=True))


__all__ = ["audit", "block", "detect", "detections", "detokenize", "execute_json", "findings", "health", "mask", "policy_matches", "protected", "redact", "register_sql", "scan", "summary", "tokenize", "vault_rows"]
