"""Guards of conversations and prompts: the latest user turn, chat payloads, prompt events, reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import KEEP, protected, scan

PAYLOAD_FIELDS = ["prompt", "user_input"]


def latest_user_turn(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> Column:
    """Whether a row is its conversation's last one of the role user."""
    last = F.row_number().over(Window.partitionBy(conversation, F.col(role).eqNullSafe(F.lit("user"))).orderBy(F.col(turn).desc()))
    return F.col(role).eqNullSafe(F.lit("user")) & (last == 1)


def guard_turns(df: DataFrame, text: str = "text", conversation: str = "conv_id", turn: str = "turn", role: str = "role", operation: str = "redact", config: dict[str, Any] | None = None, **options: Any) -> DataFrame:
    """df with the text of each conversation's latest user turn rewritten and all others as they are; and result, of that turn only.

    The latest turn comes from an aggregate (at most one row a conversation a task) and meets the turns by conversation
    and turn, which spreads the turns of a long conversation over the tasks. Rows of the role user that share a
    conversation's latest turn are all rewritten; a null turn is never the latest.
    """
    users = df.where(F.col(role) == "user").groupBy(F.col(conversation).alias(f"{KEEP}c")).agg(F.max(turn).alias(f"{KEEP}t"))
    latest = F.col(conversation).eqNullSafe(F.col(f"{KEEP}c")) & (F.col(turn) == F.col(f"{KEEP}t"))
    joined = df.join(users, latest, "left").withColumn(f"{KEEP}last", F.coalesce(F.col(role) == "user", F.lit(False)) & F.col(f"{KEEP}t").isNotNull())
    part = scan(joined.withColumn(f"{KEEP}in", F.when(F.col(f"{KEEP}last"), F.col(text))), f"{KEEP}in", operation, config, **options)
    new = F.when(F.col(f"{KEEP}last"), protected(part, f"{KEEP}in")).otherwise(F.col(text))
    return part.withColumn(text, new).withColumn("result", F.when(F.col(f"{KEEP}last"), F.col("result"))).drop(f"{KEEP}c", f"{KEEP}t", f"{KEEP}last", f"{KEEP}in")


BLOCKS = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def guard_payloads(df: DataFrame, key: str, messages: str = "messages", config: dict[str, Any] | None = None) -> DataFrame:
    """df (its key is unique) with the text blocks of each payload's last user message redacted; other blocks, turns and columns as they are."""
    is_user = lambda m: m["role"].eqNullSafe(F.lit("user"))
    flags = F.transform(F.col(messages), is_user)
    last = F.when(F.exists(F.col(messages), is_user), F.size(messages) - F.array_position(F.reverse(flags), True).cast("int")).otherwise(F.lit(None))
    marked = df.withColumn(f"{KEEP}last", last)
    blocks = marked.select(F.col(key).alias(f"{KEEP}k"), F.posexplode(F.get(F.col(messages), F.col(f"{KEEP}last"))["content"]).alias(f"{KEEP}i", f"{KEEP}b"))
    safe = scan(blocks.withColumn(f"{KEEP}v", F.when(F.col(f"{KEEP}b.type") == "text", F.col(f"{KEEP}b.text"))), f"{KEEP}v", "redact", config)
    new = F.struct(F.col(f"{KEEP}b.type").alias("type"), F.coalesce("result.transformed_content", f"{KEEP}b.text").alias("text"))
    types = F.transform("result.findings", lambda f: f["type"])
    whole = safe.select(f"{KEEP}k", F.struct(F.col(f"{KEEP}i").alias("i"), new.alias("b")).alias("x"), types.alias("t")).groupBy(f"{KEEP}k").agg(F.array_sort(F.collect_list("x")).alias(f"{KEEP}x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("finding_types"))
    joined = marked.join(whole, F.col(key) == F.col(f"{KEEP}k"), "left")
    content = F.transform(f"{KEEP}x", lambda x: x["b"])
    rebuilt = F.transform(F.col(messages), lambda m, i: F.when((i == F.col(f"{KEEP}last")) & F.col(f"{KEEP}x").isNotNull(), F.struct(m["role"].alias("role"), content.alias("content"))).otherwise(m))
    return joined.withColumn(messages, rebuilt).withColumn("finding_types", F.coalesce("finding_types", F.array().cast("array<string>"))).drop(f"{KEEP}last", f"{KEEP}k", f"{KEEP}x")


def prompts(df: DataFrame, event: str = "value") -> DataFrame:
    """df with prompt and prompt_error of JSON events: the field prompt, else user_input; a missing field isn't an empty prompt.

    prompt_error: malformed_event, no_prompt_field, prompt_field_wrong_type, or null.
    """
    parsed = F.try_parse_json(F.col(event))
    kind = lambda name: F.schema_of_variant(F.try_variant_get(F.col(f"{KEEP}v"), f"$.{name}", "variant"))
    out = df.withColumn(f"{KEEP}v", parsed)
    whole = F.schema_of_variant(F.col(f"{KEEP}v"))
    value, error = F.lit(None).cast("string"), F.lit("no_prompt_field")
    for name in reversed(PAYLOAD_FIELDS):
        there = kind(name).isNotNull()
        value = F.when(there, F.when(kind(name) == "STRING", F.try_variant_get(F.col(f"{KEEP}v"), f"$.{name}", "string"))).otherwise(value)
        error = F.when(there, F.when(kind(name) != "STRING", "prompt_field_wrong_type")).otherwise(error)
    malformed = F.col(f"{KEEP}v").isNull() | ~F.coalesce(whole.startswith("OBJECT"), F.lit(False))
    return out.withColumn("prompt", F.when(~malformed, value)).withColumn("prompt_error", F.when(malformed, "malformed_event").otherwise(error)).drop(f"{KEEP}v")


def guard_prompts(df: DataFrame, event: str = "value", enforce: bool = True, config: dict[str, Any] | None = None, session: str = "$.session_id", agent: str = "agent") -> DataFrame:
    """df with decision and would_decision (block or allow) and the columns of a report; no column holds prompt text.

    Whatever can't be read is blocked. Without enforcement decision is allow, and would_decision says what it had been.
    """
    read = prompts(df, event)
    out = scan(read.withColumn(f"{KEEP}p", F.col("prompt")), f"{KEEP}p", "redact", config)
    found = F.col("result.findings")
    failed = F.coalesce(F.col("prompt_error"), F.when(F.col("result.error").isNotNull(), "detector_failed"))
    would = F.when(failed.isNotNull() | (F.size(found) > 0), "block").otherwise("allow")
    types = F.array_sort(F.array_distinct(F.transform(found, lambda f: f["type"])))
    codes = F.when(failed.isNotNull(), F.array(F.concat(F.lit("HOOK_"), F.upper(failed)))).otherwise(F.transform(types, lambda t: F.concat(F.lit("PII_"), F.upper(t))))
    return (
        out.withColumn("would_decision", would)
        .withColumn("decision", F.col("would_decision") if enforce else F.lit("allow"))
        .withColumn("risk", F.coalesce(F.nullif(F.col("result.risk"), F.lit("none")), F.when(F.size(types) > 0, "high").otherwise("none")))
        .withColumn("reason_codes", codes)
        .withColumn("finding_types", types)
        .withColumn("finding_count", F.size(found))
        .withColumn("content_bytes", F.coalesce(F.octet_length("prompt"), F.lit(0)))
        .withColumn("session_id", F.get_json_object(F.col(event), session))
        .withColumn("agent_id", F.lit(agent))
        .drop("prompt", "prompt_error", "result", f"{KEEP}p", event)
    )


def reports(scanned: DataFrame, keys: list[str], text: str = "text", operation: str = "redact", output: str = "result") -> DataFrame:
    """Metadata of executions for an audit sink: no text, no hash of it."""
    r = F.col(output)
    types = F.array_sort(F.array_distinct(F.transform(r["findings"], lambda f: f["type"])))
    return scanned.select(
        *keys, F.lit("kelpie").alias("extension"), F.lit(operation).alias("operation"), r["decision"].alias("decision"), r["decision"].alias("would_decision"), r["risk"].alias("risk"),
        F.transform(types, lambda t: F.concat(F.lit("PII_"), F.upper(t))).alias("reason_codes"), types.alias("finding_types"), F.size(r["findings"]).alias("finding_count"), F.coalesce(F.octet_length(text), F.lit(0)).alias("content_bytes"),
    )
