"""Structured Streaming: a stateless guard that fails closed, and a count of findings by session and time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import scan


def guarded(stream: DataFrame, text: str = "text", operation: str = "redact", config: dict[str, Any] | None = None, key: bytes | None = None) -> DataFrame:
    """The stream with status and a safe text. Statuses: clean, rewritten, or refused (blocked, or a pattern ran out of time).

    A refused message has a null text; the original text is in no column.
    """
    out = scan(stream, text, operation, config, key)
    r = F.col("result")
    refused = r["error"].isNotNull() | (r["decision"] == "block")
    status = F.when(F.coalesce(refused, F.lit(True)), "refused").when(r["transformed_content"].isNotNull(), "rewritten").otherwise("clean")
    types = F.array_sort(F.array_distinct(F.transform(r["findings"], lambda f: f["type"])))
    safe = F.when(F.col("status") != "refused", F.coalesce(r["transformed_content"], F.col(text)))
    return out.withColumn("status", status).withColumn(text, safe).withColumn("finding_types", types).drop("result")


def start_guard(stream: DataFrame, passed: str, refused: str, checkpoint: str, text: str = "text", operation: str = "redact", config: dict[str, Any] | None = None, key: bytes | None = None, once: bool = False) -> StreamingQuery:
    """Writes messages that may pass and those refused to two Parquet folders.

    Each micro-batch has a folder of its own, overwritten when it is run again, so a lost driver or executor
    doesn't repeat messages. An error ends the query; nothing of that batch passes.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.where("status <> 'refused'").write.mode("overwrite").parquet(f"{passed}/batch={number}")
            held.where("status = 'refused'").write.mode("overwrite").parquet(f"{refused}/batch={number}")
        finally:
            held.unpersist()

    writer = guarded(stream, text, operation, config, key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_counts(reports: DataFrame, time: str = "ts", session: str = "session_id", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Messages, findings and blocks by session and window of event time. Late rows beyond the watermark are dropped by Spark (an extension: the engine itself has no windows)."""
    return reports.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), session).agg(F.count("*").alias("messages"), F.sum("finding_count").alias("findings"), F.sum((F.col("decision") == "block").cast("int")).alias("blocked"))
