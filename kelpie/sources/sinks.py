"""Sinks: corpora, append-only diagnostics and audit reports. None of them takes a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus(df: DataFrame, path: str, form: str = "json", mode: str = "overwrite") -> None:
    """A corpus as JSON lines or Parquet."""
    df.write.mode(mode).format(form).save(path)


def diagnostics(scanned: DataFrame, path: str, text: str = "text", output: str = "result") -> None:
    """Appends the rewritten text (empty where nothing was rewritten, so never the original) and the types found."""
    r = F.col(output)
    types = F.array_sort(F.array_distinct(F.transform(r["findings"], lambda f: f["type"])))
    scanned.select(F.current_timestamp().alias("ts"), r["decision"].alias("decision"), r["transformed_content"].alias("text"), types.alias("types")).write.mode("append").json(path)


def audit(reports: DataFrame, path: str) -> None:
    """Appends reports as Parquet, in a folder for each decision."""
    reports.write.mode("append").partitionBy("decision").parquet(path)
