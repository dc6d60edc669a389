"""Queries of the training-text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_prints, langid, mixing, pii_votes, quality, secret_scan, simhash, substring_dedup, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.span_dedup(documents(spark, sf_dir))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_rules(documents(spark, sf_dir)).drop("text")


def op3_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op4_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_prints.with_next(documents(spark, sf_dir))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draws(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return drawn.select("row.doc_id", "copy", "row.source", F.round("rate", 9).alias("rate"), F.col("order").alias("shuffle_key"), "row.text")


OP5_SQL = f"""
WITH {mixing.counts_sql()}
SELECT doc_id, copy::BIGINT AS copy, source, round(rate, 9) AS rate, md5('{mixing.SEED}|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key, text
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn)
"""


def op6_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.find(documents(spark, sf_dir))


def op9_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs, vocabulary("piece_bpe_32k.model")))


QUERIES: dict[str, Query] = {
    "op1_sentence_spans": op1_sentence_spans,
    "op2_line_frequency": op2_line_frequency,
    "op3_bucket_refinement": op3_bucket_refinement,
    "op4_content_chunks": op4_content_chunks,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_bpe_replay": op6_bpe_replay,
    "op7_simhash_index": op7_simhash_index,
    "op8_weak_supervision": op8_weak_supervision,
    "op9_credential_linking": op9_credential_linking,
    "op10_language_id": op10_language_id,
}
SQL: dict[str, str] = {
    "op1_sentence_spans": substring_dedup.SQL,
    "op2_line_frequency": quality.SQL,
    "op3_bucket_refinement": suffix_dedup.SQL,
    "op5_poisson_mixing": OP5_SQL,
    "op9_credential_linking": secret_scan.SQL,
}
