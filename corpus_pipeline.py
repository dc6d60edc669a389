"""A training-data pipeline over documents(doc_id, text, lang, source, n_chars).

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir), where docs is what
the stage before it kept, and returns a DataFrame. All but the last return the columns of
documents. Each is one operator of kelpie.llm with production parameters:

1. language_id: documents in which no language can be told (no letter) go, also where no
   language was learned.
2. near_dedup: of each component of near-duplicates the document with the smallest id stays;
   rows that repeat an id are one document (of its texts that aren't near copies of a smaller
   id's the smallest stays), and a document without an id is known by its text, after all others.
3. secret_scan: secrets, and weak parts of credentials that are linked, are replaced in the
   texts; no document goes.
4. source_mix: documents are repeated by Poisson counts so that each source has equal weight,
   and put in the order of a hash.
5. bpe: texts are encoded; the result is one row for each row kept, with its ids' digest and
   the digest of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import bpe, entries, langid, mixing, secret_scan, simhash
from kelpie.llm.common import saved

#: SQL can't express the hashes and models of stages 1, 2 and 5.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, entries.vocabulary("piece_bpe_32k.model"))
    return langid.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast(clean.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs, added=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, entries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_redaction),
    ("source_mix", source_mix),
    ("bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what a stage keeps is checkpointed for the next one."""
    docs = entries.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else saved(docs), sf_dir)
    return docs
