"""Helpers shared by the training-text operators.

Every operator first selects the columns it needs under its own names; those that return all
columns of the input carry them as one struct. So extra columns of the input, whatever they are
called, can't clash with working columns.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents without an id are ordered after all others, as one place.
NO_ID = 2**63 - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one batch holds in operators that deal whole batches to tasks.
BATCH_BYTES = 12_000_000


def key_of(doc_id: str | Column = "doc_id") -> Column:
    """The place of a document in the order of ids, never null."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(NO_ID))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="kelpie-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_batches(rows: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of record batches such that each list has about `limit` bytes or one row."""
    for batch in rows:
        if batch.num_rows == 0:
            continue
        per_row = max(1, batch.nbytes // batch.num_rows)
        step = max(1, limit // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def give_back() -> None:
    """Return memory that earlier tasks of this worker freed to the system, where its C library can (others keep it for later use)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def in_batches(docs: DataFrame, text: str, key: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs and a column __batch: a hash of the key over as many values as the texts' bytes ask for.

    The number of batches follows the input, so a batch stays as small at any size.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    n = max(1, -(-int(total) // batch_bytes))
    return docs.withColumn("__batch", F.pmod(F.xxhash64(F.lit(n), F.col(key)), F.lit(n)).cast("int"))
