"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes; a chunk ends where the hash has zeros in a mask
(normalised: a longer mask up to the normal size, a shorter one from there on; at least
SMALLEST and at most LARGEST bytes). A boundary depends on the 16 bytes before it alone, so
an edit changes the chunks around it and no others. The fingerprint is the sorted set of the
chunks, each as 8 hex digits of its digest and 2 of its length. Likeness is containment: the
bytes of shared chunks over the bytes of the smaller set; two empty sets are alike (1), an
empty and another one aren't (0).

`with_next` compares each document with the next one in descending order of ids and with a
text edited by it. Documents are dealt to ranges of ids by bounds from quantiles; each range
is sorted and streamed, and gets a copy of the first document of the following range, so one
shuffle of the texts serves all. Only the ranges' bounds and first ids reach the driver.

Defined cases: a null text is an empty one; equal ids are ordered by their texts, descending;
a null doc_id comes first, as the largest id; the only document is its own next one; an empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, key_of, text_batches

SMALLEST, NORMAL, LARGEST = 8, 32, 128
STRICT, LOOSE = np.uint32(0x3F << 22), np.uint32(0xF << 22)
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 1) for i in range(256)], dtype=np.uint32)
#: Bytes of text a range holds, and the most ranges (which bounds what the driver gathers).
RANGE_BYTES, MOST_RANGES = 2_000_000, 20_000


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for span in (1, 2, 4, 8):
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
    marks = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[marks] & STRICT) == 0).tolist()
    marks = (marks + 1).tolist()
    out, start, at = [], 0, 0
    while n - start > SMALLEST:
        end = min(start + LARGEST, n)
        at = bisect_left(marks, start + SMALLEST, at)
        for k in range(at, len(marks)):
            m = marks[k]
            if m >= end:
                break
            if strict[k] or m - start >= NORMAL:
                end = m
                break
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(text: str | None) -> np.ndarray:
    """Sorted distinct numbers digest * 256 + length."""
    data = (text or "").encode()
    ends = cuts(data)
    digest = xxhash.xxh32_intdigest
    found = [digest(data[a:b]) << 8 | b - a for a, b in zip([0, *ends], ends)]
    return np.unique(np.array(found, dtype=np.uint64))


def written(chunk: np.ndarray) -> str:
    return chunk.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = lambda x: int((x & np.uint64(255)).sum())
    return weight(np.intersect1d(a, b, assume_unique=True)) / min(weight(a), weight(b))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row of docs."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(rows, 4_000_000):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([written(chunks(t)) for t in column(part, "text")], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def above(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds (descending) are greater than the key, by two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    size = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    whole = F.size(F.filter(longs([b[-1] for b in blocks]), lambda x: x > key))
    rest = F.coalesce(F.get(F.array(*[longs(b) for b in blocks]), whole), F.array().cast("array<bigint>"))
    return whole * F.lit(size) + F.size(F.filter(rest, lambda x: x > key))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    Edited: the last half (rounded down) of the code points is replaced by as many of the next document's first ones.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key_of(doc_id).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-int(total) // range_bytes)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = own.approxQuantile("key", shares, min(0.01, 0.2 / ranges)) if shares else []
    bounds = sorted({min(int(b), 2**63 - 1) for b in bounds}, reverse=True)
    placed = own.withColumn("part", above(F.col("key"), bounds))
    heads = sorted((r.part, r.head) for r in placed.groupBy("part").agg(F.max("key").alias("head")).collect())
    follows = [(part, heads[(i + 1) % len(heads)][1]) for i, (part, _) in enumerate(heads)]
    following = F.broadcast(docs.sparkSession.createDataFrame(follows, "of int, head long"))  # a row for each range
    guests = own.join(following, F.col("key") == F.col("head")).select("doc_id", "key", "text", F.col("of").alias("part"), F.lit(True).alias("guest"))
    rows = placed.withColumn("guest", F.lit(False)).select("doc_id", "key", "text", "part", "guest").unionByName(guests)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for part in text_batches(batches, 2_000_000):
            out = []
            for place, guest, i, t in zip(*(column(part, c) for c in ("part", "guest", "doc_id", "text"))):
                if guest and (last is None or last[0] != place):
                    continue  # the range's last document has met its next one
                own = chunks(t)
                if last is not None and last[0] == place:
                    _, j, before, fp = last
                    half = len(before) // 2
                    edited = before[: len(before) - half] + t[:half]
                    new = chunks(edited)
                    out.append((j, len(before), hashlib.sha256(edited.encode()).hexdigest(), written(fp), written(new), likeness(fp, new), likeness(fp, own)))
                last = None if guest else (place, i, t, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    ordered = rows.repartition("part").sortWithinPartitions("part", "guest", F.col("key").desc(), F.col("text").desc())
    return ordered.select("part", "guest", "doc_id", "text").mapInArrow(run, SCHEMA)
