"""SimHash near-duplicates by multi-index hashing.

Fingerprint: A-Z are lowered, words are runs of characters other than space and \\t to \\r,
every shingle of four words (repeats included; fewer words: all of them) is hashed by XXH64
with seed 42, and a bit is 1 if it is set in over half the hashes. No word: fingerprint 0.

Fingerprints that differ in 4 bits or fewer are linked. The 64 bits are cut into segments;
two such fingerprints differ in at most RADIUS bits of some segment. Each distinct
fingerprint enters the table of each segment under its value, and probes the values of a
small Hamming ball around it (a flip of bits is probed by the one of a pair that has 0 at
the lowest flipped bit, the other one would only find the pair again). Entries of a key meet
in sorted runs, where full distances are verified in blocks of arrays; of the links of a run
only a spanning forest is emitted, so a group of n copies gives about n rows, not n squared.
A key with more than DENSE table entries isn't compared at all: its fingerprints are linked
through midpoints (two fingerprints are within 4 bits if and only if some value is within 2
bits of both), which takes 2,081 rows a fingerprint whatever the group's size.

Components are found by alternating stars on distinct fingerprints only.

Defined cases: null and empty texts have fingerprint 0; a null doc_id counts as the largest
id, and a component of such rows only has a null component_id; repeated rows each get their
row; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, column, key_of, saved, text_batches
from .components import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: Table entries of a key from which links are found through midpoints.
DENSE = 30_000
#: Distinct fingerprints from which two segments and radius 2 replace three and radius 1.
MANY = 1 << 26
PAIRS = 2_000_000


def fingerprint(text: str | None) -> int:
    """Of one text, as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - WORDS + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """(doc_id, key, fp): fp is the fingerprint's 64 bits as a signed long. A column `mark` of longs comes along as it is."""
    marks = [mark] if mark else []

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(rows, 8_000_000):
            found = np.array([fingerprint(t) for t in column(part, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(found), *map(part.column, marks)], names=["doc_id", "key", "fp", *marks])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), key_of(doc_id).alias("key"), F.col(text).alias("text"), *marks).mapInArrow(run, "doc_id long, key long, fp long" + "".join(f", {m} long" for m in marks))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) with the same components as the links a, b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def verify(values: np.ndarray, starts: np.ndarray, tables: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of each run. values: by run, table entries before probes; starts, tables: the run's start and table entries, for each value."""
    order = np.arange(len(values))
    counts = np.minimum(order - starts, tables)
    ends = np.cumsum(counts)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = counts[at:to]
        left = np.repeat(order[at:to], n)
        right = np.repeat(starts[at:to] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        near = np.bitwise_count(values[left] ^ values[right]) <= distance
        if near.any():
            yield spanning(values[left[near]].view(np.int64), values[right[near]].view(np.int64))
        at = to


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]


def index_entries(distinct: DataFrame, widths: list[int], radius: int) -> DataFrame:
    """(slot, probe, fp): the table entry (probe 0) and the probes (1) of each fingerprint in each segment's index."""
    def entries(s: int, width: int, offset: int) -> Column:
        value = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1)).cast("long")
        entry = lambda v, probe: F.struct((v + F.lit(s << 40)).alias("slot"), F.lit(probe).alias("probe"))
        if not radius:
            return F.array(entry(value, 0))
        flips = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
        probed = F.filter(flips, lambda m: value.bitwiseAND(m.bitwiseAND(-m)) == 0)
        return F.concat(F.array(entry(value, 0)), F.transform(probed, lambda m: entry(value.bitwiseXOR(m), 1)))

    made = [entries(s, width, sum(widths[:s])) for s, width in enumerate(widths)]
    return distinct.select("fp", F.explode(F.concat(*made)).alias("e")).select("e.slot", "e.probe", "fp")


def links(distinct: DataFrame, distance: int = DISTANCE, dense: int = DENSE, many: int = MANY) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints within the distance."""
    parts = distance // 2 + 1 if distinct.count() <= many else max(1, -(-(distance + 1) // 3))
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    entries = index_entries(distinct, widths, distance // parts)

    def alone(fp: np.ndarray) -> pa.RecordBatch:
        own = pa.array(np.unique(fp))
        return pa.RecordBatch.from_arrays([own, pa.nulls(len(own), pa.int64())], names=["a", "b"])

    def compared(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The links of whole runs."""
        slot, probe, fp = map(np.concatenate, zip(*parts))
        if not len(slot):
            return
        first = np.r_[True, slot[1:] != slot[:-1]]
        run_of = np.cumsum(first) - 1
        begin, table = np.flatnonzero(first), np.bincount(run_of, weights=probe == 0).astype(np.int64)
        wide = (table > dense)[run_of]
        if wide.any():
            yield alone(fp[wide])
        keep = ~wide & (table[run_of] > 0)
        shift = np.cumsum(~keep)[begin] - (~keep)[begin]
        for a, b in verify(fp[keep].view(np.uint64), (begin - shift)[run_of][keep], table[run_of][keep], distance):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, ...]] = []  # whole runs, and the one that may go on
        size, open_slot, entered, full = 0, None, 0, False
        for batch in rows:
            if not batch.num_rows:
                continue
            slot, probe, fp = (np.asarray(batch.column(i)) for i in range(3))
            if full:  # the open run is dense: its rows are passed on as they come
                end = int(np.searchsorted(slot, open_slot, side="right"))
                if end:
                    yield alone(fp[:end])
                slot, probe, fp, full = slot[end:], probe[end:], fp[end:], end == len(slot)
                if full:
                    continue
                open_slot = None
            cut = int(np.searchsorted(slot, slot[-1]))
            if slot[-1] != open_slot:
                rest.append((slot[:cut], probe[:cut], fp[:cut]))
                size += cut
                if size > 200_000:
                    yield from compared(rest)
                    rest, size = [], 0
                open_slot, entered = slot[-1], 0
            else:
                cut = 0
            entered += int((probe[cut:] == 0).sum())
            rest.append((slot[cut:], probe[cut:], fp[cut:]))
            size += len(slot) - cut
            if entered > dense:
                for s, _, f in rest:
                    yield alone(f[s == open_slot])
                yield from compared([(s[s != open_slot], p[s != open_slot], f[s != open_slot]) for s, p, f in rest])
                rest, size, full = [], 0, True
        if rest:
            yield from compared(rest)

    found = saved(entries.repartition("slot").sortWithinPartitions("slot", "probe").mapInArrow(run, "a long, b long"))
    # each pair within the distance shares a value within half of it; all fingerprints at such a value go to its least one
    steps = F.array(F.lit(0), *[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in ball(64, distance // 2)])
    wide = found.where("b IS NULL").select("a").distinct()
    if wide.isEmpty():
        return found
    if distance % 2:
        raise ValueError("dense keys are linked through midpoints, which takes an even distance")
    middle = wide.select("a", F.explode(steps).alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("m"))
    least = middle.groupBy("m").agg(F.min("a").alias("b"), F.max("a").alias("c")).where("b < c").select(F.col("m").alias("n"), "b")
    return found.where("b IS NOT NULL").unionByName(middle.join(least, F.col("m") == F.col("n")).where("a <> b").select("a", "b").distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, dense: int = DENSE, many: int = MANY, doc_id: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_key) of each row of docs, and its mark."""
    prints = saved(fingerprints(docs, doc_id, text, mark))
    least = prints.groupBy("fp").agg(F.min("key").alias("low"))
    roots = components(links(least.select("fp"), distance, dense, many))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # the components' smallest ids are written down, so that the join has two plain sides and Spark can split a large component
    lows = saved(rooted.groupBy("root").agg(F.min("low").alias("component")).withColumnRenamed("root", "of"))
    named = rooted.join(lows, F.col("root") == F.col("of")).select(F.col("fp").alias("print"), "component")
    digits: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, F.col("fp") == F.col("print")).select("doc_id", digits.alias("fingerprint"), F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"), F.col("component").alias("component_key"), *([mark] if mark else []))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Rows of docs, with all their columns: one document of each component, the one with the smallest id.

    Rows that repeat an id are one document; of those of its texts that aren't near copies of
    a smaller id's the smallest stays. A row without an id is known by its text, after all ids
    below 2^62.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    by_text = F.shiftrightunsigned(hashed, 2).bitwiseOR(F.lit(1 << 62))
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(doc_id).cast("long"), by_text).alias("id"), hashed.alias("mark"))  # the text is in the row only, so it is moved and sorted once
    own = F.col("row").getField(text)
    first = near_duplicates(named.select("id", own.alias("text"), "mark"), distance, doc_id="id", text="text", mark="mark").where("doc_id = component_id").groupBy(F.col("doc_id").alias("first")).agg(F.collect_set("mark").alias("same"))
    kept = named.join(first, (F.col("id") == F.col("first")) & F.array_contains("same", F.col("mark")), "left_semi")  # by id alone, as the groups are: texts are shuffled once
    return kept.groupBy("id").agg(F.min_by("row", F.struct(own.isNull(), own)).alias("row")).select("row.*")
