"""Suffix-array deduplication by refined buckets of sampled suffixes.

The method dealt is bucket-pointer refinement of all suffixes; what this does instead, and why, is
below under "Method".

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with
a smaller doc_id. Suffixes are put in buckets by their first bytes, and buckets are refined
by the identifiers of later offsets: the identifier of a longer prefix is made from those of
two shorter prefixes at two offsets, again and again up to LENGTH (Refiner.ids). A bucket that
lies in one document only is finished and never refined.

Method: identifiers are hashes, not ranks of a global sort, and only sampled suffixes enter.
Ranks of all suffixes would move each of them in each of the rounds (8, 16, 32, 50 bytes): some
40 bytes of exchange for a byte of text, ten times the disk there is. What decides a removal is
compared by 128 bits (two identifiers of different salts); 64 bits or fewer only decide what is looked at.

Not every suffix is taken up. Of the q-grams of each LENGTH-byte window the one with the
smallest hash is its anchor, so equal windows have their anchors at equal offsets:
1. Anchors are bucketed by their q-gram; only buckets of several documents live on.
2. A living anchor's context (all bytes of the windows it can serve) is its refined bucket.
   Where an earlier document has the same context, all of it is settled at once; where all
   members of a bucket share one context, there is nothing more to refine.
3. What is left (first holders of contexts in mixed buckets, mostly the ends of repeats) has
   each of its windows refined to LENGTH bytes and compared: by short identifiers first, and by
   128 bits where another document may have an equal one.

Exchange: documents are dealt to batches by a hash of their id. In each step a batch sends
its distinct identifiers with the least value seen and a flag for others, packed as byte planes, to
partitions of the identifier space; a partition sorts them and returns a bit for each entry, which the
batch reads in the order in which it sent them (of contexts, it returns those with a smaller value
elsewhere). An identifier is one entry a batch however many documents hold it, so no bucket is
hot. A blob has an entry at least, so blobs never outnumber entries, however large the input.
Positions that a batch needs in the next step travel with it, so hashes are not made anew; each step
puts the batch's texts in the same order first, as rows come from several executors in any. Texts
are shuffled once.

n_long_spans and n_long_bytes tell removed runs of more than WORDS words, whole passages, from
short phrases that many texts share.

Defined cases: null texts are empty; rows with equal doc_id are one place in the order, so
they aren't repeats of each other (each gets its row); a null doc_id comes last; an empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, in_batches, key_of

LENGTH, GRAM, WORDS = 50, 24, 50
#: Bytes of text of a batch and of a partition of identifiers, at least and at most; they grow
#: with the input in between, so that blobs hold many entries for as long as memory allows.
BATCH_BYTES, PART_BYTES = (4_000_000, 12_000_000), (2_000_000, 16_000_000)
MANY_BATCHES, MANY_PARTS = 4_000, 2_000
U = np.uint64
ODD, MIX = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a bucket that is refined by another identifier."""
    x = (a ^ (a >> U(31))) * ODD + b
    x = (x ^ (x >> U(29))) * MIX
    return x ^ (x >> U(32))


def slid(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of x[i : i + width] for each i."""
    out, span = x, 1
    while span * 2 <= width:
        out, span = best(out[:-span], out[span:]), span * 2
    n = len(x) - width + 1
    return best(out[:n], out[width - span : width - span + n]) if span < width else out


class Texts:
    """Texts as one buffer with `pad` zero bytes around each, so that reads of so many bytes beyond a text meet no other.

    They are ordered by key and text, since a shuffle hands a batch's rows to each step in any order and positions must
    mean the same in all steps. `order` has the rows of the table in that order.
    """

    def __init__(self, table: pa.Table, pad: int) -> None:
        texts = pc.fill_null(table.column("text"), "").cast(pa.large_string()).combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        key = table.column("key").combine_chunks()
        self.order = pc.sort_indices(pa.table({"key": key, "text": texts}), sort_keys=[("key", "ascending"), ("text", "ascending")]).to_numpy()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = memoryview(texts.buffers()[2] or b"")
        gap = bytes(pad)
        self.size = np.diff(offsets)[self.order] if len(texts) else np.zeros(0, np.int64)
        parts = [gap]
        for a, b in zip(offsets[:-1][self.order].tolist(), offsets[1:][self.order].tolist()):
            parts += (whole[a:b], gap)
        self.data = b"".join(parts)
        self.start = pad + np.cumsum(np.r_[0, self.size + pad])[:-1].astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.end = self.start + self.size
        self.key = np.array(key, dtype=np.int64)[self.order]
        self.word = np.ndarray((max(0, len(self.data) - 7),), dtype="<u8", buffer=self.data, strides=(1,))

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1


class Refiner:
    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        if not 8 <= gram <= length:
            raise ValueError("the q-gram takes 8 bytes or more, and no more than the string")
        self.length, self.gram, self.left, self.pad = length, gram, length - gram, length + 8

    def ids(self, t: Texts, at: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
        """Bucket identifiers of the first `size` bytes at each position: from identifiers of half the size (a power of two times 8) at two offsets."""
        if size <= 8:
            word = t.word[at] if size == 8 else t.word[at] & U((1 << 8 * size) - 1)
            return mixed(word ^ U(salt), np.full(len(at), size + salt, U))
        half = 8
        while half * 2 < size:
            half *= 2
        return mixed(self.ids(t, at, half, salt), self.ids(t, at + (size - half), half, salt))

    def anchors(self, t: Texts) -> np.ndarray:
        """Positions of the q-grams with the smallest hash of some window."""
        n, width = len(t.data), self.length - self.gram + 1
        if not len(t.size) or int(t.size.max()) < self.length:
            return np.zeros(0, np.int64)
        h, span, rest, done, out = np.frombuffer(t.data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1), 1, self.gram, 0, None
        while rest:
            if rest & 1:
                own = h[done:]
                out = own if out is None else out[: len(own)] * np.uint32(0xC2B2AE35) + own
                done += span
            rest >>= 1
            if rest:
                h = h[:-span] * np.uint32(0x85EBCA6B) + h[span:]
                h ^= h >> np.uint32(15)
                span *= 2
        out = out * np.uint32(0x27D4EB2F)
        out ^= out >> np.uint32(15)
        out |= np.uint32(1)
        least = slid(out, width, np.minimum)
        inside = np.zeros(len(least) + 1, np.int8)
        full = t.size >= self.length
        inside[t.start[full]] += 1
        inside[t.end[full] - self.length + 1] -= 1
        least[np.cumsum(inside[:-1], dtype=np.int8) == 0] = 0
        greatest = slid(np.concatenate((np.zeros(width - 1, np.uint32), least)), width, np.maximum)
        m = min(len(out), len(greatest))
        return np.flatnonzero(out[:m] == greatest[:m])

    def contexts(self, t: Texts, at: np.ndarray, doc: np.ndarray, salt: int = 0) -> np.ndarray:
        """Identifiers of all bytes of the windows that hold the q-gram at each position, ends of the text included."""
        before = np.minimum(at - t.start[doc], self.left).astype(U)
        behind = np.minimum(t.end[doc] - at, self.length).astype(U)
        return mixed(mixed(self.ids(t, at - self.left, self.length, salt), self.ids(t, at, self.length, salt)), before * U(1 << 16) + behind)


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the planes that are zero."""
    p = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    used = p.any(axis=1) if p.size else np.zeros(8, bool)
    return bytes([int(np.packbits(used)[0])]) + p[used].tobytes()


def unplanes(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    used = np.unpackbits(np.array([data[0]], np.uint8)).astype(bool)
    k = int(used.sum())
    p = np.zeros((n, 8), np.uint8)
    p[:, used] = np.frombuffer(data[1 : 1 + k * n], np.uint8).reshape(k, n).T
    return p.view("<u8").ravel(), data[1 + k * n :]


def packed(*columns: np.ndarray, flags: np.ndarray | None = None) -> bytes:
    n = len(columns[0] if columns else flags)
    return n.to_bytes(4, "little") + b"".join(planes(c) for c in columns) + (b"" if flags is None else np.packbits(flags).tobytes())


def unpacked(blob: bytes, n_columns: int) -> list[np.ndarray]:
    """The columns, and the flags if there are any."""
    data = memoryview(blob)
    n, data, out = int.from_bytes(data[:4], "little"), data[4:], []
    for _ in range(n_columns):
        column, data = unplanes(data, n)
        out.append(column)
    return out + ([np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)] if len(data) else [])


def distinct(ids: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the identifiers, and where in it each distinct one begins."""
    order = np.argsort(ids, kind="stable") if more is None else np.lexsort((more, ids))
    s = ids[order]
    new = np.r_[np.ones(min(len(s), 1), bool), s[1:] != s[:-1]]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    return order, np.flatnonzero(new)


def lowest(ids: np.ndarray, values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each identifier the least value of its equals."""
    if not len(ids):
        return values
    order, first = distinct(ids, more)
    out = np.empty_like(values)
    out[order] = np.repeat(np.minimum.reduceat(values[order], first), np.diff(np.r_[first, len(ids)]))
    return out


SENT = "part int, batch int, kind int, blob binary"
NAMES = ["part", "batch", "kind", "blob"]
CARRY = 9
#: Kinds of entries: q-grams, contexts by their q-gram, contexts, windows by short identifiers, windows.
GRAMS, BUCKETS, CONTEXTS, LIKELY, WINDOWS = 1, 2, 3, 4, 5
#: Salt of the second identifier of the kinds of entries whose equality removes text.
SALT, SURE = 0x5851F42D4C957F2D, (CONTEXTS, WINDOWS)
#: Kinds that only decide what is looked at: identifiers have some bits more than the input's size, and a chance equality costs a look.
SHORT, SPARE = (GRAMS, BUCKETS, LIKELY), 4
#: Kinds of which only the batch is compared, as they have no value of their own.
PLAIN = (GRAMS, LIKELY)


class Sent:
    """Rows that a batch sends: entries (identifier, least value, whether there are others) by partition, and what it carries to its next step."""

    def __init__(self, batch: int, parts: int, drop: int = 0) -> None:
        self.batch, self.parts, self.drop, self.rows = batch, parts, drop, []

    def entries(self, kind: int, ids: np.ndarray, values: np.ndarray, more: np.ndarray | None = None) -> None:
        """more: second identifiers."""
        if not len(ids):
            return
        drop = U(self.drop if kind in SHORT else 0)
        ids = ids >> drop
        order, first = distinct(ids, more)
        values = values[order]
        low = np.minimum.reduceat(values, first)
        several, ids = low < np.maximum.reduceat(values, first), ids[order[first]]
        rest = [*([] if kind in PLAIN else [low]), *([] if more is None else [more[order[first]]])]
        to = (((ids << drop) >> U(32)) * U(self.parts)) >> U(32)
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
            self.rows.append((int(to[a]), self.batch, kind, packed(np.diff(ids[a:b], prepend=U(0)), *[x[a:b] for x in rest], flags=several[a:b])))

    def carry(self, slot: int, *columns: np.ndarray) -> None:
        self.rows.append((-1 - self.batch, self.batch, CARRY + slot, packed(*[np.asarray(c).astype(U) for c in columns])))

    def table(self) -> pa.Table:
        return rows_table(self.rows)


def rows_table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=NAMES)


def meet(key: tuple, table: pa.Table) -> pa.Table:
    """In one partition: tell each batch which of its entries have several values, or for SURE kinds a smaller value than its own.

    It is told by a bit for each of its entries, in their order; of contexts, by identifiers and least values.
    """
    rows = list(zip(*(table.column(c).to_pylist() for c in NAMES)))
    if key[0].as_py() < 0:
        return rows_table(rows)
    out = []
    for kind in sorted({r[2] for r in rows}):
        own, sure = [r for r in rows if r[2] == kind], kind in SURE
        blobs = [unpacked(r[3], 1 + (kind not in PLAIN) + sure) for r in own]
        ids = np.concatenate([np.cumsum(b[0], dtype=U) for b in blobs])
        low = np.concatenate([np.full(len(b[0]), r[1], U) if kind in PLAIN else b[1] for r, b in zip(own, blobs)])
        order, first = distinct(ids, np.concatenate([b[2] for b in blobs]) if sure else None)
        times = np.diff(np.r_[first, len(ids)])
        floor, told = np.empty_like(low), np.zeros(len(ids), bool)
        floor[order] = np.repeat(np.minimum.reduceat(low[order], first), times)
        if sure:
            told = floor < low
        else:
            differ = (floor < low) | np.concatenate([b[-1] for b in blobs])
            told[order] = np.repeat(np.logical_or.reduceat(differ[order], first), times)
        at = 0
        for r, b in zip(own, blobs):
            e = slice(at, at + len(b[0]))
            keep, at = told[e], at + len(b[0])
            if kind != CONTEXTS:
                out.append((r[0], r[1], kind, packed(flags=keep)))
            elif keep.any():
                out.append((r[0], r[1], kind, packed(np.diff(ids[e][keep], prepend=U(0)), floor[e][keep], b[2][keep])))
    return rows_table(out)


class Returned:
    """What came back to a batch."""

    def __init__(self, table: pa.Table, drop: int = 0) -> None:
        self.rows, self.drop = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "blob")))), drop

    def told(self, kind: int, ids: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """The bits of the identifiers, which are those that the batch sent."""
        out = np.zeros(len(ids), bool)
        if len(ids):
            order, first = distinct(ids >> U(self.drop if kind in SHORT else 0), more)
            bits = np.concatenate([np.zeros(0, bool), *(unpacked(b, 0)[0] for k, _, b in self.rows if k == kind)])
            if len(bits) != len(first):
                raise RuntimeError("a batch has other identifiers than it sent")
            out[order] = np.repeat(bits, np.diff(np.r_[first, len(ids)]))
        return out

    def found(self, kind: int, ids: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the identifiers came back, and their least values."""
        blobs = [unpacked(b, 3) for k, _, b in self.rows if k == kind]
        if not blobs or not len(ids):
            return np.zeros(len(ids), bool), np.zeros(len(ids), U)
        own, low = np.concatenate([np.cumsum(b[0], dtype=U) for b in blobs]), np.concatenate([b[1] for b in blobs])
        order = np.argsort(own, kind="stable")
        own, low, second = own[order], low[order], np.concatenate([b[2] for b in blobs])[order]
        last = len(own) - 1
        at = np.minimum(np.searchsorted(own, ids), last)
        same = own[at] == ids
        while True:  # identifiers that are equal in the first 64 bits only stand side by side
            step = same & (second[at] != more) & (at < last)
            step &= own[np.minimum(at + 1, last)] == ids
            if not step.any():
                break
            at = at + step
        return same & (second[at] == more), low[at]

    def carried(self, slot: int, n_columns: int) -> list[np.ndarray]:
        for k, _, b in self.rows:
            if k == CARRY + slot:
                return [c.astype(np.int64) for c in unpacked(b, n_columns)]
        return [np.zeros(0, np.int64)] * n_columns


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals, apart from each other."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[cut], end[np.r_[cut[1:], len(start)] - 1]


def stretched(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the intervals."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum())) if len(start) else np.zeros(0, np.int64)


def words_in(t: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that lie in the bytes from start to end, in part at least."""
    blank = np.isin(np.frombuffer(t.data, np.uint8), np.frombuffer(b" \t\n\v\f\r", np.uint8))
    begins = np.r_[False, blank[:-1] & ~blank[1:]]
    count = np.r_[0, np.cumsum(begins)]
    return count[end] - count[start] + (~blank[start] & ~begins[start])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int | None = None, part_bytes: int | None = None, with_bytes: bool = False, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_long_spans, n_long_bytes) of each row of docs; with_bytes: and kept, the bytes left."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key_of(doc_id).alias("key"), F.col(text).alias("text"))
    total = int(own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    between = lambda x, least, most: max(least, min(most, x))
    batch_bytes = batch_bytes or between(total // MANY_BATCHES, *BATCH_BYTES)
    rows = in_batches(own, "text", "key", batch_bytes)
    parts = max(1, -(-total // (part_bytes or between(total // MANY_PARTS, *PART_BYTES))))
    drop = max(0, 64 - SPARE - total.bit_length())
    refine = Refiner(length, gram)
    batch_of = lambda table: table.column("__batch")[0].as_py()
    # values are compared as unsigned integers; shifted keys keep their order
    values = lambda t, doc: t.key[doc].astype(U) + U(1 << 63)

    def bucket(key: tuple, table: pa.Table) -> pa.Table:
        t = Texts(table, refine.pad)
        at = refine.anchors(t)
        sent = Sent(batch_of(table), parts, drop)
        sent.entries(GRAMS, refine.ids(t, at, gram), values(t, t.doc(at)))
        sent.carry(0, np.diff(at, prepend=0))
        return sent.table()

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        t, back = Texts(left, refine.pad), Returned(right, drop)
        at = np.cumsum(back.carried(0, 1)[0])
        ids = refine.ids(t, at, gram)
        live = back.told(GRAMS, ids)
        at, ids = at[live], ids[live]
        doc = t.doc(at)
        context = refine.contexts(t, at, doc)
        sent = Sent(batch_of(left), parts, drop)
        sent.entries(BUCKETS, ids, context)
        sent.entries(CONTEXTS, context, values(t, doc), refine.contexts(t, at, doc, SALT))
        sent.carry(0, np.diff(at, prepend=0))
        return sent.table()

    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        t, back = Texts(left, refine.pad), Returned(right, drop)
        at = np.cumsum(back.carried(0, 1)[0])
        doc = t.doc(at)
        context = refine.contexts(t, at, doc)
        mixed_bucket = back.told(BUCKETS, refine.ids(t, at, gram))
        own, second = values(t, doc), refine.contexts(t, at, doc, SALT)
        several, low = back.found(CONTEXTS, context, second)
        earlier = (several & (low < own)) | (lowest(context, own, second) < own)
        # the windows that hold the q-gram
        first, last = np.maximum(at - refine.left, t.start[doc]), np.minimum(at, t.end[doc] - length)
        sent = Sent(batch_of(left), parts, drop)
        gone = union(first[earlier], last[earlier] + length)
        sent.carry(0, np.diff(gone[0], prepend=0), gone[1] - gone[0])
        open_ = mixed_bucket & ~earlier
        runs = union(first[open_], last[open_] + 1)
        windows = stretched(*runs)
        sent.entries(LIKELY, refine.ids(t, windows, length), values(t, t.doc(windows)))
        sent.carry(1, np.diff(runs[0], prepend=0), runs[1] - runs[0])
        return sent.table()

    def sift(left: pa.Table, right: pa.Table) -> pa.Table:
        t, back = Texts(left, refine.pad), Returned(right, drop)
        steps, sizes = back.carried(1, 2)
        windows = stretched(np.cumsum(steps), np.cumsum(steps) + sizes)
        windows = windows[back.told(LIKELY, refine.ids(t, windows, length))]
        sent = Sent(batch_of(left), parts, drop)
        sent.entries(WINDOWS, refine.ids(t, windows, length), values(t, t.doc(windows)), refine.ids(t, windows, length, SALT))
        sent.carry(0, *back.carried(0, 2))
        sent.carry(1, np.diff(windows, prepend=0))
        return sent.table()

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        t, back = Texts(left, refine.pad), Returned(right, drop)
        steps, sizes = back.carried(0, 2)
        start, end = np.cumsum(steps), np.cumsum(steps) + sizes
        windows = np.cumsum(back.carried(1, 1)[0])
        own, ids, second = values(t, t.doc(windows)), refine.ids(t, windows, length), refine.ids(t, windows, length, SALT)
        hit = windows[back.told(WINDOWS, ids, second) | (lowest(ids, own, second) < own)]
        start, end = union(np.r_[start, hit], np.r_[end, hit + length])
        doc = t.doc(start)
        n = len(t.size)
        removed, spans = np.bincount(doc, end - start, n).astype(np.int64), np.bincount(doc, minlength=n)
        long_ = words_in(t, start, end) > words
        n_long, long_bytes = np.bincount(doc[long_], minlength=n), np.bincount(doc[long_], (end - start)[long_], n).astype(np.int64)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        digests, kept = [], []
        view = memoryview(t.data)
        for d, (a, b) in enumerate(zip(t.start.tolist(), t.end.tolist())):
            pieces, from_ = [], a
            for i in range(bounds[d], bounds[d + 1]):
                pieces.append(view[from_ : start[i]])
                from_ = int(end[i])
            pieces.append(view[from_:b])
            rest = b"".join(pieces)
            digests.append(hashlib.sha256(rest).hexdigest())
            if with_bytes:
                kept.append(rest)
        out = {"doc_id": left.column("doc_id").take(pa.array(t.order)), "n_bytes": t.size, "n_removed": removed, "n_spans": spans.astype(np.int64), "kept_sha256": pa.array(digests, pa.string()), "n_long_spans": n_long.astype(np.int64), "n_long_bytes": long_bytes}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_bytes else {}))

    def returned(sent: DataFrame) -> DataFrame:
        return sent.groupBy("part").applyInArrow(meet, SENT).withColumnRenamed("batch", "__batch").groupBy("__batch")

    step = rows.groupBy("__batch").applyInArrow(bucket, SENT)
    for function in (settle, split, sift):
        step = rows.groupBy("__batch").cogroup(returned(step)).applyInArrow(function, SENT)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_long_spans long, n_long_bytes long" + ", kept binary" * with_bytes
    return rows.groupBy("__batch").cogroup(returned(step)).applyInArrow(apply, schema)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(doc_id, {NO_ID}) AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT rn, k, i, substr(x, 2 * i + 1, {2 * LENGTH}) AS w FROM (SELECT rn, k, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM d)),
hits AS (SELECT rn, i FROM (SELECT *, min(k) OVER (PARTITION BY w) AS first FROM starts) WHERE first < k),
gaps AS (SELECT rn, i, lag(i) OVER (PARTITION BY rn ORDER BY i) AS p FROM hits),
runs AS (SELECT rn, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT rn, i, sum(CASE WHEN p IS NULL OR i > p + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY i) AS g FROM gaps) GROUP BY rn, g),
kept AS (SELECT rn, a, b, coalesce(lag(b) OVER (PARTITION BY rn ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY rn ORDER BY a) IS NULL AS last FROM runs),
counted AS (SELECT runs.rn, b - a AS n, len(list_filter(string_split(regexp_replace(regexp_replace(substr(x, 2 * a + 1, 2 * (b - a)), '(..)', '\1 ', 'g'), '((20|09|0A|0B|0C|0D) )+', '_', 'g'), '_'), lambda s: s <> '')) AS words FROM runs JOIN d USING (rn)),
longs AS (SELECT rn, count(*) AS n, sum(n)::BIGINT AS bytes FROM counted WHERE words > {WORDS} GROUP BY rn),
texts AS (SELECT kept.rn, sum(b - a)::BIGINT AS n, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS x FROM kept JOIN d USING (rn) GROUP BY kept.rn)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(t.n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t.x, d.x))) AS kept_sha256, coalesce(longs.n, 0)::BIGINT AS n_long_spans, coalesce(bytes, 0)::BIGINT AS n_long_bytes
FROM d LEFT JOIN texts t USING (rn) LEFT JOIN longs USING (rn)
"""
