"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes the distinct pre-tokens of a block of its documents that it hasn't met yet,
lays their bytes out in one array, and keeps an inverted index from merge rank (the pair of
neighbours that joins to that token) to positions. Ranks are replayed in ascending order
over all words of the block at once; a merge touches its two neighbours only, whose new
pairs enter the index. A pair is any two neighbours whose bytes together are a token, as in
tiktoken; if a merge makes a pair of lower rank, that rank is taken up again first.

Words are independent, so replaying per block gives the ids of a replay over the whole
corpus, without a shuffle. Memory: a block's words and a worker's table of at most CACHE
words and CACHE_BYTES bytes of words, emptied when it is full.

Defined cases: a null text is an empty one (0 tokens, digests of no bytes); repeated rows
each get their row; a word of any length is merged in n log n steps; an empty table gives
an empty result. Only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, give_back, text_batches

# Fixed value: the usual pattern, and one that matches the same in texts of COMMON characters.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAME = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
COMMON = re.compile(r"[\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")

BLOCK_BYTES = 1_000_000
CACHE, CACHE_BYTES = 400_000, 12_000_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Merges:
    """Ranks of a vocabulary file (lines of base64 token and rank), and the pairs that merge."""

    def __init__(self, lines: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.shift = max(1, len(self.tokens).bit_length())
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.laid = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        self.ranks = ranks
        self.known: dict[str, bytes] = {}  # words met so far by this worker
        self.held = 0  # bytes of those words
        self.byte_pairs = np.full((256, 256), -1, dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << self.shift | b] = rank
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        pairs, shift, byte_ids, ranks = self.pairs, self.shift, self.byte_ids, self.ranks
        get = pairs.get
        lone = [ranks.get(w, -1) for w in words]  # a word that is a token is that token
        sizes = np.array([1 if r >= 0 else len(w) for w, r in zip(words, lone)], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(words) else 0
        raw = np.frombuffer(b"".join(b"\0" if r >= 0 else w for w, r in zip(words, lone)), dtype=np.uint8)
        first, single = np.array(byte_ids, dtype=np.int64)[raw], np.array(lone, dtype=np.int64)
        whole = single >= 0
        first[ends[whole] - 1] = single[whole]
        # pairs of single bytes, by rank
        inner = np.ones(n, bool)
        inner[ends[sizes > 0] - 1] = False
        at = np.flatnonzero(inner)
        found = self.byte_pairs[raw[at], raw[at + 1]] if n else at
        at, found = at[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        at, found = at[order].tolist(), found[order]
        cut = np.flatnonzero(np.diff(found, prepend=-1)).tolist() + [len(at)]
        index: dict[int, list[int]] = {int(found[a]): at[a:b] for a, b in zip(cut, cut[1:])} if at else {}
        ids, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        for end in ends[sizes > 0].tolist():
            after[end - 1] = -1
            if end < n:
                before[end] = -1
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            lower = False
            for k, p in enumerate(places):
                a = ids[p]
                if a < 0 or (q := after[p]) < 0 or get(a << shift | ids[q]) != rank:
                    continue
                ids[p], ids[q] = rank, -1
                after[p] = nxt = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    r = get(rank << shift | ids[nxt])
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(heap, r)
                        lower |= r < rank
                prev = before[p]
                if prev >= 0:
                    r = get(ids[prev] << shift | rank)
                    if r is not None:
                        if r in index:
                            index[r].append(prev)
                        else:
                            index[r] = [prev]
                            heapq.heappush(heap, r)
                        lower |= r < rank
                if lower:
                    index.setdefault(rank, []).extend(places[k + 1 :])
                    heapq.heappush(heap, rank)
                    break
        flat = np.array(ids, dtype=np.int64)
        alive = flat >= 0
        left = np.concatenate(([0], np.cumsum(alive)))
        packed = flat[alive].astype("<u4").tobytes()
        out, start = [], 0
        for end in left[ends].tolist():
            out.append(packed[4 * start : 4 * end])
            start = end
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids as replay() gives them, gathered from all tokens laid end to end."""
        own = np.frombuffer(ids, dtype="<u4")
        n = self.sizes[own]
        ends = np.cumsum(n)
        if not len(own):
            return b""
        return self.laid[np.repeat(self.starts[own] - ends + n, n) + np.arange(int(ends[-1]))].tobytes()


class Sent:
    """The vocabulary file as workers get it, by a broadcast; what a worker makes of it goes when Spark drops the broadcast there."""

    def __init__(self, lines: bytes) -> None:
        self.lines, self.made = lines, None

    def __getstate__(self) -> dict:
        return {"lines": self.lines, "made": None}

    def merges(self) -> Merges:
        if self.made is None:
            give_back()
            self.made = Merges(self.lines)
        return self.made


def sent(spark: SparkSession, vocabulary: str) -> Broadcast[Sent]:
    """The file, of a fixed size, read on the driver."""
    return spark.sparkContext.broadcast(Sent(read_ranks(vocabulary)))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern. Texts of common characters are split by an equal expression that runs faster."""
    import regex

    slow = regex.compile(pattern).findall
    if pattern != PATTERN:
        return slow
    common, fast = COMMON.fullmatch, SAME.findall
    return lambda text: fast(text) if common(text) else slow(text)


def encoder(ranks: Broadcast[Sent], pattern: str, finish: Callable[[Merges, object, bytes], tuple], schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split = ranks.value.merges(), splitter(pattern)
        known = merges.known
        for part in text_batches(rows, BLOCK_BYTES):
            docs = [split(t) if t else [] for t in column(part, "text")]
            met = set(chain.from_iterable(docs))
            new = list(met.difference(known))
            words = [w.encode() for w in new]
            if len(known) + len(new) > CACHE or merges.held + sum(map(len, words)) > CACHE_BYTES:
                known.clear()
                merges.held, new = 0, list(met)
                words = [w.encode() for w in new]
            merges.held += sum(map(len, words))
            known.update(zip(new, merges.replay(words)))
            look = known.__getitem__
            done = [finish(merges, i, b"".join(map(look, words))) for i, words in zip(column(part, "doc_id"), docs)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text. The file is read on the driver and sent along; its size is fixed."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    finish = lambda _, i, ids: (i, np.frombuffer(ids, dtype="<u4").tolist())
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encoder(sent(docs.sparkSession, vocabulary), pattern, finish, schema), "doc_id long, ids array<long>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); a null list is an empty one."""
    ranks, schema = sent(encoded.sparkSession, vocabulary), pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ranks.value.merges().tokens
        for part in text_batches(rows, 4 * BLOCK_BYTES):
            done = [b"".join(tokens[i] for i in ids or ()) for ids in column(part, "ids")]
            yield pa.RecordBatch.from_arrays([pa.array(column(part, "doc_id"), pa.int64()), pa.array(done, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and, from the ids alone, decoded in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(merges: Merges, i: object, ids: bytes) -> tuple:
        return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(merges.decode(ids)).hexdigest()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encoder(sent(docs.sparkSession, vocabulary), pattern, finish, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
