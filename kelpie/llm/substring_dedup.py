"""Substring deduplication by sliding sentence spans.

A word is a run of characters other than space and \\t to \\r. A sentence ends after a word that
ends in `.`, `!` or `?`, after any of the full-width stops U+3002, U+FF01 and U+FF1F, and at a
newline; in a sentence of more than LONG words it also ends after each marked word, so that
passages without marks have sentences whose ends depend on nothing but their own words. (A word is
marked if 11 x its UTF-8 bytes + 7 x the lowest 6 bits of its last code point is a multiple of 13, or
if the next word is the same.) Words are normalised by lowering A-Z.

A run starts at each sentence and takes SPAN sentences, and more until it has SIZE bytes (of
words, and one for each word); a text of fewer sentences that has SIZE bytes is one run. Runs are
hashed and joined over the whole table, and a sentence is removed if a run that covers it isn't
the first of its kind (smallest doc_id, then earliest in the text).

Exchange: one pass over the texts gives each run's hash (128 bits) with its document. An aggregate
(combined before its shuffle) finds the runs of several documents, which go to the shared folder;
they are joined to the runs, which Spark can split where a run is hot, and then go to the batch that
holds the document. Batches are dealt by a hash of id and text, so that rows without an id spread as well.
Texts are shuffled once.

Defined cases: a null or empty text has no sentences and is kept as it is; a text of fewer than
SIZE bytes has no run; rows with equal doc_id are one place in the order, so they aren't repeats
of each other (each gets its row); a null doc_id comes last; an empty table gives an empty result.
Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, UPPER, key_of, saved, text_batches

SPAN, SIZE, LONG = 3, 120, 24
#: Bytes of text a batch holds.
BATCH_BYTES = 2_000_000
U = np.uint64
ODD, MIX = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
SPACE, STOP = np.zeros(256, bool), np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True
STOP[list(b".!?")] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1), modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX
    return (x ^ (x >> U(27))) * ODD


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), U)
    size = end - start
    far = np.cumsum(size)
    at = 0
    while at < len(start):  # a block of words at a time
        to = max(at + 1, int(np.searchsorted(far, (far[at - 1] if at else 0) + 500_000)))
        n = size[at:to]
        first = np.cumsum(n) - n
        offset = np.arange(int(n.sum())) - np.repeat(first, n)
        spot = offset + np.repeat(start[at:to], n)
        out[at:to] = np.add.reduceat((data[spot].astype(U) + U(1)) * powers(BASES[0], int(n.max()))[offset], first)
        at = to
    return mixed(out + size.astype(U) * ODD)


class Runs:
    """Sentences and runs of some texts. Sentence i is the bytes start[i] to start[i + 1] of `data` (or to its text's end); run j covers the sentences at[j] to until[j]."""

    def __init__(self, texts: pa.Array, span: int = SPAN, size: int = SIZE) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = bytes(memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]])
        bounds = bounds - bounds[0]
        self.bounds, n = bounds, len(self.data)
        low = np.frombuffer(self.data.translate(LOWERED), np.uint8)
        space = SPACE[low]
        fresh = np.zeros(n + 1, bool)  # a sentence starts here, if a word does
        if n >= 3:
            wide = np.flatnonzero(((low[:-2] == 0xE3) & (low[1:-1] == 0x80) & (low[2:] == 0x82)) | ((low[:-2] == 0xEF) & (low[1:-1] == 0xBC) & ((low[2:] == 0x81) | (low[2:] == 0x9F))))
            fresh[wide + 3] = True
            fresh[wide[fresh[wide]]] = False
        fresh[bounds] = True
        begins = ~space
        begins[1:] &= space[:-1] | fresh[1:n]
        ends = ~space
        ends[:-1] &= space[1:] | fresh[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        w = len(start)
        doc = np.searchsorted(bounds, start, side="right") - 1
        lines = np.cumsum(low == 10)
        opens = np.ones(w, bool)
        if w > 1:
            last = low[end[:-1] - 1]
            opens[1:] = fresh[start[1:]] | fresh[end[:-1]] | STOP[last] | (lines[start[1:] - 1] > lines[end[:-1] - 1])
        sentence = np.cumsum(opens) - 1
        long_ = np.bincount(sentence, minlength=1)[sentence] > LONG if w else opens
        n_bytes = end - start
        marked = (n_bytes * 11 + (low[end - 1] & 63).astype(np.int64) * 7) % 13 == 0 if w else opens
        like = np.flatnonzero(long_[:-1] & (n_bytes[1:] == n_bytes[:-1]) & (low[start[1:]] == low[start[:-1]])) if w else start
        marked[like[word_hashes(low, start[like], end[like]) == word_hashes(low, start[like + 1], end[like + 1])]] = True
        opens[1:] |= (marked & long_)[:-1]
        first = np.flatnonzero(opens)
        s = len(first)
        self.doc = doc[first]
        words = np.r_[first, w]
        self.words = np.diff(words)
        self.start = np.r_[start[first], n]
        if s:
            begin = np.flatnonzero(np.r_[True, self.doc[1:] != self.doc[:-1]])
            lead = bounds[self.doc[begin]]
            clear = lines[self.start[begin]] - lines[lead] + (low[lead] == 10) == 0
            self.start[begin[clear]] = lead[clear]
        amount = np.r_[0, np.cumsum(end - start + 1)][words] if w else np.zeros(s + 1, np.int64)
        own = np.searchsorted(self.doc, self.doc, side="right")  # where the text's sentences end
        own_start = np.searchsorted(self.doc, self.doc, side="left")
        from_ = np.arange(s)
        until = np.maximum(np.searchsorted(amount, amount[:-1] + size), from_ + span)
        whole = (from_ == own_start) & (own - from_ < span) & (amount[own] - amount[:-1] >= size)
        until = np.where(whole, own, until)
        self.at = np.flatnonzero(until <= own)
        self.until = until[self.at]
        word = word_hashes(low, start, end)
        self.run = [self.hashes(word, words[self.at], words[self.until], b) for b in BASES]

    @staticmethod
    def hashes(word: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
        """Of the words a to b, wherever they stand."""
        back = pow(base, -1, 1 << 64)
        sums = np.r_[U(0), np.cumsum(mixed(word ^ U(base)) * powers(base, len(word)), dtype=U)] if len(word) else np.zeros(1, U)
        return mixed((sums[b] - sums[a]) * powers(back, len(word) + 1)[a] + (b - a).astype(U)).view(np.int64)


def span_dedup(docs: DataFrame, span: int = SPAN, size: int = SIZE, batch_bytes: int = BATCH_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_words_removed, clean_text) of each row of docs."""
    own = docs.select(F.col(doc_id).alias("doc_id"), key_of(doc_id).alias("key"), F.col(text).alias("text"))
    total = int(own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    n = max(1, -(-total // batch_bytes))
    rows = own.withColumn("batch", F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, batch_bytes):
            runs = Runs(part.column("text"), span, size)
            doc, a, b = runs.doc[runs.at], *runs.run
            order = np.lexsort((b, a, doc))
            doc, a, b = doc[order], a[order], b[order]
            once = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(doc)]
            place = [part.column(c).take(pa.array(doc[once])) for c in ("key", "batch")]
            yield pa.RecordBatch.from_arrays([*place, pa.array(a[once]), pa.array(b[once])], names=["key", "batch", "run_a", "run_b"])

    held = rows.select("key", "batch", "text").mapInArrow(extract, "key long, batch int, run_a long, run_b long")
    repeated = held.groupBy("run_a", "run_b").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    repeated = saved(repeated.select(F.col("run_a").alias("a"), F.col("run_b").alias("b"), "first"))
    later = held.join(repeated, (F.col("run_a") == F.col("a")) & (F.col("run_b") == F.col("b")) & (F.col("first") < F.col("key"))).select("batch", "a", "b", "first")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        runs = Runs(left.column("text"), span, size)
        keys, doc = np.array(left.column("key"), dtype=np.int64), runs.doc[runs.at]
        a, b, first = (np.array(right.column(c), dtype=np.int64) for c in ("a", "b", "first"))
        # runs of the table and of this batch in one order, those of the table before equal ones
        order = np.lexsort((np.r_[np.zeros(len(a), bool), np.ones(len(doc), bool)], np.r_[b, runs.run[1]], np.r_[a, runs.run[0]]))
        both = [x[order] for x in (np.r_[a, runs.run[0]], np.r_[b, runs.run[1]], np.r_[first, np.full(len(doc), NO_ID)])]
        head = np.r_[True, (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])][: len(order)]
        least = np.zeros(len(order), np.int64)
        least[order] = both[2][head][np.cumsum(head) - 1]
        earlier = least[len(a) :] < keys[doc]
        own = np.lexsort((runs.at, runs.run[1], runs.run[0], doc))  # a repeat within its document
        again = np.zeros(len(own), bool)
        again[own[1:]] = np.logical_and.reduce([x[own[1:]] == x[own[:-1]] for x in (doc, *runs.run)])
        gone = np.zeros(len(runs.doc) + 1, np.int64)
        np.add.at(gone, runs.at[earlier | again], 1)
        np.add.at(gone, runs.until[earlier | again], -1)
        removed = np.cumsum(gone)[:-1] > 0
        texts, spots = left.column("text").to_pylist(), np.flatnonzero(removed)
        bounds = np.searchsorted(runs.doc[spots], np.arange(len(texts) + 1))
        for d in np.unique(runs.doc[spots]).tolist():
            kept, at, end = [], int(runs.bounds[d]), int(runs.bounds[d + 1])
            for i in spots[bounds[d] : bounds[d + 1]].tolist():
                kept.append(runs.data[at : runs.start[i]])
                at = min(int(runs.start[i + 1]), end)
            texts[d] = b"".join((*kept, runs.data[at:end])).decode()
        count = lambda w: np.bincount(runs.doc, weights=w, minlength=len(texts)).astype(np.int64)
        return pa.table({"doc_id": left.column("doc_id"), "n_sentences": count(np.ones(len(removed))), "n_removed": count(removed.astype(float)), "n_words_removed": count(removed * runs.words), "clean_text": pa.array(texts, pa.string())})

    return rows.groupBy("batch").cogroup(later.groupBy("batch")).applyInArrow(apply, "doc_id long, n_sentences long, n_removed long, n_words_removed long, clean_text string")


_WS, _STOP = r"\x20\x09-\x0D", r"\x{3002}\x{FF01}\x{FF1F}"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(doc_id, {NO_ID}) AS k, text FROM documents),
pieces AS (
  SELECT rn, k, unnest(p) AS piece, unnest(range(len(p))) AS i
  FROM (SELECT rn, k, list_filter(regexp_extract_all(text, '(?s).*?(?:[.!?]+(?:[{_WS}]+|\z)|[{_STOP}]+[{_WS}]*|\n[{_WS}]*|\z)'), lambda x: x <> '') AS p FROM d)),
tokens AS (
  SELECT rn, k, i, unnest(t) AS raw, unnest(range(len(t))) AS j, len(t) AS n, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT *, regexp_extract_all(piece, '[{_WS}]*[^{_WS}]+[{_WS}]*') AS t FROM pieces)),
marks AS (SELECT *, n > {LONG} AND ((11 * strlen(w) + 7 * (unicode(right(w, 1)) & 63)) % 13 = 0 OR coalesce(lead(w) OVER (PARTITION BY rn, i ORDER BY j) = w, false)) AS m FROM tokens),
parts AS (SELECT *, coalesce(sum(m::INT) OVER (PARTITION BY rn, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM marks),
sentences AS (
  SELECT rn, any_value(k) AS k, i, part, string_agg(raw, '' ORDER BY j) AS raw, string_agg(w, ' ' ORDER BY j) AS words, count(*) AS n, sum(strlen(w) + 1) AS size, row_number() OVER (PARTITION BY rn ORDER BY i, part) AS s
  FROM parts GROUP BY rn, i, part),
summed AS (SELECT *, sum(size) OVER (PARTITION BY rn ORDER BY s) AS upto, count(*) OVER (PARTITION BY rn) AS last FROM sentences),
ends AS (SELECT a.rn, a.k, a.s, a.last, CASE WHEN a.s = 1 AND a.last < {SPAN} THEN a.last ELSE greatest(b.s, a.s + {SPAN - 1}) END AS e FROM summed a ASOF JOIN summed b ON a.rn = b.rn AND a.upto - a.size + {SIZE} <= b.upto),
lists AS (SELECT rn, list(words ORDER BY s) AS ws FROM sentences GROUP BY rn),
runs AS (SELECT rn, k, s, e, array_to_string(list_slice(ws, s, e), ' ') AS run FROM ends JOIN lists USING (rn) WHERE e <= last),
repeats AS (SELECT rn, s, e FROM (SELECT *, min(k) OVER (PARTITION BY run) AS first, row_number() OVER (PARTITION BY run, rn ORDER BY s) AS nth FROM runs) WHERE first < k OR nth > 1),
gone AS (SELECT DISTINCT rn, unnest(range(s, e + 1)) AS s FROM repeats),
flagged AS (SELECT s.*, g.s IS NOT NULL AS gone FROM sentences s LEFT JOIN gone g ON g.rn = s.rn AND g.s = s.s),
counted AS (SELECT rn, count(*) AS a, count(*) FILTER (gone) AS b, sum(n) FILTER (gone) AS c, string_agg(CASE WHEN gone THEN '' ELSE raw END, '' ORDER BY s) AS t FROM flagged GROUP BY rn),
leads AS (SELECT rn, any_value(piece) AS piece FROM pieces WHERE NOT regexp_matches(piece, '[^{_WS}]') GROUP BY rn)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_sentences, coalesce(b, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_words_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(leads.piece, '') || coalesce(t, '') END AS clean_text
FROM d LEFT JOIN counted USING (rn) LEFT JOIN leads USING (rn)
"""
