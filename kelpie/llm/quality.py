"""Quality rules by cross-document line frequency.

Base rules look at one text (words are runs of characters other than space and \\t to \\r).
The method then hashes normalised lines (A-Z lowered, words joined by single spaces), counts
distinct documents per host (the source column), removes lines that more than MIN_DOCS
documents and more than SHARE percent of the host's documents hold, and rejects documents
that are depleted, i.e. lose more than half of their words. What is lost is counted in the
texts that are left, which come out with the verdict.

A first pass over the texts writes their line hashes to the shared folder; lines are counted
there. A second pass measures the texts and removes the lines. Lines over the limits number
at most lines per document / SHARE for each host; if they are few, each worker gets them and
no text is shuffled, else they are joined to the hashes and each text meets the lines it loses.

Defined cases: a null text has no words and stays null; blank lines stay; a null source is a
host of its own; rows with equal doc_id count as one document; repeated rows each get their
row; an empty table gives an empty result. Only id, text and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, key_of, saved, text_batches

MIN_DOCS, SHARE = 5, 3
BROADCAST_ROWS = 100_000
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes.split() cuts at space and \t to \r only
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def line_hash(line: bytes) -> int | None:
    """Of a normalised line; none of a line without a word."""
    words = line.lower().split()
    return xxhash.xxh64_intdigest(b" ".join(words)) - 2**63 if words else None


def without(text: str, gone: Collection[int]) -> str:
    """The text without the lines whose hashes are gone."""
    if not gone:
        return text
    lines = text.encode().split(b"\n")
    left = [x for x in lines if line_hash(x) not in gone]
    return text if len(left) == len(lines) else b"\n".join(left).decode()


def hashed(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_batches(rows, 4_000_000):
        lines = [list({h for x in (t or "").encode().split(b"\n") if (h := line_hash(x)) is not None}) for t in column(part, "text")]
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("host"), part.column("same"), pa.array(lines, pa.list_(pa.int64()))], names=["key", "host", "same", "lines"])


def line_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, base measures, base_failed, n_words_removed, kept, text) of each row of docs; text is what is left of it."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key_of(doc_id).alias("key"), F.col(source).cast("string").alias("host"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("same"))
    found = saved(own.select("key", "host", "same", "text").mapInArrow(hashed, "key long, host string, same long, lines array<long>"))
    lines = found.select("key", "host", "same", F.explode("lines").alias("line"))
    often = lines.groupBy("host", "line").agg(F.count_distinct("key").alias("docs")).where(F.col("docs") > min_docs)
    hosts = found.groupBy(F.col("host").alias("of")).agg(F.count_distinct("key").alias("all"))
    over = saved(often.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(100 * F.col("docs") > share * F.col("all")).select(F.col("host").alias("of"), F.col("line").alias("over")))
    few = None
    if over.count() <= broadcast_rows:
        of_host: dict[str | None, set[int]] = {}
        for r in over.collect():
            of_host.setdefault(r["of"], set()).add(r["over"])
        few = docs.sparkSession.sparkContext.broadcast(of_host)
        own = own.select("doc_id", "host", "text")
    else:
        lost = lines.join(over, (F.col("line") == F.col("over")) & F.col("host").eqNullSafe(F.col("of")))
        lost = lost.groupBy(F.col("key").alias("k"), F.col("host").alias("h"), F.col("same").alias("s")).agg(F.collect_set("line").alias("gone"))
        own = own.join(lost, (F.col("key") == F.col("k")) & (F.col("same") == F.col("s")) & F.col("host").eqNullSafe(F.col("h")), "left").select("doc_id", "text", "gone")

    def cleaned(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(rows, 4_000_000):
            texts = column(part, "text")
            gone = [few.value.get(h, ()) for h in column(part, "host")] if few else [set(g or ()) for g in column(part, "gone")]
            left = [t and without(t, g) for t, g in zip(texts, gone)]
            fields = list(zip(*(measures(t or "") for t in texts)))
            removed = [n - (n if x is t else len((x or "").encode().split())) for n, t, x in zip(fields[0], texts, left)]
            arrays = [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (*fields, removed)], pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *FIELDS, "n_words_removed", "text"])

    schema = "doc_id long, " + ", ".join(f"{f} long" for f in FIELDS) + ", n_words_removed long, text string"
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return own.mapInArrow(cleaned, schema).select("doc_id", *FIELDS, failed.alias("base_failed"), "n_words_removed", (~failed & (2 * F.col("n_words_removed") <= F.col("n_words"))).alias("kept"), "text")


_W = r"[^\x20\x09-\x0D]"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}+') AS w FROM documents),
windows AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
covered AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rn, g) AS c FROM windows) WHERE c > 1) GROUP BY rn),
lines AS (SELECT * FROM (SELECT rn, doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_W}')),
repeats AS (SELECT rn, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rn),
normal AS (SELECT rn, doc_id, source, len(v) AS n, array_to_string(v, ' ') AS l FROM (SELECT *, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}+') AS v FROM lines)),
hosts AS (SELECT source, count(DISTINCT coalesce(doc_id, -1)) AS n FROM d GROUP BY source),
often AS (SELECT n.source, l FROM normal n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, l HAVING count(DISTINCT coalesce(doc_id, -1)) > {MIN_DOCS} AND 100 * count(DISTINCT coalesce(doc_id, -1)) > {SHARE} * any_value(h.n)),
lost AS (SELECT rn, sum(n.n)::BIGINT AS n FROM normal n JOIN often o ON n.l = o.l AND n.source IS NOT DISTINCT FROM o.source GROUP BY rn),
m AS (SELECT rn, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(repeats.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_words_removed
  FROM d LEFT JOIN covered USING (rn) LEFT JOIN repeats USING (rn) LEFT JOIN lost USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words_removed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_words_removed <= n_words AS kept FROM m
"""
