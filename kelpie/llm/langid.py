"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a public one of fixed size. A language gives each piece a probability; a
word's probability is the sum over all ways to segment it into pieces, found by a forward
pass over the whole word, however long it is; a text's is the product over its words (runs of
letters and combining marks in lower case, each with a word start mark). Numerals of any kind,
punctuation, symbols, white space, format characters (joiners too) and marks without a letter
aren't scored. A code point that no piece covers counts as one unknown piece.

Probabilities are learned by expectation-maximisation (forward-backward sums of expected
piece counts) until the log likelihood gains less than GAIN of itself in a round, at most ROUNDS
rounds, over a sample bounded by SAMPLE whole documents a language, those with the smallest hashes
of their ids among those labelled and not held out, for the LANGUAGES languages of most such
documents. What the driver gathers is one number for each piece and language. Prediction covers
all words of all texts: words are looked up in a worker's table (at most CACHE_CELLS scores, one
for each word and language, and CACHE_POINTS code points, emptied when it is full), and new ones
are scored block by block. The table belongs to the broadcast model and goes with it.

Defined cases: `und` and score 0 for a null text, a text without a letter, and where no
language could be learned (an empty or unlabelled table); a null doc_id is neither held out
nor learned from; equal scores go to the language that is first in alphabetical order;
repeated rows each get their row. Only id, text and lang are read, lang for learning only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, give_back, saved, text_batches

SAMPLE, LANGUAGES, ROUNDS, GAIN, SMOOTH, FOLDS = 1000, 200, 30, 1e-3, 0.1, 5
CACHE_CELLS, CACHE_POINTS = 3_000_000, 8_000_000
#: Bytes of texts taken at once, with up to 8 languages; with more of them fewer bytes, so that scores of a batch's words take no more room.
BATCH_TEXT = 4_000_000
#: Code points of words scored at once, and of a word from which sums are made of logarithms.
BLOCK_POINTS, LONG = 200_000, 30
BROADCAST_ROWS = 200_000
MARK = "▁"
#: Words of texts that hold nothing of ODD_ONES, which has all marks and all numerals but decimal digits; most texts take this way.
WORD = re.compile(r"[^\W\d_]+")
ODD_ONES = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0300-\u1fff\u2070-\U0010ffff]")
LETTERS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(U)


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return sorted(model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Pieces:
    """The vocabulary by piece length: sorted hashes of the pieces, and a bit table that most other strings fail."""

    def __init__(self, pieces: list[str]) -> None:
        self.count, self.by_length, self.maybe = len(pieces), {}, np.zeros(1 << 20, bool)
        for n in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], dtype=np.int64)
            h = self.first(points("".join(pieces[i] for i in ids)).reshape(-1, n)[:, 0])
            for k in range(1, n):
                h = self.longer(h, points("".join(pieces[i] for i in ids)).reshape(-1, n)[:, k])
            order = np.argsort(h)
            self.by_length[n] = (h[order], ids[order])
            self.maybe[h >> U(44)] = True

    @staticmethod
    def first(c: np.ndarray) -> np.ndarray:
        return (c + U(1)) * ODD

    @staticmethod
    def longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h ^ (h >> U(31))) * ODD + c + U(1)


class Lattice:
    """All segmentations of some words (each with a start mark) as edges (word, from, to, piece), by their ends."""

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        self.length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.top = int(self.length.max()) if len(words) else 0
        c = points(MARK + MARK.join(words)) if words else np.zeros(0, U)
        start = np.cumsum(np.r_[0, self.length])[:-1]
        word = np.repeat(np.arange(len(words)), self.length)
        rest = np.repeat(start + self.length, self.length) - np.arange(len(c))  # code points left in the word
        single, edges, h, at = np.zeros(len(c), bool), [], Pieces.first(c), np.arange(len(c))
        for n in range(1, max(pieces.by_length, default=0) + 1):
            if n > 1:
                more = rest[at] >= n
                at, h = at[more], h[more]
                h = Pieces.longer(h, c[at + n - 1])
            if not len(at):
                break
            if n not in pieces.by_length:
                continue
            hashes, ids = pieces.by_length[n]
            some = np.flatnonzero(pieces.maybe[h >> U(44)])
            spot = np.minimum(np.searchsorted(hashes, h[some]), len(hashes) - 1)
            same = hashes[spot] == h[some]
            found = at[some[same]]
            edges.append((found, np.full(len(found), n), ids[spot[same]]))
            if n == 1:
                single[found] = True
        alone = np.flatnonzero(~single)
        edges.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), pieces.count)))
        at, n, p = (np.concatenate(x) for x in zip(*edges))
        w = word[at]
        a = at - start[w]
        b = a + n
        order = np.argsort(b * len(words) + w, kind="stable")
        self.w, self.a, self.b, self.p = w[order], a[order], b[order], p[order]
        self.top = int(self.length.max()) if len(words) else 0
        self.cuts, self.reach = np.searchsorted(self.b, np.arange(self.top + 2)), max(pieces.by_length, default=1)

    def edges_to(self, j: int) -> slice:
        return slice(self.cuts[j], self.cuts[j + 1])

    def forward(self, chances: np.ndarray) -> np.ndarray:
        """alpha[position, word, language] for chances[piece, language], of words up to LONG code points."""
        alpha = np.zeros((self.top + 1, len(self.length), chances.shape[1]))
        alpha[0] = 1
        for j in range(1, self.top + 1):
            e = self.edges_to(j)
            if e.start == e.stop:
                continue
            w = self.w[e]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[j, w[first]] = np.add.reduceat(alpha[self.a[e], w] * chances[self.p[e]], first, axis=0)
        return alpha

    def forward_logs(self, logs: np.ndarray, all_: bool) -> np.ndarray:
        """Logs of alpha for logs[piece, language]; all_: at every position, else at each word's end (positions out of reach are kept no longer)."""
        rows = self.top + 1 if all_ else min(self.top, self.reach) + 1
        alpha, ends = np.full((rows, len(self.length), logs.shape[1]), -np.inf), np.zeros((len(self.length), logs.shape[1]))
        alpha[0] = 0
        for j in range(1, self.top + 1):
            e = self.edges_to(j)
            alpha[j % rows] = -np.inf
            if e.start < e.stop:
                w = self.w[e]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                alpha[j % rows, w[first]] = np.logaddexp.reduceat(alpha[self.a[e] % rows, w] + logs[self.p[e]], first, axis=0)
            done = self.length == j
            ends[done] = alpha[j % rows, done]
        return alpha if all_ else ends

    def scores(self, chances: np.ndarray) -> np.ndarray:
        """Log of each word's probability, by language."""
        if self.top > LONG:
            return self.forward_logs(np.log(chances), False)
        return np.log(self.forward(chances)[self.length, np.arange(len(self.length))])

    def expected(self, chance: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece in words of one language, by forward and backward sums, and the words' log likelihood."""
        found, every = np.zeros(len(chance)), np.arange(len(self.length))
        if self.top > LONG:
            logs = np.log(chance)
            alpha = self.forward_logs(logs[:, None], True)[:, :, 0]
            whole = alpha[self.length, every]
            beta = np.full_like(alpha, -np.inf)
            beta[self.length, every] = np.log(counts) - whole
            for j in range(self.top, 0, -1):
                e = self.edges_to(j)
                back = logs[self.p[e]] + beta[j, self.w[e]]
                np.add.at(found, self.p[e], np.exp(alpha[self.a[e], self.w[e]] + back))
                np.logaddexp.at(beta, (self.a[e], self.w[e]), back)
            return found, float(counts @ whole)
        alpha = self.forward(chance[:, None])[:, :, 0]
        whole = alpha[self.length, every]
        beta = np.zeros_like(alpha)
        beta[self.length, every] = counts / whole
        for j in range(self.top, 0, -1):
            e = self.edges_to(j)
            back = chance[self.p[e]] * beta[j, self.w[e]]
            np.add.at(found, self.p[e], alpha[self.a[e], self.w[e]] * back)
            np.add.at(beta, (self.a[e], self.w[e]), back)
        return found, float(counts @ np.log(whole))


def blocks(words: list[str]) -> Iterator[list[int]]:
    """Places of the words, short ones apart from long ones, in blocks of about BLOCK_POINTS code points times the longest word's share."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    own: list[int] = []
    for i in order:
        n = len(words[i]) + 1
        if own and ((len(own) + 1) * n > BLOCK_POINTS or (n > LONG >= len(words[own[0]]) + 1)):
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (LETTERS if ODD_ONES.search(text) else WORD).findall(text)


class Model:
    """Languages, pieces and the probability of each piece in each language. It pickles with its arrays only."""

    def __init__(self, languages: list[str], pieces: list[str], chances: np.ndarray) -> None:
        self.languages, self.pieces, self.chances = languages, pieces, chances

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "pieces": "\0".join(self.pieces), "chances": self.chances.astype(np.float64)}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["languages"], state["pieces"].split("\0"), state["chances"])

    def start(self) -> None:
        give_back()
        self.index = Pieces(self.pieces)
        self.empty()

    def empty(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)))
        self.points = 0

    def learn_words(self, texts: list[list[str]]) -> None:
        known = self.at
        new = list({w for t in texts for w in t if w not in known})
        if (len(known) + len(new)) * len(self.languages) > CACHE_CELLS or self.points + sum(map(len, new)) > CACHE_POINTS:
            self.empty()
            known, new = self.at, list({w for t in texts for w in t})
        if new:
            need = len(known) + len(new)
            if need > len(self.table):
                more = np.empty((max(need, min(2 * len(self.table), CACHE_CELLS // len(self.languages))), len(self.languages)))
                more[: len(known)] = self.table[: len(known)]
                self.table = more
            for own in blocks(new):
                self.table[np.array(own) + len(known)] = Lattice([new[i] for i in own], self.index).scores(self.chances)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.points += sum(map(len, new))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) if t and self.languages else [] for t in texts]
        self.learn_words(split)
        names, scores = [], []
        for words in split:
            if not words:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def sample(docs: DataFrame, size: int = SAMPLE, most: int = LANGUAGES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text) of the labelled documents to learn from, at most `size` ids a language and `most` languages."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    slim = own.select("id", "lang")
    counts = slim.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most).collect()
    low = F.lit(None).cast("double")
    for r in counts:  # far more than `size` of a large language have hashes under this bound, so few rows meet in its task
        low = F.when(F.col("lang") == r.lang, F.lit(min(1.0, 4 * size / r.n))).otherwise(low)
    slim = slim.withColumn("h", F.xxhash64("id")).where((F.col("h").cast("double") / 2.0**64 + 0.5) <= low)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    ranked = slim.withColumn("n", rank).where(F.col("n") <= size)
    chosen = saved(ranked.select(F.col("id").alias("i"), F.col("lang").alias("l")).distinct())
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return own.join(chosen, (F.col("id") == F.col("i")) & (F.col("lang") == F.col("l"))).select("lang", "text")


def fit(docs: DataFrame, vocabulary: str | list[str], size: int = SAMPLE, rounds: int = ROUNDS, gain: float = GAIN, smooth: float = SMOOTH, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """vocabulary: the file of a sentencepiece model, or the pieces."""
    pieces = read_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary

    def count(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(rows, 8_000_000):
            found: Counter = Counter()
            for name, t in zip(column(part, "lang"), column(part, "text")):
                found.update((name, w) for w in words_of(t))
            if found:
                names, words = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = saved(sample(docs, size, LANGUAGES, doc_id, text, lang).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    model = Model(languages, pieces, np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1)))
    before = -math.inf
    for _ in range(rounds):
        now = model

        def expect(rows: Iterable[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            now.start()
            total, likelihood = np.zeros_like(now.chances), 0.0
            for batch in rows:
                by = np.array([now.languages.index(x) for x in column(batch, "lang")], dtype=np.int64)
                own, n = column(batch, "word"), np.array(column(batch, "n"), dtype=np.float64)
                for k in np.unique(by):
                    at = np.flatnonzero(by == k)
                    for block in blocks([own[i] for i in at]):
                        spots = at[block]
                        found, log = Lattice([own[i] for i in spots], now.index).expected(now.chances[:, k], n[spots])
                        total[:, k] += found
                        likelihood += log
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[piece, -1]), pa.array(np.r_[k, -1]), pa.array(np.r_[total[piece, k], likelihood])], names=["piece", "k", "n"])

        counts, reached = np.zeros_like(model.chances), 0.0
        sums = words.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        for r in sums.collect():  # at most pieces x languages
            if r.piece < 0:
                reached = r.n
            else:
                counts[r.piece, r.k] = r.n
        model = Model(languages, pieces, (counts + smooth) / (counts + smooth).sum(axis=0))
        if reached - before < gain * abs(reached):
            break
        before = reached
    return model


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        if not hasattr(own, "at"):
            own.start()
        for part in text_batches(rows, BATCH_TEXT * 8 // max(8, len(own.languages))):
            names, scores = own.predict(column(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, in whose texts a language can be told; where no language was learned, those with a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        if not hasattr(own, "at"):
            own.start()
        for part in text_batches(rows, BATCH_TEXT * 8 // max(8, len(own.languages))):
            if own.languages:
                known = [n != "und" for n in own.predict(column(part, text))[0]]
            else:
                known = [bool(t and words_of(t)) for t in column(part, text)]
            yield part.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def reference_score(word: str, chance: dict[str, float], unknown: float) -> float:
    """Log probability of a word by plain recursion over all segmentations; for tests."""

    def total(i: int) -> float:
        if i == len(word):
            return 1.0
        own = sum(chance[word[i:j]] * total(j) for j in range(i + 1, len(word) + 1) if word[i:j] in chance)
        return own + (unknown * total(i + 1) if word[i] not in chance else 0.0)

    return math.log(total(0))
