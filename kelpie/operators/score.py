"""Scorers of candidates: a protocol, a scorer by shape, and a small trained one."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 64


class Scorer(Protocol):
    """Probabilities that spans of a text are personal data, one for each span. Loaded once a worker, called with BATCH spans at most."""

    def score(self, text: str, spans: Sequence[tuple[int, int]]) -> list[float]: ...


class ShapeScorer:
    """Deterministic: by what a value looks like. For tests and as a baseline."""

    RULES = [(r"@", 0.99), (r"^\+?[\d\s().-]{8,}$", 0.9), (r"^(?:\d{1,3}\.){3}\d{1,3}$", 0.9), (r"^(?=.*[A-Za-z])(?=.*\d)\S{6,}$", 0.8), (r"^[A-ZÀ-Þ][\w'-]+ [A-ZÀ-Þ][\w'-]+", 0.6)]

    def score(self, text: str, spans: Sequence[tuple[int, int]]) -> list[float]:
        return [next((p for rx, p in self.RULES if re.search(rx, text[a:b])), 0.1) for a, b in spans]


def features(text: str, a: int, b: int, around: int = 120) -> dict[str, float]:
    """Of a candidate: its shape, its length and the words before and after it."""
    value = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value))[:12]
    before = re.findall(r"[^\W\d_]+|[:=]", text[max(0, a - around) : a].lower())[-3:]
    after = re.findall(r"[^\W\d_]+", text[b : b + around].lower())[:2]
    found = [f"shape={shape}", f"length={min(len(value), 20) // 4}", f"digits={min(sum(map(str.isdigit, value)), 16) // 3}", *[f"before{len(before) - i}={w}" for i, w in enumerate(before)], *[f"after{i}={w}" for i, w in enumerate(after)]]
    return dict.fromkeys(["bias", *found], 1.0)


class LinearScorer:
    """Logistic regression on features(); fitted on a bounded list of labelled candidates."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}

    def fit(self, examples: Iterable[tuple[str, int, int, bool]], rounds: int = 8, rate: float = 0.3) -> LinearScorer:
        rows = [(features(t, a, b), float(y)) for t, a, b, y in examples]
        for r in range(rounds):
            for f, y in rows:
                off = rate / (1 + r) * (y - self.chance(f))
                for k in f:
                    self.weights[k] = self.weights.get(k, 0.0) + off
        return self

    def chance(self, f: dict[str, float]) -> float:
        z = sum(self.weights.get(k, 0.0) for k in f)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str, spans: Sequence[tuple[int, int]]) -> list[float]:
        return [self.chance(features(text, a, b)) for a, b in spans]


def typed(scores: Column, not_pii: str = "not_pii") -> Column:
    """struct<prob,type> of a map from option to probability: 1 - P(not_pii), and the best other option."""
    best = F.array_sort(F.transform(F.filter(F.map_entries(scores), lambda e: e["key"] != not_pii), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("type"))))
    return F.struct((1 - F.coalesce(F.try_element_at(scores, F.lit(not_pii)), F.lit(0.0))).alias("prob"), F.get(best, F.lit(0))["type"].alias("type"))


def scores(text: Column, spans: Column, scorer: Scorer) -> Column:
    """array<double> aligned with spans; texts without spans never reach the scorer."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for t, own in zip(texts, lists):
                pairs = [] if own is None else [(s["start"], s["end"]) for s in own]
                found: list[float] = []
                for i in range(0, len(pairs), BATCH):
                    found += scorer.score(t, pairs[i : i + BATCH])
                out.append(found)
            yield pd.Series(out)

    return run.asNondeterministic()(text, spans)  # keeps the optimizer from running it twice


def fit_linear(df: DataFrame, text: str = "text", labelled: str = "pieces", most: int = 20_000) -> LinearScorer:
    """A LinearScorer from labelled candidates; at most `most` texts, those with the smallest hashes, are read by the driver."""
    rows = df.select(text, labelled).orderBy(F.xxhash64(text)).limit(most).collect()
    return LinearScorer().fit((r[0], s["start"], s["end"], s["type"] != "not_pii") for r in rows for s in r[1] or ())
