"""Patterns that users declare: validation, compilation, and a time-boxed search."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.taxonomy import ALL_TYPES, CATEGORIES, GENERIC
from .spans import DETECTION

# Limits.
MOST_PATTERNS, MOST_CHARS, MOST_MATCHES = 24, 400, 512
PATTERN_SECONDS, TOTAL_SECONDS = 0.25, 1.0
KEYS = {"name", "pattern", "category", "ignore_case", "confidence"}
NAME = re.compile(r"[a-z][a-z0-9_]{1,39}")
NESTED = re.compile(r"\([^()]*[*+}][^()]*\)\s*[*+{]")


class PatternError(ValueError):
    """A pattern is refused, or ran out of its time on a text. Its message never holds text."""


@dataclass(frozen=True)
class Pattern:
    name: str
    category: str
    source: str
    confidence: float
    ignore_case: bool


def checked(spec: Any, at: int, taken: set[str]) -> Pattern:
    def need(fact: bool, what: str) -> None:
        if not fact:
            raise PatternError(f"custom_patterns[{at}]: {what}")

    need(isinstance(spec, dict), "each pattern is an object with 'name' and 'pattern'")
    need(not set(spec) - KEYS, f"unknown keys {sorted(set(spec) - KEYS)}")
    name, source = spec.get("name"), spec.get("pattern")
    need(isinstance(name, str) and bool(NAME.fullmatch(name)), "'name' is 2 to 40 lowercase letters, digits or underscores, a letter first")
    need(name not in ALL_TYPES, f"'{name}' is a built-in type")
    need(name not in taken, f"'{name}' is declared twice")
    need(isinstance(source, str) and bool(source.strip()), "'pattern' is a regular expression that isn't empty")
    need(len(source) <= MOST_CHARS, f"'pattern' has {len(source)} characters, more than {MOST_CHARS}")
    need(not NESTED.search(source), "'pattern' repeats a group that holds a repetition")
    category = spec.get("category", GENERIC)
    need(category in CATEGORIES, f"'category' is one of {sorted(CATEGORIES)}")
    confidence, ignore = spec.get("confidence", 1.0), spec.get("ignore_case", False)
    need(isinstance(confidence, (int, float)) and not isinstance(confidence, bool), "'confidence' is a number")
    need(0 <= confidence <= 1, "'confidence' is between 0 and 1")
    need(isinstance(ignore, bool), "'ignore_case' is true or false")
    return Pattern(name, category, source, float(confidence), ignore)


def normalised(specs: Any) -> tuple[Pattern, ...]:
    if specs is None or specs == "":
        return ()
    if not isinstance(specs, list):
        raise PatternError("custom_patterns is a list of pattern objects")
    if len(specs) > MOST_PATTERNS:
        raise PatternError(f"custom_patterns has {len(specs)} patterns, more than {MOST_PATTERNS}")
    out: list[Pattern] = []
    for at, spec in enumerate(specs):
        out.append(checked(spec, at, {p.name for p in out}))
    return tuple(out)


@lru_cache(maxsize=256)
def expressions(patterns: tuple[Pattern, ...]) -> tuple[Any, ...]:
    out = []
    for at, p in enumerate(patterns):
        try:
            e = regex.compile(p.source, regex.IGNORECASE if p.ignore_case else 0)
        except regex.error as error:
            raise PatternError(f"custom_patterns[{at}]: 'pattern' isn't a regular expression: {error}") from error
        if e.match(""):
            raise PatternError(f"custom_patterns[{at}]: 'pattern' matches the empty string")
        out.append(e)
    return tuple(out)


def compiled(specs: Any) -> tuple[Pattern, ...]:
    """Validated patterns, which are known to compile."""
    patterns = normalised(specs)
    expressions(patterns)
    return patterns


def canonical(patterns: tuple[Pattern, ...]) -> str:
    return json.dumps([vars(p) for p in patterns], sort_keys=True)


def find(text: str | None, patterns: tuple[Pattern, ...], clock: Callable[[], float] = time.perf_counter) -> list[tuple[int, int, str, float, str, str, int]]:
    """Detections of all patterns, as tuples in the order of DETECTION; raises PatternError when time runs out."""
    out: list[tuple[int, int, str, float, str, str, int]] = []
    left = TOTAL_SECONDS
    for at, (p, e) in enumerate(zip(patterns, expressions(patterns)) if text else ()):
        budget = min(PATTERN_SECONDS, left)
        if budget <= 0:
            raise PatternError(f"custom patterns took their {TOTAL_SECONDS} s before '{p.name}' had its turn")
        group, began, n = "value" if "value" in e.groupindex else 0, clock(), 0
        try:
            for m in e.finditer(text, timeout=budget):
                a, b = m.span(group)
                if 0 <= a < b:
                    out.append((a, b, p.name, p.confidence, "custom-regex", p.category, at))
                    n += 1
                    if n == MOST_MATCHES:
                        break
        except TimeoutError:
            raise PatternError(f"custom pattern '{p.name}' took longer than {budget:.3f} s on a text") from None
        left -= clock() - began
    return out


def detections(text: Column, patterns: tuple[Pattern, ...]) -> Column:
    """struct<error,found> by one Arrow call a batch; a text that runs out of time has an error and no detections."""

    @F.udf(f"struct<error:string,found:array<{DETECTION}>>", useArrow=True)
    def search(value: str) -> tuple[str | None, list]:
        try:
            return None, find(value, patterns)
        except PatternError as error:
            return str(error), []

    return search.asNondeterministic()(text)  # keeps the optimizer from running it twice
