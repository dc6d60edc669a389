"""Configuration, decisions, risk and reason codes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.taxonomy import is_high_risk, reason_codes
from ..operators.custom import Pattern, compiled

OPERATIONS = ["detect", "redact", "mask", "tokenize", "block", "audit"]
DECISIONS = {"detect": "log", "audit": "log", "redact": "redact", "mask": "mask", "tokenize": "tokenize", "block": "block"}
REWRITES = ("redact", "mask", "tokenize")
MODES = ("hybrid", "regex")
#: From weak to strong; what an orchestrator compares.
LADDER = ["allow", "log", "redact", "require_approval", "block"]


class UnknownOperation(ValueError):
    """Not one of OPERATIONS (a caller's error 400)."""


class ScorerMissing(RuntimeError):
    """Hybrid mode without a scorer (503)."""


@dataclass(frozen=True)
class Settings:
    detector_mode: str = "hybrid"
    action: str = "redact"
    threshold: float = 0.5
    min_confidence: float = 0.0
    patterns: tuple[Pattern, ...] = ()
    extra: dict[str, Any] = field(default_factory=dict)


def resolve_config(config: dict[str, Any] | None) -> Settings:
    """Settings of a job; raises ValueError before any job starts. Unknown keys are kept in `extra`.

    min_confidence is held to 0..1, which the published manifest says.
    """
    given = dict(config or {})
    mode, action = given.pop("detector_mode", "hybrid"), given.pop("action", "redact")
    threshold, least = given.pop("threshold", 0.5), given.pop("min_confidence", 0.0)
    patterns = compiled(given.pop("custom_patterns", []))
    if mode not in MODES:
        raise ValueError(f"detector_mode is one of {MODES}")
    if action not in OPERATIONS:
        raise ValueError(f"action is one of {OPERATIONS}")
    for name, value in (("threshold", threshold), ("min_confidence", least)):
        if not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 <= value <= 1:
            raise ValueError(f"{name} is a number between 0 and 1")
    return Settings(mode, action, float(threshold), float(least), patterns, given)


def action_of(operation: str, settings: Settings) -> str:
    if operation not in OPERATIONS:
        raise UnknownOperation(f"operation is one of {OPERATIONS}")
    return settings.action if operation == "detect" else operation


def decision(found: Column, action: str) -> Column:
    return F.when(F.size(found) > 0, DECISIONS[action]).otherwise("allow")


def risk(found: Column) -> Column:
    return F.when(F.size(found) == 0, "none").when(F.exists(found, lambda d: is_high_risk(F.coalesce(d["category"], d["type"]))), "high").when(F.size(found) > 1, "medium").otherwise("low")


def codes(found: Column, operation: str) -> Column:
    own = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda d: reason_codes(d["type"], d["category"])))))
    if operation == "block":
        own = F.when(F.size(found) > 0, F.concat(own, F.array(F.lit("PII_PRESENT_BLOCKED")))).otherwise(own)
    return own


def strongest(*decisions: Column) -> Column:
    """The strongest of some decisions on LADDER; mask and tokenize rank as redact."""
    ladder = F.array(*[F.lit(x) for x in LADDER])
    rank = lambda d: F.array_position(ladder, F.when(d.isin("mask", "tokenize"), "redact").otherwise(d))
    return F.element_at(ladder, F.greatest(*map(rank, decisions)).cast("int")) if len(decisions) > 1 else decisions[0]
