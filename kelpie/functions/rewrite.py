"""Replacements of findings, keyed tokens, and the rewrite of a text by ordered findings."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import between, bound, cut, rebuilt

BLOCK = 64


def token_key(configured: str | None = None) -> bytes:
    """The key of one job: the configured one, or fresh random bytes. Make it once, on the driver."""
    return configured.encode() if configured else os.urandom(32)


def hmac_sha256(key: bytes, value: Column) -> Column:
    """Lowercase hex of HMAC-SHA256 over the value's UTF-8 bytes, from two digests."""
    if len(key) > BLOCK:
        import hashlib

        key = hashlib.sha256(key).digest()
    padded = key.ljust(BLOCK, b"\0")
    inner, outer = (bytes(b ^ x for b in padded) for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def token(key: bytes, value: Column, kind: Column) -> Column:
    return F.concat(F.lit("<"), F.upper(kind), F.lit("_"), F.substring(hmac_sha256(key, value), 1, 12), F.lit(">"))


def replacement(action: str, value: Column, kind: Column, key: bytes | None = None) -> Column:
    if action == "redact":
        return F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    if action == "mask":
        return F.repeat(F.lit("*"), F.length(value))
    if action == "tokenize":
        return token(key or token_key(), value, kind)
    return value


def rewritten(text: Column, findings: Column, action: str, key: bytes | None = None) -> Column:
    """The text with each of the ordered, non-overlapping findings replaced, in one pass."""
    return rebuilt(text, findings, lambda value, d: replacement(action, value, d["type"], key))


def vault(text: Column, findings: Column, key: bytes) -> Column:
    """array<struct<token,value>> of the findings; keep it apart from results."""
    pairs = bound(F.struct(cut(text).alias("pieces"), findings.alias("found")), lambda known: F.transform(known["found"], lambda d: bound(between(known["pieces"], d["start"], d["end"]), lambda value: F.concat(token(key, value, d["type"]), value))))
    # distinct as strings, which are hashed; a token ends at its only >
    return F.transform(F.array_distinct(pairs), lambda x: F.struct(F.concat(F.substring_index(x, ">", 1), F.lit(">")).alias("token"), F.substring(x, F.locate(">", x) + 1, F.length(x)).alias("value")))


def detokenized(text: Column, entries: Column) -> Column:
    """The text with each token of the vault's entries replaced by its value."""
    return F.aggregate(entries, text, lambda t, e: F.replace(t, e["token"], e["value"]))
