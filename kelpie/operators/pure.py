"""The regex mode in plain Python: a second model of the engine for single values and for tests."""

from __future__ import annotations

import hashlib
import hmac
import re

from ..functions.taxonomy import CATEGORY_OF
from ..functions.dialect import python
from .spans import CARD, EMAIL, FIELDS, LABEL, NO_SECRETS, SECRET

SHAPES = [(re.compile(python(shape)), kind) for shape, kind in ((SECRET, "secret"), (EMAIL, "email"), (CARD, "payment_card"))]
LABELS = [(re.compile(python(LABEL.format(label=label)), re.I), kind) for label, kind in FIELDS]


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return len(digits) >= 12 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def find_all(text: str | None) -> list[tuple[int, int, str]]:
    """Resolved (start, end, type) of a text."""
    found: list[tuple[int, int, int, int, str]] = []
    add = lambda a, b, kind: found.append((a, a - b, len(found), b, kind))
    for rx, kind in SHAPES:
        for m in rx.finditer(text or ""):
            if kind != "payment_card" or luhn(re.sub(r"\D", "", m[0])):
                add(*m.span(), kind)
    for rx, kind in LABELS:
        for m in rx.finditer(text or ""):
            value = m[2].rstrip(".:!?'\")]}>")
            good = len(value) >= 6 and value.lower() not in NO_SECRETS if CATEGORY_OF.get(kind) == "secret" else sum(map(str.isdigit, value)) >= 4
            if good:
                add(m.start(2), m.start(2) + len(value), kind)
    kept: list[tuple[int, int, str]] = []
    for a, _, _, b, kind in sorted(found):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, kind))
    return kept


def rewrite_all(text: str | None, action: str, key: bytes = b"") -> str | None:
    """The text with its findings redacted, masked or tokenized; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find_all(text):
        value = text[a:b]
        new = {"redact": f"[{kind.upper()}]", "mask": "*" * (b - a)}.get(action) or f"<{kind.upper()}_{hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:12]}>"
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])
