"""Invariants over generated inputs, on the driver only."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.operators import propose, pure
from kelpie.sources import readers

PARTS = st.sampled_from(["Sarah Lee", "acct ", "1234 5678", "a@b.co", "4111 1111 1111 1111", "token = ", "hunter2!", "'s", " ", ", ", ": ", "\n", "é", "😀", "(", "is ", "hello ", "பெயர் ", "742 Elm Road"])
TEXTS = st.lists(PARTS, max_size=12).map("".join)
EDGES = propose.edge_words()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_findings_are_ordered_apart_and_inside(text):
    found = pure.find_all(text)
    bounds = [x for a, b, _ in found for x in (a, b)]
    assert bounds == sorted(bounds) and all(0 <= a < b <= len(text) for a, b, _ in found)
    masked = pure.rewrite_all(text, "mask")
    assert len(masked) == len(text) and all(set(masked[a:b]) == {"*"} for a, b, _ in found)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_candidates_are_ordered_apart_and_trimmed(text):
    spans = propose.pieces(text, EDGES)
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert all(b - a >= 2 and text[a] not in propose.LEAD for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_tokens_restore_the_text(text):
    safe = pure.rewrite_all(text, "tokenize", b"k")
    values = [text[a:b] for a, b, _ in pure.find_all(text)]
    tokens = re.findall(r"<[A-Z_]+_[0-9a-f]{12}>", safe)
    assert len(tokens) == len(values)
    for token, value in zip(tokens, values):
        safe = safe.replace(token, value, 1)
    assert safe == text


@given(st.integers(0, 10**6), st.integers(0, 10))
def test_generated_spans_point_at_values(index, seed):
    text, spans = readers.example(index, seed)
    assert all(text[a:b].strip() for a, b, _ in spans)
    assert all(pure.luhn(text[a:b]) for a, b, kind in spans if kind == "card")
