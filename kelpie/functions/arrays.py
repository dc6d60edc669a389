"""Arrays and texts put together in time that is about linear, by built-in functions only.

An aggregate over an array copies its state at each step, so a fold that gathers elements goes
over blocks of BLOCK items: a first pass finds the state before each block, a second one gathers
a block's elements. Reading at an offset of code points scans a text from its start, so texts
that are read at many offsets are first cut into pieces of PIECE code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, PIECE = 64, 1024
Step = Callable[[Column, Column], tuple[Column, Column, Column | None]]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, start: Column, kind: str, step: Step) -> Column:
    """array<kind> of what step(state, item) -> (next state, element, whether it is kept) gives for each item; start: the first state."""
    empty = F.array().cast(f"array<{kind}>")

    def body(own: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int"))
        block = lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK))

        def outer(acc: Column, i: Column) -> Column:
            after = F.aggregate(block(i), acc["state"], lambda state, item: step(state, item)[0])
            return F.struct(after.alias("state"), F.array_append(acc["before"], acc["state"]).alias("before"))

        def inner(acc: Column, item: Column) -> Column:
            state, element, keep = step(acc["state"], item)
            out = F.array_append(acc["out"], element)
            return F.struct(state.alias("state"), (out if keep is None else F.when(keep, out).otherwise(acc["out"])).alias("out"))

        states = F.aggregate(blocks, F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("before")), outer, lambda acc: acc["before"])
        gathered = bound(states, lambda known: F.transform(blocks, lambda i: F.aggregate(block(i), F.struct(F.get(known, i).alias("state"), empty.alias("out")), inner, lambda acc: acc["out"])))
        return F.when(F.size(own) > 0, F.flatten(gathered)).otherwise(empty)

    return bound(items, body)


def cut(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text that was cut."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head = lambda n: F.coalesce(F.substring(F.get(pieces, first), start % PIECE + 1, n), F.lit(""))
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.coalesce(F.substring(F.get(pieces, last), F.lit(1), end % PIECE), F.lit(""))
    return F.when(end <= start, "").when(first == last, head(end - start)).otherwise(F.concat(head(F.lit(PIECE)), middle, tail))


def rebuilt(text: Column, spans: Column, new: Callable[[Column, Column], Column]) -> Column:
    """The text with each of the ordered spans that don't overlap replaced by new(value, span)."""

    def body(known: Column) -> Column:
        own, pieces = known["spans"], known["pieces"]
        before = lambda i: F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
        made = F.transform(own, lambda s, i: F.concat(between(pieces, before(i), s["start"]), new(between(pieces, s["start"], s["end"]), s)))
        return F.concat(F.array_join(made, ""), between(pieces, before(F.size(own)), known["size"]))

    facts = F.struct(spans.alias("spans"), cut(text).alias("pieces"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, bound(facts, body)).otherwise(text)
