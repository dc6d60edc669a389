"""Spans in texts as arrays of structs, by built-in functions only.

Offsets are code points, ends exclusive. A text is split at a pattern's matches; running
sums of the lengths of gaps and matches are the matches' offsets. Spans meet other spans by a
sweep over both in order, so a text with many spans takes n log n steps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bound, folded, rebuilt

PLAIN = "struct<start:int,end:int>"
SPAN = "struct<start:int,end:int,value:string>"
PLACED = "struct<start:int,end:int,value:string,before:string,after:string>"


def found(text: Column, pattern: str, gate: Column | None = None, around: int = 0) -> Column:
    """Leftmost non-overlapping matches (never empty ones) as an array of SPAN. gate: a cheap test that any text with a match passes.

    around: as an array of PLACED, with so many code points before each match and the one after it.
    """
    def step(state: Column, part: Column) -> tuple[Column, Column, None]:
        at = state["at"] if around else state
        start = (at + F.length(part["gap"])).cast("int")
        end = (start + F.length(part["value"])).cast("int")
        own = [start.alias("start"), end.alias("end"), part["value"].alias("value")]
        if not around:
            return end, F.struct(*own), None
        before = F.right(F.concat(state["before"], part["gap"]), F.lit(around))
        after = F.left(F.concat(part["rest"], F.coalesce(part["next"], F.lit(""))), F.lit(1))
        state = F.struct(end.alias("at"), F.right(F.concat(before, part["value"]), F.lit(around)).alias("before"))
        return state, F.struct(*own, before.alias("before"), after.alias("after")), None

    kind = PLACED if around else SPAN
    first = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("before")) if around else F.lit(0).cast("int")

    def body(known: Column) -> Column:
        gaps, values = known["gaps"], known["values"]
        parts = [F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value")]
        parts += [F.slice(gaps, 2, F.size(values)).alias("rest"), F.slice(values, 2, F.size(values)).alias("next")] if around else []
        return F.when(F.size(values) > 0, folded(F.arrays_zip(*parts), first, kind, step)).otherwise(F.array().cast(f"array<{kind}>"))

    out = bound(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), body)
    return out if gate is None else F.when(gate, out).otherwise(F.array().cast(f"array<{kind}>"))


def marked(spans: Column, kind: str, rank: int, by_kind: bool = False) -> Column:
    """Spans as structs that sort by start, then rank (by_kind: rank, then start)."""
    keys = (lambda s: (F.lit(rank), s["start"])) if by_kind else (lambda s: (s["start"], F.lit(rank)))
    return F.transform(spans, lambda s: F.struct(keys(s)[0].alias("k1"), keys(s)[1].alias("k2"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def ordered(*arrays: Column) -> Column:
    return F.sort_array(reduce(F.concat, arrays))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def only(spans: Column, others: Column, places: Callable[[Column, Column], Column], keep: bool) -> Column:
    """The spans at the places (keep), or all the others, in their order; both arrays are computed once."""

    def body(known: Column) -> Column:
        own, far = known["own"], known["others"]
        at = lambda p: F.sort_array(p if keep else F.array_except(F.sequence(F.lit(0), F.size(own) - 1), p))
        none = F.slice(own, 1, 0) if keep else own
        return F.when((F.size(own) > 0) & (F.size(far) > 0), F.transform(at(places(own, far)), lambda i: F.get(own, i))).otherwise(none)

    slim = F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end")))
    return bound(F.struct(spans.alias("own"), slim.alias("others")), body)


def apart_from(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""

    def places(own: Column, far: Column) -> Column:
        # below a span's end the last end of others that start there
        event = lambda at, asks, ends, i, start: F.struct(at.alias("at"), F.lit(asks).alias("asks"), ends.cast("int").alias("ends"), i.cast("int").alias("i"), start.cast("int").alias("start"))
        marks = F.transform(far, lambda o: event(o["start"], 1, o["end"], F.lit(-1), F.lit(-1)))
        asked = F.transform(own, lambda s, i: event(s["end"], 0, F.lit(-1), i, s["start"]))
        step = lambda most, e: (F.greatest(most, e["ends"]), e["i"], (e["asks"] == 0) & (most > e["start"]))
        return folded(F.sort_array(F.concat(marks, asked)), F.lit(-1).cast("int"), "int", step)

    return only(spans, others, places, False)


def near(spans: Column, others: Column, within: int) -> Column:
    """Interval join: spans with another span that doesn't overlap them and whose gap to them is at most `within`."""

    def places(own: Column, far: Column) -> Column:
        # below a span's start the last end of others, below its end and the gap the last start of others
        event = lambda at, asks, ends, starts, i, least: F.struct(at.cast("int").alias("at"), F.lit(asks).alias("asks"), ends.cast("int").alias("ends"), starts.cast("int").alias("starts"), i.cast("int").alias("i"), least.cast("int").alias("least"))
        none = F.lit(-1)
        marks = F.transform(far, lambda o: F.array(event(o["end"], 0, o["end"], none, none, none), event(o["start"], 0, none, o["start"], none, none)))
        asked = F.transform(own, lambda s, i: F.array(event(s["start"], 1, none, none, i, F.greatest(s["start"] - within, F.lit(0))), event(s["end"] + within, 2, none, none, i, s["end"])))

        def step(most: Column, e: Column) -> tuple[Column, Column, Column]:
            after = F.struct(F.greatest(most["ends"], e["ends"]).alias("ends"), F.greatest(most["starts"], e["starts"]).alias("starts"))
            return after, e["i"], F.when(e["asks"] == 1, most["ends"] >= e["least"]).when(e["asks"] == 2, most["starts"] >= e["least"]).otherwise(F.lit(False))

        first = F.struct(none.cast("int").alias("ends"), none.cast("int").alias("starts"))
        return F.array_distinct(folded(F.sort_array(F.flatten(F.concat(marks, asked))), first, "int", step))

    return only(spans, others, places, True)


def replaced(text: Column, spans: Column, by: str) -> Column:
    """The text with each stretch that ordered spans cover replaced."""
    joined = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))

    def step(state: Column, s: Column) -> tuple[Column, Column, Column]:
        new = s["start"] >= state["end"]
        grown = F.struct(F.when(new, s["start"]).otherwise(state["start"]).cast("int").alias("start"), F.greatest(state["end"], s["end"]).cast("int").alias("end"))
        return grown, state, new & (state["end"] > 0)

    def body(known: Column) -> Column:
        end = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"))  # closes the last stretch
        stretches = folded(F.concat(F.transform(known, lambda s: joined(s["start"], s["end"])), F.array(end)), joined(F.lit(0), F.lit(0)), PLAIN, step)
        return rebuilt(text, stretches, lambda value, s: F.lit(by))

    return F.when(F.size(spans) > 0, bound(spans, body)).otherwise(text)
