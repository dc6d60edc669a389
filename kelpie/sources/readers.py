"""Sources: JSON corpora, lines, semi-structured spans, systematic samples, generated examples."""

from __future__ import annotations

import ast
import json
import os
import random
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASES = "text string, pii array<string>, keep array<string>, source string"
SPANS = "array<struct<start:int,end:int,text:string,label:string>>"


def json_objects(spark: SparkSession, path: str, schema: str = CASES) -> DataFrame:
    """A JSON file that holds an array of objects (one file is one task; many files are many)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """(index, text) of a JSON array of strings."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
    return whole.select(F.posexplode("a").alias("index", "text"))


def zipped(texts: DataFrame, labels: DataFrame, index: str = "index") -> DataFrame:
    """Texts joined with their labels by position; what one side lacks goes, as in a zip."""
    return texts.join(labels, index)


def parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each line that isn't blank."""
    return spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "text")


def systematic(df: DataFrame, order: str, offsets: list[int] = [0, 12_500, 25_000, 50_000, 75_000, 99_000], per: int = 100, buckets: int = 200) -> DataFrame:  # noqa: B006
    """`per` rows from each offset in the order of a unique integer column (a sampling operator).

    Fixed bounds from quantiles cut the column into buckets, whose counts give each bucket its first rank; rows are
    ranked only in buckets that hold a wanted rank. Bounds are literals, so a task that is run again ranks alike.
    """
    bounds = sorted({int(b) for b in df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.5 / buckets)})
    own = df.select(order).withColumn("__b", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col(order))))
    first, at = {}, 0
    for r in own.groupBy("__b").agg(F.count("*").alias("n")).orderBy("__b").collect():  # one row a bucket
        if any(o < at + r.n and at < o + per for o in offsets):
            first[r["__b"]] = at
        at += r.n
    base = F.lit(None).cast("long")
    for k, v in first.items():
        base = F.when(F.col("__b") == k, F.lit(v)).otherwise(base)
    rank = base + F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1
    wanted = reduce(or_, [F.col("__r").between(o, o + per - 1) for o in offsets], F.lit(False))
    chosen = own.where(F.col("__b").isin(list(first))).withColumn("__r", rank).where(wanted).select(F.col(order).alias("__k"))
    return df.join(chosen, F.col(order) == F.col("__k"), "left_semi")


def parse_spans(raw: Column) -> Column:
    """Spans of a column that holds JSON or Python literals; what can't be read is an empty array."""

    @F.udf(SPANS, useArrow=True)
    def read(value: str) -> list:
        for parse in (ast.literal_eval, json.loads):
            try:
                found = parse(value)
                break
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
        else:
            return []
        whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) else None
        word = lambda x: x if isinstance(x, str) else None
        return [(whole(s.get("start")), whole(s.get("end")), word(s.get("text")), word(s.get("label"))) for s in found if isinstance(s, dict)] if isinstance(found, list) else []

    native = F.from_json(raw, SPANS)  # strict JSON stays in the JVM; the rest is read in Python
    return F.coalesce(native, read(F.when(native.isNull(), raw)))


def model_dir(name: str, configured: str | None = None, checkout: str | None = None, cache: str | None = None) -> str:
    """The first place that holds a model: a configured folder, one beside the code, one in the cache. None of them is an error."""
    places = [configured, checkout, os.path.join(cache, name) if cache else None]
    for place in places:
        if place and os.path.isdir(place):
            return place
    raise FileNotFoundError(f"no weights of {name} in {[p for p in places if p]}")


NAMES, ORGANISATIONS = ["Asha Verma", "Liam Byrne", "Chloé Martin", "Noor Haddad", "Jonas Weiß", "Mina Okafor"], ["Harbour Freight", "Blue Lantern", "Cobalt Works"]
TEMPLATES = [
    "Please call {person} on {phone} before noon.",
    "{person} moved to {address} in spring, near {~org}.",
    "The card {card} was declined by {~org}.",
    "Write to {email} about invoice {~number}.",
    "My password is {secret} and my login is {email}.",
    "Server {network} answered in {~number} ms.",
    "{person} was born on {date}; the meeting is on Friday.",
    "Order {~number} from {~org} has shipped.",
    "Member id: {id}, handled by {person}.",
]


def slot(name: str, r: random.Random) -> str:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return {
        "person": lambda: r.choice(NAMES),
        "org": lambda: r.choice(ORGANISATIONS),
        "phone": lambda: f"+44 20 {digits(4)} {digits(4)}",
        "address": lambda: f"{r.randint(1, 999)} {r.choice(['Willow', 'Quarry', 'Mill'])} {r.choice(['Lane', 'Road', 'Court'])}",
        "card": lambda: luhn_number("4" + digits(14)),
        "email": lambda: f"{r.choice(['kim', 'sam', 'ola'])}.{digits(2)}@mail.example.com",
        "secret": lambda: "".join(r.choice("abcdefghkmnpqrstXYZ23456789!#") for _ in range(12)) + "7!",
        "network": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
        "date": lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/19{digits(2)}",
        "id": lambda: f"MBR-{digits(7)}",
        "number": lambda: digits(5),
    }[name]()


def luhn_number(body: str) -> str:
    total = sum(x - 9 * (x > 9) for i, c in enumerate(reversed(body)) for x in [int(c) * (2 - i % 2)])
    return body + str(-total % 10)


def example(index: int, seed: int) -> tuple[str, list[tuple[int, int, str]]]:
    """One text and its gold spans: a slot {x} is labelled, a decoy {~x} isn't; sometimes text around it or an ending."""
    r = random.Random(f"{seed}:{index}")
    text, spans = "", []
    for i, part in enumerate(r.choice(TEMPLATES).replace("}", "{").split("{")):
        if i % 2 == 0:
            text += part
            continue
        value = slot(part.lstrip("~"), r)
        if not part.startswith("~"):
            spans.append((len(text), len(text) + len(value), part))
        text += value
    if r.random() < 0.3:
        lead = r.choice(["Hi team, ", "FYI: ", "As agreed, "])
        text, spans = lead + text, [(a + len(lead), b + len(lead), t) for a, b, t in spans]
    if r.random() < 0.08:
        text += r.choice([" Thanks!", " Best, M."])
    return text, spans


def generate(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(index, text, pii_spans): n generated examples; each depends on seed and index alone, so any task can make any of them."""
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pii_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())])))])

    def make(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *example(i, seed)) for i in f["id"].tolist()]
            yield pd.DataFrame({"index": [i for i, _, _ in rows], "text": [t for _, t, _ in rows], "pii_spans": [[{"start": a, "end": b, "type": k} for a, b, k in s] for _, _, s in rows]})

    return spark.range(n).mapInPandas(make, schema)
