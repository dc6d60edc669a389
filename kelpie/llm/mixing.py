"""Mixing sources to target weights by Poisson replication.

A source s with weight w_s gets the mean repetition rate
    rate_s = (w_s / sum of weights) * budget / units_s
(units: code points). A document's count is the inverse of the Poisson distribution with
that mean at a number in [0, 1) hashed from seed and doc_id, so it depends on nothing but
the document, its source's rate and the seed. Each document is repeated by its count and
all copies are put in the order of a second hash.

Up to the rate LARGE the inverse is read from a table of the distribution; beyond, it is the
floor of its asymptotic expansion in powers of the rate's root at the normal quantile, which
differs from the exact count in fewer than one of 10,000 documents, and then by one.

A source of few units may repeat a document any number of times. Documents of such sources are
first repeated by blocks of BLOCK copies, the blocks are dealt to all tasks, and each is repeated
by its copies there. Units of sources are summed once and written to the shared folder.

Defined cases: a null source is a source of its own; a null text has no units; a source
without units keeps its documents once on average (rate 1); documents with equal ids (null
ids included) get equal numbers, so equal counts within a source; rows that are repeated in
the input are repeated in the output; an empty table gives an empty result. Sources that
`weights` doesn't name get weight 0. Columns of any name are kept, but for those named like
a column that `replicate` adds.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SEED = 17
#: The rate from which counts come from the expansion, and copies of a document that one task makes.
LARGE, BLOCK = 2000, 10_000
#: Entries of distribution tables that may be broadcast; beyond, the join shuffles.
BROADCAST_ENTRIES = 200_000
# Coefficients, from the constant on, of the rational functions of algorithm AS 241 for
# the normal quantile (around the median, in the tails, far in the tails), each a numerator and a denominator.
MIDDLE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3], [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
TAIL = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4], [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
FAR = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def hashed(seed: int, what: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def unit_interval(digest: Column) -> Column:
    """52 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def quotient(x: str, of: tuple[list[float], list[float]]) -> str:
    """A rational function of x in SQL that Spark and DuckDB read alike."""
    a, b = (reduce(lambda inner, c: f"({inner} * {x} + {c!r}D)", reversed(cs[:-1]), f"{cs[-1]!r}D") for cs in of)
    return f"({a} / {b})"


def normal_quantile(u: str) -> str:
    """In SQL; u is held in (0, 1)."""
    u = f"greatest({u}, 1e-17D)"
    r = f"sqrt(-ln(least({u}, 1.0D - {u})))"
    outer = f"CASE WHEN {r} <= 5.0D THEN {quotient(f'({r} - 1.6D)', TAIL)} ELSE {quotient(f'({r} - 5.0D)', FAR)} END"
    return f"CASE WHEN abs({u} - 0.5D) <= 0.425D THEN ({u} - 0.5D) * {quotient(f'(0.180625D - ({u} - 0.5D) * ({u} - 0.5D))', MIDDLE)} ELSE sign({u} - 0.5D) * ({outer}) END"


def large_count(rate: str, w: str) -> str:
    """The inverse of the Poisson distribution with a large mean at the normal quantile w, in SQL."""
    return f"CAST(greatest(floor({rate} + sqrt({rate}) * {w} + (2.0D + {w} * {w}) / 6.0D - ({w} * 2.0D + {w} * {w} * {w}) / 72.0D / sqrt({rate}) + ({w} * {w} * {w} * {w} * 3.0D + {w} * {w} * 7.0D - 16.0D) / 810.0D / {rate}), 0.0D) AS BIGINT)"


def poisson_cdf(rate: Column, top: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... P(X <= top) as an array, for rates up to about LARGE."""
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, j: Column) -> Column:
        log_p = s["log_p"] + F.ln(rate) - F.ln(j.cast("double"))
        return F.struct(log_p.alias("log_p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + F.exp(log_p)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate) of each source."""
    units = saved(docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("units")))
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*pairs, F.lit(0.0))
    units = units.withColumn("weight", weight)
    total = units.agg(F.sum("weight").alias("w"), F.sum("units").alias("u")).first()
    all_weight, goal = float(total.w or 0.0), float(budget if budget is not None else total.u or 0)
    share = F.col("weight") / F.lit(all_weight) * F.lit(goal) / F.col("units").cast("double") if all_weight > 0 else F.lit(0.0)
    return units.select("source", F.when(F.col("units") > 0, share).otherwise(F.lit(1.0)).alias("rate"))


def counted(rates: DataFrame, u: str = "u") -> Column:
    """How often a document with the number u is repeated; rates: of (rate, cdf), as `replicate` joins them."""
    return F.when(F.col("rate") > LARGE, F.expr(large_count("rate", "w"))).otherwise(F.size(F.filter("cdf", lambda c: c <= F.col(u))).cast("long"))


def draws(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, copy, rate, order): each row of docs as a struct, as often as drawn, with the copy's number from 1."""
    rates = source_rates(docs, weights, budget, source, text)
    top = F.when(F.col("rate") <= LARGE, F.ceil(F.col("rate") + 12 * F.sqrt("rate")) + 40).otherwise(0).cast("int")
    most = rates.agg(F.sum(top.cast("long") + 1).alias("entries"), F.max("rate").alias("rate")).first()
    rates = rates.select(F.col("source").alias("of"), "rate", F.when(F.col("rate") <= LARGE, poisson_cdf(F.col("rate"), top)).alias("cdf"))
    rates = F.broadcast(rates) if (most.entries or 0) <= BROADCAST_ENTRIES else rates
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"))
    u = unit_interval(hashed(seed, "count", F.col("id")))

    def repeated(rates: DataFrame, blocks: bool) -> DataFrame:
        met = own.withColumn("u", u).join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("w", F.when(F.col("rate") > LARGE, F.expr(normal_quantile("u"))))
        met = met.withColumn("n", counted(rates)).where("n >= 1").select("row", "id", "rate", "n")
        if blocks:
            met = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long")))).repartition(F.xxhash64("id", "block"))
            met = met.withColumn("copy", F.explode(F.sequence(F.col("block") * block + 1, F.least((F.col("block") + 1) * block, F.col("n")))))
        else:
            met = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        return met.select("row", "id", "copy", "rate")

    limit = block / 4  # a count is never near four times such a rate
    if (most.rate or 0.0) <= limit:
        out = repeated(rates, False)
    else:
        out = repeated(rates.where(F.col("rate") <= limit), False).unionByName(repeated(rates.where(F.col("rate") > limit), True))
    out = out.withColumn("order", hashed(seed, "order", F.col("id"), F.col("copy")))
    return out.orderBy("order", "id", "copy").select("row", "copy", "rate", "order")


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", added: bool = True) -> DataFrame:
    """Rows of docs, each as often as drawn, in the order of a hash; added: with __copy (from 1), __rate and __order (hex)."""
    more = {"__copy": "copy", "__rate": "rate", "__order": "order"} if added else {}
    out = draws(docs, weights, budget, seed, doc_id, source, text)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in more], *[F.col(c).alias(name) for name, c in more.items()])


def counts_sql(seed: int = SEED) -> str:
    """DuckDB SQL of (doc_id, source, text, rate, n) with equal weights."""
    duck = lambda sql: re.sub(r"(?<=[0-9])D\b", "", sql)
    return f"""
units AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS units FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN units > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM units) * (SELECT sum(units) FROM units)::DOUBLE / units ELSE 1.0 END AS rate FROM units),
tops AS (SELECT source, rate, CASE WHEN rate <= {LARGE} THEN (ceil(rate + 12 * sqrt(rate)) + 40)::INT ELSE 0 END AS top FROM rates),
probs AS (SELECT source, rate, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p FROM (SELECT source, rate, unnest(range(0, top + 1)) AS j FROM tops)),
cdf AS (SELECT source, rate, list(c ORDER BY j) AS cdf FROM (SELECT source, rate, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM probs) GROUP BY source, rate),
numbers AS (SELECT *, ('0x' || substr(md5('{seed}|count|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
quantiles AS (SELECT *, {duck(normal_quantile("u"))} AS w FROM numbers),
drawn AS (SELECT d.doc_id, d.source, d.text, rate, CASE WHEN rate > {LARGE} THEN {duck(large_count("rate", "w"))} ELSE len(list_filter(cdf, lambda c: c <= u)) END AS n
  FROM quantiles d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)"""
