"""Evaluation of detectors: recall of candidates, confusion matrices, threshold sweeps, value metrics, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import occurrences, overlaps

THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def with_prf(df: DataFrame) -> DataFrame:
    """df (tp, fp, fn) with precision, recall and f1; 0 where a denominator is 0."""
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    both = df.withColumn("precision", precision).withColumn("recall", recall)
    return both.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(pred: Column, truth: Column) -> list[Column]:
    count = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    return [count(pred & truth, "tp"), count(pred & ~truth, "fp"), count(~pred & truth, "fn"), count(~pred & ~truth, "tn")]


def gold_spans(text: Column, values: Column) -> Column:
    """array<struct<start,end>> of all occurrences of all labelled values."""
    return F.flatten(F.transform(values, lambda v: occurrences(text, v)))


def candidate_recall(df: DataFrame, text: str = "text", values: str = "pii", spans: str = "spans") -> DataFrame:
    """(gold, covered, n_missed, recall): labelled values of which some occurrence overlaps some candidate; recall 1 without any."""
    return with_recall(covered_values(df, text, values, spans))


def covered_values(df: DataFrame, text: str = "text", values: str = "pii", spans: str = "spans") -> DataFrame:
    """One row for each labelled value: text, value, covered, and why it isn't."""
    each = df.select(F.col(text).alias("text"), F.col(spans).alias("spans"), F.explode(values).alias("value")).withColumn("at", occurrences(F.col("text"), F.col("value")))
    hit = F.exists("at", lambda g: F.exists("spans", lambda s: overlaps(s, g)))
    return each.select("text", "value", hit.alias("covered"), F.when(~hit, F.when(F.size("at") == 0, "label not found in text").otherwise("no candidate overlaps it")).alias("why"))


def with_recall(covered: DataFrame) -> DataFrame:
    n = covered.agg(F.count("*").alias("gold"), F.coalesce(F.sum(F.col("covered").cast("long")), F.lit(0)).alias("covered"))
    return n.select("gold", "covered", (F.col("gold") - F.col("covered")).alias("n_missed"), F.when(F.col("gold") == 0, 1.0).otherwise(F.col("covered") / F.col("gold")).alias("recall"))


def scored_pieces(df: DataFrame, keys: list[str], spans: str = "spans", scores: str = "scores", gold: str = "gold") -> DataFrame:
    """One row for each candidate: keys, start, end, p, truth (whether it overlaps gold)."""
    zipped = F.arrays_zip(F.col(spans).alias("s"), F.col(scores).alias("p"))
    each = df.select(*keys, F.col(gold).alias("gold"), F.explode(zipped).alias("z"))
    return each.select(*keys, F.col("z.s.start").alias("start"), F.col("z.s.end").alias("end"), F.col("z.p").alias("p"), F.exists("gold", lambda g: overlaps(F.col("z.s"), g)).alias("truth"))


def piece_metrics(pieces: DataFrame, threshold: float = 0.5) -> DataFrame:
    return with_prf(pieces.agg(*confusion(F.col("p") >= threshold, F.col("truth"))))


def threshold_sweep(pieces: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """piece_metrics at each threshold, from one pass over the scored candidates."""
    at = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    each = pieces.groupBy("p", "truth").agg(F.count("*").alias("n")).select("p", "truth", "n", at)  # few distinct scores, if rounded
    pred, truth, n = F.col("p") >= F.col("threshold"), F.col("truth"), F.col("n")
    count = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    return with_prf(each.groupBy("threshold").agg(count(pred & truth, "tp"), count(pred & ~truth, "fp"), count(~pred & truth, "fn"), count(~pred & ~truth, "tn")))


def value_metrics(df: DataFrame, text: str = "text", masked: str = "masked", pii: str = "pii", keep: str = "keep") -> DataFrame:
    """Labelled values that vanished or stayed in the masked text, in any case of letters; and clean texts that were changed."""
    low = F.lower(F.col(masked))
    inside = lambda v: low.contains(F.lower(v))
    count = lambda a, f: F.coalesce(F.sum(F.size(F.filter(a, f))), F.lit(0))
    clean = F.size(pii) == 0
    sums = df.agg(
        count(pii, lambda v: ~inside(v)).alias("tp"), count(keep, lambda v: ~inside(v)).alias("fp"), count(pii, inside).alias("fn"), count(keep, inside).alias("tn"),
        F.coalesce(F.sum((clean & (F.col(masked) != F.col(text))).cast("int")), F.lit(0)).alias("clean_inputs_touched"), F.coalesce(F.sum(clean.cast("int")), F.lit(0)).alias("clean_inputs"),
    )
    return with_prf(sums)


def masked(text: Column, spans: Column, scores: Column, threshold: float) -> Column:
    """The text with each candidate at or over the threshold replaced by [PII]."""
    taken = F.filter(F.arrays_zip(spans.alias("s"), scores.alias("p")), lambda z: z["p"] >= threshold)

    def step(state: Column, z: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, z["s"]["start"] - state["at"])
        return F.struct(z["s"]["end"].cast("int").alias("at"), F.concat(state["out"], gap, F.lit("[PII]")).alias("out"))

    return F.aggregate(taken, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(F.length(text) - s["at"], F.lit(0)))))


def errors(pieces: DataFrame, threshold: float = 0.5, top: int = 20) -> DataFrame:
    """The worst wrong decisions: `top` misses and `top` false alarms by descending p (a report, so a limit)."""
    wrong = pieces.withColumn("kind", F.when((F.col("p") >= threshold) & ~F.col("truth"), "false_positive").when((F.col("p") < threshold) & F.col("truth"), "false_negative")).where("kind IS NOT NULL")
    order = [F.col("p").desc(), *[F.col(c) for c in pieces.columns if c not in ("p", "truth")]]
    return wrong.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("rank") <= top)


def hard_examples(df: DataFrame, spans: str = "spans", scores: str = "scores", gold: str = "gold", threshold: float = 0.5) -> DataFrame:
    """Rows with any wrong decision."""
    zipped = F.arrays_zip(F.col(spans).alias("s"), F.col(scores).alias("p"))
    return df.where(F.exists(zipped, lambda z: (z["p"] >= threshold) != F.exists(F.col(gold), lambda g: overlaps(z["s"], g))))


def match_predictions(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """(tp, fp, fn, precision, recall, f1): a prediction takes the first gold span (by start, then end) it overlaps; gold that none takes is missed."""
    order = F.array_sort(F.array_distinct(F.transform(F.col(gold), lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end")))))
    ps = F.array_distinct(F.transform(F.col(pred), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    taken = F.transform(ps, lambda p: F.get(F.filter(order, lambda g: overlaps(p, g)), F.lit(0)))
    rows = df.select(F.size(F.filter(taken, lambda t: t.isNotNull())).alias("tp"), F.size(F.filter(taken, lambda t: t.isNull())).alias("fp"), (F.size(order) - F.size(F.array_distinct(F.filter(taken, lambda t: t.isNotNull())))).alias("fn"))
    return with_prf(rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def compare_detectors(a: DataFrame, b: DataFrame, keys: list[str], score: str = "p") -> DataFrame:
    """Full outer join of two detectors' spans: keys, p_a, p_b, side (both, only_a, only_b)."""
    joined = a.select(*keys, F.col(score).alias("p_a")).join(b.select(*keys, F.col(score).alias("p_b")), keys, "full_outer")
    return joined.withColumn("side", F.when(F.col("p_b").isNull(), "only_a").when(F.col("p_a").isNull(), "only_b").otherwise("both"))


def comparison_stats(compared: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(shared, only_a, only_b, max_delta, median_delta, crossed, interchangeable); the median is the upper one.

    The median comes from counts of rounded deltas in ascending order, which are few, not from sorting all rows.
    """
    delta = F.round(F.abs(F.col("p_a") - F.col("p_b")), 6)
    crossed = (F.least("p_a", "p_b") < threshold) & (F.greatest("p_a", "p_b") >= threshold)
    n = lambda side: F.sum((F.col("side") == side).cast("int"))
    total = compared.agg(n("both").alias("shared"), n("only_a").alias("only_a"), n("only_b").alias("only_b"), F.max(delta).alias("max_delta"), F.coalesce(F.sum(crossed.cast("int")), F.lit(0)).alias("crossed"))
    by = compared.where("side = 'both'").groupBy(delta.alias("d")).agg(F.count("*").alias("n"))
    running = by.withColumn("upto", F.sum("n").over(Window.orderBy("d"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    median = running.where("upto > all div 2").agg(F.min("d").alias("median_delta"))
    return total.join(median, how="left").withColumn("interchangeable", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("crossed") == 0))
