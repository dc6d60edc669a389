"""Building labelled corpora: mapping labels, checking offsets, stratified samples, splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How labels of an external dataset map to types.
SENSITIVE = "sensitive_attribute"
ADOPT = {
    "person_name": ["first_name", "last_name"],
    "email": ["email"],
    "phone": ["phone_number", "fax_number"],
    "address": ["street_address", "postcode", "coordinate"],
    "date_of_birth": ["date_of_birth", "date"],
    "government_id": ["ssn", "national_id", "tax_id", "certificate_license_number", "license_plate", "vehicle_identifier", "medical_record_number", "health_plan_beneficiary_number"],
    "payment_card": ["credit_debit_card"],
    "financial": ["account_number", "bank_routing_number", "swift_bic"],
    "secret": ["password", "pin", "cvv", "api_key", "http_cookie", "user_name"],
    "network_address": ["ipv4", "ipv6", "mac_address"],
    "personal_data": ["customer_id", "employee_id", "unique_id", "device_identifier", "biometric_identifier"],
}
NEGATIVE = ["company_name", "occupation", "employment_status", "education_level", "city", "state", "county", "country", "language"]
SENSITIVE_LABELS = ["age", "gender", "race_ethnicity", "religious_belief", "sexuality", "political_view", "blood_type"]
SKIP = ["date_time", "time", "url"]
MISSED = ["date_of_birth", "ipv4", "ipv6", "phone_number", "postcode", "street_address"]

SPAN = "array<struct<start:int,end:int,text:string,label:string>>"


def label_map() -> list[tuple[str, str, str | None]]:
    """(label, bucket, type) of all mapped labels."""
    out = [(label, "adopt", kind) for kind, labels in ADOPT.items() for label in labels]
    return out + [(x, "negative", None) for x in NEGATIVE] + [(x, "sensitive", SENSITIVE) for x in SENSITIVE_LABELS] + [(x, "skip", None) for x in SKIP]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_map(), "label string, bucket string, type string")


def with_buckets(df: DataFrame, label: str = "label") -> DataFrame:
    """Lookup join with the label table (a fixed small one, so broadcast); labels that it lacks are unmapped."""
    table = label_table(df.sparkSession).select(F.col("label").alias("__label"), "bucket", "type")
    joined = df.join(F.broadcast(table), F.col(label) == F.col("__label"), "left").drop("__label")
    return joined.withColumn("bucket", F.coalesce("bucket", F.lit("unmapped")))


def bucket_of(label: Column) -> Column:
    """struct<bucket,type> of a label, without a join."""
    bucket, kind = F.lit("unmapped"), F.lit(None).cast("string")
    for b in ("skip", "sensitive", "negative", "adopt"):
        bucket = F.when(label.isin([x for x, y, _ in label_map() if y == b]), b).otherwise(bucket)
    for t, labels in {**ADOPT, SENSITIVE: SENSITIVE_LABELS}.items():
        kind = F.when(label.isin(labels), t).otherwise(kind)
    return F.struct(bucket.alias("bucket"), kind.alias("type"))


def label_overlaps(df: DataFrame) -> DataFrame:
    """Labels that are in more than one bucket (there should be none)."""
    return df.groupBy("label").agg(F.count_distinct("bucket").alias("buckets")).where("buckets > 1")


def convert(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with pii_spans, pii, keep and source_labels; rows without text, or with neither a positive nor a negative span, go.

    spans: SPAN. A span counts only if its offsets still point at its text.
    """
    fits = lambda s: s["text"].isNotNull() & s["start"].isNotNull() & s["end"].isNotNull() & F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).eqNullSafe(s["text"])
    good = F.transform(F.filter(F.coalesce(F.col(spans), F.array().cast(SPAN)), fits), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label"), bucket_of(s["label"]).alias("b")))
    out = df.where(F.length(text) > 0).withColumn("__good", good)
    own = F.filter("__good", lambda s: s["b"]["bucket"].isin("adopt", "sensitive"))
    out = (
        out.withColumn("pii_spans", F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["b"]["type"].alias("type"))))
        .withColumn("pii", F.transform(own, lambda s: s["text"]))
        .withColumn("keep", F.transform(F.filter("__good", lambda s: s["b"]["bucket"] == "negative"), lambda s: s["text"]))
        .withColumn("source_labels", F.transform(own, lambda s: s["label"]))
    )
    return out.where((F.size("pii_spans") > 0) | (F.size("keep") > 0)).drop("__good")


def example_score(labels: Column, keep: Column, locale: Column) -> Column:
    """3 for each distinct target label, 14 if there is any negative, 2 for each of up to four negatives, 1 for the locale intl."""
    targets = F.size(F.array_intersect(F.array_distinct(labels), F.array(*[F.lit(x) for x in MISSED])))
    return 3 * targets + F.when(F.size(keep) > 0, 14).otherwise(0) + 2 * F.least(F.size(keep), F.lit(4)) + F.when(locale.eqNullSafe(F.lit("intl")), 1).otherwise(0)


def ranked(df: DataFrame, key: str, seed: int = 20261003, labels: str = "source_labels", keep: str = "keep", locale: str = "locale") -> DataFrame:
    """df with score and tie, a hash of seed and key that breaks ties."""
    return df.withColumn("score", example_score(F.col(labels), F.col(keep), F.col(locale))).withColumn("tie", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))


def stratified(df: DataFrame, key: str, n: int, date_share: float = 0.2, seed: int = 20261003, labels: str = "source_labels", keep: str = "keep", locale: str = "locale") -> DataFrame:
    """n rows of df by score, after a floor for each target label and with a cap on rows that lean on dates (a sampling operator; key is unique).

    Labels take their floors in alphabetical order from rows that none before them took. Since a label loses at most the
    floors of those before it, one bounded top-k for each label holds all it can take, and likewise for the fill: the
    driver gathers keys and ranks in proportion to n only, and settles the order-dependent part there.
    """
    own = ranked(df, key, seed, labels, keep, locale)
    slim = own.select(F.col(key).alias("k"), "score", "tie", F.col(labels).alias("labels"))
    floor, budget = max(20, n // len(MISSED) // 4), int(n * date_share)
    order = [F.col("score").desc(), F.col("tie")]
    each = slim.select("k", "score", "tie", F.explode(F.array_intersect("labels", F.array(*[F.lit(x) for x in MISSED]))).alias("label"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("r") <= floor * len(MISSED)).select("label", "r", "k").collect()
    taken: dict = {}
    for label in MISSED:
        free = [r.k for r in sorted((r for r in top if r.label == label), key=lambda r: r.r) if r.k not in taken]
        taken.update(dict.fromkeys(free[: min(floor, n - len(taken))]))
    dated = 2 * F.size(F.filter("labels", lambda x: x == "date")) > F.size("labels")
    rest = slim.select("k", "score", "tie", dated.alias("dated"))
    bounds = ((~F.col("dated"), n), (F.col("dated"), budget + len(taken)))
    fill = sorted((r for which, most in bounds for r in rest.where(which).orderBy(*order).limit(most).collect()), key=lambda r: (-r.score, r.tie))
    dates = 0
    for r in fill:
        if len(taken) >= n:
            break
        if r.k in taken or (r.dated and dates >= budget):
            continue
        dates += r.dated
        taken[r.k] = None
    chosen = df.sparkSession.createDataFrame([(k,) for k in taken], df.select(F.col(key).alias("__k")).schema)
    return own.join(F.broadcast(chosen), F.col(key) == F.col("__k"), "left_semi")  # at most n rows


def counts(df: DataFrame, array: str, name: str) -> DataFrame:
    """How often each element of an array column occurs."""
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def label_report(df: DataFrame, spans: str = "spans", examples: int = 3) -> DataFrame:
    """(label, bucket, type, n, examples): of all spans; up to `examples` of the smallest distinct values each."""
    each = df.select(F.explode(spans).alias("s")).select("s.label", "s.text")
    n = each.groupBy("label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("text"))
    few = each.distinct().withColumn("r", rank).where(F.col("r") <= examples).groupBy("label").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    return with_buckets(n.join(few, "label", "left"))


def unseen_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Mapped labels that df lacks."""
    table = label_table(df.sparkSession)
    return table.join(df.select(F.col(label).alias("label")).distinct(), "label", "left_anti")


def parity_split(df: DataFrame, index: str, validation: float = 0.2, seed: int = 7) -> DataFrame:
    """df with split: even indices are train or, for a hashed fifth, val; odd ones are test."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(index)), F.lit(1000)) < int(1000 * validation)
    return df.withColumn("split", F.when(F.col(index) % 2 != 0, "test").when(u, "val").otherwise("train"))


def union_all(*corpora: DataFrame) -> DataFrame:
    """Rows of all corpora; columns that some lack are null."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def span_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct spans of one side only: keys and side."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("a")).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("b")))
