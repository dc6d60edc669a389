import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from kelpie.functions import rewrite, taxonomy, typing
from kelpie.plans.queries import VALUES


def test_types_of_values(spark):
    df = spark.createDataFrame([(v,) for v in [*VALUES, None]], "v string")
    got = {r.v: (r.a, r.b) for r in df.select("v", typing.classify(F.col("v")).alias("a"), typing.guess_type(F.col("v")).alias("b")).collect()}
    assert got == VALUES | {None: (None, None)}


@pytest.mark.parametrize(("number", "valid"), [("4111 1111 1111 1111", True), ("4111-1111-1111-1112", False), ("0", False), ("000000000000", True), ("٤١١١١١١١١١١١١١١١", True)])
def test_luhn(spark, number, valid):
    assert spark.range(1).select(typing.luhn_valid(F.lit(number))).first()[0] is valid


def test_taxonomy_is_closed():
    assert set(taxonomy.HIGH_RISK) <= set(taxonomy.CATEGORIES)
    assert {taxonomy.CATEGORY_OF[t] for t in taxonomy.ALL_TYPES} <= set(taxonomy.CATEGORIES)
    assert len(taxonomy.ALL_TYPES) == len(taxonomy.CATEGORIES) + sum(map(len, taxonomy.SPECIFIC.values()))


def test_unknown_types_are_their_own_category(spark):
    row = spark.range(1).select(taxonomy.category_of(F.lit("claim_no")).alias("c"), taxonomy.reason_codes(F.lit("pan")).alias("r"), taxonomy.is_high_risk(F.lit("pan")).alias("h")).first()
    assert (row.c, row.r, row.h) == ("claim_no", ["PII_PAN", "PII_GOVERNMENT_ID"], True)


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_keyed_tokens_equal_hmac(spark, key):
    value = "Zoë 4111"
    got = spark.range(1).select(rewrite.token(key, F.lit(value), F.lit("pan"))).first()[0]
    assert got == f"<PAN_{hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:12]}>"


def test_token_keys():
    assert rewrite.token_key("abc") == b"abc"
    assert rewrite.token_key() != rewrite.token_key()
