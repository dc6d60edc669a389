"""Types, categories, risk and reason codes, as data and as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public vocabulary of findings.
PERSON, GENERIC = "person_name", "personal_data"
CATEGORIES = [PERSON, "email", "phone", "address", "date_of_birth", "government_id", "financial", "payment_card", "secret", "network_address", GENERIC]
SPECIFIC = {
    "government_id": ["aadhaar", "pan", "ssn", "passport", "driver_license", "tax_id", "medical_record", "health_insurance", "employee_id"],
    "financial": ["upi_id", "ifsc", "bank_account"],
    "secret": ["password", "api_key", "jwt", "otp", "pin", "cvv"],
    "network_address": ["ip_address", "mac_address"],
    "address": ["postal_code"],
}
HIGH_RISK = ["secret", "payment_card", "financial", "government_id"]

CATEGORY_OF = {t: c for c, types in SPECIFIC.items() for t in types} | {c: c for c in CATEGORIES}
ALL_TYPES = frozenset(CATEGORY_OF)


def category_of(kind: Column) -> Column:
    """The category of a type; an unknown type is its own category."""
    table = F.create_map(*chain.from_iterable((F.lit(t), F.lit(c)) for t, c in CATEGORY_OF.items()))
    return F.coalesce(F.try_element_at(table, kind), kind)


def is_high_risk(kind: Column) -> Column:
    return category_of(kind).isin(HIGH_RISK)


def reason_codes(kind: Column, category: Column | None = None) -> Column:
    """PII_<TYPE>, and PII_<CATEGORY> where that differs."""
    broad = category_of(kind) if category is None else F.coalesce(category, category_of(kind))
    own, wide = F.concat(F.lit("PII_"), F.upper(kind)), F.concat(F.lit("PII_"), F.upper(broad))
    return F.when(kind == broad, F.array(own)).otherwise(F.array(own, wide))


def policy_matches(kind: Column, wanted: list[str]) -> Column:
    """Whether a policy rule names the type or its category."""
    return F.arrays_overlap(F.array(kind, category_of(kind)), F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(False)
