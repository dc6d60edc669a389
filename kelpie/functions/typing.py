"""Typing of single values by their shape, as ordered CASE expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import DIGIT as D
from .dialect import NOT_SPACE, SPACE, WORD
from .taxonomy import GENERIC, PERSON

# Prefixes of numbers; the shapes below, and their order, are fixed as well.
PREFIXES = {"DL": "driver_license", "MRN": "medical_record", "EMP": "employee_id", "POL": "health_insurance", "INS": "health_insurance", "MBR": "health_insurance"}
LETTERS = r"[A-Za-zÀ-ÿऀ-ॿ஀-௿]"


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+\z", "")


#: Decimal digits of other scripts, by rule.
OTHER_DIGITS = "".join(chr(i) for i in range(0x80, 0x1FC00) if unicodedata.category(chr(i)) == "Nd")
AS_ASCII = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)


def digits(value: Column) -> Column:
    """The decimal digits of a value, of any script, as ASCII."""
    return F.regexp_replace(F.translate(value, OTHER_DIGITS, AS_ASCII), "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """The card checksum over the digits of a value, of which there are at least 12."""
    d = digits(value)
    return F.coalesce((F.length(d) >= 12) & F.call_function("luhn_check", d), F.lit(False))


def numeric_type(value: Column) -> Column:
    """The type of a run of digits and separators, or null."""
    text, d = stripped(value), digits(value)
    n = F.length(d)
    return (
        F.when(n == 0, None)
        .when(text.startswith("+") & n.between(10, 15), "phone")
        .when(text.rlike(rf"^{D}{{4}}{SPACE}?{D}{{4}}{SPACE}?{D}{{4}}$"), "aadhaar")
        .when(n == 10, F.when(d.rlike("^[6-9]"), "phone").otherwise("financial"))
        .when(n.between(11, 13) & d.rlike("^(?:91|1|44|61)"), "phone")
        .when(n.between(13, 19), F.when(luhn_valid(d), "payment_card").otherwise("financial"))
        .when(n.isin(5, 6), "postal_code")
        .when(n.between(9, 18), "financial")
    )


def classify(value: Column) -> Column:
    """The narrowest type that a value's shape supports; null stays null."""
    v = stripped(value)
    prefix = F.upper(F.regexp_extract(v, r"(?i)^(POL|MBR|EMP|INS|DL|MRN)", 1))
    prefixed = F.when(F.lit(False), "")
    for p, kind in PREFIXES.items():
        prefixed = prefixed.when(prefix == p, kind)
    numeric = numeric_type(v)
    return (
        F.when(value.isNull(), None)
        .when(v == "", GENERIC)
        .when(v.rlike(rf"^[^@\s\x1c-\x1f\x85\p{{Z}}]+@[^@\s\x1c-\x1f\x85\p{{Z}}]+\.[A-Za-z]{{2,}}$"), "email")
        .when(v.rlike(rf"(?iu)^[\p{{L}}\p{{N}}_.-]{{3,}}@(?:ok{WORD}+|paytm|ybl|upi|axl|ibl)$"), "upi_id")
        .when(v.rlike(rf"^(?:{D}{{1,3}}\.){{3}}{D}{{1,3}}$"), "ip_address")
        .when(v.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), "mac_address")
        .when(v.rlike(r"^(?:sk-[A-Za-z0-9]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})"), "api_key")
        .when(v.rlike(r"^eyJ[A-Za-z0-9_-]{6,}\."), "jwt")
        .when(v.rlike(rf"^(?=.*[A-Za-z])(?=.*{D})(?=.*[!@#$%^&*_]){NOT_SPACE}{{8,}}$"), "password")
        .when(v.rlike(rf"^{D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}$|^{D}{{4}}-{D}{{2}}-{D}{{2}}$|^{D}{{1,2}}{SPACE}+[A-Z][a-z]+{SPACE}+{D}{{4}}$"), "date_of_birth")
        .when(v.rlike(rf"^[A-Z]{{5}}{D}{{4}}[A-Z]$"), "pan")
        .when(v.rlike(rf"^{D}{{3}}-{D}{{2}}-{D}{{4}}$"), "ssn")
        .when(v.rlike(rf"^[A-Z]{D}{{7,8}}$"), "passport")
        .when(v.rlike(rf"(?iu)^(?:POL|MBR|EMP|INS|DL|MRN)(?:-|{SPACE})?{WORD}+"), prefixed)
        .when((v.rlike(rf"^\+?{D}(?:{D}|{SPACE}|[()\-]){{7,18}}$") | v.rlike(rf"^(?:{D}|{SPACE}|[()\-])+$")) & numeric.isNotNull(), numeric)
        .when(v.rlike(rf"(?iu)^{D}{{1,5}}[A-Za-z]?{SPACE}+[A-Z]|^(?:Flat|House|H\.?{SPACE}?No|Plot|Door)(?!{WORD})"), "address")
        .when(v.rlike(LETTERS), PERSON)
        .otherwise(GENERIC)
    )


def guess_type(value: Column) -> Column:
    """The coarse type that labels of training values get; null stays null."""
    v = stripped(value)
    return (
        F.when(value.isNull(), None)
        .when(v.rlike(r"^[^@\s\x1c-\x1f\x85\p{Z}]+@[^@\s\x1c-\x1f\x85\p{Z}]+$"), "email")
        .when(v.rlike(rf"^(?:{D}{{1,3}}\.){{3}}{D}{{1,3}}$|^(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}$"), "network")
        .when(v.rlike(rf"^{D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}$|^{D}{{4}}-{D}{{2}}-{D}{{2}}$|^{D}{{1,2}}{SPACE}+[A-Z][a-z]+{SPACE}+{D}{{4}}$"), "date")
        .when(v.rlike(r"^(?:sk-|ghp_|AKIA|eyJ)|[!@#$%^&*]"), "secret")
        .when(v.rlike(rf"^[A-Z]{{5}}{D}{{4}}[A-Z]$|^{D}{{3}}-{D}{{2}}-{D}{{4}}$|^(?:POL|MBR|EMP|INS|DL)(?:-|{D})|^[A-Z]{D}{{7,8}}$"), "id")
        .when(v.rlike(rf"^(?:{D}{{4}}(?:{SPACE}|-)?){{3,4}}{D}{{0,4}}$|^{D}{{9,18}}$"), "financial")
        .when(v.rlike(rf"^\+?(?:{D}|{SPACE}|[()-]){{8,}}$"), "phone")
        .when(v.rlike(rf"(?iu)^{D}{{1,5}}[A-Za-z]?{SPACE}+[A-Z]|^(?:Flat|House|H\.?No)(?!{WORD})"), "address")
        .when(v.rlike(rf"^{D}{{5,6}}$"), "address")
        .when(v.rlike("[A-Za-z]"), "person")
        .otherwise("id")
    )
