"""Span generators on built-in functions, overlap resolution and interval predicates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bound, folded
from ..functions.dialect import DIGIT, java
from ..functions.taxonomy import CATEGORY_OF
from ..functions.typing import luhn_valid

DETECTION = "struct<start:int,end:int,type:string,confidence:double,detector:string,category:string,seq:int>"
SPANS = "array<struct<start:int,end:int>>"

# Shapes that prove themselves, and the value after a label, in classes that functions.dialect writes out for an engine.
SECRET = r"(?<![<w>])(?:sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
EMAIL = r"<edge>[<w>.%+-]++@[<w>.-]+\.[A-Za-z]{2,}<edge>"
CARD = r"(?<![<w>])(?:<digit>[ -]?){12,18}<digit>(?![<w>])"
LABEL = r"(<edge>(?:{label})<edge><space>*(?::|=|is|-)?<space>+)([<nonspace>,;]+(?:[ -]<digit>{{2,}}){{0,3}})"
# Labels whose value is a finding, in the order in which they are tried.
FIELDS = [
    (r"a/?c|acct|account(?: number| no\.?)?|bank account", "bank_account"),
    (r"ifsc|routing(?: number)?|sort code", "ifsc"),
    (r"upi(?: id)?", "upi_id"),
    (r"cvv|cvc", "cvv"),
    (r"otp|verification code|2fa", "otp"),
    (r"password|passcode|pwd", "password"),
    (r"api[ _-]?key|secret|token", "api_key"),
    (r"(?:login )?user ?name|user id", "secret"),
    (r"aadhaar|aadhar", "aadhaar"),
    (r"pan(?: number)?", "pan"),
    (r"passport(?: number| no\.?)?", "passport"),
    (r"driver'?s? licen[cs]e(?: number| no\.?)?|dl no\.?", "driver_license"),
    (r"mrn|medical record number", "medical_record"),
    (r"(?:insurance )?member id|policy(?: number| no\.?)?", "health_insurance"),
    (r"employee id|emp id", "employee_id"),
    (r"ssn", "ssn"),
    (r"(?:tax|national) id(?: number)?", "tax_id"),
    (r"ip(?: address)?", "ip_address"),
    (r"mac(?: address)?", "mac_address"),
    (r"dob|date of birth", "date_of_birth"),
    (r"phone|mobile|contact(?: number)?|cell", "phone"),
]
#: Of labels whose values need no digits: pieces of which every match of the label holds one, in lower case.
STEMS = {
    "cvv": ["cvv", "cvc"],
    "otp": ["otp", "verification code", "2fa"],
    "password": ["password", "passcode", "pwd"],
    "api_key": ["key", "secret", "token"],
    "secret": ["user"],
}
NO_SECRETS = ["closed", "expired", "reset"]


def find_spans(text: Column, pattern: str, gate: Column, values: bool = False) -> Column:
    """array<struct<start,end,value>> of leftmost non-overlapping matches, by running sums of the lengths of gaps and matches.

    The gate is a cheap test that every text with a match passes. values: the pattern has two groups, a prefix and
    the value that follows it up to the match's end, and the spans are those of the value.
    """
    kind = "struct<start:int,end:int,value:string>"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    facts = [F.split(text, pattern, -1).alias("gaps"), whole.alias("whole")]
    facts += [F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("values")] if values else []

    def step(at: Column, part: Column) -> tuple[Column, Column, None]:
        end = (at + F.length(part["gap"]) + F.length(part["whole"])).cast("int")
        value = part["value" if values else "whole"]
        return end, F.struct((end - F.length(value)).cast("int").alias("start"), end.alias("end"), value.alias("value")), None

    def body(known: Column) -> Column:
        parts = [F.slice(known["gaps"], 1, F.size(known["whole"])).alias("gap"), known["whole"].alias("whole")]
        parts += [known["values"].alias("value")] if values else []
        found = folded(F.arrays_zip(*parts), F.lit(0).cast("int"), kind, step)
        return F.when(F.size(known["whole"]) > 0, found).otherwise(F.array().cast(f"array<{kind}>"))

    return F.when(gate, bound(F.struct(*facts), body)).otherwise(F.array().cast(f"array<{kind}>"))


def as_detections(spans: Column, kind: str, detector: str, seq: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"), F.lit(detector).alias("detector"), F.lit(CATEGORY_OF.get(kind, kind)).alias("category"), F.lit(seq).alias("seq")),
    )


def secrets(text: Column) -> Column:
    gate = text.contains("sk-") | text.contains("ghp_") | text.contains("AKIA") | text.contains("eyJ")
    return as_detections(find_spans(text, java(SECRET), gate), "secret", "regex", 100)


def emails(text: Column) -> Column:
    return as_detections(find_spans(text, java(EMAIL), text.contains("@")), "email", "regex", 101)


def cards(text: Column) -> Column:
    found = find_spans(text, java(CARD), text.rlike(DIGIT) & text.rlike(rf"{DIGIT}[ -]?{DIGIT}[ -]?{DIGIT}[ -]?{DIGIT}"))
    return as_detections(F.filter(found, lambda s: luhn_valid(s["value"])), "payment_card", "regex", 102)


def field_pattern(label: str) -> str:
    return "(?iu)" + java(LABEL.format(label=label))


def fields(text: Column, labels: list[tuple[str, str]] | None = None) -> Column:
    """Values that a label before them names.

    Most values need four digits, so texts without any digit skip those labels by one cheap test; the others are
    preceded by a search for plain pieces of their labels. Regexes run on what is left. The tests' operands are bound as
    a lambda's variable, so that they are computed once a text and not once a label.
    """
    odd = text.contains("ſ") | text.contains("ı") | text.contains("\u212a")  # letters that match s, i and k in any case
    facts = F.struct(F.lower(text).alias("low"), text.rlike(DIGIT).alias("numbers"), odd.alias("odd"))

    def one(i: int, label: str, kind: str, known: Column) -> Column:
        if CATEGORY_OF.get(kind, kind) == "secret":
            good = lambda s: (F.length(s["value"]) >= 6) & ~F.lower(s["value"]).isin(NO_SECRETS)
            gate = reduce(or_, [known["low"].contains(x) for x in STEMS[kind]], known["odd"]) if kind in STEMS else F.lit(True)
        else:
            good = lambda s: F.regexp_count(s["value"], F.lit(DIGIT)) >= 4
            gate = known["numbers"] & text.rlike(rf"(?iu)(?:{label})")

        def trimmed(s: Column) -> Column:
            value = F.regexp_replace(s["value"], r"""[.:!?'")\]}>]+\z""", "")
            return F.struct(s["start"].alias("start"), (s["start"] + F.length(value)).cast("int").alias("end"), value.alias("value"))

        found = find_spans(text, field_pattern(label), gate, values=True)
        return as_detections(F.filter(F.transform(found, trimmed), good), kind, "field-regex", 200 + i)

    every = list(enumerate(FIELDS if labels is None else labels))
    plain = {x for _, kind in FIELDS if labels is None for x in STEMS.get(kind, [])}

    def all_of(known: Column) -> Column:
        found = F.concat(*[one(i, label, kind, known) for i, (label, kind) in every])
        if labels is not None:
            return found
        some = reduce(or_, [known["low"].contains(x) for x in sorted(plain)], known["numbers"] | known["odd"])
        return F.when(some, found).otherwise(F.array().cast(f"array<{DETECTION}>"))

    return F.get(F.transform(F.array(facts), all_of), F.lit(0))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def without(spans: Column, settled: Column) -> Column:
    """Interval anti-join inside a row: spans that overlap none of the settled ones."""
    return F.filter(spans, lambda s: ~F.exists(settled, lambda d: overlaps(s, d)))


def resolved(found: Column) -> Column:
    """Detections by start (custom first, then longer, then earlier stage), each kept unless it starts inside the last kept one."""
    keyed = F.transform(found, lambda d: F.struct(d["start"].alias("k1"), F.when(d["detector"] == "custom-regex", 0).otherwise(1).alias("k2"), (d["start"] - d["end"]).alias("k3"), d["seq"].alias("k4"), d.alias("d")))

    def step(end: Column, x: Column) -> tuple[Column, Column, Column]:
        fits = x["d"]["start"] >= end
        return F.when(fits, x["d"]["end"]).otherwise(end), x["d"], fits

    return folded(F.array_sort(keyed), F.lit(0).cast("int"), DETECTION, step)


def context(text: Column, span: Column, chars: int = 120) -> Column:
    """struct<text,span> that a scorer sees: the value and `chars` code points on each side."""
    from_ = F.greatest(span["start"] - chars, F.lit(0))
    return F.struct(F.substring(text, from_ + 1, span["end"] + chars - from_).alias("text"), F.substring(text, span["start"] + 1, span["end"] - span["start"]).alias("span"))


def occurrences(text: Column, value: Column) -> Column:
    """array<struct<start,end>> of all occurrences of a value in any case, overlapping ones too; none for an empty value.

    The text is split before each occurrence, so that the lengths of the parts are the places.
    """
    low, v = F.lower(text), F.lower(value)
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E)"))

    def step(at: Column, part: Column) -> tuple[Column, Column, Column]:
        span = F.struct(at.alias("start"), (at + F.length(value)).cast("int").alias("end"))
        return (at + F.length(part)).cast("int"), span, (at > 0) | low.startswith(v)

    starts = folded(F.split(low, quoted, -1), F.lit(0).cast("int"), "struct<start:int,end:int>", step)
    return F.when((F.length(v) > 0) & low.contains(v), starts).otherwise(F.array().cast(SPANS))
