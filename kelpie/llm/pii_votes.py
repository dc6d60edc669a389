"""Personal data by weak-supervision aggregation, by DataFrame functions only.

Base spans (kinds email, ip, card, phone) are always reported. Candidates are the base
spans and spans of looser shapes (weak_phone, weak_card, weak_ip, ssn). Five labelers vote
-1, 0 or 1 on each candidate: its shape (a regex), its inner structure (checksums, ranges),
gazetteers (top-level domains, issuer prefixes, calling codes), and words before it that
speak for or against it. One aggregation over all texts counts the candidates of each vote
pattern; patterns are few whatever the input (kinds x 3^5 votes x 8 shapes of surroundings),
so their counts go to the driver, where expectation-maximisation estimates each labeler's
reliabilities and a logistic classifier is trained on the posteriors. Its weights go back
into the plan as literals, and a second pass adds the looser spans that it accepts and that
overlap no base span. Texts are never shuffled.

Defined cases: a null or empty text has no spans (its digest is that of no bytes); with no
candidate at all nothing is trained and nothing added; repeated rows each get their row; an
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import apart_from, found, marked, ordered, written

# The base kinds' shapes. Each starts only where no earlier start could match,
# and repeats possessively, so that scans are linear and need no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser shapes.
WEAK_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])"
WEAK_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
# Gazetteers, as alternations.
DOMAINS = r"\.(?:com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|eu|us|uk|de|fr|es|it|nl|be|ch|at|se|no|fi|dk|pl|pt|ie|ca|au|nz|in|jp|cn|kr|br|mx|ar|za|ru)$"
ISSUERS = r"^(?:4|5[1-5]|2(?:2[2-9]|[3-6]|7[01]|720)|3[47]|35|6011|65|62)"
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NETWORKS = r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|192\.0\.2|198\.51\.100|203\.0\.113)\."
# Words before a candidate.
FOR = {
    "email": r"e-?mail|mailto|contact|write to|reach",
    "ip": r"\bip\b|address|host|server|from|login|client",
    "card": r"card|visa|master|amex|payment|credit|debit|pay",
    "phone": r"phone|call|tel|mobile|cell|fax|contact|sms",
    "ssn": r"ssn|social|security|taxpayer",
}
AGAINST = r"version|release|isbn|issn|order|invoice|page|chapter|section|serial|\bsku\b|build|part no|figure"
KINDS = ["email", "ip", "card", "phone", "weak_phone", "weak_card", "weak_ip", "ssn"]
LIKE = {"weak_phone": "phone", "weak_card": "card", "weak_ip": "ip"}
BEFORE, ROUNDS, STEPS = 40, 25, 300


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def either(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def structure(kind: str, v: Column) -> Column:
    like = LIKE.get(kind, kind)
    if kind == "weak_ip":
        return either(v.rlike("[0-9]") & v.rlike("[A-Fa-f]"))
    if like == "email":
        return either(v.rlike("^[^@]*[A-Za-z]"))
    if like == "ip":
        return vote(v.rlike("[0-9]{2}"), ~v.rlike("[0-9]{2}"))
    if like == "card":
        return either(F.coalesce(F.call_function("luhn_check", digits(v)), F.lit(False)))
    if like == "phone":
        return vote(F.length(digits(v)) >= 10, F.length(digits(v)) < 9)
    return either(~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-") & ~v.rlike("0000$"))


def gazetteer(kind: str, v: Column) -> Column:
    if kind == "email":
        return either(F.lower(v).rlike(DOMAINS))
    if kind == "ip":
        return F.when(v.rlike(NETWORKS), 1).otherwise(0)
    if kind in ("card", "weak_card"):
        return either(digits(v).rlike(ISSUERS))
    if kind == "phone":
        return either(v.rlike(CALLING))
    if kind == "weak_phone":
        return either(digits(v).rlike("^[2-9][0-9]{2}[2-9]"))
    return F.lit(0)


def candidates(spans: Column, kind: str) -> Column:
    """Spans (with what is around them) with the votes and the shape of their surroundings."""
    speaks = FOR[LIKE.get(kind, kind)]

    def judged(s: Column) -> Column:
        before, v = F.lower(s["before"]), s["value"]
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.lit(1 if kind in KINDS[:4] else 0).alias("v0"), structure(kind, v).alias("v1"), gazetteer(kind, v).alias("v2"),
            F.when(before.rlike(speaks), 1).otherwise(0).alias("v3"), F.when(before.rlike(AGAINST), -1).otherwise(0).alias("v4"),
            before.rlike(r"[a-z0-9]$").alias("glued"), s["after"].rlike(r"[A-Za-z0-9]").alias("runs_on"),
            v.rlike(r"[\x20()-]").alias("parted"),
        )

    return F.transform(spans, judged)


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with __email, __ip, __card, __phone and the looser __weak_phone, __weak_card, __weak_ip, __ssn."""
    numbers = text.rlike("[0-9]")
    out = docs.withColumn("__numbers", numbers).withColumn("__email", found(text, EMAIL, text.contains("@"), BEFORE))
    has = F.col("__numbers")
    ip = F.filter(found(text, IP, has & text.rlike(r"[0-9]\.[0-9]"), BEFORE), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(BYTE)))
    phone = F.filter(found(text, PHONE, has & text.contains("+"), BEFORE), lambda s: F.length(digits(s["value"])).between(9, 15))
    out = out.withColumn("__ip", ip).withColumn("__cards", found(text, CARD, has, BEFORE)).withColumn("__phone", phone)
    passes = lambda s: F.coalesce(F.call_function("luhn_check", digits(s["value"])), F.lit(False))
    out = out.withColumn("__card", F.filter("__cards", passes)).withColumn("__weak_card", F.filter("__cards", lambda s: ~passes(s)))
    loose = [("__weak_phone", found(text, WEAK_PHONE, has, BEFORE)), ("__weak_ip", found(text, WEAK_IP, has & text.contains(":"), BEFORE)), ("__ssn", found(text, SSN, has & text.contains("-"), BEFORE))]
    return reduce(lambda d, x: d.withColumn(*x), loose, out).drop("__cards", "__numbers")


VOTES = [f"v{i}" for i in range(5)]
SHAPES = ["glued", "runs_on", "parted"]


def reliabilities(patterns: list[dict], rounds: int = ROUNDS) -> tuple[dict, list[dict], list[float]]:
    """Expectation-maximisation over counted vote patterns: each kind's prior, each labeler's chances of its votes given the truth, and each pattern's posterior."""
    post = [1 / (1 + math.exp(-2 * sum(p[v] for v in VOTES))) for p in patterns]
    prior: dict = {}
    chance: list[dict] = []
    for _ in range(rounds):
        prior = {}
        for kind in {p["kind"] for p in patterns}:
            own = [(p["n"], q) for p, q in zip(patterns, post) if p["kind"] == kind]
            prior[kind] = (1 + sum(n * q for n, q in own)) / (2 + sum(n for n, _ in own))
        chance = []
        for v in VOTES:
            sums = {(c, y): 1.0 for c in (-1, 0, 1) for y in (0, 1)}
            for p, q in zip(patterns, post):
                sums[p[v], 1] += p["n"] * q
                sums[p[v], 0] += p["n"] * (1 - q)
            alls = {y: sum(sums[c, y] for c in (-1, 0, 1)) for y in (0, 1)}
            chance.append({k: x / alls[k[1]] for k, x in sums.items()})
        for i, p in enumerate(patterns):
            odds = math.log(prior[p["kind"]] / (1 - prior[p["kind"]])) + sum(math.log(c[p[v], 1] / c[p[v], 0]) for c, v in zip(chance, VOTES))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, chance, post


def features(p: dict) -> list[str]:
    return ["bias", f"kind={p['kind']}", *[f"{v}={p[v]}" for v in VOTES if p[v]], *[s for s in SHAPES if p[s]]]


def classifier(patterns: list[dict], post: list[float], steps: int = STEPS, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier fitted to the posteriors by gradient steps over the counted patterns."""
    own = [(features(p), p["n"], q) for p, q in zip(patterns, post)]
    total = sum(n for _, n, _ in own)
    w: dict[str, float] = {f: 0.0 for fs, _, _ in own for f in fs}
    for _ in range(steps):
        slope = {f: decay * x for f, x in w.items()}
        for fs, n, q in own:
            off = n / total * (1 / (1 + math.exp(-sum(w[f] for f in fs))) - q)
            for f in fs:
                slope[f] += off
        for f in w:
            w[f] -= 4.0 * slope[f]
    return w


def score(weights: dict[str, float], c: Column) -> Column:
    """The classifier's log odds of a candidate."""
    out = F.lit(weights.get("bias", 0.0))
    for f, x in sorted(weights.items()):
        name, _, value = f.partition("=")
        if name == "kind":
            out = out + F.when(c["kind"] == value, x).otherwise(0.0)
        elif name in VOTES:
            out = out + F.when(c[name] == int(value), x).otherwise(0.0)
        elif name in SHAPES:
            out = out + F.when(c[name], x).otherwise(0.0)
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, float]:
    """The final classifier's weights, from the candidates of all texts."""
    own = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    all_of = base_spans(own, F.col("text"))
    every = F.concat(*[candidates(F.col(f"__{k}"), k) for k in KINDS])
    counted = all_of.select(F.explode(every).alias("c")).select("c.*").groupBy("kind", *VOTES, *SHAPES).agg(F.count("*").alias("n"))
    patterns = sorted((r.asDict() for r in counted.collect()), key=lambda p: (p["kind"], *[p[v] for v in VOTES], *[p[s] for s in SHAPES]))
    if not patterns:
        return {}
    _, _, post = reliabilities(patterns)
    return classifier(patterns, post)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs."""
    weights = train(docs, doc_id, text) if weights is None else weights
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = base_spans(own, F.col("text"))
    base = [marked(F.col(f"__{k}"), k, i, by_kind=True) for i, k in enumerate(KINDS[:4])]
    out = out.withColumn("__base", ordered(*base))
    added = []
    for i, k in enumerate(KINDS[4:]):
        if f"kind={k}" in weights:
            good = F.filter(candidates(F.col(f"__{k}"), k), lambda c: score(weights, c) > 0)
            added.append(marked(apart_from(good, F.col("__base")), k, 4 + i, by_kind=True))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    spans = ordered(F.col("__base"), *added) if added else F.col("__base")
    return out.select("doc_id", *counts, F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(spans).alias("spans"))
