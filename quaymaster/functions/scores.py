"""CVSS base scores, bands, and small scalar functions, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import let

#: Metric weights of CVSS 3 (fixed values).
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.50},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}


def metric(vector: Column, name: str) -> Column:
    """The metric's value in a vector, the last one if it is given twice; '' if it is not there."""
    return F.regexp_extract(vector, f"^(?:.*/)?{name}:([^/]*)", 1)


def weight(value: Column, name: str) -> Column:
    out = F.lit(None).cast("double")
    for k, w in WEIGHTS[name].items():
        out = F.when(value == k, F.lit(w)).otherwise(out)
    return out


def quantised(x: Column, digits: int = 6) -> Column:
    """x rounded the same way in every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def base_of(get) -> Column:
    """The CVSS 3 base score; get(name) is a metric's value. A missing or unknown metric gives 0."""
    changed = get("S") == "C"
    base = F.lit(1.0) - (F.lit(1.0) - weight(get("C"), "C")) * (F.lit(1.0) - weight(get("I"), "I")) * (F.lit(1.0) - weight(get("A"), "A"))
    impact = F.when(changed, F.lit(7.52) * (base - 0.029) - F.lit(3.25) * F.pow(base - 0.02, F.lit(15.0))).otherwise(F.lit(6.42) * base)
    privilege = F.when(changed, weight(get("PR"), "PR_C")).otherwise(weight(get("PR"), "PR"))
    exploit = F.lit(8.22) * weight(get("AV"), "AV") * weight(get("AC"), "AC") * privilege * weight(get("UI"), "UI")
    up = lambda x: F.ceil(x * F.lit(10.0)).cast("double") / F.lit(10.0)
    total = F.when(changed, up(F.lit(1.08) * (impact + exploit))).otherwise(up(impact + exploit))
    return F.coalesce(F.when((impact + exploit).isNull(), 0.0).when(impact <= 0, 0.0).otherwise(F.least(total, F.lit(10.0))), F.lit(0.0))


def score_v3(vector: Column) -> Column:
    return base_of(lambda name: metric(vector, name))


def score_v4(vector: Column) -> Column:
    """An approximation: version 3's formula over the metrics that both have, with unchanged scope."""
    names = {"C": "VC", "I": "VI", "A": "VA"}
    return base_of(lambda name: F.lit("U") if name == "S" else metric(vector, names.get(name, name)))


def base_score(severity: Column) -> Column:
    """The largest base score in an OSV severity list array<struct<type,score>>; bare numbers count, up to 10."""

    def one(s: Column) -> Column:
        raw = F.trim(F.coalesce(s["score"], F.lit("")))
        return let(raw, lambda r: F.when(r.try_cast("double").isNotNull(), F.least(r.try_cast("double"), F.lit(10.0))).when(F.startswith(r, F.lit("CVSS:4")), score_v4(r)).when(F.startswith(r, F.lit("CVSS:3")) | r.contains("AV:"), score_v3(r)).otherwise(0.0))

    best = F.aggregate(F.coalesce(severity, F.array().cast("array<struct<type:string,score:string>>")), F.lit(0.0), lambda acc, s: F.greatest(acc, one(s)))
    return F.floor(best * 10 + 0.5) / F.lit(10.0)


def band(score: Column) -> Column:
    return F.when(score == 0, "none").when(score < 4, "low").when(score < 7, "medium").when(score < 9, "high").otherwise("critical")


def year_fraction(date: Column) -> Column:
    """An ISO date as a year with its fraction; a missing month counts as June, a missing day as the 15th; null outside 1990 to 2035."""
    part = lambda i, d: F.coalesce(F.get(F.split(date, "-"), F.lit(i)).try_cast("int"), F.lit(d)).cast("double")
    year = F.get(F.split(date, "-"), F.lit(0)).try_cast("int")
    at = year.cast("double") + (part(1, 6) - 1) / 12 + (part(2, 15) - 1) / 365
    return F.when(year.between(1990, 2035), at)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(text: Column) -> Column:
    """Lower case; runs of characters that no package name has become one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.:+/@_-]+", " "))


def squashed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
