"""Version order as data: a version becomes an array of (r, n, s) that compares like the version, so that every comparison is a native
`<` in joins, windows and max_by.

Three orders: semantic versions (npm, cargo, go, rubygems, packagist, nuget and any unknown ecosystem), Maven, and PEP 440 (pypi). Where
one of two pypi versions is not valid under PEP 440, both are compared as semantic versions, so a key holds both arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = "struct<r:int,n:decimal(38,0),s:string>"
PARTS = f"array<{PART}>"
#: Maven's order of qualifiers (fixed values).
QUALIFIERS = {"alpha": -6, "beta": -5, "milestone": -4, "rc": -3, "cr": -3, "snapshot": -2, "": -1, "final": 0, "ga": 0, "release": 0, "sp": 1}
SEMVER = r"^[vV]?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?"
PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def part(r, n=None, s=None) -> Column:
    lit = lambda x, d: x if isinstance(x, Column) else F.lit(d if x is None else x)
    return F.struct(lit(r, 0).cast("int").alias("r"), lit(n, 0).try_cast("decimal(38,0)").alias("n"), F.coalesce(lit(s, ""), F.lit("")).alias("s"))


def strip(v: Column) -> Column:
    return F.regexp_replace(F.coalesce(v, F.lit("")), r"^\s+|\s+$", "")


def semver_fields(v: Column) -> Column:
    """struct(major, minor, patch, pre): pre is null for a release. What is no semantic version is read as its first three numbers."""

    def fields(v: Column) -> Column:
        ok = v.rlike(SEMVER)
        numbers = F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0))
        one = lambda i: F.when(ok, F.regexp_extract(v, SEMVER, i + 1)).otherwise(F.coalesce(F.get(numbers, F.lit(i)), F.lit("0"))).try_cast("decimal(38,0)")
        pre = F.regexp_extract(v, SEMVER, 4)
        return F.struct(one(0).alias("major"), one(1).alias("minor"), one(2).alias("patch"), F.when(ok & (pre != ""), pre).alias("pre"))

    return let(F.substring_index(strip(v), "+incompatible", 1), fields)


def semver_parts(v: Column) -> Column:
    def parts(f: Column) -> Column:
        ids = F.transform(F.split(f["pre"], r"\."), lambda x: F.when(x.rlike(r"^\d+$"), part(0, x)).otherwise(part(1, 0, x)))
        head = F.array(part(0, f["major"]), part(0, f["minor"]), part(0, f["patch"]), part(F.when(f["pre"].isNull(), 1).otherwise(0)))
        return F.concat(head, F.coalesce(ids, F.array().cast(PARTS)))

    return let(semver_fields(v), parts)


def maven_parts(v: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for k, n in QUALIFIERS.items() for x in (k, n)])
    tokens = F.regexp_extract_all(F.lower(strip(v)), F.lit(r"\d+|[^\d.-]+"), F.lit(0))
    own = F.transform(tokens, lambda t: F.when(t.rlike(r"^\d"), part(1, t)).when(rank[t].isNotNull(), part(1, rank[t])).otherwise(part(0, 0, t)))

    # A version goes on with zeros without end. The end of the array is (1, 0, "m"); zeros before another part are one element that stands
    # before the end if that part is less than zero, the nearer the more zeros there are, and after it if it is greater.
    def step(acc: Column, x: Column) -> Column:
        zero = (x["r"] == 1) & (x["n"] == 0)
        less = (x["r"] == 0) | (x["n"] < 0)
        k = F.lpad(F.when(less, acc["zeros"]).otherwise(999_999_999 - acc["zeros"]).cast("string"), 9, "0")
        run = F.when(acc["zeros"] > 0, F.array(part(1, 0, F.concat(F.when(less, "l").otherwise("n"), k)))).otherwise(F.array().cast(PARTS))
        return F.when(zero, F.struct(acc["out"].alias("out"), (acc["zeros"] + 1).alias("zeros"))).otherwise(F.struct(F.concat(acc["out"], run, F.array(x)).alias("out"), F.lit(0).alias("zeros")))

    return F.aggregate(own, F.struct(F.array().cast(PARTS).alias("out"), F.lit(0).alias("zeros")), step, lambda acc: F.concat(acc["out"], F.array(part(1, 0, "m"))))


def pep440_parts(v: Column) -> Column:
    """Null if v is no valid version."""
    g = lambda i: F.regexp_extract(v, PEP440, i)
    num = lambda i: F.when(g(i) == "", "0").otherwise(g(i))
    release = F.transform(F.split(F.regexp_replace(g(2), r"(?:\.0+)*$", ""), r"\."), lambda x: part(5, x))
    release = F.when(g(2).rlike(r"^0+(?:\.0+)*$"), F.array().cast(PARTS)).otherwise(release)
    letter = F.lower(g(3))
    letter = F.when(letter.isin("a", "alpha"), "a").when(letter.isin("b", "beta"), "b").otherwise("rc")
    has_pre, has_post, has_dev = g(3) != "", (g(5) != "") | (g(6) != ""), g(8) != ""
    pre = F.when(has_pre, F.array(part(1, 0, letter), part(0, num(4)))).when(~has_post & has_dev, F.array(part(0), part(0))).otherwise(F.array(part(2), part(0)))
    post = F.when(g(5) != "", part(1, g(5))).when(has_post, part(1, num(7))).otherwise(part(0))
    dev = F.when(has_dev, part(0, num(9))).otherwise(part(1))
    local = F.when(g(10) == "", F.array().cast(PARTS)).otherwise(F.transform(F.split(F.lower(g(10)), "[-_.]"), lambda x: F.when(x.rlike(r"^\d+$"), part(2, x)).otherwise(part(1, 0, x))))
    return F.when(v.rlike(PEP440), F.concat(F.array(part(0, num(1))), release, pre, F.array(post, dev), local))


def version_key(version: Column, ecosystem: Column) -> Column:
    """struct(pep, base): pep is the PEP 440 key of a valid pypi version, base the key that always is there."""
    eco = F.lower(F.coalesce(ecosystem, F.lit("")))
    return F.struct(F.when(eco.isin("pypi", "pip"), pep440_parts(version)).alias("pep"), F.when(eco == "maven", maven_parts(version)).otherwise(semver_parts(version)).alias("base"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two keys of one ecosystem."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(a["pep"].isNotNull() & b["pep"].isNotNull(), sign(a["pep"], b["pep"])).otherwise(sign(a["base"], b["base"]))


def sort_key(key: Column) -> Column:
    """A key for windows and max_by over one package: versions that are no PEP 440 versions first."""
    return F.struct(key["pep"].isNotNull().alias("valid"), key["pep"].alias("pep"), key["base"].alias("base"))


EVENTS = "array<map<string,string>>"
ENTRY = "versions ARRAY<STRING>, ranges ARRAY<STRUCT<type: STRING, events: ARRAY<MAP<STRING,STRING>>>>"


def intervals(events: Column) -> Column:
    """An OSV event list as array<struct<lo,hi,inclusive>>; lo null or '0': from the beginning, hi null: without end."""
    steps = F.flatten(F.transform(F.coalesce(events, F.array().cast(EVENTS)), F.map_entries))
    kind = "array<struct<lo:string,hi:string,inclusive:boolean>>"
    zero = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(kind).alias("done"))

    def step(acc: Column, e: Column) -> Column:
        closed = F.concat(acc["done"], F.array(F.struct(acc["open"].alias("lo"), e["value"].alias("hi"), (e["key"] == "last_affected").alias("inclusive"))))
        return F.when(e["key"] == "introduced", F.struct(e["value"].alias("open"), acc["done"].alias("done"))).when(e["key"].isin("fixed", "last_affected"), F.struct(F.lit(None).cast("string").alias("open"), closed.alias("done"))).otherwise(acc)

    def close(acc: Column) -> Column:
        last = F.array(F.struct(acc["open"].alias("lo"), F.lit(None).cast("string").alias("hi"), F.lit(False).alias("inclusive"))).cast(kind)
        return F.when(acc["open"].isNotNull(), F.concat(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(steps, zero, step, close)


def entry_intervals(entry: Column) -> Column:
    """All intervals of an entry's ranges but GIT ones."""
    ranges = F.filter(F.coalesce(entry["ranges"], F.array().cast("array<struct<type:string,events:array<map<string,string>>>>")), lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")
    return F.flatten(F.transform(ranges, lambda r: intervals(r["events"])))


def in_interval(key: Column, lo: Column, lo_key: Column, hi: Column, hi_key: Column, inclusive: Column) -> Column:
    above = lo.isNull() | (lo == "0") | (compare(key, lo_key) >= 0)
    c = compare(key, hi_key)
    return above & (hi.isNull() | F.when(inclusive, c <= 0).otherwise(c < 0))


def in_intervals(version: Column, ecosystem: Column, spans: Column) -> Column:
    """Whether a version lies in one of the intervals; for joins, explode the intervals and compute their keys once instead."""
    key = version_key(version, ecosystem)
    return let(key, lambda k: F.exists(spans, lambda x: in_interval(k, x["lo"], version_key(x["lo"], ecosystem), x["hi"], version_key(x["hi"], ecosystem), x["inclusive"])))


def affected(version: Column, entry: Column, ecosystem: Column) -> Column:
    """A non-empty list of versions decides alone; else any range."""
    return F.when(F.size(F.coalesce(entry["versions"], F.array().cast("array<string>"))) > 0, F.array_contains(entry["versions"], version)).otherwise(in_intervals(version, ecosystem, entry_intervals(entry)))


def fixed_versions(entry: Column) -> Column:
    """All fixed versions of an entry in order, GIT ranges included."""
    return F.flatten(F.transform(F.coalesce(entry["ranges"], F.array().cast("array<struct<type:string,events:array<map<string,string>>>>")), lambda r: F.transform(F.filter(r["events"], lambda e: F.map_contains_key(e, "fixed")), lambda e: e["fixed"])))


#: Words and marks of unfinished versions (fixed values).
UNFINISHED = r"alpha|beta|rc|dev|snapshot|preview|pre|m\d|cr\d|a\d|b\d|nightly|canary|next|milestone"


def is_prerelease(version: Column) -> Column:
    return semver_fields(F.lower(version))["pre"].isNotNull() | F.lower(F.coalesce(version, F.lit(""))).rlike(UNFINISHED)


def major(version: Column) -> Column:
    """The leading digits, as text; 0 if there are none."""
    got = F.regexp_extract(F.coalesce(version, F.lit("")), r"^[vV]?(\d+)", 1)
    return F.when(got == "", "0").otherwise(got)
