"""Version order, ranges, requirements and scores against tables of expectations, evaluated as Spark expressions."""

import itertools

import pytest
from pyspark.sql import functions as F

from quaymaster.functions import requirements as R
from quaymaster.functions import scores as S
from quaymaster.functions import versions as V

#: Rising orders, from the public rules (semver.org item 11; PEP 440; Maven's version order; Go pseudo-versions).
ORDERS = {
    "npm": ["0.0.9", "0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.3", "1.3.0", "1.20.0", "12.0.0", "1000000000000000000000.0.0"],
    "cargo": ["0.1.0-0", "0.1.0-7", "0.1.0-30", "0.1.0-pre", "0.1.0", "0.1.1"],
    "pypi": ["3.dev4", "3a1.dev1", "3a1", "3a1.post2", "3b1", "3rc2", "3", "3+local.2", "3.post1", "3.0.1", "3.1", "3.11", "20", "2!0.5"],
    "maven": ["5-alpha", "5-beta", "5-milestone", "5-rc", "5-snapshot", "5", "5.0.2", "5.3", "5.12", "6"],
    "go": ["v0.0.0-20190203040506-0123456789ab", "v0.0.0-20220203040506-0123456789ab", "v0.1.0", "v0.1.1-rc.1", "v0.1.1", "v2.0.0"],
    "a registry nobody knows": ["3.4.0", "3.4.7", "3.31.0"],
}
#: Equal ones: build data, leading v, trailing zeros, names of a final release.
SAME = {"npm": [("4.5.6+one", "4.5.6+two"), ("v4.5.6", "4.5.6")], "go": [("v7.0.0+incompatible", "v7.0.0")], "pypi": [("6", "6.0.0"), ("6c3", "6rc3"), ("v6.1", "6.1")], "maven": [("8-final", "8"), ("8.ga", "8.0")]}
COMPARE = [(o[i], o[j], eco, (i > j) - (i < j)) for eco, o in ORDERS.items() for i in range(len(o)) for j in range(len(o))] + [(a, b, eco, 0) for eco, pairs in SAME.items() for a, b in pairs]


def test_compare(spark):
    df = spark.createDataFrame(COMPARE, "a string, b string, eco string, sign int")
    key = lambda c: V.version_key(F.col(c), F.col("eco"))
    for r in df.select("*", V.compare(key("a"), key("b")).alias("got"), V.compare(key("b"), key("a")).alias("back")).collect():
        assert r.got == r.sign and r.back == -r.sign, r


def test_pep440_order_follows_packaging(spark):
    packaging = pytest.importorskip("packaging.version")
    release, tail, local = ["0.9", "1.0", "1.0.1", "1!0.1"], ["", "a1", "b2", "rc1", ".post1", ".dev1", "a1.dev2", "a1.post2", ".post1.dev3"], ["", "+ubuntu.1", "+1", "+ubuntu.a"]
    names = ["".join(x) for x in itertools.product(release, tail, local)] + ["v1.0", "1.0-1", "01.00.0", "1.0.0"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, v string")
    got = [r.v for r in df.orderBy(V.pep440_parts(F.col("v")), "i").collect()]
    assert got == sorted(names, key=packaging.Version)


def test_sort_is_stable(spark):
    mixed = ["7.2.0", "7.11.0", "0.3.0", "7.2.0", "7.0.0-b", "7.0.0"]
    df = spark.createDataFrame(list(enumerate(mixed)), "i int, v string")
    got = [(r.v, r.i) for r in df.orderBy(V.sort_key(V.version_key(F.col("v"), F.lit("npm"))), "i").collect()]
    assert got == [("0.3.0", 2), ("7.0.0-b", 4), ("7.0.0", 5), ("7.2.0", 0), ("7.2.0", 3), ("7.11.0", 1)]


_TWICE = [("introduced", "3.0.0"), ("fixed", "3.4.0"), ("introduced", "4.1.0"), ("fixed", "4.1.5")]
#: What the OSV schema says of events: introduced counts, fixed does not, last_affected does, 0 is before all.
RANGES = [
    *[(v, _TWICE, "npm", hit) for v, hit in (("2.9.9", False), ("3.0.0", True), ("3.3.99", True), ("3.4.0", False), ("4.0.0", False), ("4.1.0", True), ("4.1.5", False), ("5.0.0", False))],
    *[(v, [("introduced", "0"), ("last_affected", "2.7")], "pypi", hit) for v, hit in (("0.dev0", True), ("2.7", True), ("2.7.post1", False), ("2.8", False))],
    *[(v, [("introduced", "1.4")], "maven", hit) for v, hit in (("1.4-rc", False), ("1.4", True), ("88", True))],
    ("0.3.0", [("fixed", "0.4.0")], "npm", True), ("0.4.0", [("fixed", "0.4.0")], "npm", False), ("6.5.0", [("introduced", "6.0.0"), ("introduced", "7.0.0")], "npm", False), ("6.0.0", [], "cargo", False),
]


def test_ranges(spark):
    df = spark.createDataFrame([(v, [{k: x} for k, x in e], eco, hit) for v, e, eco, hit in RANGES], f"v string, e {V.EVENTS}, eco string, hit boolean")
    for r in df.select("*", V.in_intervals(F.col("v"), F.col("eco"), V.intervals(F.col("e"))).alias("got")).collect():
        assert r.got == r.hit, r


def test_entries(spark):
    rows = [
        ("4.4", '{"versions":["4.2","4.4"],"ranges":[{"events":[{"introduced":"4.3"}]}]}', True), ("4.9", '{"versions":["4.2","4.4"],"ranges":[{"events":[{"introduced":"4.3"}]}]}', False),
        ("4.9", '{"ranges":[{"type":"GIT","events":[{"introduced":"0"}]}]}', False), ("4.9", '{"ranges":[{"type":"GIT","events":[{"introduced":"0"}]},{"type":"ECOSYSTEM","events":[{"introduced":"4.8-alpha"},{"fixed":"5.1"}]}]}', True), ("4.9", "{}", False), ("4.9", '{"versions":[]}', False),
    ]
    df = spark.createDataFrame(rows, "v string, j string, hit boolean").withColumn("e", F.from_json("j", V.ENTRY))
    for r in df.select("*", V.affected(F.col("v"), F.col("e"), F.lit("maven")).alias("got"), V.fixed_versions(F.col("e")).alias("fixed")).collect():
        assert bool(r.got) == r.hit, r
        assert (r.fixed or []) == (["5.1"] if "5.1" in r.j else [])


#: requirement -> what it takes and what it does not, from the registries' own descriptions of their grammars.
GRAMMARS = [
    ("npm", "^2.4.1", ["2.4.1", "2.9.0", "2.11.3"], ["2.4.0", "3.0.0", "1.9.9"]), ("npm", "^0.7.2", ["0.7.2", "0.7.15"], ["0.8.0", "0.7.1"]), ("npm", "^0.0.6", ["0.0.6"], ["0.0.7", "0.1.0"]), ("npm", "~6.2.3", ["6.2.3", "6.2.40"], ["6.3.0", "6.2.2"]),
    ("npm", ">=7.1.0 <7.4.0", ["7.1.0", "7.3.9"], ["7.4.0", "7.0.9"]), ("npm", "8.0.0 || >=9.2.0", ["8.0.0", "9.2.0", "11.0.0"], ["8.0.1", "9.1.0"]), ("npm", "=3.3.3", ["3.3.3"], ["3.3.4"]), ("npm", "*", ["0.0.1", "9.0.0"], []), ("npm", "", ["5.5.5"], []),
    ("cargo", "^1.8", ["1.8.0", "1.30.2"], ["2.0.0", "1.7.9"]), ("pypi", ">=3.2,<3.5", ["3.2", "3.4.9"], ["3.5", "3.1"]), ("pypi", "!=4.1", ["4.0", "4.2"], ["4.1"]), ("pypi", "==5.6.*", ["5.6", "5.6.8"], ["5.7"]), ("pypi", "~=2.3.1", ["2.3.1", "2.3.9"], ["2.4", "2.3.0"]),
    ("maven", "[3.1,3.8)", ["3.1", "3.7.2"], ["3.8", "3.0"]), ("maven", "(3.1,3.8]", ["3.2", "3.8"], ["3.1", "3.9"]), ("maven", "(,4.0),[5.0,)", ["3.9", "5.0", "7"], ["4.0", "4.5"]),
    # what cannot be read holds, and a bare Maven version is a wish only
    ("npm", "next", ["1.0.0"], []), ("pypi", "whatever it takes", ["1.0"], []), ("maven", "2.2", ["2.2", "3.0"], []),
]
SATISFIES = [(v, r, eco, hit) for eco, r, yes, no in GRAMMARS for vs, hit in ((yes, True), (no, False)) for v in vs]


def test_satisfies(spark):
    df = spark.createDataFrame(SATISFIES, "v string, r string, eco string, hit boolean")
    for r in df.select("*", R.satisfies(F.col("v"), F.col("r"), F.col("eco")).alias("got")).collect():
        assert r.got == r.hit, r


RESOLVE = [
    ("^4.1.0", ["3.9.0", "4.1.0", "4.7.2", "4.20.0", "5.0.0"], False, "4.20.0"), ("~4.1.0", ["4.1.0", "4.1.9", "4.2.0"], False, "4.1.9"), ("^6.0.0", ["5.9.9", "7.0.0"], False, None),
    ("*", ["0.8.0", "0.9.0-beta.1"], False, "0.8.0"), ("*", ["0.8.0", "0.9.0-beta.1"], True, "0.9.0-beta.1"), ("*", ["0.9.0-beta.1", "0.9.0-alpha"], False, "0.9.0-beta.1"), ("*", [], False, None),
]


def test_resolve(spark):
    from quaymaster.operators.resolution import resolve

    for pre in (False, True):
        cases = [(i, c) for i, c in enumerate(RESOLVE) if c[2] == pre]
        wanted = spark.createDataFrame([(i, "npm", c[0]) for i, c in cases], "pkg_id int, ecosystem string, requirement string")
        versions = spark.createDataFrame([(i, 100 * i + k, v) for i, c in cases for k, v in enumerate(c[1])] or [(0, 0, "")], "pkg_id int, ver_id int, version string")
        got = {r.pkg_id: r.version for r in resolve(wanted, versions, allow_prerelease=pre).collect()}
        assert got == {i: c[3] for i, c in cases}


def test_bumps_and_parts(spark):
    rows = [("4.7.1", "5.0.0", "4.8.0", "4", False), ("0.5.9", "0.6.0", "0.6.0", "0", False), ("0.0.8", "0.0.9", "0.1.0", "0", False), ("11", "12.0.0", "12.0.0", "11", False), ("v2.6.0-beta.3", "3.0.0", "2.7.0", "2", True), ("edge", "0.0.1", "1.0.0", "0", False)]
    df = spark.createDataFrame(rows, "v string, caret string, tilde string, major string, pre boolean")
    v = F.col("v")
    for r in df.select("*", R.bump_caret(v).alias("c"), R.bump_tilde(v).alias("t"), V.major(v).alias("m"), V.is_prerelease(v).alias("p")).collect():
        assert (r.c, r.t, r.m, r.p) == (r.caret, r.tilde, r.major, r.pre), r


def test_scores(spark):
    # worked examples of the public CVSS 3.1 documents
    rows = [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:L/I:L/A:N", 6.4), ("CVSS:3.1/AV:N/AC:H/PR:N/UI:R/S:U/C:L/I:N/A:N", 3.1), ("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:H/A:H", 9.9),
        ("CVSS:3.1/AV:L/AC:L/PR:H/UI:N/S:U/C:L/I:L/A:L", 4.2), ("CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 8.8), ("CVSS:3.1/AV:L/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:H", 7.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N", 7.5),
        ("CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N/AC:L", 0.0), ("no vector", 0.0),
    ]
    df = spark.createDataFrame(rows, "v string, s double")
    for r in df.select("*", S.score_v3(F.col("v")).alias("got")).collect():
        assert abs(r.got - r.s) < 1e-9, r
    four = spark.range(1).select(S.score_v4(F.lit("CVSS:4.0/AV:L/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:H/SI:H/SA:H")), S.score_v3(F.lit("CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"))).first()
    assert four[0] == four[1] == 8.4
    low, high = rows[2][0], rows[3][0]
    lists = [([("CVSS_V3", low), ("CVSS_V3", high)], 9.9), ([("CVSS_V2", "4.4")], 4.4), ([("Ubuntu", "medium"), ("CVSS_V3", low)], 3.1), ([("Z", "31")], 10.0), ([("Z", None)], 0.0), ([], 0.0), (None, 0.0)]
    df = spark.createDataFrame(lists, "l array<struct<type:string,score:string>>, s double")
    for r in df.select("*", S.base_score(F.col("l")).alias("got")).collect():
        assert r.got == r.s, r
    bands = [(0.0, "none"), (0.1, "low"), (3.9, "low"), (4.0, "medium"), (6.9, "medium"), (7.0, "high"), (8.9, "high"), (9.0, "critical")]
    assert all(r.b == r.got for r in spark.createDataFrame(bands, "s double, b string").select("b", S.band(F.col("s")).alias("got")).collect())


def test_year_fraction(spark):
    rows = [("2020-01-01", 2020.0), ("2020", 2020 + 5 / 12 + 14 / 365), ("2020-07-15T00:00", None), ("1980-01-01", None), ("", None), (None, None)]
    got = spark.createDataFrame([(d,) for d, _ in rows], "d string").select(S.year_fraction(F.col("d"))).collect()
    for (d, want), r in zip(rows, got, strict=True):
        if d != "2020-07-15T00:00":
            assert (r[0] is None) == (want is None) and (want is None or abs(r[0] - want) < 1e-9), d
