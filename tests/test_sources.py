"""Feeds in their raw formats, and the queries against their SQL on the smallest tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quaymaster.plans import catalog
from quaymaster.sources import readers


def test_advisory_archives(spark, tmp_path):
    recs = [
        {"id": "A-1", "aliases": ["CVE-2020-1"], "summary": "s" * 500, "severity": [{"type": "CVSS_V3", "score": "7.5"}], "affected": [{"package": {"ecosystem": "PyPI", "name": "x"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2"}]}]}]},
        {"id": "A-2", "withdrawn": "2020-01-01", "published": "2019-01-01"},
    ]
    with zipfile.ZipFile(tmp_path / "pypi.zip", "w") as z:
        for r in recs:
            z.writestr(f"{r['id']}.json", json.dumps(r))
        z.writestr("broken.json", "{nope")
        z.writestr("note.txt", "x")
    with zipfile.ZipFile(tmp_path / "zz.zip", "w") as z:
        z.writestr("A-1.json", json.dumps({"id": "A-1", "summary": "later"}))
    got = readers.advisory_archives(spark, str(tmp_path))
    assert got.count() == 3
    t = readers.tables_of_advisories(got)
    a = {r.osv_id: r for r in t["advisories"].collect()}
    assert len(a["A-1"].summary) == 400 and a["A-1"].severity == 7.5 and not a["A-1"].withdrawn and a["A-2"].withdrawn
    assert [r.alias for r in t["aliases"].collect()] == ["CVE-2020-1"]
    assert json.loads(t["affected"].first().entry_json)["ranges"][0]["events"][1] == {"fixed": "2"}


def test_dependency_records(spark, tmp_path):
    rec = {"ecosystem": "npm", "package": "a", "version": "2.0.0", "versions": ["1.0.0", "2.0.0"], "nodes": [{"name": "b", "version": "1.0.0", "relation": "DIRECT"}], "resolved": [{"from": ["a", "2.0.0"], "to": ["b", "1.0.0"], "requirement": "^1"}] * 2}
    (tmp_path / "d.jsonl").write_text(json.dumps(rec) + "\n")
    t = readers.tables_of_records(readers.dependency_records(spark, str(tmp_path)))
    assert t["packages"].count() == 2 and t["versions"].count() == 3 and t["resolved"].count() == 1
    assert [r.version for r in t["versions"].where("is_default").collect()] == ["2.0.0"]
    assert t["resolved"].join(t["versions"], "ver_id").count() == 1


def test_csv_shards(spark, tmp_path):
    (tmp_path / "p-1.csv").write_text('Platform,Name,Extra\nNPM,"a ""quoted"", name",1\nNPM,b,2\n')
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = readers.csv_shards(spark, str(tmp_path), ["Name", "Gone"], "p-*.csv").orderBy("Name").collect()
    assert [tuple(r) for r in got] == [('a "quoted", name', None), ("b", None)]


def test_stream_drops_repeated_advisories(spark, tmp_path):
    from quaymaster.streaming import feed

    rows = [(1, "A", "2024-01-01"), (1, "A", "2024-01-01"), (2, "B", "2024-01-02")]
    spark.createDataFrame(rows, "adv_id long, osv_id string, published string").write.parquet(str(tmp_path / "in"))
    s = feed.advisory_stream(spark, str(tmp_path / "in"), "adv_id long, osv_id string, published string")
    q = feed.append(s.select("adv_id", "osv_id"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.osv_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]


SMALL = [n for n in catalog.SQL if "reached AS" not in catalog.SQL[n] and "AS hops" not in catalog.SQL[n]]


def test_every_query_has_a_name_and_sql_of_its_own():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 150


@pytest.mark.parametrize("name", SMALL[::6])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    a, b = catalog.QUERIES[name](spark, d).toPandas(), con.sql(catalog.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    plain = lambda df: sorted(tuple("" if x is None or x != x else str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))
    assert plain(a) == plain(b)


def test_flagship_has_rows(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        got = catalog.QUERIES[catalog.FLAGSHIP](spark, "/root/testdata/sf0.001")
        assert got.where(F.col("alert")).count() > 0
