"""Measures, keys and tables where a shortcut would show, against plain counterparts."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quaymaster.functions import versions as V
from quaymaster.operators import learn as L
from quaymaster.operators import rank as RK
from quaymaster.operators import structure as ST
from quaymaster.plans import staging
from quaymaster.sources import readers


def test_maven_versions_go_on_with_zeros(spark):
    import re

    rnd, rank = random.Random(3), V.QUALIFIERS

    def padded(v, n=60):
        own = [(1, int(t), "") if t[0].isdigit() else (1, rank[t], "") if t in rank else (0, 0, t) for t in re.findall(r"\d+|[^\d.-]+", v.lower())]
        return own + [(1, 0, "")] * (n - len(own))

    names = {"1", "1.0", "1-final", "1.0.0.1", "1.0-alpha", "1.0.0-beta", "1-0-0-0-sp", "1.ga.1", "".join("1." for _ in range(30)) + "alpha", "".join("1." for _ in range(30)) + "0"}
    while len(names) < 60:
        names.add("1" + "".join(rnd.choice([".0", "-0", ".1", "-sp", "-alpha", ".final", "-xyz", ".2"]) for _ in range(rnd.choice([1, 2, 3, 4, 30]))))
    names = sorted(names)
    df = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
    key = lambda c: V.version_key(F.col(c), F.lit("maven"))
    for r in df.select("a", "b", V.compare(key("a"), key("b")).alias("got")).collect():
        x, y = padded(r.a), padded(r.b)
        assert r.got == (x > y) - (x < y), r


def test_kendall_tau_counts_all_pairs(spark):
    rnd = random.Random(5)
    for n, most in ((2, 3), (30, 5), (80, 1000), (120, 12)):
        rows = [(rnd.randrange(most), rnd.randrange(most)) for _ in range(n)]
        s = na = nb = 0
        for (a, b), (c, d) in itertools.combinations(rows, 2):
            s += ((a > c) - (a < c)) * ((b > d) - (b < d))
            na += a != c
            nb += b != d
        got = RK.kendall_tau(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().tau
        assert (got is None and not na * nb) or abs(got - s / math.sqrt(na * nb)) < 1e-9


def test_gini_and_percentiles_fold_equal_values(spark):
    rnd = random.Random(6)
    x = [rnd.choice([0, 0, 0, 1, 2, 7, 7.5]) for _ in range(101)]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    s = sorted(x)
    want = 2 * sum((k + 1) * v for k, v in enumerate(s)) / (len(s) * sum(s)) - (len(s) + 1) / len(s)
    assert abs(RK.gini(df, "v").first().gini - want) < 1e-12
    r = ST.percentiles(df.unionByName(spark.createDataFrame([(None,)], "v double")), "v").first()
    assert (r.n, r.p50, r.p90, r.p99, r.max) == (101, s[50], s[90], s[99], s[-1]) and abs(r.mean - sum(x) / 101) < 1e-12


def test_text_vectors_count_ngrams(spark):
    texts = ["", None, "a", "left-pad", "aaaaaa", "some longer name of a package"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    grams = {r.i: r.g for r in df.select("i", F.expr("transform(sequence(1, greatest(length(concat(' ', lower(coalesce(t, '')), ' ')) - 2, 1)), k -> cast(pmod(xxhash64(substring(concat(' ', lower(coalesce(t, '')), ' '), k, 3)), 16) as int))").alias("g")).collect()}
    for r in df.select("i", L.text_vector(F.col("t"), 16).alias("v")).collect():
        c = [grams[r.i].count(k) for k in range(16)]
        norm = math.sqrt(sum(x * x for x in c))
        assert len(r.v) == 16 and all(abs(a - b / norm) < 1e-6 for a, b in zip(r.v, c, strict=True))


def test_auroc_of_one_class_is_unknown(spark):
    one = spark.createDataFrame([(1, 1, 0.5, 0.4), (2, 1, 0.2, 0.1)], "pkg_id int, label int, p double, b double")
    assert L.auroc(one).first().auroc is None
    pairs = one.withColumnRenamed("p", "a")
    assert L.bootstrap_delta(pairs, 5).first().delta_mean is None
    two = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 5)) for i in range(60)], "pkg_id int, label int, a double, b double")
    assert L.bootstrap_delta(two, 20).first() == L.bootstrap_delta(two.repartition(3), 20).first()


def test_graph_features_feed_the_model(spark):
    f = spark.createDataFrame([(i, float(i % 3), float(i)) for i in range(40)], "pkg_id long, x double, y double")
    e = spark.createDataFrame([(i, (i * 7 + 1) % 40) for i in range(40)], "src long, dst long")
    got = L.neighbour_means(f, e, ["x", "y"], 2)
    assert got.columns == ["pkg_id", "x", "y", "x_1", "y_1", "x_2", "y_2"]
    rows = got.join(spark.createDataFrame([(i, i % 2, "train" if i < 30 else "test") for i in range(40)], "pkg_id long, label int, split string"), "pkg_id")
    assert L.trained(rows, got.columns[1:]).where("p between 0 and 1").count() == 40


def test_rows_that_csv_reading_leaves_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,Number\nx,1\n"y,\nz",2\nw,3,4,5\n')
    assert sorted((r.Name, r.Number, r.More) for r in readers.csv_shards(spark, str(tmp_path), ["Name", "Number", "More"]).collect()) == [("x", "1", None), ("y,\nz", "2", None)]
    assert [r.row.strip() for r in readers.csv_malformed(spark, str(tmp_path)).collect()] == ["w,3,4,5"]


def test_hashed_ids_are_checked(spark):
    df = spark.createDataFrame([(1, "npm", "a"), (1, "npm", "b"), (2, "npm", "c"), (2, "npm", "c")], "id long, eco string, name string")
    assert [r.id for r in readers.collisions(df, "id", "eco", "name").collect()] == [1]


class Session:
    """A session that has only what shared_dir asks for."""

    def __init__(self, master, conf=None, context=None):
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: conf if k == "spark.checkpoint.dir" else d)})
        option = type("Option", (), {"isDefined": lambda s: context is not None, "get": lambda s: context})()
        jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: option})()})()
        self.sparkContext = type("C", (), {"master": master, "_jsc": jsc})


def test_staged_tables_lie_in_the_shared_folder(spark):
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        assert staging.shared_dir(Session(master, "hdfs://x/y/", "hdfs://z")) == "hdfs://x/y" and staging.shared_dir(Session(master, None, "hdfs://z/")) == "hdfs://z"
        with pytest.raises(RuntimeError):
            staging.shared_dir(Session(master))
    at = staging.shared_dir(spark)
    t = staging.staged(spark.range(5), "t")
    b = staging.staged_by(spark.range(5).withColumn("k", F.col("id") % 2), "b", "k")
    assert all(x._qm_path.startswith(f"{at}/qm-") for x in (t, b)) and b.count() == 5
    assert "Exchange" not in b.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    for x in (t, b):
        staging.drop(x)
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(x._qm_path)
