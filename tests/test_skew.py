"""Heavy keys give the same results as the plain plans."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftmark.operators import skew
from driftmark.operators.skew import OrderedKeys, expand_copies, heavy_keys, lookup_join
from driftmark.operators.versions import nearest_version

HEAVY = {"min_rows": 10, "parts": 200}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to key 0, a sixth to null."""
    rnd = random.Random(3)
    rows = [({0: 0, 1: None, 3: 0}.get(n % 6, rnd.randint(1, 200)), n, rnd.choice("abcdef")) for n in range(3000)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k int, at int, v string").repartition(8).persist()


def test_heavy_keys_are_bounded(skewed):
    found = heavy_keys(skewed, ["k"], parts=50, min_rows=10).collect()
    assert {r.k for r in found} == {0, None}


def test_lag_over_split_keys(skewed):
    ordered = OrderedKeys(skewed, ["k"], ["at"], **HEAVY)
    assert ordered.split
    got = {(r.at, r.p.v if r.p else None) for r in ordered.lag(["at", "v"], "p").collect()}
    plain = skewed.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("at")))
    assert got == {(r.at, r.p) for r in plain.collect()}


def test_split_keys_really_use_several_buckets(skewed):
    rows = OrderedKeys(skewed, ["k"], ["at"], **HEAVY).rows
    sizes = [r["count"] for r in rows.filter("k = 0").groupBy("__bucket").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 200


def test_positions_and_running_sums(skewed):
    ordered = OrderedKeys(skewed, ["k"], ["at"], **HEAVY)
    got = {(r.at, r.n, r.s) for r in ordered.running_sums({"n": F.lit(1), "s": F.col("at") % 7}).collect()}
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.select("at", F.sum(F.lit(1)).over(w).alias("n"), F.sum(F.col("at") % 7).over(w).alias("s"))
    assert got == {(r.at, r.n, r.s) for r in plain.collect()}
    assert {(r.at, r.n) for r in ordered.positions("n").select("at", "n").collect()} == {(a, n) for a, n, _ in got}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join(spark, skewed, how):
    dim = spark.createDataFrame([(k, f"name{k}") for k in range(0, 150)], "k int, name string")
    got = lookup_join(skewed, dim, ["k"], how, salt_by=["at"], parts=50, min_rows=10)
    assert sorted(map(tuple, got.select("k", "at", "name").collect()), key=repr) == sorted(
        map(tuple, skewed.join(dim, "k", how).select("k", "at", "name").collect()), key=repr
    )


def test_expand_copies(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 10_000)], "x string, n long")
    got = expand_copies(df, "n", "k", chunk=64)
    counts = {r.x: (r.n, r.lo, r.hi, r.d) for r in got.groupBy("x").agg(
        F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.countDistinct("k").alias("d")
    ).collect()}
    assert counts == {"a": (3, 1, 3, 3), "c": (10_000, 1, 10_000, 10_000)}


@pytest.mark.parametrize("skew", [{}, {"min_rows": 3, "parts": 50}])
def test_nearest_version_by_brute_force(spark, skew):
    rnd = random.Random(11)
    marks = [(rnd.randint(0, 10**6), f"s{i:02d}") for i in range(25)]
    events = [(i, rnd.randint(-(10**5), 11 * 10**5)) for i in range(400)] + [(1000, None)]
    ms = spark.createDataFrame(marks, "s long, sid string").select(F.timestamp_seconds("s").alias("m"), "sid")
    es = spark.createDataFrame(events, "e int, s long").select("e", F.timestamp_seconds("s").alias("t"))
    got = {r.e: r.sid for r in nearest_version(es, "t", ms, "m", "sid", **skew).collect()}
    for e, t in events:
        want = None if t is None else min((abs(t - m), m, s) for m, s in marks)[2]
        assert got[e] == want


def test_heavy_keys_are_counted_by_many_tasks(skewed, monkeypatch):
    """Bringing the few heavy keys together must not bring the counting of all keys into one task."""
    plans = []
    monkeypatch.setattr(skew, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    dim = skewed.select("k").distinct()
    lookup_join(skewed, dim, ["k"])
    OrderedKeys(skewed, ["k"], ["at"])
    assert len(plans) == 2 and not any("Coalesce 1" in p for p in plans)


def test_many_rows_are_dealt_into_partitions_of_bounded_size(skewed, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 100)
    ordered = OrderedKeys(skewed, ["k"], ["at"])
    assert ordered.rows.rdd.getNumPartitions() == 30
    got = {(r.at, r.n) for r in ordered.positions("n").collect()}
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("at")))
    assert got == {(r.at, r.n) for r in plain.collect()}


def test_backfilled_records_are_dealt_by_their_rows(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, entry.queries()["records_backfilled"](spark, folder).collect()))
    monkeypatch.setattr(skew, "ROWS", 500)
    n = -(-spark.read.parquet(f"{folder}/lineitem.parquet").count() // 500)
    df = entry.queries()["records_backfilled"](spark, folder)
    assert f", {n}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == plain
