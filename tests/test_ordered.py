"""Sliced scans must equal plain windows, whatever the slice width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.operators import intervals, ordered
from kerbline.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key, size in (("hot", 400), ("a", 7), ("b", 1)):
        t = 0.0
        for i in range(size):
            t += rng.choice([0.5, 1.0, 40.0])
            data.append((key, i, t, rng.choice([None, 1.0, 2.0, 5.0]), rng.random() < 0.4))
    return spark.createDataFrame(data, "k string, i long, t double, v double, f boolean").cache()


@pytest.mark.parametrize("width", [1.0, 25.0, 1e9])
def test_scan_equals_window(rows, width):
    got = ordered.scan(
        rows, ["k"], ["t"], ordered.time_slice("t", width), s=ordered.cum_sum(F.col("v")), se=ordered.cum_sum(F.col("v"), strict=True),
        m=ordered.cum_max(F.col("v")), p=ordered.last_known(F.col("v"), strict=True), n=ordered.next_known(F.col("v")),
        lg=ordered.previous(F.col("v")), ld=ordered.following(F.col("v")), tot=ordered.whole("sum", F.col("v")),
    )
    w = Window.partitionBy("k").orderBy("t")
    up, before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.select(
        "*", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("se"), F.max("v").over(up).alias("m"),
        F.last("v", True).over(before).alias("p"), F.first("v", True).over(after).alias("n"), F.lag("v").over(w).alias("lg"),
        F.lead("v").over(w).alias("ld"), F.sum("v").over(Window.partitionBy("k")).alias("tot"),
    )
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_islands_join_across_slices(rows):
    got = ordered.islands(
        rows, ["k"], "i", F.floor(F.col("i") / 3), F.col("f"), {"a": ("min", F.col("i")), "b": ("max", F.col("i")), "x": ("first", F.col("t")), "y": ("last", F.col("t"))}
    ).collect()
    runs = {}
    for r in rows.orderBy("k", "i").collect():
        if r.f:
            open_ = runs.setdefault(r.k, [])
            if open_ and open_[-1][1] == r.i - 1:
                open_[-1][1], open_[-1][3] = r.i, r.t
            else:
                open_.append([r.i, r.i, r.t, r.t])
    want = sorted((k, *run) for k, part in runs.items() for run in part)
    assert sorted(tuple(r) for r in got) == want


def test_sessions_split_on_gap(rows):
    got = ordered.sessions(rows, ["k"], ["t"], ordered.time_slice("t", 10.0), lambda p: F.col("t") - p > 30, F.col("t"), "no")
    counts = {r.k: r.n for r in got.groupBy("k").agg((F.max("no") + 1).alias("n")).collect()}
    want = {}
    for k in ("hot", "a", "b"):
        t = [r.t for r in rows.where(F.col("k") == k).orderBy("t").collect()]
        want[k] = 1 + sum(b - a > 30 for a, b in zip(t, t[1:]))
    assert counts == want


def test_overlap_join_emits_each_pair_once(spark):
    rng = random.Random(5)
    spans = [(i, s := rng.uniform(0, 500), s + rng.uniform(0, 200)) for i in range(60)]
    left = spark.createDataFrame([("k", i, a, b) for i, a, b in spans], "k string, i int, a double, b double")
    right = spark.createDataFrame([("k", i, a, b) for i, a, b in spans], "k string, j int, c double, d double")
    got = intervals.overlap_join(left, right, ["k"], ("a", "b"), ("c", "d"), 37.0).select("i", "j").collect()
    want = [(i, j) for i, a, b in spans for j, c, d in spans if max(a, c) < min(b, d)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_quantiles_interpolate_and_count_zeros(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 2, 9)], "k string, v double")
    zeros = spark.createDataFrame([("x", 4)], "k string, n long")
    assert quantiles(df, ["k"], F.col("v"), {"p": 0.5, "q": 0.9}).collect()[0][1:] == (2.0, pytest.approx(6.9))
    assert quantiles(df, ["k"], F.col("v"), {"p": 0.5, "q": 1.0}, zeros=zeros).collect()[0][1:] == (0.5, 9.0)


def test_asof_nearest_prefers_the_earlier_on_a_tie(spark):
    left = spark.createDataFrame([("k", 10.0, 1), ("k", 14.0, 2), ("k", 99.0, 3)], "k string, x double, id int")
    right = spark.createDataFrame([("k", 8.0, "a"), ("k", 12.0, "b"), ("k", 15.0, "c")], "k string, x double, name string")
    got = ordered.asof(left, right, ["k"], "x", F.floor(F.col("x") / 5), ["name"], how="nearest", tol=40.0)
    assert {r.id: r.name for r in got.collect()} == {1: "a", 2: "c", 3: None}


def test_interpolate_clamps(spark):
    left = spark.createDataFrame([("k", x) for x in (-1.0, 0.0, 2.5, 5.0, 9.0)], "k string, x double")
    right = spark.createDataFrame([("k", 0.0, 0.0), ("k", 5.0, 10.0)], "k string, x double, y double")
    got = ordered.interpolate(left, right, ["k"], "x", ["y"], F.floor(F.col("x") / 2), tie=["y"])
    assert {r.x: r.y for r in got.collect()} == {-1.0: 0.0, 0.0: 0.0, 2.5: 5.0, 5.0: 10.0, 9.0: 10.0}


def _ran(df):
    """Operators of the plan that was run, without those that reuse another's exchange."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan


def test_sessions_read_their_input_once(spark, rows, tmp_path):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    df = spark.read.parquet(path)
    plan = _ran(ordered.sessions(df, ["k"], ["t"], ordered.time_slice("t", 10.0), lambda p: F.col("t") - p > 30, F.col("t"), "no").select("k", "t", "no"))
    assert plan.count("FileScan parquet") == 1
    assert plan.count("ReusedExchange") >= 1
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("width", [1.0, 37.0, 1e9])
def test_sessions_equal_a_plain_window(rows, width):
    breaks = lambda p: (p["t"] + 20 < F.col("t")) | (p["f"] != F.col("f"))
    got = ordered.sessions(rows, ["k"], ["t"], ordered.time_slice("t", width), breaks, F.struct("t", "f"), "no").select("k", "i", "no").collect()
    w = Window.partitionBy("k").orderBy("t")
    before = rows.withColumn("p", F.lag(F.struct("t", "f")).over(w))
    want = before.withColumn("o", F.coalesce(breaks(F.col("p")), F.lit(False)).cast("long")).select("k", "i", F.sum("o").over(w).alias("no")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sessions_of_an_empty_table_and_null_values(spark, rows):
    assert ordered.sessions(rows.where("false"), ["k"], ["t"], ordered.time_slice("t"), lambda p: p > 0, F.col("v")).count() == 0
    got = ordered.sessions(rows, ["k"], ["t"], ordered.time_slice("t", 9.0), lambda p: p > 4, F.col("v"))
    w = Window.partitionBy("k").orderBy("t")
    want = rows.withColumn("p", F.lag("v").over(w)).select("k", "i", F.sum(F.coalesce((F.col("p") > 4).cast("long"), F.lit(0))).over(w))
    assert sorted(map(tuple, got.select("k", "i", "session_no").collect())) == sorted(map(tuple, want.collect()))
