"""Divisions by zero that tables of any size bring: a cadence of 0, a series that does not vary."""

from pyspark.sql import functions as F

from kerbline.functions import curve
from kerbline.operators import motion


def test_bandwidth_of_no_cadence(spark):
    rows = spark.createDataFrame([(0.0,), (None,), (1.0,), (4.0,), (16.0,), (-3.0,)], "c double")
    got = [r[0] for r in rows.select(curve.bandwidth_for_cadence(F.col("c"))).collect()]
    assert got == [20, 20, 20, 10, 5, 5]


def test_correlation_of_constant_series(spark):
    rows = [("flat", 1.0, float(k)) for k in range(40)] + [("one", 1.0, 2.0)] + [("both", float(k), 3.0 - 2.0 * k) for k in range(40)]
    rows += [("both", None, 100.0), ("both", -50.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = dict(df.groupBy("k").agg(motion.correlation(F.col("x"), F.col("y"))).collect())
    assert got["flat"] is None and got["one"] is None and abs(got["both"] + 1.0) < 1e-12


def test_accel_vs_gps_with_steady_speed(spark):
    clean = [("T1", k / 2.0, 0.1 * (k % 7), False, 200, 0.0, 99.5) for k in range(200)]
    phone = spark.createDataFrame(clean, "trip_id string, t double, a_horiz double, handling boolean, seg_size long, seg_first double, seg_last double")
    fixes = spark.createDataFrame([("T1", 2.0 * k, 0.0) for k in range(45)], "trip_id string, t double, a_mps2 double")
    (row,) = motion.accel_vs_gps(phone, fixes).collect()
    assert (row["n_valid"], row["r"]) == (45, None)
