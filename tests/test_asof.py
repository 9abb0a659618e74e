"""Both neighbours of a row come from one exchange of the rows."""

import random

from pyspark.sql import functions as F

from kerbline.operators import ordered


def test_both_sides_equal_brute_force(spark):
    rng = random.Random(3)
    right = [("a" if k % 3 else "b", float(rng.randrange(60)), float(k)) for k in range(50)] + [("c", 5.0, -1.0)]
    left = [(rng.choice("abcd"), rng.randrange(120) / 2.0, k) for k in range(200)]
    lhs = spark.createDataFrame(left, "g string, t double, id long")
    rhs = spark.createDataFrame(right, "g string, t double, v double")
    near = ordered.asof(lhs, rhs, ["g"], "t", F.floor(F.col("t") / 10), ["v"], how="both", tie=["v"])
    got = {r.id: (r.prev_t, r.prev_v, r.next_t, r.next_v) for r in near.collect()}
    assert len(got) == 200
    for g, t, k in left:
        before = max(((u, v) for h, u, v in right if h == g and u <= t), default=(None, None))
        after = min(((u, v) for h, u, v in right if h == g and u >= t), default=(None, None))
        assert got[k] == (*before, *after)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_second_side_adds_no_exchange(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("t"), F.col("id").alias("v"))
    one, both = (ordered.asof(rows, rows, ["g"], "t", F.floor(F.col("t") / 10), ["v"], how=how) for how in ("backward", "both"))
    assert exchanges(both) == exchanges(one) > 0
