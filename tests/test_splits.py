"""Joins that split hot keys as measured give what plain joins give, in tasks of bounded size."""

from pyspark.sql import functions as F

from kerbline.operators import delay, intervals, smooth


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def hot_facts(spark, n=6000):
    # a third of all rows share one key
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("shape_id"), (F.col("id") % 7).alias("seg"), F.col("id").alias("trip_id"))


def test_parts_follow_the_counts(spark):
    facts = hot_facts(spark)
    assert intervals.hot_keys(facts, ["shape_id"]) is None
    hot = intervals.hot_keys(facts, ["shape_id"], rows_a_task=300)
    assert {r["shape_id"]: r["__parts"] for r in hot.parts.collect()} == {"hot": 7}
    few = intervals.hot_keys(facts, ["shape_id"], rows_a_task=50, most=1)
    assert [r["shape_id"] for r in few.parts.collect()] == ["hot"]
    assert intervals.hot_keys(facts.where("false"), ["shape_id"], rows_a_task=0) is None


def test_split_joins_equal_plain_joins(spark):
    facts = hot_facts(spark).union(spark.createDataFrame([(None, 1, 9_999_999)], "shape_id string, seg long, trip_id long"))
    dims = spark.createDataFrame([("hot", s, float(s)) for s in range(5)] + [(f"k{i}", 0, 1.0 * i) for i in range(20)] + [(None, 1, 0.5)], "shape_id string, seg long, v double")
    hot = intervals.hot_keys(facts, ["shape_id"], rows_a_task=100)
    for how in ("inner", "left"):
        want = facts.join(dims, ["shape_id", "seg"], how)
        got = intervals.split_join(facts, dims, ["shape_id", "seg"], F.col("trip_id"), hot, how)
        assert got.columns == want.columns and rows_of(got.na.fill(-1.0).na.fill("")) == rows_of(want.na.fill(-1.0).na.fill(""))


def test_no_part_of_a_hot_key_is_large(spark):
    facts = hot_facts(spark, 30_000)
    hot = intervals.hot_keys(facts, ["shape_id"], rows_a_task=1000)
    dims = facts.select("shape_id").distinct()
    lhs, rhs, more = intervals.dealt(facts, dims, F.col("trip_id"), hot)
    assert more == ["__part"] and lhs.groupBy("shape_id", "__part").count().agg(F.max("count")).first()[0] < 1300
    assert rhs.where("shape_id = 'hot'").count() == 10 and rhs.where("shape_id = 'k1'").count() == 1


def test_overlaps_of_hot_keys(spark):
    left = hot_facts(spark, 900).select("shape_id", "trip_id", (F.col("trip_id") * 1.5).alias("a0"), (F.col("trip_id") * 1.5 + 40).alias("a1"))
    right = spark.range(60).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("k1").alias("shape_id"), F.col("id").alias("z"), (F.col("id") * 25.0).alias("b0"), (F.col("id") * 25.0 + 10).alias("b1"))
    plain = intervals.overlap_join(left, right, ["shape_id"], ("a0", "a1"), ("b0", "b1"), 30.0)
    split = intervals.overlap_join(left, right, ["shape_id"], ("a0", "a1"), ("b0", "b1"), 30.0, hot=intervals.hot_keys(left, ["shape_id"], rows_a_task=50))
    assert plain.columns == split.columns and rows_of(plain) == rows_of(split) and plain.count() > 300


def test_segment_times_of_hot_shapes(spark, products, monkeypatch):
    want = rows_of(products.times.select("trip_id", "seg_id", "t_in", "t_out"))
    real = intervals.hot_keys
    monkeypatch.setattr(delay, "hot_keys", lambda facts, on, **_: real(facts, on, rows_a_task=20))
    assert real(products.pieces, ["shape_id"], rows_a_task=20) is not None
    got = delay.segment_times(products.pieces, products.segs, ["trip_id"])
    assert rows_of(got.select("trip_id", "seg_id", "t_in", "t_out")) == want
    named, _ = delay.attributions(products.events, products.times, products.zones, products.seg_controls, ["trip_id"])
    columns = ["trip_id", "t_start", "seg_id", "category", "facility_id"]
    assert rows_of(named.select(columns).na.fill("")) == rows_of(products.attributed.select(columns).na.fill(""))


def test_positions_are_numbered_along_the_shape(spark):
    given = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("a", 5.0), ("b", 2.0)], "shape_id string, pos_m double")
    assert rows_of(smooth.numbered_positions(given)) == [("a", 1.0, 1), ("a", 5.0, 2), ("b", 2.0, 1)]
