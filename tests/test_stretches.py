"""Contiguous stretches of recordings are numbered, placed and measured from one exchange."""

from pyspark.sql import functions as F

from kerbline.operators import motion, stage


def test_stretches_need_no_written_step(spark):
    # one trip with gaps, stretches across slices of 600 s, one in a single slice, and rows without a trip
    times = [x * 7.0 for x in range(200)] + [1500.0, 1501.0, 1502.0] + [5000.0 + x for x in range(1300)]
    rows = [(trip, t, t * 2) for trip in ("A", "B", None) for t in (times if trip != "B" else times[190:210])]
    samples = spark.createDataFrame(rows, "trip_id string, t double, ax double").repartition(5, F.rand(1))
    written = len(stage._written)
    out = motion.segment_gaps(samples, gap_s=8.0)
    assert len(stage._written) == written
    got = {(r["trip_id"], r["t"]): r for r in out.collect()}
    want = 0
    for trip in ("A", "B"):
        mine = sorted(r[1] for r in rows if r[0] == trip)
        starts = [0, *[k for k in range(1, len(mine)) if mine[k] - mine[k - 1] > 8.0], len(mine)]
        for no, (a, b) in enumerate(zip(starts, starts[1:])):
            for n in range(a, b):
                r = got[trip, mine[n]]
                want += 1
                assert (r["seg_no"] - got[trip, mine[0]]["seg_no"], r["n"], r["ax"]) == (no, n, mine[n] * 2)
                assert (r["seg_first"], r["seg_last"], r["seg_size"], r["seg_n0"], r["seg_n1"]) == (mine[a], mine[b - 1], b - a, a, b - 1)
    assert len(got) == want


def test_full_rows_are_shuffled_once(spark):
    samples = stage.stage(spark.range(50).select(F.lit("A").alias("trip_id"), F.col("id").cast("double").alias("t"), (F.col("id") * 2.0).alias("ax")), "samples")
    out = motion.segment_gaps(samples)
    assert out.count() == 50
    plan = out.groupBy("trip_id").agg(F.max("ax"), F.max("seg_size"), F.max("n"))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text
