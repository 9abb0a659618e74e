"""Segments, events, causes and the decomposition identity."""

import pytest
from pyspark.sql import functions as F

from kerbline.operators import aggregate, delay, segments, smooth
from kerbline.operators.ordered import cum_sum, scan

K = ["trip_id"]
CP = "shape_id string, node_id long, lat double, lon double, dist_m double, control_type string, cross_street_names array<string>"


def controls(spark, *rows):
    return spark.createDataFrame([("S", n, 0.0, 0.0, float(d), kind, []) for n, d, kind in rows], CP)


def stops(spark, *rows):
    return spark.createDataFrame([("S", i, f"Stop {i}", float(d)) for i, d in rows], "shape_id string, stop_id string, name string, dist_m double")


def test_near_side_rule(spark):
    c = controls(spark, (1, 115, "traffic_signals"), (2, 410, "stop"), (3, 500, "ped_crossing_signal"))
    s = stops(spark, ("a", 100), ("b", 130), ("c", 400), ("d", 115 - 27.4), ("e", 115 - 27.5), ("f", 490))
    got = {r.stop_id: r.is_near_side for r in segments.near_side_stops(s, c).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False, "f": True}


def test_segments_between_signals(spark):
    c = controls(spark, (1, 0, "traffic_signals"), (2, 200, "ped_crossing_marked"), (3, 500, "ped_crossing_signal"), (4, 800, "traffic_signals"))
    segs = segments.segments(c)
    assert [(r.seg_id, r.x_start, r.x_end) for r in segs.orderBy("x_start").collect()] == [("SIG_1__SIG_3", 0, 500), ("SIG_3__SIG_4", 500, 800)]
    inside = segments.segment_controls(c, segs).collect()
    assert [(r.node_id, r.seg_id) for r in inside] == [(2, "SIG_1__SIG_3")]
    assert segments.segments(c.where("node_id = 1")).count() == 0


@pytest.mark.parametrize("cross,zone", [(None, (70, 110)), (85, (85, 110)), (105, (70, 105)), (100, (70, 110))])
def test_dwell_zone_clips(spark, cross, zone):
    rows = [(1, 0, "traffic_signals"), (9, 400, "traffic_signals")] + ([(5, cross, "stop")] if cross else [])
    c = controls(spark, *rows)
    segs = segments.segments(c)
    near = segments.near_side_stops(stops(spark, ("a", 100)), c)
    got = segments.dwell_zones(segments.segment_stops(near, segs), segments.segment_controls(c, segs)).collect()[0]
    assert (got.zone_lo, got.zone_hi) == zone


def samples(spark, speeds, dt=1.0):
    """Rows from (mph, seconds) stretches."""
    rows, t, x, i = [], 0.0, 0.0, 0
    for mph, secs in speeds:
        for _ in range(int(secs / dt)):
            rows.append(("T", "S", i, t, x, float(mph)))
            t, x, i = t + dt, x + mph / 2.236936 * dt, i + 1
    return spark.createDataFrame(rows, "trip_id string, shape_id string, i long, t double, x double, v_mph double")


def test_events_need_duration_and_merge_when_creeping(spark):
    one = delay.slow_events(samples(spark, [(20, 20), (2, 11), (20, 20)]), K, min_s=10).collect()
    assert len(one) == 1 and (one[0].t_start, one[0].t_end, one[0].min_v_mph) == (20, 30, 2)
    flat = samples(spark, [(10, 60)])
    assert delay.slow_events(flat, K).count() == 0
    assert delay.slow_events(flat, K, threshold=delay.below_speed(15.0)).count() == 1
    creep = samples(spark, [(20, 10), (1, 20), (8, 3), (1, 20), (8, 30), (1, 20)])
    got = delay.slow_events(creep, K).orderBy("t_start").collect()
    assert len(got) == 2 and got[0].t_end - got[0].t_start > 40


def test_event_order_drop_then_merge(spark):
    # The short run in the middle is dropped first, so the gap spans it.
    creep = samples(spark, [(1, 20), (6, 2), (1, 5), (6, 2), (1, 20)])
    assert delay.slow_events(creep, K).count() == 1
    wide = samples(spark, [(1, 20), (12, 3), (1, 5), (12, 3), (1, 20)])
    assert delay.slow_events(wide, K).count() == 2


def test_shoulders_inside_ramps(spark):
    rows, x = [], 0.0
    for i in range(61):
        t = i * 0.5
        v = 20.0 if t <= 5 else 20 - 4 * (t - 5) if t <= 10 else 0.0 if t <= 15 else 4 * (t - 15) if t <= 20 else 20.0
        rows.append(("T", "S", i, t, x, v))
    s = spark.createDataFrame(rows, "trip_id string, shape_id string, i long, t double, x double, v_mph double")
    e = spark.createDataFrame([("T", "S", 10.0, 15.0)], "trip_id string, shape_id string, t_start double, t_end double")
    got = delay.loss_shoulders(s, e, K).collect()[0]
    assert 5 < got.decel_lo < 10 and 15 < got.accel_hi < 20 and got.decel_lo == 7.5 and got.accel_hi == 17.5
    flat = s.withColumn("v_mph", F.lit(3.0))
    same = delay.loss_shoulders(flat, e, K).collect()[0]
    assert (same.decel_lo, same.accel_hi) == (10.0, 15.0)


def causes(spark, events, c, s):
    segs = segments.segments(c)
    near = segments.segment_stops(segments.near_side_stops(s, c), segs)
    seg_c = segments.segment_controls(c, segs)
    zones = segments.dwell_zones(near, seg_c)
    ev = spark.createDataFrame([("T", "S", float(a), float(b), float(p), float(q), 0.0) for a, b, p, q in events], "trip_id string, shape_id string, t_start double, t_end double, x_start double, x_end double, min_v_mph double")
    times = segs.select(F.lit("T").alias("trip_id"), "shape_id", "seg_id", "x_start", "x_end", "down_node", F.col("x_start").alias("t_in"), F.col("x_end").alias("t_out"))
    named, _ = delay.attributions(ev, times, zones, seg_c, K)
    return [(r.category, r.facility_id, r.dwell_near_signal) for r in named.orderBy("t_start").collect()]


def test_precedence_and_overflow(spark):
    c = controls(spark, (1, 0, "traffic_signals"), (7, 600, "stop"), (2, 1000, "traffic_signals"))
    s = stops(spark, ("near", 985), ("mid", 300))
    assert causes(spark, [(970, 990, 980, 986)], c, s) == [("dwell", "near", True)]
    assert causes(spark, [(290, 320, 295, 300)], c, s) == [("dwell", "mid", False)]
    assert causes(spark, [(560, 590, 570, 580)], c, s) == [("crossing", "CX_7", False)]
    assert causes(spark, [(910, 930, 920, 930)], c, s) == [("signal_uniform", "SIG_2", False)]
    assert causes(spark, [(400, 430, 400, 410)], c, s) == [("slowdown", None, False)]
    queue = [(700, 720, 700, 710), (760, 780, 760, 770), (910, 930, 920, 930)]
    assert [k for k, _, _ in causes(spark, queue, c, s)] == ["signal_overflow", "signal_overflow", "signal_uniform"]
    blocked = [(200, 220, 200, 210), (295, 320, 295, 300), (910, 930, 920, 930)]
    assert [k for k, _, _ in causes(spark, blocked, c, s)] == ["slowdown", "dwell", "signal_uniform"]


def test_decomposition_closes(spark):
    from kerbline.sources.readers import knots_of_records

    record = [("T", "1", [0.0, 99.0, 100.0, 120.0, 121.0, 300.0], [0.0, 495.0, 500.0, 500.0, 505.0, 1395.0], [5.0, 5.0, 0.0, 0.0, 5.0, 5.0])]
    rec = spark.createDataFrame(record, "trip_id string, pattern_id string, t_knots array<double>, x_knots array<double>, slopes array<double>")
    pieces = knots_of_records(rec).withColumn("shape_id", F.lit("S"))
    c = controls(spark, (1, 0, "traffic_signals"), (2, 1000, "traffic_signals"))
    s = stops(spark, ("a", 500))
    segs = segments.segments(c)
    zones = segments.dwell_zones(segments.segment_stops(segments.near_side_stops(s, c), segs), segments.segment_controls(c, segs))
    free = segs.select("shape_id", "seg_id", F.lit(100.0).alias("t_ff"))
    for loss in (False, True):
        rows, named = delay.decompose(pieces, segs, zones, segments.segment_controls(c, segs), free, K, include_loss=loss)
        r = rows.collect()[0]
        assert r.t_ff + r.t_dwell + r.d_signal + r.d_crossing + r.d_congestion == pytest.approx(r.t_obs, abs=1e-6)
        assert r.t_dwell > 10 and r.d_signal == 0 and named.collect()[0].facility_id == "a"


def test_products_close_and_buckets_are_positive(products):
    d = products.decomposed
    gap = F.abs(F.col("t_obs") - F.col("t_ff") - F.col("t_dwell") - F.col("d_signal") - F.col("d_crossing") - F.col("d_congestion"))
    assert d.where(gap > 1e-6).count() == 0 and d.where("t_obs < 0 or t_dwell < 0 or d_signal < 0 or d_crossing < 0").count() == 0
    assert d.count() == products.times.count()


def test_door_rule_can_replace_proximity(products):
    doors = products.attributed.where("category = 'dwell'").select("trip_id", F.col("facility_id").alias("stop_id"), F.col("t_start").alias("open_s"), F.col("t_end").alias("close_s"))
    rule = lambda primary, zones, keys: delay.door_dwells(primary, zones, doors, keys)
    named, _ = delay.attributions(products.events, products.times, products.zones, products.seg_controls, K, dwell_rule=rule)
    assert named.where("category = 'dwell'").count() >= doors.count() * 0.9


def test_zero_filled_statistics(spark):
    rows = spark.createDataFrame([("a", "S", "f", 60.0), ("b", "S", "f", 0.0), ("c", "S", "f", 30.0)], "trip_id string, shape_id string, facility_id string, core_s double")
    named = rows.where("core_s > 0").withColumn("category", F.lit("dwell"))
    trips = spark.createDataFrame([("S", 4)], "shape_id string, n_trips long")
    fac = spark.createDataFrame([("S", "f", "F", "stop", 10.0)], "shape_id string, facility_id string, label string, kind string, dist_m double")
    r = aggregate.facility_stats(named, trips, fac, K).collect()[0]
    assert (r.mean_s, r.median_s, r.n, r.n_trips) == (22.5, 15.0, 2, 4) and r.std_s == pytest.approx(24.8747, abs=1e-3)


def test_batch_of_trips_equals_single_trips(products):
    trip = products.trace.select("trip_id").orderBy("trip_id").limit(1).collect()[0].trip_id
    alone = smooth.smooth_pchip(products.trace.where(F.col("trip_id") == trip), K).select("t", "x", "m")
    together = products.pieces.where(F.col("trip_id") == trip).select("t", "x", "m")
    assert alone.exceptAll(together).count() == 0 and together.exceptAll(alone).count() == 0


def test_scan_plan_shuffles_rows_by_key_and_slice(products):
    plan = scan(products.trace, K, ["i"], F.floor(F.col("i") / 4096), s=cum_sum(F.col("d")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
