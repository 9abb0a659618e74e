"""Road features, stops, selection, motion and streaming rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.operators import mapmatch, motion, roads, sensitivity, stops
from kerbline.plans.queries_study import drained
from kerbline.streaming import live

CP = "shape_id string, node_id long, dist_m double, control_type string, cross_street_names array<string>"


def controls(spark, *rows):
    return spark.createDataFrame([("S", i + 1, float(d), kind, [f"St {i}"]) for i, (d, kind) in enumerate(rows)], CP)


@pytest.mark.parametrize("gap,rows,want", [
    (200.0, [(1000, "traffic_signals"), (1100, "traffic_signals"), (1190, "traffic_signals")], [(1, [2, 3])]),
    (200.0, [(1000, "traffic_signals"), (1480, "traffic_signals")], [(1, []), (2, [])]),
    (200.0, [(1000, "traffic_signals"), (1100, "stop")], [(1, []), (2, [])]),
    (200.0, [(1000, "traffic_signals"), (1150, "traffic_signals"), (1300, "traffic_signals")], [(1, [2]), (3, [])]),
])
def test_clusters_compare_with_the_first_member(spark, gap, rows, want):
    got = roads.cluster_controls(controls(spark, *rows), gap_m=gap).orderBy("dist_m").collect()
    assert [(r.node_id, r.merged_node_ids) for r in got] == want
    if len(want) == 1:
        assert got[0].cross_street_names == ["St 0", "St 1", "St 2"]


def test_drop_near_is_one_sided(spark):
    c = controls(spark, (100, "traffic_signals"), (139, "ped_crossing_signal"), (141, "ped_crossing_signal"), (60, "ped_crossing_signal"), (110, "ped_crossing_marked"))
    left = roads.drop_near(c, "ped_crossing_signal", ["traffic_signals"])
    assert sorted(r.dist_m for r in left.collect()) == [100, 110, 141]


def test_polyline_decoding(spark):
    got = roads.matched_vertices(spark.createDataFrame([("S", "_izlhA~rlgdF_{geC~ywl@")], "shape_id string, shape string")).orderBy("idx").collect()
    assert [(r.lat, r.lon) for r in got] == [(38.5, -120.2), (40.7, -120.95)]


@pytest.fixture(scope="module")
def street(spark):
    step = 100.0 / 111320.0
    pts = spark.createDataFrame([("S", i, 42.0 - i * step, -87.6, 100.0 * i) for i in range(11)], "shape_id string, seq int, lat double, lon double, dist_m double")
    return mapmatch.shape_segments(pts).cache(), step


def network(spark, step, tags, extra=()):
    nodes = [(i, 42.0 - i * step, -87.6, tags.get(i, {})) for i in range(11)] + list(extra)
    ways = [(1, list(range(11)), {"highway": "primary"}), (2, [6, 99], {"highway": "residential", "name": "Cross"}), (3, [8, 98], {"highway": "footway"})]
    return (
        spark.createDataFrame([("S", 1, 0, 0.0, 1000.0, "forward")], "shape_id string, way_id long, way_no long, dist_start_m double, dist_end_m double, direction string"),
        spark.createDataFrame(ways, "id long, nodes array<long>, tags map<string,string>"),
        spark.createDataFrame(nodes, "id long, lat double, lon double, tags map<string,string>"),
    )


def test_signal_at_a_shared_node(spark, street):
    segs, step = street
    got = roads.control_points(*network(spark, step, {6: {"highway": "traffic_signals"}, 8: {"highway": "traffic_signals"}}), segs).collect()
    assert [(r.node_id, r.control_type, round(r.dist_m), r.cross_street_names) for r in got] == [(6, "traffic_signals", 600, ["Cross"])]


def test_sign_reaches_the_next_vertex_only_nearby(spark, street):
    segs, step = street
    near = ((50, 42.0 - 5.8 * step, -87.6, {"highway": "stop"}),)
    seg, ways, nodes = network(spark, step, {}, near)
    ways = ways.withColumn("nodes", F.when(F.col("id") == 1, F.array(*[F.lit(v).cast("long") for v in (0, 1, 2, 3, 4, 5, 50, 6, 7, 8, 9, 10)])).otherwise(F.col("nodes")))
    got = roads.control_points(seg, ways, nodes, segs).collect()
    assert [(r.node_id, r.control_type) for r in got] == [(6, "stop")]
    far = nodes.withColumn("lat", F.when(F.col("id") == 50, 42.0 - 5.5 * step).otherwise(F.col("lat")))
    assert roads.control_points(seg, ways, far, segs).count() == 0
    against = nodes.withColumn("tags", F.when(F.col("id") == 50, F.create_map(F.lit("highway"), F.lit("stop"), F.lit("direction"), F.lit("backward"))).otherwise(F.col("tags")))
    assert roads.control_points(seg, ways, against, segs).count() == 0


def test_crossing_is_kept_and_anchored(spark, street):
    segs, step = street
    zebra = ((50, 42.0 - 6.2 * step, -87.6, {"highway": "crossing", "crossing:markings": "zebra", "crossing:island": "yes"}),)
    seg, ways, nodes = network(spark, step, {6: {"highway": "traffic_signals"}}, zebra)
    ways = ways.withColumn("nodes", F.when(F.col("id") == 1, F.array(*[F.lit(v).cast("long") for v in (0, 1, 2, 3, 4, 5, 6, 50, 7, 8, 9, 10)])).otherwise(F.col("nodes")))
    got = {r.node_id: r for r in roads.control_points(seg, ways, nodes, segs).collect()}
    assert set(got) == {6, 50} and got[50].anchor_node_id == 6 and got[50].markings == "zebra" and got[50].has_island and not got[50].signalized


def test_diff_matches_by_place_then_by_name(spark):
    schema = "shape_id string, node_id long, lat double, lon double, dist_m double, control_type string, cross_street_names array<string>"
    a = spark.createDataFrame([("A", 1, 42.0, -87.6, 0.0, "stop", []), ("A", 2, 42.01, -87.6, 100.0, "stop", ["Elm"]), ("A", 3, 42.02, -87.6, 200.0, "stop", [])], schema)
    b = spark.createDataFrame([("B", 11, 42.0001, -87.6, 300.0, "stop", []), ("B", 12, 42.0125, -87.6, 100.0, "stop", ["Elm"]), ("B", 13, 42.02, -87.6, 0.0, "traffic_signals", [])], schema)
    pairs = spark.createDataFrame([("A", "B")], "shape_a string, shape_b string")
    only_a, only_b = roads.diff_control_points(a, b, pairs)
    assert [r.node_id for r in only_a.collect()] == [3] and [r.node_id for r in only_b.collect()] == [13]


def test_nearest_stops_box_and_fallback_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    places = [(str(i), 42 + float(a), -87 + float(b)) for i, (a, b) in enumerate(rng.uniform(-0.05, 0.05, (80, 2)))]
    points = [(i, 42 + float(a), -87 + float(b)) for i, (a, b) in enumerate(rng.uniform(-0.1, 0.1, (40, 2)))] + [(99, 10.0, 20.0)]
    got = stops.nearest_stops(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(places, "stop_id string, lat double, lon double"), n=5)
    found = {}
    for r in got.orderBy("rank").collect():
        found.setdefault(r.point_id, []).append(r.stop_id)

    def far(p, s):
        u, v = math.radians(p[1]), math.radians(s[1])
        h = math.sin((v - u) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(s[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    for p in points:
        box = [s for s in places if abs(s[1] - p[1]) < 0.02 and abs(s[2] - p[2]) < 0.028]
        pool = box if len(box) >= 5 else places
        assert found[p[0]] == [s[0] for s in sorted(pool, key=lambda s: far(p, s))[:5]]


def test_simplify_keeps_corners(spark):
    pts = [("S", i, 42.0 + 0.001 * min(i, 10), -87.0 + 0.001 * max(i - 10, 0)) for i in range(21)]
    kept = stops.simplify_shape(spark.createDataFrame(pts, "shape_id string, seq int, lat double, lon double")).orderBy("seq").collect()
    assert [r.seq for r in kept] == [0, 10, 20]


def test_long_lines_simplify_alike_in_rounds_and_in_a_task(spark):
    rng = np.random.default_rng(0)
    steps = rng.normal(size=(2, 600)).cumsum(1) * 2e-5
    pts = spark.createDataFrame([("S", 3 * i, 42 + float(a), -87 + float(b)) for i, (a, b) in enumerate(steps.T)], "shape_id string, seq int, lat double, lon double")
    whole, rounds = ({r.seq for r in stops.simplify_shape(pts, in_task=n).collect()} for n in (4096, 150))
    x, y = pts.toPandas()["lon"] * np.cos(np.radians(42 + steps[0, 0])) * 111320.0, pts.toPandas()["lat"] * 110540.0
    want, open_ = {0, 599}, [(0, 599)]
    for a, b in open_:
        far = max(((np.hypot(*((np.array([x[i] - x[a], y[i] - y[a]]) - np.clip(((x[i] - x[a]) * (x[b] - x[a]) + (y[i] - y[a]) * (y[b] - y[a])) / ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2), 0, 1) * np.array([x[b] - x[a], y[b] - y[a]])))), i) for i in range(a + 1, b)), default=(0, 0))
        if far[0] > 8.0:
            want.add(far[1])
            open_ += [(a, far[1]), (far[1], b)]
    assert whole == rounds == {3 * i for i in want}


def test_bench_level_scores_full_marks(products):
    from kerbline.plans.queries_study import _components

    row = sensitivity.pool_metrics(_components(products)).where("level = 0").collect()[0]
    assert row.m1_position_pct == row.m2_speed_pct == row.m3_slow_f1 == row.m4_event_f1 == row.m5_jaccard == 100


def test_lowpass_equals_direct_recursion(spark):
    rng = np.random.default_rng(2)
    hz, cutoff, n = 50.0, 2.0, 3000
    x = rng.normal(size=n) + 3
    rows = spark.createDataFrame(pd.DataFrame({"trip_id": "T", "i": range(n), "t": np.arange(n) / hz, "ax": x}))
    ready = motion.segment_gaps(rows).withColumn("hz", F.lit(hz))
    old = motion.BLOCK_S
    motion.BLOCK_S = 20.0
    try:
        got = np.array([r.ax_lp for r in motion.lowpass(ready, {"ax_lp": ("ax", cutoff)}).orderBy("n").collect()])
    finally:
        motion.BLOCK_S = old
    # Second-order recursion form of the same filter, run both ways.
    w = 2 * hz * np.tan(np.pi * cutoff / hz)
    poles = w * np.exp(1j * np.pi * (2 * np.arange(1, 5) + 3) / 8)
    z = (2 * hz + poles) / (2 * hz - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(4)) * a.sum() / 16

    def run(v):
        past_x, past_y, out = [v[0]] * 4, [v[0]] * 4, []
        for s in v:
            y = b[0] * s + sum(b[j] * past_x[-j] for j in range(1, 5)) - sum(a[j] * past_y[-j] for j in range(1, 5))
            past_x.append(s)
            past_y.append(y)
            out.append(y)
        return np.array(out)

    wide = np.concatenate([2 * x[0] - x[15:0:-1], x, 2 * x[-1] - x[-2:-17:-1]])
    want = run(run(wide)[::-1])[::-1][15:15 + n]
    assert np.abs(got - want).max() < 1e-6


def test_handling_mask_pads_a_second(spark):
    rows = spark.createDataFrame([("T", i, i / 10.0, 100.0 if i == 50 else 0.0, 10.0) for i in range(100)], "trip_id string, n long, t double, gyro_mag double, hz double")
    held = [r.n for r in motion.handling_mask(rows).where("handling").orderBy("n").collect()]
    assert held == list(range(40, 60))


def test_propagated_axis_holds_without_rotation(spark):
    n = 400
    rows = spark.createDataFrame(
        [("T", 0, i, i / 50.0, 50.0, 0, n - 1, n, 0.0, (n - 1) / 50.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0) for i in range(n)],
        "trip_id string, seg_no long, n long, t double, hz double, seg_n0 long, seg_n1 long, seg_size long, seg_first double, seg_last double, gx double, gy double, gz double, sx double, sy double, sz double, a_horiz double",
    )
    anchors = spark.createDataFrame([("T", 80, 120, 100, 2.0, 1.0, 0.0, 0.0), ("T", 280, 320, 300, 6.0, 0.0, 1.0, 0.0)], "trip_id string, n0 long, n1 long, n_mid long, t_mid double, fx double, fy double, fz double")
    got = {r.n: r for r in motion.propagate_axis(rows, anchors).collect()}
    assert got[10].ux == pytest.approx(1) and got[390].uy == pytest.approx(1)
    assert got[200].ux == pytest.approx(got[200].uy) and got[200].ux == pytest.approx(math.sqrt(0.5))


def test_stream_slow_events_equal_batch(products):
    at = F.timestamp_millis(F.lit(1704110400000) + F.floor(F.col("t") * 1000))
    rows = products.samples.select("trip_id", at.alias("ts"), "t", "x", "v_mph")
    end = rows.limit(1).select(F.lit("~end").alias("trip_id"), (F.col("ts") + F.expr("interval 2 days")).alias("ts"), "t", "x", F.lit(60.0).alias("v_mph"))
    got = drained(products, rows.unionByName(end), lambda s: live.live_slow_events(s, keys=["trip_id"]))
    want = products.events
    cols = ["trip_id", "t_start", "t_end", "x_start", "x_end", "min_v_mph"]
    assert got.count() == want.count() and got.select(cols).exceptAll(want.select(cols)).count() == 0


def streamed(spark, folder, batches, build):
    """Feed each batch as a file of its own, one per trigger."""
    import os
    import time

    live.use_keyed_state(spark)
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(str(folder / f"part{k}"))
        (made,) = [f for f in os.listdir(folder / f"part{k}") if f.endswith(".parquet")]
        os.makedirs(folder / "in", exist_ok=True)
        os.link(folder / f"part{k}" / made, folder / "in" / f"{k}.parquet")
        os.utime(folder / "in" / f"{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches[0].schema)
    plan = build(live.stream_pings(spark, str(folder / "in"), schema, 1))
    job = plan.writeStream.format("parquet").option("checkpointLocation", str(folder / "marks")).option("path", str(folder / "out")).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(plan.schema).parquet(str(folder / "out"))


def test_late_batches_do_not_change_slow_events(spark, products, tmp_path):
    at = F.timestamp_millis(F.lit(1704110400000) + F.floor(F.col("t") * 1000))
    rows = products.samples.where("t < 250").select("trip_id", at.alias("ts"), "t", "x", "v_mph").cache()
    late = (F.floor(F.col("t") / 20) % 2) == 1
    end = rows.limit(1).select(F.lit("~end").alias("trip_id"), (F.col("ts") + F.expr("interval 2 days")).alias("ts"), "t", "x", F.lit(60.0).alias("v_mph"))
    last = end.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    cols = ["trip_id", "t_start", "t_end", "x_start", "x_end", "min_v_mph"]
    whole = streamed(spark, tmp_path / "a", [rows, end, last], lambda s: live.live_slow_events(s, keys=["trip_id"], watermark="400 seconds")).select(cols)
    split = streamed(spark, tmp_path / "b", [rows.where(~late), rows.where(late), end, last], lambda s: live.live_slow_events(s, keys=["trip_id"], watermark="400 seconds")).select(cols)
    assert whole.count() > 0 and whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0


def test_a_trip_id_that_returns_is_another_run(spark, tmp_path):
    def ping(day, minute, dist, bus="B"):
        return ("T1", bus, "S", f"2024-01-{day:02d} 12:{minute:02d}:00", dist, True)

    cast = lambda rows: spark.createDataFrame(rows, "trip_id string, bus_id string, shape_id string, ts string, dist_m double, on_route boolean").withColumn("ts", F.to_timestamp("ts"))
    lengths = spark.createDataFrame([("S", 1000.0)], "shape_id string, shape_len_m double")
    batches = [[ping(1, 0, 10.0), ping(1, 5, 990.0), ping(1, 6, 995.0)], [ping(1, 4, 700.0), ping(1, 7, 999.0)], [ping(8, 0, 20.0), ping(8, 1, 500.0), ping(8, 2, 10.0, "C")]]
    out = streamed(spark, tmp_path, [cast(b) for b in batches], lambda s: live.stop_after_terminal(s, lengths, tol_m=20.0))
    assert sorted((r.ts.day, r.ts.minute, r.bus_id) for r in out.collect()) == [(1, 0, "B"), (1, 4, "B"), (1, 5, "B"), (8, 0, "B"), (8, 1, "B"), (8, 2, "C")]


def test_motion_chunks_stream(spark, products, tmp_path):
    trip = tmp_path / "T1"
    trip.mkdir()
    (trip / "motion-0.csv").write_text("timestamp,ax,ay,az,gx,gy,gz,interval_ms,agx,agy,agz\n2026-07-01 07:00:00.000,1,0,0,0,0,0,20,0,0,0\n")
    (trip / "motion-1.csv").write_text("2026-07-01 07:00:00.020,2,0,0,0,0,0,20,0,0,0\n")
    job = live.motion_chunks(spark, str(tmp_path / "*")).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start()
    job.awaitTermination()
    assert [(r.trip_id, r.ax) for r in spark.sql("select * from chunks order by ts").collect()] == [("T1", 1.0), ("T1", 2.0)]


def test_next_stop_stays_last_after_the_end(spark):
    lists = stops.pattern_stop_lists(spark.createDataFrame([("P", 1, "a", "A", 0.0), ("P", 2, "b", "B", 500.0)], "pattern_id string, stop_seq int, stop_id string, name string, dist_m double"))
    fixes = spark.createDataFrame([("P", 1, 1.0, 1.0, 20.0, 5.0), ("P", 2, 1.0, 1.0, 30.0, 5.0), ("P", 3, 1.0, 1.0, 900.0, 5.0), ("P", 4, 1.0, 1.0, 0.0, 99.0)], "pattern_id string, id int, lat double, lon double, progress_m double, accuracy_m double")
    assert {r.id: r.next_stop_id for r in stops.next_stop(fixes, lists).collect()} == {1: "a", 2: "b", 3: "b", 4: None}
