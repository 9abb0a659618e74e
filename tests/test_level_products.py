"""Level products made from pieces equal those made from listed samples, and only what is read is written."""

from pyspark.sql import functions as F

from kerbline.operators import delay, sensitivity, smooth
from kerbline.operators import stage as staged

K = ["trip_id", "level"]


def pieces(spark):
    """Curves of two trips at two levels: stops, a long gap, knots off the whole seconds."""
    rows = []
    for trip, shift in (("A", 0.0), ("B", 0.37)):
        for level, every in ((0, 1), (3, 4)):
            t, x = 0.25 + shift, 0.0
            for k in range(80):
                if k % every == 0:
                    rows.append((trip, level, "s", t, x))
                step = 400.0 if k == 40 else 7.0 + 0.3 * (k % 5)
                x += 0.0 if k % 11 in (3, 4) else (0.5 if k % 11 == 5 else 9.0) * step / 2
                t += step
    knots = spark.createDataFrame(rows, "trip_id string, level int, shape_id string, t double, x double")
    return smooth.pchip_slopes(knots, K).where(F.col("n_knots") >= 2).localCheckpoint()


def rows_of(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_events_of_pieces_equal_events_of_samples(spark):
    curves = pieces(spark)
    cols = [*K, "t_start", "t_end", "x_start", "x_end", "min_v_mph"]
    for how in ({"rule": "whole", "floor_zero": True}, {"dt": 2.0}, {"dt": 1.0}, {"dt": 0.7, "rule": "span"}):
        want = rows_of(delay.slow_events(smooth.sample_trajectory(curves, K, **how), K, min_s=4.0), cols)
        got = rows_of(delay.curve_slow_events(curves, K, min_s=4.0, **how), cols)
        assert len(want) > 10 and got == want


def test_runs_cut_between_chunks_are_joined(spark):
    curves = pieces(spark)
    whole, cut = (delay._piece_runs(curves, K, 5.0, 1.0, "clip", False, most) for most in (1 << 18, 3))
    assert cut.count() > whole.count()
    length = F.sum(F.col("__last") - F.col("__first") + 1)
    assert cut.agg(length).first() == whole.agg(length).first()


def test_components_equal_those_of_seconds(spark):
    curves = pieces(spark)
    samples = smooth.sample_trajectory(curves, K, rule="whole", floor_zero=True)
    base = {(r.trip_id, r.i): r for r in samples.where("level = 0").collect()}
    want, spans, doors_want = {}, {}, {}
    opens = [("A", 1, 12.5, 60.25), ("A", 2, 55.0, 90.0), ("B", 3, 100.0, 105.0), ("B", 4, 300.0, 900.0)]
    for r in samples.collect():
        lo, hi = spans.get((r.trip_id, r.level), (r.i, r.i))
        spans[r.trip_id, r.level] = min(lo, r.i), max(hi, r.i)
        if b := base.get((r.trip_id, r.i)):
            n, s, ok = want.get((r.trip_id, r.level), (0, 0.0, 0))
            want[r.trip_id, r.level] = n + 1, s + abs(r.x - b.x), ok + (abs(r.v_mph - b.v_mph) <= 2.5)
    got = {(r.trip_id, r.level): (r.n_sec, r.pos_abs_sum, r.spd_ok) for r in sensitivity.grid_components(curves).collect()}
    assert {k: (n, round(s, 6), ok) for k, (n, s, ok) in got.items()} == {k: (n, round(s, 6), ok) for k, (n, s, ok) in want.items()}
    shared = {(t, k): (max(lo, spans[t, 0][0]), min(hi, spans[t, 0][1])) for (t, k), (lo, hi) in spans.items()}
    span_rows = sensitivity.common_span(curves)
    assert {(r.trip_id, r.level): (r.t_lo, r.t_hi) for r in span_rows.collect()} == shared
    for r in samples.collect():
        lo, hi = shared[r.trip_id, r.level]
        for trip, _, a, b in opens:
            a, b = max(a, lo), min(b, hi)
            if trip == r.trip_id and b - a >= 10 and a <= r.i <= b:
                n, k = doors_want.get((r.trip_id, r.level), (0, 0))
                doors_want[r.trip_id, r.level] = n + 1, k + (r.v_mph < 5)
    doors = spark.createDataFrame(opens, "trip_id string, event_id long, open_s double, close_s double").withColumn("stop_id", F.lit("x"))
    found = {(r.trip_id, r.level): (r.door_sec, r.door_slow) for r in sensitivity.door_speed_components(curves, span_rows, doors).collect()}
    assert found == doors_want


def test_ladder_writes_no_seconds(spark, monkeypatch):
    """A query of the ladder alone builds no level product; events need pieces only, and no step has a row a second."""
    written = []
    monkeypatch.setattr(sensitivity, "stage", lambda df, name="step": written.append(name) or staged.stage(df, name))
    monkeypatch.setattr(smooth, "smooth_pchip", lambda *a, **b: pieces(spark))
    levels = sensitivity.run_levels(spark.createDataFrame([(True, 3, 1.0)], "on_route boolean, n long, dist_m double"), None, None, None)
    assert written == []
    assert levels["events"].count() > 0 and levels["spans"].count() == 4
    assert written == ["level_pieces", "level_events", "spans"]
    assert levels["samples"].count() > 1000 and written == ["level_pieces", "level_events", "spans"]


def test_shoulders_read_each_sample_once(spark):
    """Neither end of an event is looked up again in the samples."""
    samples = smooth.sample_trajectory(pieces(spark), K, rule="whole").select(*K, "i", "t", "v_mph")
    events = spark.createDataFrame([("A", 0, 1.0, 2.0)], "trip_id string, level int, t_start double, t_end double")
    plan = delay.loss_shoulders(samples, events, K)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") <= 4
