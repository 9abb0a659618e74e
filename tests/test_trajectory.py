"""Map matching and smoothing on analytic shapes, and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import mapmatch, quintic, smooth

K = ["trip_id"]


@pytest.fixture(scope="module")
def straight(spark):
    length = 1000.0
    step = float(length / 10 / (111320.0 * np.cos(np.radians(41.9))))
    pts = spark.createDataFrame([("S", i, 41.9, -87.65 + i * step, None) for i in range(11)], "shape_id string, seq int, lat double, lon double, dist_m double")
    return mapmatch.shape_segments(pts).cache(), step


def test_snap_on_a_straight_line(spark, straight):
    segs, step = straight
    north = 100.0 / 111320.0
    before = float(-200.0 / (111320.0 * np.cos(np.radians(41.9))))
    far = 5000.0 / 111320.0
    points = spark.createDataFrame(
        [("S", 0, 41.9, -87.65), ("S", 1, 41.9, -87.65 + 5 * step), ("S", 2, 41.9, -87.65 + 10 * step), ("S", 3, 41.9 + north, -87.65 + 5 * step),
         ("S", 4, 41.9, -87.65 + before), ("S", 5, 41.9 + far, -87.65 + 5 * step), ("none", 6, 41.9, -87.65)], "shape_id string, id int, lat double, lon double",
    )
    got = {r.id: r for r in mapmatch.snap_to_shape(points, segs, max_perp_m=20.0).collect()}
    assert [round(got[i].dist_m) for i in (0, 1, 2)] == [0, 500, 1000]
    assert not got[3].on_route and got[3].perp_m == pytest.approx(100, abs=0.5)
    assert got[4].dist_m == 0 and got[4].perp_m == pytest.approx(200, abs=0.5)
    assert got[5].dist_m == pytest.approx(500, abs=0.5) and got[5].perp_m == pytest.approx(5000, abs=1)
    assert got[6].dist_m is None and not got[6].on_route


def trace(spark, t, d, trip="T"):
    n = len(t)
    return spark.createDataFrame([(trip, "S", i, n, float(a), float(b)) for i, (a, b) in enumerate(zip(t, d))], "trip_id string, shape_id string, i long, n long, t double, d double")


def reference_locreg(t, d, bw, degree=3):
    """Plain weighted least squares per point."""
    n, out = len(t), []
    bw = min(bw, n)
    for i in range(n):
        lo = max(0, i - bw // 2)
        lo = max(0, min(lo + bw, n) - bw)
        tw, dw = t[lo:lo + bw] - t[i], d[lo:lo + bw]
        h = max(np.abs(tw).max(), 1e-9)
        w = np.clip(1 - np.abs(tw / h) ** 3, 0, None) ** 3
        deg = min(degree, len(tw) - 1)
        if deg < 1:
            out.append(dw[0])
            continue
        v = np.vander(tw, deg + 1) * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(v, dw * np.sqrt(w), rcond=None)[0][-1])
    return np.array(out)


@pytest.mark.parametrize("bw,degree", [(5, 3), (6, 3), (7, 3), (20, 3), (10, 2), (8, 1)])
def test_locreg_equals_least_squares(spark, bw, degree):
    rng = np.random.default_rng(bw)
    t = np.cumsum(rng.uniform(1, 40, 60))
    d = np.cumsum(rng.uniform(0, 300, 60))
    got = smooth.locreg(trace(spark, t, d), K, bandwidth=bw, degree=degree).orderBy("i").collect()
    assert np.allclose([r.x_smooth for r in got], reference_locreg(t, d, bw, degree), atol=1e-6)


def test_locreg_blocks_do_not_change_values(spark, monkeypatch):
    rng = np.random.default_rng(1)
    t, d = np.cumsum(rng.uniform(1, 9, 300)), np.cumsum(rng.uniform(0, 50, 300))
    monkeypatch.setattr(smooth, "BLOCK", 32)
    got = smooth.locreg(trace(spark, t, d), K, bandwidth=20).orderBy("i").collect()
    assert np.allclose([r.x_smooth for r in got], reference_locreg(t, d, 20), atol=1e-6)


def pieces_of(spark, t, d, bw=20):
    return smooth.smooth_pchip(trace(spark, t, d), K, bandwidth=bw)


def test_noisy_quadratic_is_recovered(spark):
    t = np.linspace(0, 100, 200)
    clean = 0.5 * t**2
    noisy = clean + np.random.default_rng(0).normal(0, 5, 200)
    got = smooth.locreg(trace(spark, t, noisy), K).orderBy("i").collect()
    assert np.sqrt(np.mean((np.array([r.x_smooth for r in got]) - clean) ** 2)) < 5


def test_spike_and_duplicates_stay_monotone(spark):
    t = np.arange(40.0)
    d = 10 * t
    d[20] = 50.0
    t[11] = t[10]
    knots = pieces_of(spark, t, d, 5).orderBy("t").collect()
    x = [r.x for r in knots]
    assert all(b >= a for a, b in zip(x, x[1:])) and len({r.t for r in knots}) == len(knots) == 39
    speed = [r.v_mph for r in smooth.sample_trajectory(pieces_of(spark, t, d, 5), K, dt=0.25).collect()]
    assert min(speed) >= -1e-9


def test_running_max(spark):
    rows = spark.createDataFrame([("T", i, v) for i, v in enumerate([0.0, 1.0, 0.5, 2.0, 1.5, 3.0])], "trip_id string, i long, x double")
    got = mapmatch.running_max(rows, K, ["i"], F.floor(F.col("i") / 2), "x").orderBy("i").collect()
    assert [r.x_max for r in got] == [0, 1, 1, 2, 2, 3]


def knots(spark, t, x):
    return smooth.pchip_slopes(spark.createDataFrame([("T", "S", float(a), float(b)) for a, b in zip(t, x)], "trip_id string, shape_id string, t double, x double"), K)


def test_two_knots_are_a_chord(spark):
    a, b = knots(spark, [0, 10], [0, 50]).orderBy("t").collect()
    assert a.m == a.m_next == b.m == 5.0 and b.m_next is None


def test_last_time_at_uses_the_end_of_a_dwell(spark):
    k = knots(spark, [0, 1, 2, 3, 4], [0, 10, 10, 10, 20])
    places = spark.createDataFrame([("S", v) for v in (-1.0, 0.0, 5.0, 10.0, 20.0, 99.0)], "shape_id string, pos_m double")
    at = {r.pos_m: r.t_at for r in smooth.last_time_at(k, places, K).collect()}
    assert at[10.0] == pytest.approx(3, abs=2e-3) and at[-1.0] == 0 and at[0.0] == 0 and at[20.0] == 4 and at[99.0] == 4
    assert 0 < at[5.0] < 1


@pytest.mark.parametrize("rule,count,last", [("clip", 6, 4.7), ("span", 5, 4.0), ("whole", 5, 4.0)])
def test_grid_rules(spark, rule, count, last):
    got = smooth.sample_trajectory(knots(spark, [0, 2.5, 4.7], [0, 5, 9]), K, dt=1.0, rule=rule).orderBy("i").collect()
    assert len(got) == count and got[-1].t == pytest.approx(last)


def test_quintic_acceleration_is_continuous(spark):
    t = np.arange(40.0)
    x = np.cumsum(np.abs(np.sin(t / 5)) * 3 + 1)
    bent = quintic.smooth_mqsi(knots(spark, t, x), K)
    rows = {r.k: r for r in bent.collect()}
    assert all(rows[k].c_next == rows[k + 1].c for k in range(39)) and rows[0].c == rows[39].c == 0
    sampled = quintic.sample_quintic(bent, K, 0.5).orderBy("t").collect()
    assert sampled[0].x == pytest.approx(x[0]) and max(abs(r.x - np.interp(r.t, t, x)) for r in sampled) < 1.0


def test_products_keep_their_invariants(products):
    p = products.pieces
    assert p.where("t_next <= t or x_next < x - 1e-9 or m < -1e-9").count() == 0
    assert products.samples.where("v_mph < -1e-6").count() == 0
