"""Nearest stops and greedy pairs on hard layouts, against brute force."""

import math
import random

from pyspark.sql import functions as F

from kerbline.operators import stops
from kerbline.operators.matching import greedy_pairs

POINTS = "point_id long, lat double, lon double"
STOPS = "stop_id string, lat double, lon double"


def far(p, s):
    u, v = math.radians(p[1]), math.radians(s[1])
    h = math.sin((v - u) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(s[2] - p[2]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def brute(points, places, n):
    out = {}
    for p in points:
        box = [s for s in places if abs(s[1] - p[1]) < 0.02 and abs(s[2] - p[2]) < 0.028]
        pool = box if len(box) >= n else places
        out[p[0]] = [s for _, s in sorted((round(far(p, s), 6), s[0]) for s in pool)[:n]]
    return out


def found(spark, points, places, n):
    got = stops.nearest_stops(spark.createDataFrame(points, POINTS).repartition(4), spark.createDataFrame(places, STOPS), n=n)
    rows = sorted((r["point_id"], r["rank"], round(r["dist_m"], 6), r["stop_id"]) for r in got.collect())
    out = {}
    for point, rank, _, stop in rows:
        out.setdefault(point, []).append(stop)
        assert len(out[point]) == rank
    return out


def test_dense_coincident_and_distant_stops(spark):
    rng = random.Random(3)
    places = [(f"c{i:04d}", 42.0, -87.0) for i in range(300)]  # one place
    places += [(f"d{i:04d}", 42.01 + rng.uniform(0, 0.0004), -87.01 + rng.uniform(0, 0.0004)) for i in range(900)]  # more than a cell may hold
    places += [(f"e{i:04d}", 42.02 + rng.uniform(-0.5, 0.5), -87.0 + rng.uniform(-0.5, 0.5)) for i in range(200)]
    places += [(f"f{i}", -33.9 + i / 100, 151.2) for i in range(4)]
    points = [(i, 42.0 + rng.uniform(-0.03, 0.03), -87.0 + rng.uniform(-0.03, 0.03)) for i in range(150)]
    points += [(200 + i, 42.0 + rng.uniform(-4, 4), -87.0 + rng.uniform(-9, 9)) for i in range(60)]
    points += [(300, 42.0, -87.0), (301, 42.0102, -87.0098), (302, -34.0, 151.0), (303, 0.0, 0.0), (304, 42.03, -87.028)]
    assert found(spark, points, places, 7) == brute(points, places, 7)


def test_few_or_no_stops_and_points_without_position(spark):
    points = [(1, 42.0, -87.0), (2, None, -87.0), (3, 10.0, None)]
    places = [("a", 42.1, -87.0), ("b", 42.0, -87.0), ("x", None, 1.0)]
    assert found(spark, points, places, 5) == {1: ["b", "a"]}
    assert found(spark, points, [("x", None, None)], 5) == {}


def test_greedy_rounds_equal_one_pass(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(12), rng.randrange(14), rng.random()) for g in range(5) for _ in range(90)]
    rows += [(9, i, i + d, float(10 * i + d)) for i in range(40) for d in (0, 1)]  # every pair waits for the one before
    rows = list({r[:3]: r for r in rows}.values())
    got = greedy_pairs(spark.createDataFrame(rows, "g int, a int, b int, w double"), ["g"], "a", "b", ["w"])
    want, left, right = set(), set(), set()
    for g, a, b, _ in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        if (g, a) not in left and (g, b) not in right:
            want.add((g, a, b))
            left.add((g, a))
            right.add((g, b))
    assert {tuple(r) for r in got.collect()} == want
    none = spark.createDataFrame([], "g int, a int, b int, w double")
    assert greedy_pairs(none, ["g"], "a", "b", ["w"]).collect() == []


def test_no_pool_is_longer_than_stated(spark):
    places = spark.createDataFrame([(str(i), 42.0 + (i % 37) / 1e5, -87.0 + (i % 41) / 1e5) for i in range(3000)], STOPS)
    kept = stops._distinct_places(places, 5)
    assert kept.groupBy("slat", "slon").count().agg(F.max("count")).first()[0] <= 5
    for size in stops.FINE:
        assert (stops._pools(kept, size, 200).agg(F.max(F.size("__near"))).first()[0] or 0) <= 200


def test_shapes_along_one_line_are_scored_once(spark):
    from kerbline.operators import mapmatch

    line = [(42.0 - 0.01 * k, -87.0) for k in range(5)]
    beside = [(a, b + 0.01) for a, b in line]
    shapes = {"S3": line, "S1": line, "S2": beside, "S4": line[::-1], "S5": line}
    pts = spark.createDataFrame([(s, i, a, b, None) for s, v in shapes.items() for i, (a, b) in enumerate(v)], "shape_id string, seq int, lat double, lon double, dist_m double")
    segments = mapmatch.shape_segments(pts)
    route = spark.createDataFrame([("r", "S3"), ("r", "S1"), ("r", "S2"), ("r", "S4"), ("q", "S5"), ("r", "none")], "route_id string, shape_id string")
    kept = {tuple(r) for r in mapmatch.distinct_geometries(route, segments, "shape_id").collect()}
    assert kept == {("r", "S1"), ("r", "S2"), ("r", "S4"), ("q", "S5"), ("r", "none")}
    pings = spark.createDataFrame([("t", "r", i, 42.0 - 0.004 * i, -87.0) for i in range(10)], "trip_id string, route_id string, i int, lat double, lon double")
    [row] = mapmatch.choose_shape(pings, route, segments, ["trip_id"], "i").collect()
    assert row["shape_id"] == "S1" and row["frac"] == 1.0
    ranked = spark.createDataFrame([("r", "S2", 0), ("r", "S3", 1), ("r", "S1", 2)], "route_id string, shape_id string, rank int")
    [row] = mapmatch.best_shape(pings, ranked, segments, ["trip_id"], "i").collect()
    assert row["shape_id"] == "S3"
