"""The nearest stops within a distance, against brute force; distant points are answered without the pyramid."""

import random

from kerbline.operators import stops
from tests.test_nearest import POINTS, STOPS, brute, far

REACH = 140.0


def test_stops_within_reach_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    near = lambda d: rng.uniform(-d, d)
    places = [(f"c{i:04d}", 42.0, -87.0) for i in range(30)]  # one place
    places += [(f"d{i:04d}", 42.01 + near(0.0002), -87.01 + near(0.0002)) for i in range(900)]  # more than a cell may hold
    places += [(f"e{i:04d}", 42.0 + near(0.01), -87.0 + near(0.01)) for i in range(300)]
    places += [(f"p{i}", 89.7, 10.0 + 0.02 * i) for i in range(12)]  # a box there is narrower than the reach
    points = [(i, 42.0 + near(0.012), -87.0 + near(0.012)) for i in range(150)]
    points += [(300, 42.0, -87.0), (301, 42.0101, -87.0099), (302, 89.7, 10.1), (303, None, 1.0)]
    points += [(400 + i, 42.35 + near(0.01), -87.0 + near(0.3)) for i in range(50)]  # far from all
    asked, descend = [], stops._descend
    monkeypatch.setattr(stops, "_descend", lambda p, *more: asked.append([r[0] for r in p.select("point_id").collect()]) or descend(p, *more))
    given = spark.createDataFrame(points, POINTS).repartition(4), spark.createDataFrame(places, STOPS)
    got = stops.nearest_stops(*given, n=7, max_m=REACH).collect()
    known = {p[0]: p for p in points}
    at = {s[0]: s for s in places}
    want = {(p, rank + 1, s) for p, found in brute([p for p in points if p[1] is not None], places, 7).items() for rank, s in enumerate(found) if far(known[p], at[s]) <= REACH}
    mine = {(r["point_id"], r["rank"]): r["dist_m"] for r in got}
    assert mine.keys() == {(p, rank) for p, rank, _ in want} and len(got) == len(want) > 200
    assert all(abs(mine[p, rank] - far(known[p], at[s])) < 1e-5 for p, rank, s in want)
    assert not any(400 <= p < 450 for part in asked for p in part)
