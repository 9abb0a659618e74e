"""Stops near a point, the next stop of a vehicle, and per-pattern bundles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.constants import EARTH_R_M, FT_PER_M, M_PER_DEG, M_PER_DEG_LAT_APP
from kerbline.functions import geo, text
from kerbline.operators.intervals import salted_join, salted_left_join
from kerbline.operators.mapmatch import cumulative_distance
from kerbline.operators.segments import near_side_stops
from kerbline.operators.stage import stage

BUFFER_M = 27.43
GOOD_ACCURACY_M = 30.0
BOX = (0.02, 0.028)
# cells that answer most points, and how many times n stops may lie around one
FINE = ((0.0005, 0.0007), (0.002, 0.0028), (0.008, 0.0112))
POOL = 40
# the pyramid: size of its smallest cells in degrees, cells of a level along a side of the next, levels above the smallest
CELL, FAN, LEVELS = 0.00125, 16, 3
SIMPLIFY_EPS_M = 8.0


@dataclass(frozen=True)
class City:
    """What differs between cities: stop filter, pattern key, near-side flags."""

    is_bus_stop: Callable[[], Column]
    pattern_key: Callable[[Column, Column, Column], Column]
    near_side: bool


def _plain_stop() -> Column:
    return F.coalesce(F.col("location_type"), F.lit("")).isin("", "0")


CITIES = {
    "cta": City(
        lambda: _plain_stop() & (F.coalesce(F.col("stop_id").try_cast("int"), F.lit(-1)) < 30000) & F.col("stop_id").try_cast("int").isNotNull(),
        lambda route, direction, shape: text.pattern_of_shape(shape), True,
    ),
    "mta": City(_plain_stop, lambda route, direction, shape: text.route_direction_key(route, direction), False),
}


def filter_bus_stops(stops: DataFrame, city: str = "cta") -> DataFrame:
    return stops.where(CITIES[city].is_bus_stop())


def _distinct_places(stops: DataFrame, n: int) -> DataFrame:
    """Stops that can be among the n nearest of any point: of those at one place the n with the smallest ids."""
    first = Window.partitionBy("lat", "lon").orderBy("stop_id")
    ranked = stops.where("lat is not null and lon is not null").select("stop_id", "lat", "lon", F.row_number().over(first).alias("__no"))
    return ranked.where(F.col("__no") <= n).select("stop_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))


def _pools(places: DataFrame, size: tuple[float, float], most: int) -> DataFrame:
    """Stops of each map cell and its eight neighbours as one array, where they are at most ``most``; without it where ``__many``."""
    step = F.sequence(F.lit(-1), F.lit(1))
    wide = places.withColumn("__dy", F.explode(step)).withColumn("__dx", F.explode(step)).select(
        F.struct("stop_id", "slat", "slon").alias("__s"), (F.floor(F.col("slat") / size[0]) + F.col("__dy")).alias("__cy"), (F.floor(F.col("slon") / size[1]) + F.col("__dx")).alias("__cx")
    )
    counts = wide.groupBy("__cy", "__cx").count()
    pools = wide.join(counts.where(F.col("count") <= most), ["__cy", "__cx"], "left_semi").groupBy("__cy", "__cx").agg(F.collect_list("__s").alias("__near"))
    many = counts.where(F.col("count") > most).select("__cy", "__cx", F.lit(True).alias("__many"))
    return pools.withColumn("__many", F.lit(False)).unionByName(many, allowMissingColumns=True)


def _inside_box() -> Column:
    return (F.abs(F.col("slat") - F.col("lat")) < BOX[0]) & (F.abs(F.col("slon") - F.col("lon")) < BOX[1])


def _bound(far: bool) -> Column:
    """Distance that no stop of a cell (lat0..lat1, lon0..lon1) is below, or with ``far`` above."""
    lat, lon = F.col("lat"), F.col("lon")
    if far:
        dy = F.greatest(F.abs(lat - F.col("lat0")), F.abs(lat - F.col("lat1")))
        dx = F.greatest(F.abs(lon - F.col("lon0")), F.abs(lon - F.col("lon1")))
        across = F.when((F.col("lat0") <= 0) & (F.col("lat1") >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs("lat0"), F.abs("lat1")))))
    else:
        dy = F.greatest(F.lit(0.0), F.col("lat0") - lat, lat - F.col("lat1"))
        dx = F.greatest(F.lit(0.0), F.col("lon0") - lon, lon - F.col("lon1"))
        across = F.cos(F.radians(F.greatest(F.abs("lat0"), F.abs("lat1"))))
    h = F.pow(F.sin(F.radians(dy) / 2), 2) + F.cos(F.radians(lat)) * across * F.pow(F.sin(F.radians(dx) / 2), 2)
    return 2 * EARTH_R_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _descend(points: DataFrame, places: DataFrame, n: int, key: str, boxed: bool) -> DataFrame:
    """The n nearest stops (with ``boxed`` of those in the box) by descending a pyramid of cells.

    A cell that begins beyond a distance within which other cells surely hold n
    stops is left out, so a point follows few cells on each level, wherever it is.
    """
    ids = places.select("*", F.floor(F.col("slat") / CELL).alias("__y"), F.floor(F.col("slon") / CELL).alias("__x"))
    up = lambda c, k: F.floor(F.col(c) / FAN**k)
    extent = [F.count("*").alias("count"), F.min("slat").alias("lat0"), F.max("slat").alias("lat1"), F.min("slon").alias("lon0"), F.max("slon").alias("lon1")]

    def cells(k: int) -> DataFrame:
        return ids.groupBy(up("__y", k).alias("__cy"), up("__x", k).alias("__cx")).agg(*extent)

    def pruned(rows: DataFrame) -> DataFrame:
        sure = F.lit(True)
        if boxed:
            lat, lon = F.col("lat"), F.col("lon")
            wide, tall = BOX[1] + 1e-9, BOX[0] + 1e-9
            rows = rows.where((F.col("lat1") > lat - tall) & (F.col("lat0") < lat + tall) & (F.col("lon1") > lon - wide) & (F.col("lon0") < lon + wide))
            wide, tall = BOX[1] - 1e-9, BOX[0] - 1e-9
            sure = (F.col("lat0") > lat - tall) & (F.col("lat1") < lat + tall) & (F.col("lon0") > lon - wide) & (F.col("lon1") < lon + wide)
        rows = rows.select(key, "lat", "lon", "__cy", "__cx", _bound(False).alias("__lo"), F.when(sure, _bound(True)).alias("__hi"), F.when(sure, F.col("count")).otherwise(0).alias("__held"))
        nearest = Window.partitionBy(key).orderBy(F.asc_nulls_last("__hi"), "__cy", "__cx").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__within", F.when(F.sum("__held").over(nearest) >= n, F.col("__hi")))
        rows = rows.withColumn("__limit", F.min("__within").over(Window.partitionBy(key)))
        return rows.where(F.col("__limit").isNull() | (F.col("__lo") <= F.col("__limit") * (1 + 1e-9) + 1e-6)).select(key, "lat", "lon", "__cy", "__cx")

    top = cells(LEVELS).collect()  # at most as many as the globe has cells of five degrees
    names = ["__cy", "__cx", "count", "lat0", "lat1", "lon0", "lon1"]
    if not top:
        return points.select(key, F.lit(0).alias("rank"), F.lit("").alias("stop_id"), F.lit(0.0).alias("dist_m")).limit(0)
    held = F.arrays_zip(*[F.lit([r[c] for r in top]).alias(c) for c in names])
    now = pruned(points.select(key, "lat", "lon", F.inline(held).alias(*names)))
    for k in range(LEVELS - 1, -1, -1):
        children = cells(k).withColumnsRenamed({"__cy": "__y", "__cx": "__x"}).withColumn("__cy", F.floor(F.col("__y") / FAN)).withColumn("__cx", F.floor(F.col("__x") / FAN))
        joined = salted_join(now, children, ["__cy", "__cx"], F.col(key))
        now = pruned(joined.drop("__cy", "__cx").withColumnsRenamed({"__y": "__cy", "__x": "__cx"}))
    met = salted_join(now, ids.withColumnsRenamed({"__y": "__cy", "__x": "__cx"}), ["__cy", "__cx"], F.col(key))
    met = met.where(_inside_box()) if boxed else met
    far = met.select(key, "stop_id", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")).alias("dist_m"))
    return far.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("dist_m", "stop_id"))).where(F.col("rank") <= n).select(key, "rank", "stop_id", "dist_m")


def nearest_stops(points: DataFrame, stops: DataFrame, *, n: int = 10, key: str = "point_id", max_m: float | None = None) -> DataFrame:
    """The n nearest stops of every point, ranked.

    The pool is the stops in a box around the point, or all stops where the box
    holds fewer than n. Cells of growing size, with at most ``POOL`` times n stops
    around each, answer the points that surely have n stops nearer than the border
    of the cells; only the others go on, at last to a pyramid of cells. ``key``
    is unique; points without a position have no rows. With ``max_m`` only those of
    the n that are at most so far are returned; then cells wider than ``max_m``, which
    the box holds, answer every point but those among too many stops.
    """
    places = stage(_distinct_places(stops, n), "places")
    left, done = points.where("lat is not null and lon is not null").select(key, "lat", "lon"), []
    pool = F.col("__near")
    if max_m is not None:
        # distances are taken only inside a box around the point, a hundredth wider than the reach
        tall = F.lit(max_m / 110000.0)
        across = F.cos(F.radians(F.abs("lat") + tall))
        wide = F.when(across > 0.1, tall / across).otherwise(360.0)
        pool = F.filter("__near", lambda s: (F.abs(s["slat"] - F.col("lat")) <= tall) & (F.abs(s["slon"] - F.col("lon")) <= wide))
    far = F.transform(pool, lambda s: F.struct(geo.haversine_m(F.col("lat"), F.col("lon"), s["slat"], s["slon"]).alias("dist_m"), s["stop_id"].alias("stop_id")))
    for size in FINE:
        keyed = left.withColumn("__cy", F.floor(F.col("lat") / size[0])).withColumn("__cx", F.floor(F.col("lon") / size[1]))
        near = salted_left_join(keyed, _pools(places, size, POOL * n), ["__cy", "__cx"], F.col(key))
        reach = F.least(F.lit(size[0] * 110574.0), size[1] * 111320.0 * F.cos(F.radians(F.abs(F.col("lat")) + size[0])))
        met = far if max_m is None else F.filter(far, lambda s: s["dist_m"] <= max_m)
        ranked = near.withColumn("__r", F.slice(F.array_sort(met), 1, n))
        sure = (F.size("__r") == n) & (F.get("__r", F.lit(n - 1))["dist_m"] <= reach)
        if max_m is not None:
            none = F.array().cast(ranked.schema["__r"].dataType)
            ranked = ranked.withColumn("__r", F.coalesce("__r", none))
            sure = sure | (~F.coalesce("__many", F.lit(False)) & (reach * 0.998 >= max_m) & (F.abs("lon") + size[1] < 180))
        step = stage(ranked.select(key, "lat", "lon", F.when(sure, F.col("__r")).alias("__found")), "nearest")
        done.append(step.where(F.col("__found").isNotNull()).select(key, F.posexplode("__found").alias("place", "s")).select(key, (F.col("place") + 1).alias("rank"), "s.stop_id", "s.dist_m"))
        left = step.where(F.col("__found").isNull()).select(key, "lat", "lon")
    boxed = stage(_descend(left, places, n, key, True), "boxed")
    full = boxed.where(F.col("rank") == n).select(key)
    rest = left.join(full, key, "left_anti")
    done += [boxed.join(full, key, "left_semi"), _descend(rest, places, n, key, False)]
    found = reduce(DataFrame.unionByName, [d.withColumn("rank", F.col("rank").cast("int")) for d in done])
    return found if max_m is None else found.where(F.col("dist_m") <= max_m)


def project_on_pattern(points: DataFrame, pattern_lines: DataFrame) -> DataFrame:
    """Progress along a pattern line in the live application's frame.

    pattern_lines: pattern_id, line = array of (lat, lon, cum_m). Each point is
    projected on every step of its own pattern's line; adds progress_m, offset_m.
    """
    joined = salted_left_join(points, pattern_lines, ["pattern_id"], F.struct("lat", "lon"))
    steps = F.size("line") - 1
    framed = joined.withColumn("__mx", M_PER_DEG * F.cos(F.radians("lat"))).withColumn(
        "__p", F.transform("line", lambda v: F.struct(
            ((v["lon"] - F.col("lon")) * F.col("__mx")).alias("x"), ((v["lat"] - F.col("lat")) * M_PER_DEG_LAT_APP).alias("y"), v["cum_m"].alias("cum")
        ))
    )

    def step(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), a["cum"].alias("cum"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def share(c: Column) -> Column:
        zero = F.lit(0.0)
        return F.struct(
            *[c[n].alias(n) for n in ("x", "y", "cum", "dx", "dy")],
            geo.clamp_share(-c["x"], -c["y"], zero, zero, c["dx"], c["dy"]).alias("t"),
        )

    def measure(c: Column, i: Column) -> Column:
        ex, ey = c["x"] + c["t"] * c["dx"], c["y"] + c["t"] * c["dy"]
        length = F.sqrt(c["dx"] * c["dx"] + c["dy"] * c["dy"])
        return F.struct(F.round(ex * ex + ey * ey, 6).alias("near"), i.alias("i"), (ex * ex + ey * ey).alias("d2"), (c["cum"] + c["t"] * length).alias("m"))

    sides = F.zip_with(F.slice("__p", 1, F.greatest(steps, F.lit(0))), F.slice("__p", 2, F.greatest(steps, F.lit(0))), step)
    # The first of equally near steps wins, to a square millimetre.
    best = F.array_min(F.transform(F.transform(sides, share), measure))
    return framed.withColumn("__b", F.when(steps >= 1, best)).select(
        *points.columns, F.col("__b")["m"].alias("progress_m"), F.sqrt(F.col("__b")["d2"]).alias("offset_m")
    )


def pattern_stop_lists(pattern_stops: DataFrame) -> DataFrame:
    """Stops of each pattern in order as one array (pattern_id, stops)."""
    near = F.col("is_near_side") if "is_near_side" in pattern_stops.columns else F.lit(None).cast("boolean")
    return pattern_stops.groupBy("pattern_id").agg(F.array_sort(F.collect_list(
        F.struct("stop_seq", "stop_id", "name", "dist_m", near.alias("near_side"))
    )).alias("stops"))


def next_stop(
    located: DataFrame, stop_lists: DataFrame, *, buffer_m: float = BUFFER_M, max_acc_m: float = GOOD_ACCURACY_M
) -> DataFrame:
    """First stop not yet passed by more than the buffer; the last one when all are passed.

    ``located`` holds progress_m and accuracy_m. Coarse fixes take
    predicted_stop_id when that column exists, else null.
    """
    joined = salted_left_join(located, stop_lists, ["pattern_id"], F.struct("lat", "lon"))
    ahead = F.filter("stops", lambda s: s["dist_m"] >= F.col("progress_m") - buffer_m)
    first = F.coalesce(F.get(ahead, F.lit(0)), F.element_at("stops", -1))
    good = (F.col("accuracy_m") <= max_acc_m) & F.col("progress_m").isNotNull() & (F.size("stops") > 0)
    if "predicted_stop_id" in located.columns:
        told = F.get(F.filter("stops", lambda s: s["stop_id"] == F.col("predicted_stop_id")), F.lit(0))
        pick = F.when(F.coalesce(good, F.lit(False)), first).otherwise(told)
    else:
        pick = F.when(F.coalesce(good, F.lit(False)), first)
    return joined.withColumn("__n", pick).select(
        *located.columns, F.col("__n")["stop_id"].alias("next_stop_id"), F.col("__n")["name"].alias("next_stop_name"),
        F.col("__n")["stop_seq"].alias("next_stop_seq"), F.col("__n")["near_side"].alias("next_near_side"),
    )


def upcoming_stops(nexts: DataFrame, stop_lists: DataFrame, etas: DataFrame | None = None, *, n: int = 3, key: str = "point_id") -> DataFrame:
    """The next n stops and the terminus, with an arrival estimate where known."""
    joined = salted_left_join(nexts.where(F.col("next_stop_seq").isNotNull()), stop_lists, ["pattern_id"], F.col(key))
    ahead = F.filter("stops", lambda s: s["stop_seq"] >= F.col("next_stop_seq"))
    head = F.slice(ahead, 1, n)
    last = F.element_at("stops", -1)
    listed = F.when(F.size(ahead) > n, F.array_append(head, last)).otherwise(head)
    out = joined.withColumn("__n", F.size(ahead)).select(key, "__n", F.posexplode(listed).alias("place", "s")).select(
        key, (F.col("place") + 1).alias("place"), "s.stop_id", "s.name", (F.col("place") == n).alias("is_terminus")
    )
    return out if etas is None else out.join(etas.select(key, "stop_id", "eta_min"), [key, "stop_id"], "left")


def approaching_buses(nearby: DataFrame, predictions: DataFrame, *, max_m: float = 150.0, max_eta_min: int = 15) -> DataFrame:
    """Predicted arrivals within reach at stops close to a point."""
    close = nearby.where(F.col("dist_m") <= max_m)
    return close.join(predictions.where(F.col("eta_min").isNotNull() & (F.col("eta_min") <= max_eta_min)), "stop_id")


def representative_trip(trips: DataFrame, by: str = "pattern_key") -> DataFrame:
    """The trip with the smallest id per pattern."""
    first = trips.where(F.col(by).isNotNull()).groupBy(by).agg(F.min_by(F.struct("trip_id", "shape_id"), "trip_id").alias("r"))
    return first.select(by, "r.trip_id", *([] if by == "shape_id" else ["r.shape_id"]))


def route_stops(trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Ordered stops of each shape from its smallest trip id; calls without distance are dropped."""
    chosen = representative_trip(trips, "shape_id").select("trip_id", "shape_id") if "pattern_key" not in trips.columns else trips
    calls = chosen.join(stop_times.where(F.col("shape_dist_ft").isNotNull()), "trip_id")
    return calls.join(stops.select("stop_id", "name"), "stop_id", "left").select(
        "shape_id", "stop_id", F.coalesce("name", F.lit("")).alias("name"), "stop_sequence", (F.col("shape_dist_ft") / FT_PER_M).alias("dist_m")
    )


def _off_chord(px, py, dx, dy):
    """Distance of points from a chord, all relative to its begin."""
    size = dx * dx + dy * dy
    share = np.clip(np.divide(px * dx + py * dy, size, out=np.zeros_like(size), where=size > 0), 0, 1)
    return np.hypot(px - share * dx, py - share * dy)


def _corners(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Inner vertices that matter; all open chords are split at once."""
    inner = np.arange(1, len(x) - 1)
    begin, end, found = np.zeros_like(inner), np.full_like(inner, len(x) - 1), []
    while len(inner):
        off = _off_chord(x[inner] - x[begin], y[inner] - y[begin], x[end] - x[begin], y[end] - y[begin])
        first = np.flatnonzero(np.append(True, begin[1:] != begin[:-1]))
        size = np.diff(np.append(first, len(inner)))
        most = np.maximum.reduceat(off, first)
        peaks = np.flatnonzero(off == np.repeat(most, size))
        corner = inner[peaks[np.searchsorted(peaks, first)]]
        found.append(corner[most > eps])
        corner, split = np.repeat(corner, size), np.repeat(most > eps, size) & (inner != np.repeat(corner, size))
        before = inner < corner
        begin, end, inner = np.where(before, begin, corner)[split], np.where(before, corner, end)[split], inner[split]
    return np.concatenate([*found, inner])


def simplify_shape(shape_pts: DataFrame, *, eps_m: float = SIMPLIFY_EPS_M, in_task: int = 4096) -> DataFrame:
    """Line vertices that matter at ``eps_m`` (Ramer, Douglas and Peucker).

    A chord with at most ``in_task`` vertices is finished in one task. Longer ones are
    split all at once by rounds of an aggregate, which finds the vertex furthest from
    each chord (the first of equal ones), and a join that deals the others to the new chords.
    """
    line = shape_pts.select("shape_id", F.col("seq").cast("long").alias("seq"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    ends = line.groupBy("shape_id").agg(F.min(F.struct("seq", "lat", "lon")).alias("a"), F.max(F.struct("seq", "lat", "lon")).alias("b"))
    scale = F.cos(F.radians(F.col("a")["lat"])) * M_PER_DEG
    flat = lambda p: F.struct(p["seq"].alias("seq"), (p["lon"] * scale).alias("x"), (p["lat"] * M_PER_DEG_LAT_APP).alias("y"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    inner = line.join(ends, "shape_id").where((F.col("seq") > F.col("a")["seq"]) & (F.col("seq") < F.col("b")["seq"]))
    todo = inner.select("shape_id", flat(F.struct("seq", "lat", "lon")).alias("p"), flat(F.col("a")).alias("a"), flat(F.col("b")).alias("b"))
    kept = ends.select("shape_id", F.inline(F.array("a", "b")))
    chord = ["shape_id", F.col("a.seq").alias("begin"), F.col("b.seq").alias("end")]
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    px, py = F.col("p.x") - F.col("a.x"), F.col("p.y") - F.col("a.y")
    size = dx * dx + dy * dy
    share = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / size))).otherwise(0.0)
    off = F.hypot(px - share * dx, py - share * dy)
    while not todo.groupBy(*chord).count().where(F.col("count") > in_task).isEmpty():
        furthest = F.max_by(F.struct("p", off.alias("off")), F.struct(off, -F.col("p.seq"))).alias("m")
        split = stage(todo.groupBy(*chord).agg(furthest).where(F.col("m.off") > eps_m).select("shape_id", "begin", "end", F.col("m.p").alias("m")), "splits")
        kept = kept.unionByName(split.select("shape_id", "m.seq", "m.lat", "m.lon"))
        dealt = todo.withColumn("begin", F.col("a.seq")).withColumn("end", F.col("b.seq")).join(split, ["shape_id", "begin", "end"])
        before = F.col("p.seq") < F.col("m.seq")
        todo = stage(dealt.where(F.col("p.seq") != F.col("m.seq")).select(
            "shape_id", "p", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b")
        ), "chords")

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        x, y = (np.concatenate([rows[f"a{c}"].iloc[:1], rows[c], rows[f"b{c}"].iloc[:1]]) for c in "xy")
        return rows.iloc[np.sort(_corners(x, y, eps_m)) - 1][["shape_id", "seq", "lat", "lon"]]

    open_ = todo.select(*chord, "p.*", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    rest = open_.groupBy("shape_id", "begin", "end").applyInPandas(finish, "shape_id string, seq bigint, lat double, lon double")
    return kept.unionByName(rest).distinct()


def pattern_lines(simplified: DataFrame) -> DataFrame:
    """Simplified lines with great-circle distances as arrays, rounded for publication."""
    run = cumulative_distance(simplified, ["shape_id"], "seq", method="haversine")
    box = F.struct(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("cum_m", 1).alias("cum_m"))
    lined = run.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", box.alias("p")))), lambda v: v["p"]).alias("line"))
    return lined.withColumn("pattern_id", text.pattern_of_shape(F.col("shape_id")))


def project_stops(stops: DataFrame, lines: DataFrame) -> DataFrame:
    """Stop distance on the simplified line, else the scheduled one; rounded to 0.1 m."""
    placed = project_on_pattern(stops, lines.select("pattern_id", "line"))
    return placed.withColumn("dist_m", F.round(F.coalesce("progress_m", "dist_m"), 1)).drop("progress_m", "offset_m")


def stop_bundles(
    trips: DataFrame, stop_times: DataFrame, stop_places: DataFrame, shape_pts: DataFrame, controls: DataFrame | None, city: str = "cta"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all bus stops, ordered stops per pattern, line per pattern) of a city."""
    rules = CITIES[city]
    all_stops = filter_bus_stops(stop_places, city).select("stop_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).dropDuplicates(["stop_id"])
    keyed = trips.withColumn("pattern_key", rules.pattern_key(F.col("route_id"), F.col("direction_id"), F.col("shape_id")))
    chosen = stage(representative_trip(keyed), "representative")
    lines = stage(pattern_lines(simplify_shape(shape_pts.join(chosen.select("shape_id").distinct(), "shape_id", "left_semi"))), "lines")
    lines = chosen.join(lines.drop("pattern_id"), "shape_id").select(F.col("pattern_key").alias("pattern_id"), "shape_id", "line")
    places = stop_places.select("stop_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).dropDuplicates(["stop_id"])
    calls = chosen.join(stop_times, "trip_id").join(places, "stop_id", "left").select(
        F.col("pattern_key").alias("pattern_id"), "shape_id", F.col("stop_sequence").alias("stop_seq"), "stop_id",
        F.coalesce("name", "stop_id").alias("name"), "lat", "lon", (F.col("shape_dist_ft") / FT_PER_M).alias("dist_m"),
    )
    calls = stage(calls, "calls")
    listed = project_stops(calls, lines)
    if rules.near_side and controls is not None:
        scheduled = calls.where(F.col("dist_m").isNotNull())
        near = near_side_stops(scheduled.select("shape_id", "pattern_id", "stop_id", "dist_m"), controls).where("is_near_side").select("pattern_id", "stop_id").distinct()
        known = controls.select("shape_id").distinct().withColumn("__known", F.lit(True))
        listed = listed.join(near.withColumn("__near", F.lit(True)), ["pattern_id", "stop_id"], "left").join(known, "shape_id", "left").withColumn(
            "is_near_side", F.when(F.col("__known"), F.coalesce("__near", F.lit(False)))
        ).drop("__near", "__known")
    else:
        listed = listed.withColumn("is_near_side", F.lit(None).cast("boolean"))
    return all_stops, listed.drop("shape_id"), lines.drop("shape_id")


def list_shapes(trips: DataFrame, routes: DataFrame, route_type: int | None = None) -> DataFrame:
    """Distinct shape ids of trips on routes of a type, in order."""
    rows = trips.where(F.col("shape_id").isNotNull() & (F.col("shape_id") != ""))
    if route_type is not None:
        rows = rows.join(routes.where(F.col("route_type") == route_type).select("route_id"), "route_id", "left_semi")
    return rows.select("shape_id").distinct().orderBy("shape_id")


def route_shape_map(trips: DataFrame) -> DataFrame:
    """Bus shapes of each route."""
    fits = F.col("shape_id").startswith("678") & (F.length("shape_id") == 8)
    return trips.where(fits).select("route_id", "shape_id").distinct()
