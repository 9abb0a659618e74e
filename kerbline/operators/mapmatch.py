"""Snapping points to route shapes and choosing a shape for a trip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import M_PER_DEG, MAX_PERP_M
from kerbline.functions import geo
from kerbline.operators.intervals import salted_left_join
from kerbline.operators.ordered import cum_max, cum_sum, following, previous, scan, whole
from kerbline.operators.quantiles import quantiles

CELL_LAT = 0.002
CELL_LON = 0.003
VERTICES_PER_SLICE = 512


def _vertex_slice(order: str = "seq") -> Column:
    return F.floor(F.col(order) / VERTICES_PER_SLICE)


def cumulative_distance(
    points: DataFrame, by: Sequence[str], order: str, *, method: str = "midlat",
    slices: Column | None = None,
) -> DataFrame:
    """Running length of a polyline in metres as ``cum_m``.

    ``midlat`` uses each step's middle latitude, ``haversine`` the great circle,
    ``centroid`` one projection around the mean vertex.
    """
    cut = _vertex_slice(order) if slices is None else slices
    seen = scan(
        points, by, [order], cut,
        __p=previous(F.struct("lat", "lon")), __lat=whole("sum", F.col("lat")),
        __n=whole("sum", F.lit(1)),
    )
    lat0, lon0 = F.col("__p")["lat"], F.col("__p")["lon"]
    if method == "haversine":
        step = geo.haversine_m(lat0, lon0, F.col("lat"), F.col("lon"))
    elif method == "centroid":
        mean = F.col("__lat") / F.col("__n")
        dx = geo.local_x(F.col("lon"), mean, lon0)
        dy = geo.local_y(F.col("lat"), lat0)
        step = F.sqrt(dx * dx + dy * dy)
    else:
        step = geo.equirect_m(lat0, lon0, F.col("lat"), F.col("lon"))
    stepped = seen.withColumn("__step", F.coalesce(step, F.lit(0.0))).drop("__p", "__lat", "__n")
    return scan(stepped, by, [order], cut, cum_m=cum_sum(F.col("__step"))).drop("__step")


def shape_segments(shape_pts: DataFrame) -> DataFrame:
    """One row per polyline step with its local frame and route distances.

    Input: shape_id, seq, lat, lon, dist_m, where dist_m is null for a whole
    shape or for none of it. Distances fall back to the projected length.
    """
    by = ["shape_id"]
    pts = shape_pts.select("shape_id", "seq", "lat", "lon", "dist_m")
    steps = scan(
        pts, by, ["seq"], _vertex_slice(),
        seg_idx=cum_sum(F.lit(1).cast("long"), strict=True),
        __q=following(F.struct("lat", "lon", "dist_m")),
        __lat=whole("sum", F.col("lat")), __lon=whole("sum", F.col("lon")),
        __n=whole("sum", F.lit(1)),
    ).where(F.col("__q").isNotNull())
    lat0, lon0 = F.col("__lat") / F.col("__n"), F.col("__lon") / F.col("__n")
    q = F.col("__q")
    local = steps.select(
        "shape_id", "seq", "seg_idx", "dist_m", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"),
        q["lat"].alias("lat_b"), q["lon"].alias("lon_b"), q["dist_m"].alias("dist_b"),
        lat0.alias("lat0"), lon0.alias("lon0"),
        geo.local_x(F.col("lon"), lat0, lon0).alias("ax"), geo.local_y(F.col("lat"), lat0).alias("ay"),
        geo.local_x(q["lon"], lat0, lon0).alias("bx"), geo.local_y(q["lat"], lat0).alias("by"),
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    sized = local.withColumn("__len", F.sqrt(dx * dx + dy * dy))
    run = scan(
        sized, by, ["seq"], _vertex_slice(), __cum=cum_sum(F.col("__len"), strict=True),
        __total=whole("sum", F.col("__len")), __last=whole("max", F.col("dist_b")),
    )
    return run.select(
        "shape_id", "seg_idx", "lat_a", "lon_a", "lat_b", "lon_b", "lat0", "lon0",
        "ax", "ay", "bx", "by",
        F.coalesce("dist_m", "__cum").alias("s0"),
        F.coalesce(F.col("dist_b") - F.col("dist_m"), F.col("__len")).alias("ds"),
        F.coalesce("__last", "__total").alias("shape_len_m"),
    )


_CAND = ("seg_idx", "ax", "ay", "bx", "by", "s0", "ds", "lat0", "lon0")


def _nearest(candidates: Column) -> Column:
    """Closest candidate as struct(d2, seg_idx, frac, dist_m); ties take the first segment."""

    def place(c: Column) -> Column:
        return F.struct(
            c["seg_idx"].alias("seg_idx"), c["s0"].alias("s0"), c["ds"].alias("ds"),
            (geo.local_x(F.col("lon"), c["lat0"], c["lon0"]) - c["ax"]).alias("px"),
            (geo.local_y(F.col("lat"), c["lat0"]) - c["ay"]).alias("py"),
            (c["bx"] - c["ax"]).alias("dx"), (c["by"] - c["ay"]).alias("dy"),
        )

    def share(c: Column) -> Column:
        zero = F.lit(0.0)
        return F.struct(
            *[c[n].alias(n) for n in ("seg_idx", "s0", "ds", "px", "py", "dx", "dy")],
            geo.clamp_share(c["px"], c["py"], zero, zero, c["dx"], c["dy"]).alias("t"),
        )

    def measure(c: Column) -> Column:
        ex, ey = c["px"] - c["t"] * c["dx"], c["py"] - c["t"] * c["dy"]
        return F.struct(
            (ex * ex + ey * ey).alias("d2"), c["seg_idx"].alias("seg_idx"), c["t"].alias("frac"),
            (c["s0"] + c["t"] * c["ds"]).alias("dist_m"),
        )

    return F.array_min(F.transform(F.transform(F.transform(candidates, place), share), measure))


def _cells(segments: DataFrame) -> DataFrame:
    """Segments of each shape around every map cell they reach, one cell wide."""
    lat_cells = F.sequence(
        F.floor(F.least("lat_a", "lat_b") / CELL_LAT) - 1, F.floor(F.greatest("lat_a", "lat_b") / CELL_LAT) + 1
    )
    lon_cells = F.sequence(
        F.floor(F.least("lon_a", "lon_b") / CELL_LON) - 1, F.floor(F.greatest("lon_a", "lon_b") / CELL_LON) + 1
    )
    return (
        segments.select("shape_id", F.struct(*_CAND).alias("__c"), F.explode(lat_cells).alias("__cy"), lon_cells.alias("__lc"))
        .withColumn("__cx", F.explode("__lc"))
        .groupBy("shape_id", "__cy", "__cx")
        .agg(F.collect_list("__c").alias("__near"))
    )


def snap_to_shape(
    points: DataFrame, segments: DataFrame, *, max_perp_m: float = MAX_PERP_M
) -> DataFrame:
    """Nearest shape segment of every point: seg_idx, frac, dist_m, perp_m, on_route.

    Points join the segments around their map cell, then the few that have
    nothing within a cell width are compared with the whole shape, so the result
    equals the full comparison. Points of an unknown shape keep nulls.
    """
    cand = F.struct(*_CAND)
    cells = _cells(segments)
    spread = F.struct("lat", "lon", *[c for c in points.columns if c.endswith("_id")][:3])
    placed = points.withColumn("__cy", F.floor(F.col("lat") / CELL_LAT)).withColumn(
        "__cx", F.floor(F.col("lon") / CELL_LON)
    )
    near = salted_left_join(placed, cells, ["shape_id", "__cy", "__cx"], spread)
    near = near.withColumn("__m", _nearest(F.col("__near")))
    reach = F.least(
        F.lit(CELL_LAT * M_PER_DEG * 0.999),
        CELL_LON * M_PER_DEG * 0.999 * F.cos(F.radians(F.abs(F.col("lat")) + CELL_LAT)),
    )
    sure = F.coalesce(F.col("__m")["d2"] <= reach * reach, F.lit(False))
    near = near.withColumn(
        "__far",
        F.when(~sure, F.col("shape_id")).otherwise(
            F.concat(F.lit("#"), F.xxhash64(spread).cast("string"))
        ),
    ).drop("__near", "__cy", "__cx")
    full = segments.groupBy(F.col("shape_id").alias("__far")).agg(F.collect_list(cand).alias("__all"))
    best = salted_left_join(near, full, ["__far"], spread).withColumn(
        "__m", F.coalesce(_nearest(F.col("__all")), F.col("__m"))
    )
    perp = F.sqrt(F.col("__m")["d2"])
    return best.select(
        *points.columns,
        F.col("__m")["seg_idx"].alias("seg_idx"), F.col("__m")["frac"].alias("frac"),
        F.col("__m")["dist_m"].alias("dist_m"), perp.alias("perp_m"),
        F.coalesce(perp <= max_perp_m, F.lit(False)).alias("on_route"),
    )


def shape_extent(shape_pts: DataFrame) -> DataFrame:
    """Bounds, length, bearing and camera rotation per shape."""
    ends = shape_pts.groupBy("shape_id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.min_by(F.struct("lat", "lon"), "seq").alias("a"),
        F.max_by(F.struct("lat", "lon"), "seq").alias("b"),
        F.count(F.lit(1)).alias("n_vertices"),
    )
    bearing = geo.planar_bearing_deg(F.col("a")["lat"], F.col("a")["lon"], F.col("b")["lat"], F.col("b")["lon"])
    length = shape_segments(shape_pts).groupBy("shape_id").agg(F.max("shape_len_m").alias("length_m"))
    return ends.join(length, "shape_id", "left").select(
        "shape_id", "n_vertices", "min_lat", "max_lat", "min_lon", "max_lon", "length_m",
        bearing.alias("bearing_deg"), geo.camera_bearing(bearing).alias("camera_deg"),
    )


def _on_shapes(points: DataFrame, candidates: DataFrame, segments: DataFrame, keys, max_perp_m: float) -> tuple[DataFrame, DataFrame]:
    """(pings near a candidate shape of their route with dist_m and perp_m, pings per trip and candidate).

    A ping meets only the shapes that pass its own map cell. ``max_perp_m`` lies
    within a cell's width, so a ping on a shape is never missed.
    """
    by_route = _cells(segments).join(candidates.select("route_id", "shape_id").distinct(), "shape_id")
    placed = points.withColumn("__cy", F.floor(F.col("lat") / CELL_LAT)).withColumn("__cx", F.floor(F.col("lon") / CELL_LON))
    spread = F.struct("lat", "lon", *[c for c in points.columns if c.endswith("_id")][:3])
    near = salted_left_join(placed, by_route, ["route_id", "__cy", "__cx"], spread).where(F.col("shape_id").isNotNull())
    perp = F.sqrt(F.col("__m")["d2"])
    found = near.withColumn("__m", _nearest(F.col("__near"))).where(perp <= max_perp_m)
    rows = found.select(*points.columns, "shape_id", F.col("__m")["dist_m"].alias("dist_m"), perp.alias("perp_m"))
    counted = points.groupBy(*keys, "route_id").agg(F.count(F.lit(1)).alias("__n"))
    extra = [c for c in candidates.columns if c not in ("route_id", "shape_id")]
    totals = counted.join(candidates, "route_id").groupBy(*keys, "shape_id", *extra).agg(F.sum("__n").alias("n_pings"))
    return rows, totals


def distinct_geometries(candidates: DataFrame, segments: DataFrame, first: str) -> DataFrame:
    """Of the candidates of a route that run along the same line the one with the smallest ``first``.

    Schedules give one line many shape ids; what is measured on one holds for all.
    """
    line = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("seg_idx", *[c for c in _CAND if c != "seg_idx"])))), 256)
    lines = segments.groupBy("shape_id").agg(line.alias("__line"))
    known = candidates.join(lines, "shape_id", "left").withColumn("__line", F.coalesce("__line", "shape_id"))
    best = known.groupBy("route_id", "__line").agg(F.min_by(F.struct(*candidates.columns), F.struct(first, "shape_id")).alias("__c"))
    return best.select("__c.*")


def choose_shape(
    pings: DataFrame, route_shapes: DataFrame, segments: DataFrame, keys: Sequence[str], order: str,
    *, max_perp_m: float = MAX_PERP_M, hint: str | None = None, tie: str | None = None,
) -> DataFrame:
    """Shape of the route each trip follows forward in time.

    ``pings`` must not hold shape_id; ``tie`` orders pings of one time. Candidates rank by
    (forward with more than 60 % on route, net progress or on-route share, to 1e-6); the
    smallest id wins a tie. Trips without a candidate of two on-route pings get ``hint``'s
    column value.
    """
    keys = list(keys)
    lines = distinct_geometries(route_shapes.select("route_id", "shape_id").distinct(), segments, "shape_id")
    rows, totals = _on_shapes(pings, lines, segments, keys, max_perp_m)
    at = F.struct(order, tie) if tie else F.col(order)
    on = rows.groupBy(*keys, "shape_id").agg(
        F.count(F.lit(1)).alias("n_on"), (F.max_by("dist_m", at) - F.min_by("dist_m", at)).alias("net_m")
    ).where(F.col("n_on") >= 2)
    per = on.join(totals, [*keys, "shape_id"]).withColumn("frac", F.col("n_on") / F.col("n_pings"))
    good = F.col("frac") > 0.6
    forward = F.when(good & (F.col("net_m") > 0), 1.0).otherwise(0.0)
    key = F.struct(
        (-forward).alias("a"), (-F.round(F.when(good, F.col("net_m")).otherwise(F.col("frac")), 6)).alias("b"),
        F.col("shape_id").alias("c"),
    )
    best = per.groupBy(*keys).agg(F.min_by(F.struct("shape_id", "frac", "net_m"), key).alias("m"))
    best = best.select(*keys, "m.shape_id", "m.frac", "m.net_m")
    if hint is None:
        return best
    hinted = pings.groupBy(*keys).agg(F.min(hint).alias("__hint"))
    return hinted.join(best, keys, "left").select(
        *keys, F.coalesce("shape_id", "__hint").alias("shape_id"), "frac", "net_m"
    )


def best_shape(
    pings: DataFrame, candidates: DataFrame, segments: DataFrame, keys: Sequence[str], order: str,
    *, max_perp_m: float = MAX_PERP_M,
) -> DataFrame:
    """Candidate with more than half its pings on route and the lowest median offset.

    ``candidates`` (route_id, shape_id, rank): the first one stands in when none
    qualifies and competes with its own offset otherwise.
    """
    keys = list(keys)
    rows, totals = _on_shapes(pings, distinct_geometries(candidates, segments, "rank"), segments, keys, max_perp_m)
    by = [*keys, "shape_id"]
    on = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_on"))
    median = quantiles(rows, by, F.col("perp_m"), {"median_perp_m": 0.5})
    both = totals.join(on, by, "left").join(median, by, "left").withColumn("coverage", F.coalesce("n_on", F.lit(0)) / F.col("n_pings"))
    allowed = (F.col("rank") == 0) | (F.col("coverage") > 0.5)
    score = F.coalesce(F.col("median_perp_m"), F.lit(float("inf")))
    return (
        both.where(allowed)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("shape_id", "median_perp_m", "coverage"), F.struct(F.round(score, 6), F.col("rank"))).alias("m"))
        .select(*keys, "m.shape_id", "m.median_perp_m", "m.coverage")
    )


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], slices: Column, column: str) -> DataFrame:
    """Forward fill of decreases: column ``{column}_max``."""
    return scan(df, by, order, slices, **{f"{column}_max": cum_max(F.col(column))})
