"""Signal-to-signal segments, stops and facilities of every shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import DWELL_AHEAD_M, DWELL_BACK_M, NEAR_SIDE_M
from kerbline.functions import geo, text
from kerbline.operators.intervals import point_join
from kerbline.operators.ordered import asof, following, interpolate, scan

ROUTE_SLICE_M = 20000.0
NEAR_BIN_M = 500.0


def route_slice(column: str = "dist_m") -> Column:
    return F.floor(F.col(column) / ROUTE_SLICE_M)


def near_side_stops(stops: DataFrame, controls: DataFrame, *, near_side_m: float = NEAR_SIDE_M) -> DataFrame:
    """Stops with is_near_side and the next signal downstream within reach.

    stops: shape_id, stop_id, name, dist_m. controls: control points.
    """
    signals = controls.where(text.is_signal(F.col("control_type"))).select("shape_id", "dist_m", "node_id")
    near = asof(
        stops, signals, ["shape_id"], "dist_m", route_slice(), ["node_id"], how="forward", tie=["node_id"]
    )
    gap = F.col("next_dist_m") - F.col("dist_m")
    hit = F.coalesce(gap <= near_side_m, F.lit(False))
    return near.select(
        *stops.columns, hit.alias("is_near_side"), F.when(hit, F.col("next_node_id")).alias("signal_node_id"),
        F.when(hit, gap).alias("signal_gap_m"),
    )


def segments(controls: DataFrame) -> DataFrame:
    """Stretches between consecutive signals: seg_id, seg_no, x_start, x_end, nodes."""
    signals = controls.where(text.is_signal(F.col("control_type")))
    nxt = F.struct("node_id", "dist_m", "control_type")
    paired = scan(
        signals.select("shape_id", "dist_m", "node_id", "control_type"),
        ["shape_id"], ["dist_m", "node_id"], route_slice(), __q=following(nxt),
    ).where(F.col("__q").isNotNull())
    return paired.select(
        "shape_id",
        text.segment_id(F.col("node_id"), F.col("__q")["node_id"]).alias("seg_id"),
        F.col("dist_m").alias("x_start"), F.col("__q")["dist_m"].alias("x_end"),
        F.col("node_id").alias("up_node"), F.col("__q")["node_id"].alias("down_node"),
        F.col("__q")["control_type"].alias("down_type"),
    )


def _inside(points: DataFrame, segs: DataFrame, closed_end: bool) -> DataFrame:
    spans = segs.select("shape_id", "seg_id", "x_start", "x_end")
    below = F.col("dist_m") <= F.col("x_end") if closed_end else F.col("dist_m") < F.col("x_end")
    keep = (F.col("dist_m") > F.col("x_start")) & below
    return point_join(points, spans, ["shape_id"], "dist_m", ("x_start", "x_end"), 1000.0, keep)


def segment_stops(stops: DataFrame, segs: DataFrame) -> DataFrame:
    """Stops in (x_start, x_end] of their segment."""
    return _inside(stops, segs, True)


def segment_controls(controls: DataFrame, segs: DataFrame) -> DataFrame:
    """Control points strictly inside their segment."""
    return _inside(controls, segs, False)


def dwell_zones(
    seg_stops: DataFrame, seg_controls: DataFrame, *, back_m: float = DWELL_BACK_M, ahead_m: float = DWELL_AHEAD_M
) -> DataFrame:
    """Reach of each stop, cut at the segment and at intersections around the stop."""
    near = seg_controls.select("shape_id", "seg_id", F.col("dist_m").alias("xi"))
    lhs = seg_stops.withColumn("__bin", F.floor(F.col("dist_m") / NEAR_BIN_M))
    reach = max(back_m, ahead_m)
    rhs = near.withColumn("__bin", F.explode(F.sequence(
        F.floor((F.col("xi") - reach) / NEAR_BIN_M), F.floor((F.col("xi") + reach) / NEAR_BIN_M)
    )))
    x, xi = F.col("dist_m"), F.col("xi")
    both = lhs.join(rhs, ["shape_id", "seg_id", "__bin"], "left")
    back = F.max(F.when((xi >= x - back_m) & (xi < x), xi))
    front = F.min(F.when((xi > x) & (xi <= x + ahead_m), xi))
    return (
        both.groupBy(*seg_stops.columns)
        .agg(back.alias("__back"), front.alias("__front"))
        .withColumn("zone_lo", F.greatest(x - back_m, F.col("x_start"), F.col("__back")))
        .withColumn("zone_hi", F.least(x + ahead_m, F.col("x_end"), F.col("__front")))
        .drop("__back", "__front")
    )


def facility_index(segs: DataFrame, seg_stops: DataFrame, seg_controls: DataFrame, controls: DataFrame) -> DataFrame:
    """One row per facility an event can be attributed to."""
    stops = seg_stops.select(
        "shape_id", F.col("stop_id").alias("facility_id"),
        F.concat("name", F.lit(" ("), "stop_id", F.lit(")")).alias("label"),
        F.when(F.col("is_near_side"), "stop_near_side").otherwise("stop").alias("kind"), "dist_m",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    down = segs.select("shape_id", F.col("down_node").alias("node_id")).distinct()
    signals = controls.join(down, ["shape_id", "node_id"]).select(
        "shape_id", text.signal_id(F.col("node_id")).alias("facility_id"),
        text.facility_label(F.col("control_type"), F.col("cross_street_names")).alias("label"),
        F.lit("signal").alias("kind"), "dist_m", "lat", "lon",
    )
    crossings = seg_controls.where(~text.is_signal(F.col("control_type"))).select(
        "shape_id", text.crossing_id(F.col("node_id")).alias("facility_id"),
        text.facility_label(F.col("control_type"), F.col("cross_street_names")).alias("label"),
        F.lit("crossing").alias("kind"), "dist_m", "lat", "lon",
    )
    return stops.unionByName(signals).unionByName(crossings).dropDuplicates(["shape_id", "facility_id"])


def vertices_with_distance(segments_of_shapes: DataFrame) -> DataFrame:
    """Shape vertices on the route ruler: shape_id, dist_m, lat, lon."""
    starts = segments_of_shapes.select("shape_id", F.col("s0").alias("dist_m"), F.col("lat_a").alias("lat"), F.col("lon_a").alias("lon"))
    last = segments_of_shapes.groupBy("shape_id").agg(
        F.max_by(F.struct((F.col("s0") + F.col("ds")).alias("dist_m"), F.col("lat_b").alias("lat"), F.col("lon_b").alias("lon")), "seg_idx").alias("e")
    ).select("shape_id", "e.dist_m", "e.lat", "e.lon")
    return starts.unionByName(last)


def positions_on_shape(points: DataFrame, shape_segments: DataFrame) -> DataFrame:
    """lat and lon of route distances, by linear interpolation between vertices."""
    corners = vertices_with_distance(shape_segments)
    return interpolate(points, corners, ["shape_id"], "dist_m", ["lat", "lon"], route_slice(), tie=["lat", "lon"])


def heading_at(points: DataFrame, shape_segments: DataFrame) -> DataFrame:
    """Compass direction of the shape at route distances: heading_deg."""
    ends = ("lat_a", "lon_a", "lat_b", "lon_b")
    starts = shape_segments.select("shape_id", F.col("s0").alias("dist_m"), "seg_idx", *ends)
    near = asof(points, starts, ["shape_id"], "dist_m", route_slice(), list(ends), how="both", tie=["seg_idx"])
    a, b, c, d = (F.coalesce(f"prev_{e}", f"next_{e}") for e in ends)
    return near.select(*points.columns, geo.planar_bearing_deg(a, b, c, d).alias("heading_deg"))


def route_features(controls: DataFrame, stops: DataFrame, shape_segments: DataFrame) -> DataFrame:
    """Controls and stops with ids that delay attributions use, labels and places."""
    ctl = controls.select(
        "shape_id",
        text.control_facility_id(F.col("control_type"), F.col("node_id")).alias("facility_id"),
        F.col("control_type").alias("kind"),
        text.feature_label(F.col("control_type"), F.col("cross_street_names")).alias("label"),
        "dist_m", "lat", "lon",
    )
    placed = positions_on_shape(stops.select("shape_id", "stop_id", "name", "dist_m"), shape_segments)
    halts = placed.select(
        "shape_id", F.col("stop_id").alias("facility_id"), F.lit("bus_stop").alias("kind"),
        F.col("name").alias("label"), "dist_m", "lat", "lon",
    )
    return ctl.unionByName(halts)


def control_type_counts(controls: DataFrame) -> DataFrame:
    """Counts per shape and type with a total row per shape and overall."""
    return controls.rollup("shape_id", "control_type").agg(F.count(F.lit(1)).alias("n"))


def near_side_listing(near: DataFrame) -> DataFrame:
    """Near-side stops by mile with their signal."""
    return near.where("is_near_side").select(
        "shape_id", "stop_id", "name", (F.col("dist_m") / 1609.344).alias("mile"),
        text.signal_id(F.col("signal_node_id")).alias("signal_id"), "signal_gap_m",
    )


def in_distance_window(rows: DataFrame, lo: float, hi: float, column: str = "dist_m", margin: float = 0.0) -> DataFrame:
    return rows.where(F.col(column).between(lo - margin, hi + margin))


def spans_in_window(rows: DataFrame, lo: float, hi: float, start: str = "x_start", end: str = "x_end", margin: float = 0.0) -> DataFrame:
    """Rows whose span touches the window."""
    return rows.where((F.col(end) >= lo - margin) & (F.col(start) <= hi + margin))
