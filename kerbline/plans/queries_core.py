"""Map matching, smoothing, segments, delay and corridor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import aggregate, delay, mapmatch, quintic, segments, smooth, stops
from kerbline.operators.ordered import asof, interpolate, time_slice
from kerbline.operators.stage import stage
from kerbline.plans import derived
from kerbline.plans.oracle import _H, events_from, grid, locreg, pieces, relation, snap
from kerbline.plans.registry import query
from kerbline.plans.workspace import TRIP

# Map matching and geometry ------------------------------------------------------


@query("snap_to_shape", "event_id trip_id place:6 dist_m:3 perp_m:3 on_route", "SELECT *, seg_idx + frac AS place FROM matched")
def _(w):
    return w.matched.withColumn("place", F.col("seg_idx") + F.col("frac"))


@query("cumulative_distance", "shape_id seq midlat_m:3 haversine_m:3 centroid_m:3", """
SELECT shape_id, seq, sum(a) OVER w AS midlat_m, sum(b) OVER w AS haversine_m, sum(c) OVER w AS centroid_m FROM (
 SELECT shape_id, seq,
  coalesce(6371000.0*sqrt(pow(radians(lat-pl),2) + pow(radians(lon-po)*cos(radians(lat+pl)/2),2)), 0.0) AS a,
  coalesce(2*6371000.0*asin(sqrt(pow(sin(radians(lat-pl)/2),2) + cos(radians(pl))*cos(radians(lat))*pow(sin(radians(lon-po)/2),2))), 0.0) AS b,
  coalesce(sqrt(pow((lat-pl)*111320.0,2) + pow((lon-po)*111320.0*cos(radians(mlat)),2)), 0.0) AS c
 FROM (SELECT *, lag(lat) OVER v AS pl, lag(lon) OVER v AS po, avg(lat) OVER (PARTITION BY shape_id) AS mlat FROM shape_pts
       WINDOW v AS (PARTITION BY shape_id ORDER BY seq))) WINDOW w AS (PARTITION BY shape_id ORDER BY seq)""")
def _(w):
    out = w.shape_pts
    for method in ("midlat", "haversine", "centroid"):
        out = mapmatch.cumulative_distance(out, ["shape_id"], "seq", method=method).withColumnRenamed("cum_m", f"{method}_m")
    return out


@query("shape_segments", "shape_id seg_idx ax:3 ay:3 bx:3 by:3 s0:3 ds:3 shape_len_m:3", "SELECT * FROM shapes")
def _(w):
    return w.shapes


@query("shape_extent", "shape_id n_vertices min_lat:6 max_lat:6 min_lon:6 max_lon:6 length_m:3 bearing_deg:4 camera_deg:4", """
SELECT *, CASE WHEN bearing_deg >= 90 THEN bearing_deg - 90 ELSE bearing_deg + 270 END AS camera_deg FROM (
 SELECT p.*, s.length_m, fmod(degrees(atan2((blon-alon)*cos(radians((alat+blat)/2)), blat-alat)) + 360, 360) AS bearing_deg
 FROM (SELECT shape_id, count(*) AS n_vertices, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
   arg_min(lat, seq) AS alat, arg_min(lon, seq) AS alon, arg_max(lat, seq) AS blat, arg_max(lon, seq) AS blon FROM shape_pts GROUP BY 1) p
 JOIN (SELECT shape_id, max(shape_len_m) AS length_m FROM shapes GROUP BY 1) s USING (shape_id))""")
def _(w):
    return mapmatch.shape_extent(w.shape_pts)


relation("route_shapes", f"SELECT DISTINCT CAST(22 + (o_custkey // 50) % 5 AS VARCHAR) AS route_id, '678' || lpad(CAST(o_custkey // 50 AS VARCHAR), 5, '0') AS shape_id FROM orders")
relation("cand_pings", "SELECT p.trip_id, p.route_id, p.event_id, p.ts, p.lat, p.lon, r.shape_id, p.event_id || '/' || r.shape_id AS ck FROM pings p JOIN route_shapes r USING (route_id)")
relation("cand_fit", snap("cand_pings", "trip_id, event_id, ts, p_shape, ck", "ck").replace("p.shape_id = s.shape_id", "p.shape_id = s.shape_id").replace("SELECT p.*,", "SELECT p.*, p.shape_id AS p_shape,"))


def _route_shapes(w):
    return stops.route_shape_map(derived.gtfs_trips(w.spark, w.sf_dir))


@query("choose_shape", "trip_id shape_id frac:4 net_m:2", """
SELECT trip_id, shape_id, frac, net_m FROM (
 SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY CASE WHEN frac > 0.6 AND net_m > 0 THEN 0 ELSE 1 END,
   round(CASE WHEN frac > 0.6 THEN -net_m ELSE -frac END, 6), shape_id) AS rn FROM (
  SELECT trip_id, p_shape AS shape_id, avg(CAST(on_route AS DOUBLE)) AS frac, sum(CAST(on_route AS INT)) AS n_on,
    arg_max(dist_m, (ts, event_id)) FILTER (on_route) - arg_min(dist_m, (ts, event_id)) FILTER (on_route) AS net_m FROM cand_fit GROUP BY 1, 2)
 WHERE n_on >= 2) WHERE rn = 1""")
def _(w):
    return mapmatch.choose_shape(w.pings.drop("shape_id"), _route_shapes(w), w.shapes, TRIP, "ts", tie="event_id")


@query("best_shape", "trip_id shape_id median_perp_m:3 coverage:4", """
SELECT trip_id, shape_id, median_perp_m, coverage FROM (
 SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY round(coalesce(median_perp_m, 1e9), 6), rank) AS rn FROM (
  SELECT f.trip_id, p_shape AS shape_id, r.rank, avg(CAST(on_route AS DOUBLE)) AS coverage, quantile_cont(perp_m, 0.5) FILTER (on_route) AS median_perp_m
  FROM cand_fit f JOIN (SELECT shape_id, row_number() OVER (PARTITION BY route_id ORDER BY shape_id) - 1 AS rank FROM route_shapes) r ON r.shape_id = f.p_shape
  GROUP BY 1, 2, 3) WHERE rank = 0 OR coverage > 0.5) WHERE rn = 1""")
def _(w):
    from kerbline.operators.ordered import number_rows

    ranked = number_rows(_route_shapes(w), ["route_id"], ["shape_id"], F.floor(F.substring("shape_id", 4, 5).cast("int") / 1000), "rank")
    return mapmatch.best_shape(w.pings.drop("shape_id"), ranked, w.shapes, TRIP, "ts")


# Smoothing ----------------------------------------------------------------------


@query("locreg", "trip_id i t:3 d:3 x_smooth:3", "SELECT * FROM smoothed")
def _(w):
    return smooth.locreg(w.trace, TRIP)


relation("smoothed5", locreg("trace", "trip_id", "5"))
relation("pieces5", pieces("smoothed5", "trip_id"))


@query("locreg_bandwidth_5", "trip_id i t:3 x_smooth:3", "SELECT * FROM smoothed5")
def _(w):
    return smooth.locreg(w.trace, TRIP, bandwidth=5)


@query("running_max", "trip_id i d:3 d_max:3", "SELECT *, max(d) OVER (PARTITION BY trip_id ORDER BY i) AS d_max FROM trace")
def _(w):
    return mapmatch.running_max(w.trace, TRIP, ["i"], F.floor(F.col("i") / smooth.INDEX_SLICE), "d")


@query("monotone_knots", "trip_id t:3 x:3", "SELECT trip_id, t, avg(m) AS x FROM (SELECT *, max(x_smooth) OVER (PARTITION BY trip_id ORDER BY i) AS m FROM smoothed) GROUP BY 1, 2")
def _(w):
    return smooth.monotone_knots(smooth.monotone_pings(smooth.locreg(w.trace, TRIP), TRIP), TRIP)


@query("pchip_slopes", "trip_id k t:3 x:3 m:5", "SELECT * FROM pieces")
def _(w):
    return w.pieces


@query("smooth_pchip_archive", "trip_id k t:3 x:3 m:5", "SELECT * FROM pieces5")
def _(w):
    return w.archive_pieces


@query("reconstruct_rejects", "trip_id n_pings n_on_route reason", """
SELECT trip_id, n_pings, n AS n_on_route, CASE WHEN n < 2 THEN 'fewer than 2 on-route pings' ELSE 'one distinct time' END AS reason
FROM (SELECT trip_id, max(n_pings) AS n_pings, CAST(max(n) AS BIGINT) AS n, count(DISTINCT CASE WHEN on_route THEN t END) AS nt FROM early_clock GROUP BY 1) WHERE n < 2 OR nt < 2""")
def _(w):
    early = w.matched.withColumn("on_route", F.col("on_route") & (F.col("perp_m") > 2.4))
    return smooth.rejects(smooth.trip_clock(early, TRIP), TRIP)


relation("early_clock", "SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY trip_id))) // 1000 / 1000.0 AS t, count(*) OVER (PARTITION BY trip_id) AS n_pings, sum(CAST(on_route AS BIGINT)) OVER (PARTITION BY trip_id) AS n FROM (SELECT * REPLACE (on_route AND perp_m > 2.4 AS on_route) FROM matched)")


@query("sample_trajectory", "trip_id i t:3 x:2 v_mph:3", "SELECT * FROM samples")
def _(w):
    return w.samples


_FIN = "t_next IS NULL"


@query("sample_whole_seconds", "trip_id n s:1", f"""
SELECT trip_id, count(*) AS n, sum(x) AS s FROM ({grid('pieces', 'trip_id', 'ceil(t)', f'CASE WHEN {_FIN} THEN floor(t) ELSE ceil(t_next)-1 END', 'CAST(i AS DOUBLE)')}) GROUP BY 1""")
def _(w):
    grid_rows = smooth.sample_trajectory(w.pieces, TRIP, rule="whole")
    return grid_rows.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))


@query("sample_linspace", "trip_id i t:3 x:2", grid(
    "pieces", "trip_id", f"CASE WHEN {_FIN} THEN 99 ELSE ceil((t-t_first)/((t_last-t_first)/99.0)) END",
    f"CASE WHEN {_FIN} THEN 99 ELSE least(ceil((t_next-t_first)/((t_last-t_first)/99.0))-1, 98) END",
    "CASE WHEN i = 99 THEN t_last ELSE t_first + i*((t_last-t_first)/99.0) END"))
def _(w):
    return smooth.sample_trajectory(w.pieces, TRIP, n=100)


_ACC = f"(2*((3*((x_next-x)/{_H})-2*m-m_next)/{_H}))"


@query("at_pings", "trip_id i t:3 d_raw:3 x_smooth:3 v_mph:4", """
SELECT s.trip_id, s.i, s.t, s.d AS d_raw, p.x AS x_smooth, p.m*2.236936292054402 AS v_mph FROM smoothed s JOIN pieces p ON p.trip_id = s.trip_id AND p.t = s.t""")
def _(w):
    return smooth.at_pings(w.trace, w.pieces, TRIP)


@query("knot_acceleration", "trip_id k a:3", f"""
SELECT trip_id, k, CASE WHEN t_next IS NOT NULL THEN {_ACC}
  ELSE (2*((3*((x-px)/(t-pt))-2*pm-m)/(t-pt)) + 6*(t-pt)*((pm+m-2*((x-px)/(t-pt)))/((t-pt)*(t-pt)))) END AS a
FROM (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(m) OVER w AS pm FROM pieces WINDOW w AS (PARTITION BY trip_id ORDER BY t))""")
def _(w):
    return w.pieces


@query("last_time_at", "trip_id pos_m:3 t_at:3", "SELECT * FROM at_trip")
def _(w):
    ends = w.segs.select("shape_id", F.col("x_start").alias("pos_m")).union(w.segs.select("shape_id", F.col("x_end").alias("pos_m")))
    return smooth.last_time_at(w.pieces, ends, TRIP)


@query("run_summary", "trip_id n_pings n_on_route minutes:4 miles:4 mean_mph:4", """
SELECT p.*, n_pings, n_on_route FROM (SELECT trip_id, (max(t)-min(t))/60 AS minutes, (max(x)-min(x))/1609.344 AS miles,
  (max(x)-min(x))/(max(t)-min(t))*2.236936292054402 AS mean_mph FROM pieces GROUP BY 1) p
JOIN (SELECT trip_id, count(*) AS n_pings, CAST(sum(CAST(on_route AS INT)) AS BIGINT) AS n_on_route FROM matched GROUP BY 1) USING (trip_id)""")
def _(w):
    return smooth.run_summary(w.pieces, w.matched, TRIP)


@query("filter_max_duration", "trip_id k", "SELECT trip_id, k FROM pieces WHERE t_last - t_first <= 2750")
def _(w):
    return smooth.filter_max_duration(w.pieces, 2750.0)


@query("departure_align", "trip_id k depart_s:3 t_aligned:3", """
SELECT p.trip_id, p.k, d.depart_s, p.t - d.depart_s AS t_aligned FROM pieces p JOIN (
 SELECT trip_id, coalesce(max(t) FILTER (t < tm), min(t)) AS depart_s FROM (
  SELECT *, min(CASE WHEN x - x_first >= 0.03*1609.344 THEN t END) OVER (PARTITION BY trip_id) AS tm FROM pieces) GROUP BY 1) d USING (trip_id)""")
def _(w):
    return smooth.align_departure(w.pieces, smooth.departure_from_pings(w.pieces, TRIP), TRIP)


@query("departure_first_sample", "trip_id depart_s:3", """
SELECT trip_id, coalesce(min(t) FILTER (x - x0 >= 0.03*1609.344), min(t)) AS depart_s
FROM (SELECT *, min(x) OVER (PARTITION BY trip_id) AS x0 FROM even_trip) GROUP BY 1""")
def _(w):
    return smooth.departure_from_grid(w.pieces, TRIP)


relation("multi_trace", "SELECT t.trip_id, t.shape_id, t.i, t.n, t.t, t.d, b.bandwidth FROM trace t, (VALUES (5), (10), (20)) b(bandwidth)")
relation("multi_smooth", locreg("multi_trace", "trip_id, bandwidth", "bandwidth"))
relation("multi_pieces", pieces("multi_smooth", "trip_id, bandwidth"))


@query("compare_bandwidths", "trip_id bandwidth k t:3 x:3", "SELECT * FROM multi_pieces")
def _(w):
    return smooth.compare_bandwidths(w.trace, TRIP, [5, 10, 20])


# Elimination forward and substitution backward over the inner knots of a trip, one knot a step.
relation("bent_rows", """
SELECT trip_id, k, n_knots, hl, hr, 2*(hl + hr) AS diag, 6*(dr - dl) AS rhs FROM pieces WHERE n_knots > 2 AND k BETWEEN 1 AND n_knots - 2""")
relation("bent_down", """
WITH RECURSIVE f AS (SELECT trip_id, k, n_knots, hr, diag, rhs FROM bent_rows WHERE k = 1
 UNION ALL SELECT r.trip_id, r.k, r.n_knots, r.hr, r.diag - r.hl/f.diag*r.hl, r.rhs - r.hl/f.diag*f.rhs FROM f JOIN bent_rows r ON r.trip_id = f.trip_id AND r.k = f.k + 1)
SELECT * FROM f""")
relation("bent_up", """
WITH RECURSIVE b AS (SELECT trip_id, k, rhs/diag AS c FROM bent_down WHERE k = n_knots - 2
 UNION ALL SELECT d.trip_id, d.k, (d.rhs - d.hr*b.c)/d.diag FROM b JOIN bent_down d ON d.trip_id = b.trip_id AND d.k = b.k - 1)
SELECT * FROM b""")
relation("bent", """
SELECT p.*, coalesce(c, 0.0) AS c, lead(coalesce(c, 0.0)) OVER (PARTITION BY p.trip_id ORDER BY p.k) AS c_next FROM pieces p LEFT JOIN bent_up b ON b.trip_id = p.trip_id AND b.k = p.k""")
relation("bent_coef", """
SELECT *, (10*rest - 4*slope*h + (c_next-c)*h*h/2)/(h*h*h) AS a3, (-15*rest + 7*slope*h - (c_next-c)*h*h)/(h*h*h*h) AS a4, (6*rest - 3*slope*h + (c_next-c)*h*h/2)/(h*h*h*h*h) AS a5 FROM (
 SELECT *, x_next - x - m*h - c*h*h/2 AS rest, m_next - m - c*h AS slope FROM (SELECT *, t_next - t AS h FROM bent))""")
relation("bent_grid", """
SELECT trip_id, i, t_first + i*5.0 AS ts, coalesce(x + s*(m + s*(c/2 + s*(a3 + s*(a4 + s*a5)))), x) AS xs, coalesce(m + s*(c + s*(3*a3 + s*(4*a4 + s*5*a5))), m) AS v_mps, coalesce(c + s*(6*a3 + s*(12*a4 + s*20*a5)), c) AS a_mps2 FROM (
 SELECT *, t_first + i*5.0 - t AS s FROM (
  SELECT *, unnest(range(CAST(ceil((t-t_first)/5.0) AS BIGINT), CAST(CASE WHEN t_next IS NULL THEN floor((t-t_first)/5.0 + 1e-9) ELSE ceil((t_next-t_first)/5.0) - 1 END AS BIGINT) + 1)) AS i FROM bent_coef))""")


def _bent(w):
    return quintic.smooth_mqsi(w.pieces, TRIP)


@query("mqsi_knots", "trip_id k t:3 c:4 c_next:4", "SELECT * FROM bent")
def _(w):
    return _bent(w)


@query("sample_quintic", "trip_id i t:3 x:2 v_mps:3 a_mps2:3", "SELECT trip_id, i, ts AS t, xs AS x, v_mps, a_mps2 FROM bent_grid")
def _(w):
    return quintic.sample_quintic(_bent(w), TRIP, 5.0)


@query("smooth_mqsi", "trip_id n:0 v_min:1 x_end:1", "SELECT trip_id, count(*) AS n, min(v_mps) AS v_min, max(xs) AS x_end FROM bent_grid GROUP BY 1")
def _(w):
    grid_rows = quintic.sample_quintic(_bent(w), TRIP, 5.0)
    return grid_rows.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.min("v_mps").alias("v_min"), F.max("x").alias("x_end"))


@query("asof_backward", "event_id prev_t:3 prev_d:2", """
SELECT b.event_id, a.t AS prev_t, a.d AS prev_d FROM clocked b ASOF LEFT JOIN (SELECT trip_id, t + 7.25 AS t, d FROM trace) a ON a.trip_id = b.trip_id AND a.t <= b.t""")
def _(w):
    right = w.trace.select("trip_id", (F.col("t") + 7.25).alias("t"), "d")
    return asof(w.clocked.select("trip_id", "t", "event_id"), right, TRIP, "t", time_slice("t"), ["d"])


@query("interp_lookup", "event_id d:3", """
SELECT b.event_id, CASE WHEN p.t IS NULL THEN q.d WHEN q.t IS NULL THEN p.d WHEN q.t > p.t THEN p.d + (b.t-p.t)/(q.t-p.t)*(q.d-p.d) ELSE p.d END AS d
FROM clocked b ASOF LEFT JOIN (SELECT trip_id, t + 7.25 AS t, d FROM trace) p ON p.trip_id = b.trip_id AND p.t <= b.t
ASOF LEFT JOIN (SELECT trip_id, t + 7.25 AS t, d FROM trace) q ON q.trip_id = b.trip_id AND q.t >= b.t""")
def _(w):
    right = w.trace.select("trip_id", (F.col("t") + 7.25).alias("t"), "d")
    return interpolate(w.clocked.select("trip_id", "t", "event_id"), right, TRIP, "t", ["d"], time_slice("t"), tie=["d"])


# Segments and features ------------------------------------------------------------


@query("near_side_stops", "shape_id stop_id dist_m:3 is_near_side signal_node_id:s signal_gap_m:3", "SELECT * FROM near_stops")
def _(w):
    return w.near_stops


@query("near_side_listing", "shape_id stop_id mile:4 signal_id", "SELECT shape_id, stop_id, dist_m/1609.344 AS mile, 'SIG_' || signal_node_id AS signal_id FROM near_stops WHERE is_near_side")
def _(w):
    return segments.near_side_listing(w.near_stops)


@query("segments", "shape_id seg_id x_start:3 x_end:3 up_node down_node", "SELECT * FROM segs")
def _(w):
    return w.segs


@query("stops_in_segment", "shape_id seg_id stop_id dist_m:3", "SELECT * FROM seg_stops")
def _(w):
    return w.seg_stops


@query("controls_in_segment", "shape_id seg_id node_id dist_m:3", "SELECT * FROM seg_controls")
def _(w):
    return w.seg_controls


@query("dwell_zone", "shape_id stop_id zone_lo:3 zone_hi:3", "SELECT * FROM zones")
def _(w):
    return w.zones


@query("filter_control_types", "shape_id node_id control_type", "SELECT * FROM controls WHERE control_type IN ('traffic_signals', 'ped_crossing_signal')")
def _(w):
    return w.controls.where(F.col("control_type").isin("traffic_signals", "ped_crossing_signal"))


@query("filter_distance_window", "shape_id stop_id dist_m:3", "SELECT * FROM stops WHERE dist_m BETWEEN 1900 AND 6100")
def _(w):
    return segments.in_distance_window(w.stops, 2000.0, 6000.0, margin=100.0)


@query("events_in_window", "trip_id t_start:3 x_start:2", "SELECT * FROM slow WHERE x_end >= 1900 AND x_start <= 6100")
def _(w):
    return segments.spans_in_window(w.events, 2000.0, 6000.0, margin=100.0)


@query("control_type_counts", "shape_id control_type n", "SELECT shape_id, control_type, count(*) AS n FROM controls GROUP BY ROLLUP (shape_id, control_type)")
def _(w):
    return segments.control_type_counts(w.controls)


_CTL = "CASE WHEN control_type IN ('traffic_signals','ped_crossing_signal') THEN 'SIG_' ELSE 'CX_' END || node_id"
relation("facilities", """
SELECT shape_id, stop_id AS facility_id, name || ' (' || stop_id || ')' AS label, CASE WHEN is_near_side THEN 'stop_near_side' ELSE 'stop' END AS kind, dist_m FROM seg_stops
UNION ALL SELECT c.shape_id, 'SIG_' || node_id, CASE control_type WHEN 'traffic_signals' THEN 'Traffic Signal' ELSE 'Ped Signal' END || ' @ ' ||
  CASE WHEN len(cross_street_names) > 0 THEN array_to_string(cross_street_names, ' / ') ELSE '(unnamed)' END, 'signal', dist_m
FROM controls c JOIN (SELECT DISTINCT shape_id, down_node FROM segs) s ON s.shape_id = c.shape_id AND s.down_node = c.node_id
UNION ALL SELECT shape_id, 'CX_' || node_id, CASE control_type WHEN 'stop' THEN 'Stop Sign' ELSE 'Crosswalk' END || ' @ ' ||
  CASE WHEN len(cross_street_names) > 0 THEN array_to_string(cross_street_names, ' / ') ELSE '(unnamed)' END, 'crossing', dist_m
FROM seg_controls WHERE control_type NOT IN ('traffic_signals','ped_crossing_signal')""")


@query("facility_index", "shape_id facility_id label kind dist_m:3", "SELECT * FROM facilities")
def _(w):
    return w.facilities


relation("corners", """
SELECT shape_id, s0 AS dist_m, lat0 + ay/111320.0 AS lat, lon0 + ax/(111320.0*cos(radians(lat0))) AS lon FROM shapes
UNION ALL SELECT shape_id, s0 + ds, lat0 + "by"/111320.0, lon0 + bx/(111320.0*cos(radians(lat0))) FROM shapes
QUALIFY seg_idx = max(seg_idx) OVER (PARTITION BY shape_id)""")
relation("features", f"""
SELECT shape_id, {_CTL} AS facility_id, control_type AS kind, CASE WHEN control_type IN ('traffic_signals','ped_crossing_signal') THEN 'Signal'
   WHEN control_type = 'stop' THEN 'Stop sign' ELSE 'Crosswalk' END || ' @ ' ||
   CASE WHEN len(cross_street_names) > 0 THEN array_to_string(cross_street_names, ' & ') ELSE 'mid-block' END AS label, dist_m, lat, lon FROM controls
UNION ALL SELECT s.shape_id, s.stop_id, 'bus_stop', s.name, s.dist_m,
   coalesce(CASE WHEN q.dist_m > p.dist_m THEN p.lat + (s.dist_m-p.dist_m)/(q.dist_m-p.dist_m)*(q.lat-p.lat) ELSE p.lat END, p.lat, q.lat),
   coalesce(CASE WHEN q.dist_m > p.dist_m THEN p.lon + (s.dist_m-p.dist_m)/(q.dist_m-p.dist_m)*(q.lon-p.lon) ELSE p.lon END, p.lon, q.lon)
FROM stops s ASOF LEFT JOIN corners p ON p.shape_id = s.shape_id AND p.dist_m <= s.dist_m ASOF LEFT JOIN corners q ON q.shape_id = s.shape_id AND q.dist_m >= s.dist_m""")


@query("route_features", "shape_id facility_id kind label dist_m:3 lat:6 lon:6", "SELECT * FROM features")
def _(w):
    return segments.route_features(w.controls, w.stops, w.shapes)


@query("heading_at", "shape_id stop_id heading_deg:4", """
SELECT s.shape_id, s.stop_id, fmod(degrees(atan2((bx-ax)/(111320.0*cos(radians(lat0)))*cos(radians(lat0 + (ay+"by")/2/111320.0)), ("by"-ay)/111320.0)) + 360, 360) AS heading_deg
FROM stops s ASOF JOIN shapes g ON g.shape_id = s.shape_id AND g.s0 <= s.dist_m""")
def _(w):
    return segments.heading_at(w.stops.select("shape_id", "stop_id", "dist_m"), w.shapes)


@query("trips_in_all_runs", "trip_id", "SELECT DISTINCT trip_id FROM multi_pieces WHERE trip_id NOT IN (SELECT trip_id FROM pings WHERE bus_id = 'B3')")
def _(w):
    runs = [w.pieces, w.archive_pieces]
    buses = w.pings.select("trip_id", "bus_id").distinct()
    return smooth.trips_in_all_runs([r.select("trip_id").distinct().join(buses, "trip_id") for r in runs], exclude=["B3"])


# Delay ------------------------------------------------------------------------------


@query("slow_events", "trip_id t_start:3 t_end:3 x_start:2 x_end:2 min_v_mph:3", "SELECT * FROM slow")
def _(w):
    return w.events


relation("slow12", events_from("samples", "trip_id", limit=12.0, min_s=60.0, merge=50.0))


@query("slow_events_custom_rule", "trip_id t_start:3 t_end:3 min_v_mph:3", "SELECT * FROM slow12")
def _(w):
    return delay.slow_events(w.samples, TRIP, threshold=delay.below_speed(12.0), min_s=60.0, merge_m=50.0)


@query("loss_shoulders", "trip_id t_start:3 decel_lo:3 accel_hi:3", """
SELECT e.trip_id, e.t_start, coalesce((SELECT min(s.t) FROM samples s WHERE s.trip_id = e.trip_id AND s.t <= e.t_start AND s.i > coalesce(
    (SELECT max(f.i) FROM flank f WHERE f.trip_id = e.trip_id AND f.t < e.t_start AND NOT f.falling), -1)), e.t_start) AS decel_lo,
  coalesce((SELECT max(s.t) FROM samples s WHERE s.trip_id = e.trip_id AND s.t >= e.t_end AND s.i < coalesce(
    (SELECT min(f.i) FROM flank f WHERE f.trip_id = e.trip_id AND f.t > e.t_end AND NOT f.rising), 1000000000)), e.t_end) AS accel_hi FROM slow e""")
def _(w):
    return delay.loss_shoulders(w.samples, w.events, TRIP)


relation("flank", """
SELECT trip_id, i, t, coalesce(v_mph < 12 AND v_mph > lead(v_mph) OVER w, false) AS falling, coalesce(v_mph < 12 AND v_mph > lag(v_mph) OVER w, false) AS rising
FROM samples WINDOW w AS (PARTITION BY trip_id ORDER BY i)""")


@query("segment_times", "trip_id seg_id t_in:3 t_out:3 t_obs:3", "SELECT * FROM seg_times")
def _(w):
    return w.times


@query("events_x_segments", "trip_id t_start:3 seg_id in_seg_s:3", "SELECT * FROM pairs_trip")
def _(w):
    return delay.event_segments(w.events, w.times, TRIP)


@query("primary_segment", "trip_id t_start:3 seg_id in_primary_s:3", "SELECT *, in_seg_s AS in_primary_s FROM primary_trip")
def _(w):
    return delay.primary_segment(w.attribution[1], w.events, TRIP)


@query("attribute_events", "trip_id t_start:3 seg_id category facility_id dwell_near_signal core_s:3", """
SELECT trip_id, t_start, seg_id, cat0 AS category, CASE WHEN category = 'signal_overflow' THEN NULL ELSE facility_id END AS facility_id, dwell_near_signal, core_s FROM attributed""")
def _(w):
    primary = stage(delay.primary_segment(w.attribution[1], w.events, TRIP), "primary")
    return delay.attribute_events(primary, delay.proximity_dwells(primary, w.zones, TRIP), w.seg_controls, TRIP)


@query("overflow_pass", "trip_id t_start:3 seg_id category facility_id", "SELECT * FROM attributed")
def _(w):
    return w.attributed


_ROW = "trip_id shape_id seg_id t_obs:3 t_ff:3 t_dwell:3 d_signal_uniform:3 d_signal_overflow:3 d_signal:3 d_crossing:3 d_congestion:3 t_dwell_near_signal:3"


@query("decompose", _ROW, "SELECT * FROM decomposed")
def _(w):
    return w.decomposed


@query("decompose_with_loss", "trip_id seg_id core:2 loss:2", """
SELECT t.trip_id, t.seg_id, coalesce(c.core, 0.0) AS core, coalesce(l.loss, 0.0) AS loss FROM seg_times t
LEFT JOIN (SELECT p.trip_id, p.seg_id, sum(in_seg_s) AS core FROM pairs_trip p JOIN attributed a ON a.trip_id = p.trip_id AND a.t_start = p.t_start
  WHERE category <> 'slowdown' GROUP BY 1, 2) c ON c.trip_id = t.trip_id AND c.seg_id = t.seg_id
LEFT JOIN (SELECT x.trip_id, x.seg_id, sum(greatest(0.0, least(x.t_out, s.w1) - greatest(x.t_in, s.w0))) AS loss FROM (
   SELECT trip_id, t_start, decel_lo AS w0, t_start AS w1, category FROM wings UNION ALL SELECT trip_id, t_start, t_end, accel_hi, category FROM wings) s
   JOIN seg_times x ON x.trip_id = s.trip_id WHERE s.category <> 'slowdown' GROUP BY 1, 2) l ON l.trip_id = t.trip_id AND l.seg_id = t.seg_id""")
def _(w):
    rows, _ = delay.decompose(w.pieces, w.segs, w.zones, w.seg_controls, w.freeflow, TRIP, include_loss=True, times=w.times)
    parts = ("t_dwell", "d_signal_uniform", "d_signal_overflow", "d_crossing")
    total = lambda p: sum((F.col(f"{c}_{p}") for c in parts), F.lit(0.0))
    return rows.withColumn("core", total("core")).withColumn("loss", total("loss"))


relation("wings", """
SELECT e.trip_id, e.t_start, e.t_end, a.category, coalesce((SELECT min(s.t) FROM samples s WHERE s.trip_id = e.trip_id AND s.t <= e.t_start AND s.i > coalesce(
    (SELECT max(f.i) FROM flank f WHERE f.trip_id = e.trip_id AND f.t < e.t_start AND NOT f.falling), -1)), e.t_start) AS decel_lo,
  coalesce((SELECT max(s.t) FROM samples s WHERE s.trip_id = e.trip_id AND s.t >= e.t_end AND s.i < coalesce(
    (SELECT min(f.i) FROM flank f WHERE f.trip_id = e.trip_id AND f.t > e.t_end AND NOT f.rising), 1000000000)), e.t_end) AS accel_hi
FROM slow e JOIN attributed a ON a.trip_id = e.trip_id AND a.t_start = e.t_start""")


@query("freeflow_table", "shape_id seg_id t_ff:3", "SELECT * FROM freeflow")
def _(w):
    return w.freeflow


@query("delay_bands", "trip_id t_start:1 t_end:1 category label facility_id seg_id", """
SELECT trip_id, round(t_start, 1) AS t_start, round(t_end, 1) AS t_end, CASE WHEN category = 'dwell' AND dwell_near_signal THEN 'dwell_near_signal' ELSE category END AS category,
  coalesce(f.label, '') AS label, a.facility_id, seg_id FROM attributed a LEFT JOIN facilities f ON f.shape_id = a.shape_id AND f.facility_id = a.facility_id""")
def _(w):
    return delay.delay_bands(w.attributed, w.facilities, TRIP)


# Corridor tables ----------------------------------------------------------------------

_AGG = ", ".join(
    f"avg({m}) AS mean_{m}, stddev_pop({m}) AS std_{m}"
    for m in ("t_obs", "t_ff", "t_dwell", "d_signal", "d_signal_uniform", "d_signal_overflow", "d_crossing", "d_congestion", "t_dwell_near_signal")
)
relation("per_segment", f"SELECT shape_id, seg_id, count(*) AS n_trips, min(x_start) AS x_start, min(x_end) AS x_end, {_AGG} FROM decomposed GROUP BY 1, 2")


@query("aggregate_trips", "shape_id seg_id n_trips mean_t_obs:3 std_t_obs:3 mean_t_ff:3 mean_t_dwell:3 std_t_dwell:3 mean_d_signal:3 std_d_signal:3 mean_d_crossing:3 mean_d_congestion:3 std_d_congestion:3 near_signal_share:4",
       "SELECT *, coalesce(mean_t_dwell_near_signal / nullif(mean_t_dwell, 0.0), 0.0) AS near_signal_share FROM per_segment")
def _(w):
    return aggregate.aggregate_trips(w.decomposed)


@query("segment_payload", "shape_id seg_id n_trips t_ff_min:4 t_dwell_clean_min:4 t_dwell_near_signal_min:4 d_signal_uniform_min:4 d_crossing_min:4 d_congestion_pos_min:4 d_congestion_neg_min:4", """
SELECT shape_id, seg_id, n_trips, mean_t_ff/60 AS t_ff_min, greatest(0.0, mean_t_dwell - mean_t_dwell_near_signal)/60 AS t_dwell_clean_min, mean_t_dwell_near_signal/60 AS t_dwell_near_signal_min,
  mean_d_signal_uniform/60 AS d_signal_uniform_min, mean_d_crossing/60 AS d_crossing_min, CASE WHEN mean_d_congestion IS NOT NULL THEN greatest(0.0, mean_d_congestion)/60 END AS d_congestion_pos_min,
  CASE WHEN mean_d_congestion IS NOT NULL THEN greatest(0.0, -mean_d_congestion)/60 END AS d_congestion_neg_min FROM per_segment""")
def _(w):
    return aggregate.segment_payload(aggregate.aggregate_trips(w.decomposed))


@query("segments_lookup", "shape_id seg_id up_node down_node n_trips mean_t_obs:3", "SELECT p.shape_id, p.seg_id, up_node, down_node, n_trips, mean_t_obs FROM per_segment p JOIN segs s ON s.shape_id = p.shape_id AND s.seg_id = p.seg_id")
def _(w):
    return aggregate.segments_lookup(w.segs, aggregate.aggregate_trips(w.decomposed))


@query("facility_seconds", "trip_id level facility_id category seconds:3", """
SELECT trip_id, 'facility' AS level, facility_id, NULL AS category, sum(core_s) AS seconds FROM attributed WHERE facility_id IS NOT NULL AND category <> 'slowdown' GROUP BY trip_id, facility_id
UNION ALL SELECT trip_id, 'category', facility_id, category, sum(core_s) FROM attributed WHERE facility_id IS NOT NULL AND category <> 'slowdown' GROUP BY trip_id, facility_id, category
UNION ALL SELECT trip_id, 'other', NULL, NULL, sum(CASE WHEN facility_id IS NULL OR category = 'slowdown' THEN core_s ELSE 0.0 END) FROM attributed GROUP BY trip_id""")
def _(w):
    return aggregate.facility_seconds(w.attributed, TRIP)


relation("trips_n", "SELECT shape_id, count(*) AS n_trips FROM (SELECT DISTINCT trip_id, shape_id FROM pings) GROUP BY 1")


def zero_filled(src: str, by: str) -> str:
    """Statistics over an explicit grid of every trip and group."""
    on = " AND ".join(f"g.{b} = s.{b}" for b in by.split(", "))
    gb = ", ".join(f"g.{b}" for b in by.split(", "))
    return f"""
SELECT {gb}, count(*) AS n_trips, CAST(sum(CASE WHEN s.sec > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n, sum(coalesce(s.sec, 0.0)) AS total_s, avg(coalesce(s.sec, 0.0)) AS mean_s,
  stddev_pop(coalesce(s.sec, 0.0)) AS std_s, quantile_cont(coalesce(s.sec, 0.0), 0.5) AS median_s, quantile_cont(coalesce(s.sec, 0.0), 0.25) AS q25_s,
  quantile_cont(coalesce(s.sec, 0.0), 0.75) AS q75_s, quantile_cont(coalesce(s.sec, 0.0), 0.95) AS p95_s
FROM (SELECT DISTINCT {by} FROM ({src})) g JOIN (SELECT DISTINCT trip_id, shape_id FROM pings) t ON t.shape_id = g.shape_id
LEFT JOIN ({src}) s ON s.trip_id = t.trip_id AND {on} GROUP BY {gb}"""


relation("fac_sec", "SELECT trip_id, shape_id, facility_id, sum(core_s) AS sec FROM attributed WHERE facility_id IS NOT NULL AND category <> 'slowdown' GROUP BY 1, 2, 3")
relation("fac_stats", zero_filled("SELECT * FROM fac_sec", "shape_id, facility_id"))
_STATS = "n_trips n total_s:3 mean_s:3 std_s:3 median_s:3 q25_s:3 q75_s:3 p95_s:3 buffer_s:3"


def _trips(w):
    return aggregate.trips_per_shape(w.pings, TRIP)


def _stats(w):
    return aggregate.facility_stats(w.attributed, _trips(w), w.facilities, TRIP)


@query("facility_stats", f"shape_id facility_id label kind mile:4 {_STATS}", """
SELECT s.*, greatest(0.0, p95_s - mean_s) AS buffer_s, label, kind, dist_m/1609.344 AS mile FROM fac_stats s JOIN facilities f ON f.shape_id = s.shape_id AND f.facility_id = s.facility_id WHERE n > 0""")
def _(w):
    return _stats(w)


relation("cong_stats", zero_filled("SELECT trip_id, shape_id, seg_id, greatest(0.0, d_congestion) AS sec FROM decomposed WHERE d_congestion IS NOT NULL", "shape_id, seg_id"))


@query("congestion_stats", f"shape_id seg_id mile:4 {_STATS}", """
SELECT s.*, greatest(0.0, p95_s - mean_s) AS buffer_s, (x_start + x_end)/2/1609.344 AS mile FROM cong_stats s JOIN segs g ON g.shape_id = s.shape_id AND g.seg_id = s.seg_id WHERE n > 0""")
def _(w):
    return aggregate.congestion_stats(w.decomposed, _trips(w))


@query("other_stats", f"shape_id {_STATS}", "SELECT *, greatest(0.0, p95_s - mean_s) AS buffer_s FROM (" + zero_filled(
    "SELECT trip_id, shape_id, sum(core_s) AS sec FROM attributed WHERE facility_id IS NULL OR category = 'slowdown' GROUP BY 1, 2", "shape_id") + ")")
def _(w):
    return aggregate.other_stats(w.attributed, _trips(w), TRIP)


@query("category_totals", "shape_id cause minutes:3", """
SELECT shape_id, cause, seconds/60 AS minutes FROM (SELECT shape_id, sum(t_ff) AS freeflow, sum(greatest(0.0, t_dwell - t_dwell_near_signal)) AS dwell_clean, sum(t_dwell_near_signal) AS dwell_near_signal,
  sum(d_signal_uniform) AS signal_uniform, sum(d_signal_overflow) AS signal_overflow, sum(d_crossing) AS crossing, sum(d_congestion) AS congestion_net FROM decomposed GROUP BY 1)
UNPIVOT INCLUDE NULLS (seconds FOR cause IN (freeflow, dwell_clean, dwell_near_signal, signal_uniform, signal_overflow, crossing, congestion_net))""")
def _(w):
    return aggregate.category_totals(w.decomposed)


_COUNTS = ", ".join(f"CAST(count(*) FILTER (category = '{c}') AS BIGINT) AS n_{c}" for c in ("dwell", "crossing", "signal_uniform", "signal_overflow", "slowdown"))


@query("event_counts", "trip_id seg_id n_dwell n_crossing n_signal_uniform n_signal_overflow n_slowdown", f"""
SELECT t.trip_id, t.seg_id, {_COUNTS} FROM seg_times t LEFT JOIN attributed a ON a.trip_id = t.trip_id AND a.seg_id = t.seg_id GROUP BY 1, 2""")
def _(w):
    return aggregate.event_counts(w.attributed, w.decomposed, TRIP)


relation("ranked", "SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY mean_s DESC, facility_id) AS rank FROM fac_stats WHERE n > 0")


@query("rank_facilities", "shape_id facility_id rank mean_s:3", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY p95_s DESC, facility_id) AS rank FROM fac_stats WHERE n > 0)")
def _(w):
    return aggregate.rank_facilities(_stats(w), "p95_s")


@query("top_facilities", "shape_id facility_id rank mean_s:3", "SELECT * FROM ranked WHERE rank <= 8")
def _(w):
    return aggregate.rank_facilities(_stats(w), "mean_s", 8)


@query("rest_bucket", "shape_id facility_id n total_s:3 mean_s:3 std_s:3", """
SELECT shape_id, facility_id, n, total_s, mean_s, std_s FROM ranked WHERE rank <= 3
UNION ALL SELECT shape_id, 'other ' || count(*), -1, sum(total_s), sum(mean_s), sqrt(sum(std_s*std_s)) FROM ranked WHERE rank > 3 GROUP BY shape_id""")
def _(w):
    return aggregate.rest_bucket(_stats(w), 3)


@query("attributed_share", "trip_id run_s:3 facility_share:5 slowdown_share:5 moving_share:5", """
SELECT r.trip_id, run_s, coalesce(f, 0.0)/run_s AS facility_share, coalesce(s, 0.0)/run_s AS slowdown_share, 1 - (coalesce(f, 0.0) + coalesce(s, 0.0))/run_s AS moving_share
FROM (SELECT trip_id, max(t) - min(t) AS run_s FROM pieces GROUP BY 1) r LEFT JOIN (SELECT trip_id, sum(CASE WHEN category <> 'slowdown' THEN core_s ELSE 0 END) AS f,
  sum(CASE WHEN category = 'slowdown' THEN core_s ELSE 0 END) AS s FROM attributed GROUP BY 1) a USING (trip_id)""")
def _(w):
    return aggregate.attributed_share(w.attributed, w.pieces, TRIP)


@query("facility_lookup", "shape_id facility_id kind mean_min:4 p95_min:4 buffer_min:4 attributed", """
SELECT f.shape_id, f.facility_id, f.kind, coalesce(mean_s, 0.0)/60 AS mean_min, coalesce(p95_s, 0.0)/60 AS p95_min,
  greatest(0.0, coalesce(p95_s, 0.0) - coalesce(mean_s, 0.0))/60 AS buffer_min, coalesce(p95_s, 0.0) >= 30.0 AS attributed
FROM features f LEFT JOIN (SELECT s.* FROM fac_stats s JOIN facilities i ON i.shape_id = s.shape_id AND i.facility_id = s.facility_id WHERE n > 0) s
  ON s.shape_id = f.shape_id AND s.facility_id = f.facility_id""")
def _(w):
    return aggregate.facility_lookup(segments.route_features(w.controls, w.stops, w.shapes), _stats(w))


@query("flag_attributed", "trip_id shape_id facility_id attributed", r"""
SELECT t.trip_id, f.shape_id, f.facility_id, EXISTS (SELECT 1 FROM attributed a WHERE a.trip_id = t.trip_id AND a.shape_id = f.shape_id AND a.facility_id IS NOT NULL
  AND regexp_extract(a.facility_id, '(\d+)\D*$', 1) = regexp_extract(f.facility_id, '(\d+)\D*$', 1)) AS attributed
FROM features f JOIN (SELECT DISTINCT trip_id, shape_id FROM pieces) t ON t.shape_id = f.shape_id""")
def _(w):
    return aggregate.flag_referenced(segments.route_features(w.controls, w.stops, w.shapes), w.attributed, w.pieces, TRIP)


@query("ping_density", "route_id cx cy n", """
SELECT route_id, CAST(floor(radians(lon)*6378137.0/500) AS BIGINT) AS cx, CAST(floor(ln(tan(pi()/4 + radians(lat)/2))*6378137.0/500) AS BIGINT) AS cy, count(*) AS n FROM pings GROUP BY 1, 2, 3""")
def _(w):
    return aggregate.ping_density(w.pings, "route_id")


@query("route_aggregate", "shape_id seg_id n_trips mean_delay_min:4", """
SELECT shape_id, seg_id, n_trips, greatest(0.0, mean_t_dwell - mean_t_dwell_near_signal)/60 + mean_t_dwell_near_signal/60 + mean_d_signal_uniform/60 + mean_d_signal_overflow/60 + mean_d_crossing/60 AS mean_delay_min FROM per_segment""")
def _(w):
    segs, _ = aggregate.route_aggregate(w.decomposed, w.attributed, _trips(w), w.facilities, w.controls, w.stops, w.shapes, TRIP)
    parts = ("t_dwell_clean_min", "t_dwell_near_signal_min", "d_signal_uniform_min", "d_signal_overflow_min", "d_crossing_min")
    return segs.withColumn("mean_delay_min", sum((F.col(c) for c in parts), F.lit(0.0)))


