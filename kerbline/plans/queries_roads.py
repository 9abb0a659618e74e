"""Road feature, stop and live-position queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.operators import roads, stops
from kerbline.operators.stage import stage
from kerbline.plans import derived
from kerbline.plans.oracle import along, relation, shape, snap
from kerbline.plans.queries_recording import responses_of
from kerbline.plans.registry import query
from kerbline.sources import readers

# Road network ------------------------------------------------------------------------

relation("osm_nodes", """
SELECT 1000*(g+1) + k AS id, 42.02 - 0.006*k AS lat, -87.67 + 0.02*(g % 5) + 0.001*(k % 3) AS lon,
  CASE WHEN k % 5 = 0 THEN 'traffic_signals' WHEN k % 5 = 2 THEN 'stop' WHEN k % 5 = 3 THEN 'crossing' END AS highway, CASE WHEN k % 5 = 3 THEN 'ped_crossing_signal' END AS ped FROM grp, kk
UNION ALL SELECT 1000*(g+1) + 500 + k, 42.02 - 0.006*k - 0.006*0.027, -87.67 + 0.02*(g % 5) + 0.001*(k % 3) + 0.027*0.001*(((k+1) % 3) - (k % 3)), 'crossing', 'ped_crossing_marked'
FROM grp, kk WHERE k % 4 = 1 AND k < 24""")
relation("route_ways", """
SELECT g, w, 100*(g+1) + w AS way_id, k, p, 1000*(g+1) + 500*p + k AS node_id, row_number() OVER (PARTITION BY g, w ORDER BY k, p) - 1 AS pos
FROM grp, (SELECT range AS w FROM range(4)), kk, (VALUES (0), (1)) v(p) WHERE k BETWEEN 6*w AND 6*w + 6 AND (p = 0 OR (k % 4 = 1 AND k < 6*w + 6))""")
relation("way_segments", f"""
SELECT {shape('g')} AS shape_id, 100*(g+1) + w AS way_id, w AS way_no, CASE WHEN w = 0 THEN 0.0 ELSE {along('6*w')} - 2.0 END AS dist_start_m, {along('6*w+6')} + 2.0 AS dist_end_m, g
FROM grp, (SELECT range AS w FROM range(4))""")
relation("visit_pts", """
SELECT s.shape_id, s.way_id, s.way_no, s.dist_start_m, s.dist_end_m, r.pos, r.k, r.node_id, n.lat, n.lon, n.highway, n.ped, s.shape_id || '/' || s.way_no || '/' || r.pos AS vk
FROM way_segments s JOIN route_ways r ON r.way_id = s.way_id JOIN osm_nodes n ON n.id = r.node_id""")
relation("visits", "SELECT * FROM (" + snap("visit_pts", "p_shape, way_id, way_no, dist_start_m, dist_end_m, pos, k, node_id, lat, lon, highway, ped, vk", "vk", 200.0).replace("SELECT p.*,", "SELECT p.*, p.shape_id AS p_shape,")
         + ") WHERE perp_m <= 30 AND dist_m >= dist_start_m - 1e-3 AND dist_m <= dist_end_m + 1e-3")


def _network(w):
    if not hasattr(w, "network"):
        w.ways = stage(derived.osm_ways(w.spark, w.sf_dir), "ways")
        w.nodes = stage(derived.osm_nodes(w.spark, w.sf_dir), "nodes")
        w.network = stage(derived.way_segments(w.spark, w.sf_dir), "way_segments")
        w.visits = stage(roads.node_visits(w.network, w.ways, w.nodes, w.shapes), "visits")
        w.crossing_names = stage(roads.cross_ways(w.visits, w.network, w.ways), "cross_ways")
        w.vertices = stage(roads.intersection_vertices(w.visits, w.crossing_names), "vertices")
    return w


@query("node_visits", "shape_id way_no pos node_id dist_m:3", "SELECT p_shape AS shape_id, way_no, pos, node_id, dist_m FROM visits")
def _(w):
    return _network(w).visits


@query("node_to_road_ways", "way_id node_id name", "SELECT 100*(g+1) + w AS way_id, node_id, 'Route ' || g AS name FROM route_ways UNION ALL SELECT 1000000 + 100*(g+1) + k, 1000*(g+1) + k, 'Street ' || k FROM grp, kk WHERE k % 2 = 0")
def _(w):
    return roads.node_to_road_ways(_network(w).ways)


@query("cross_ways", "shape_id node_id names", "SELECT DISTINCT p_shape AS shape_id, node_id, 'Street ' || k AS names FROM visits WHERE node_id % 1000 < 500 AND k % 2 = 0")
def _(w):
    return _network(w).crossing_names.withColumn("names", F.array_join("cross_street_names", "/"))


relation("vertices", """
SELECT p_shape AS shape_id, node_id, dist_m, lat, lon, way_id AS on_way_id, CASE WHEN highway = 'traffic_signals' THEN 'traffic_signals' WHEN highway = 'stop' THEN 'stop' END AS control_type, 'Street ' || k AS names
FROM visits WHERE node_id % 1000 < 500 AND k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY p_shape, node_id ORDER BY way_no, pos) = 1""")


@query("intersection_vertices", "shape_id node_id dist_m:3 on_way_id control_type names", "SELECT * FROM vertices")
def _(w):
    return _network(w).vertices.withColumn("names", F.array_join("cross_street_names", "/"))


relation("peds", """
SELECT v.shape_id, v.node_id, v.dist_m, v.control_type, a.node_id AS anchor, v.control_type = 'ped_crossing_signal' AS signalized FROM (
 SELECT p_shape AS shape_id, node_id, dist_m, ped AS control_type FROM visits WHERE ped IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_shape, node_id ORDER BY way_no, pos) = 1) v
LEFT JOIN vertices a ON a.shape_id = v.shape_id AND abs(a.dist_m - v.dist_m) <= 40""")


@query("ped_crossings", "shape_id node_id dist_m:3 control_type signalized anchor_node_id:s", "SELECT *, anchor AS anchor_node_id FROM peds")
def _(w):
    return roads.ped_crossings(_network(w).visits, w.vertices)


@query("anchor_to_vertex", "shape_id stop_id anchor_node_id:s", """
SELECT s.shape_id, s.stop_id, (SELECT arg_min(v.node_id, (abs(v.dist_m - s.dist_m), v.dist_m)) FROM vertices v WHERE v.shape_id = s.shape_id AND abs(v.dist_m - s.dist_m) <= 400) AS anchor_node_id FROM stops s""")
def _(w):
    return roads.anchor_to_vertex(w.stops.select("shape_id", "stop_id", "dist_m"), _network(w).vertices, radius_m=400.0)


@query("control_points", "shape_id node_id dist_m:3 control_type", """
SELECT shape_id, node_id, dist_m, control_type FROM vertices WHERE control_type IS NOT NULL
UNION ALL SELECT p.shape_id, p.node_id, p.dist_m, p.control_type FROM peds p WHERE NOT EXISTS (SELECT 1 FROM vertices v WHERE v.shape_id = p.shape_id AND abs(v.dist_m - p.dist_m) <= 40
  AND ((p.control_type = 'ped_crossing_signal' AND v.control_type = 'traffic_signals') OR (p.control_type = 'ped_crossing_marked' AND v.control_type = 'stop')))""")
def _(w):
    _network(w)
    return roads.control_points(w.network, w.ways, w.nodes, w.shapes)


relation("dense_controls", """
SELECT shape_id, node_id, dist_m, CASE WHEN node_id % 7 < 5 THEN 'traffic_signals' ELSE 'stop' END AS control_type, row_number() OVER (PARTITION BY shape_id ORDER BY dist_m, node_id) AS rn FROM (
 SELECT p.shape_id, CAST(p.event_id AS BIGINT) AS node_id, round(p.true_m, 1) AS dist_m FROM pings p)""")
relation("folded", """
WITH RECURSIVE f AS (SELECT shape_id, node_id, dist_m, control_type, rn, dist_m AS head_d, node_id AS head FROM dense_controls WHERE rn = 1
 UNION ALL SELECT d.shape_id, d.node_id, d.dist_m, d.control_type, d.rn, CASE WHEN d.control_type = f.control_type AND d.dist_m - f.head_d <= 30 THEN f.head_d ELSE d.dist_m END,
   CASE WHEN d.control_type = f.control_type AND d.dist_m - f.head_d <= 30 THEN f.head ELSE d.node_id END FROM f JOIN dense_controls d ON d.shape_id = f.shape_id AND d.rn = f.rn + 1)
SELECT shape_id, head AS node_id, min(dist_m) AS dist_m, min(control_type) AS control_type, count(*) - 1 AS n_merged, string_agg(CAST(CASE WHEN node_id <> head THEN node_id END AS VARCHAR), '/' ORDER BY rn) AS merged FROM f GROUP BY 1, 2""")


def _dense(w):
    return w.pings.select(
        "shape_id", F.col("event_id").alias("node_id"), F.round("true_m", 1).alias("dist_m"), F.when(F.col("event_id") % 7 < 5, "traffic_signals").otherwise("stop").alias("control_type"),
        F.array(F.lit("Main")).alias("cross_street_names"),
    )


@query("cluster_controls", "shape_id node_id dist_m:1 control_type n_merged merged", "SELECT *  REPLACE (coalesce(merged, '') AS merged) FROM folded")
def _(w):
    out = roads.cluster_controls(_dense(w))
    return out.withColumn("n_merged", F.size("merged_node_ids").cast("long")).withColumn("merged", F.array_join(F.col("merged_node_ids").cast("array<string>"), "/"))


@query("drop_near", "shape_id node_id control_type", """
SELECT d.shape_id, d.node_id, d.control_type FROM dense_controls d WHERE d.control_type <> 'stop' OR NOT EXISTS (SELECT 1 FROM dense_controls e WHERE e.shape_id = d.shape_id AND e.control_type = 'traffic_signals' AND abs(e.dist_m - d.dist_m) <= 12.34)""")
def _(w):
    return roads.drop_near(_dense(w), "stop", ["traffic_signals"], radius_m=12.34)


relation("matched_line", f"SELECT {shape('g')} AS shape_id, k AS idx, 42.02 - 0.006*k + 0.00004 AS lat, -87.67 + 0.02*(g % 5) + 0.001*(k % 3) AS lon, {shape('g')} || '/' || k AS vk FROM grp, kk")
relation("line_at", "SELECT p_shape AS shape_id, idx, dist_m FROM (" + snap("matched_line", "p_shape, idx, vk", "vk", 200.0).replace("SELECT p.*,", "SELECT p.*, p.shape_id AS p_shape,") + ")")


@query("way_tiling", "shape_id way_id way_no dist_start_m:3 dist_end_m:3 direction name", """
SELECT b.shape_id, w + 7 AS way_id, w AS way_no, CASE WHEN w = 0 THEN 0.0 ELSE b.dist_m END AS dist_start_m, CASE WHEN w = 3 THEN l.len ELSE e.dist_m END AS dist_end_m,
  CASE WHEN w < 2 THEN 'forward' WHEN w = 2 THEN 'reverse' ELSE 'unknown' END AS direction, 'Way ' || w AS name
FROM (SELECT range AS w FROM range(4)) JOIN line_at b ON b.idx = 6*w JOIN line_at e ON e.shape_id = b.shape_id AND e.idx = 6*w + 6
JOIN (SELECT shape_id, max(shape_len_m) AS len FROM shapes GROUP BY 1) l ON l.shape_id = b.shape_id""")
def _(w):
    edges, lines = readers.scan_matched_edges(w.spark, responses_of(w), lines=True)
    return roads.way_tiling(stage(edges, "edges"), roads.matched_vertices(lines), w.shapes)


def _diff_sql(pairs: str, a: str, b: str) -> str:
    """Greedy pass over the near pairs of two shapes, one recursion step a pair, then names."""
    gap = "sqrt(pow((a.lat - b.lat)*111320.0, 2) + pow((a.lon - b.lon)*111320.0*cos(radians((a.lat + b.lat)/2)), 2))"

    def numbered(rows: str, c: str) -> str:
        return f"""SELECT shape_a, shape_b, control_type, list_sort(cross_street_names) AS names, node_id, row_number() OVER (PARTITION BY shape_a, shape_b, control_type, list_sort(cross_street_names) ORDER BY dist_m, node_id) AS no
 FROM {pairs} p JOIN {rows} r ON r.shape_id = p.{c} WHERE len(cross_street_names) > 0"""

    return f"""
WITH RECURSIVE near AS (
 SELECT p.shape_a, p.shape_b, a.node_id AS na, b.node_id AS nb, row_number() OVER (PARTITION BY p.shape_a, p.shape_b ORDER BY a.dist_m, a.node_id, {gap}, b.node_id) AS rn
 FROM {pairs} p JOIN {a} a ON a.shape_id = p.shape_a JOIN {b} b ON b.shape_id = p.shape_b AND b.control_type = a.control_type WHERE {gap} <= 30.0),
greedy AS (
 SELECT shape_a, shape_b, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub FROM {pairs}
 UNION ALL
 SELECT g.shape_a, g.shape_b, n.rn, CASE WHEN list_contains(ua, na) OR list_contains(ub, nb) THEN ua ELSE list_append(ua, na) END, CASE WHEN list_contains(ua, na) OR list_contains(ub, nb) THEN ub ELSE list_append(ub, nb) END
 FROM greedy g JOIN near n ON n.shape_a = g.shape_a AND n.shape_b = g.shape_b AND n.rn = g.rn + 1),
last AS (SELECT shape_a, shape_b, arg_max(ua, rn) AS ua, arg_max(ub, rn) AS ub FROM greedy GROUP BY 1, 2),
xa AS ({numbered(a, 'shape_a')}), xb AS ({numbered(b, 'shape_b')}),
same AS (SELECT shape_a, shape_b, xa.node_id AS na, xb.node_id AS nb FROM xa JOIN xb USING (shape_a, shape_b, control_type, names, no))
SELECT l.shape_a, l.shape_b, 'a' AS side, r.node_id, r.control_type FROM last l JOIN {a} r ON r.shape_id = l.shape_a WHERE NOT list_contains(ua, r.node_id) AND NOT EXISTS (SELECT 1 FROM same s WHERE s.shape_a = l.shape_a AND s.shape_b = l.shape_b AND s.na = r.node_id)
UNION ALL SELECT l.shape_a, l.shape_b, 'b', r.node_id, r.control_type FROM last l JOIN {b} r ON r.shape_id = l.shape_b WHERE NOT list_contains(ub, r.node_id) AND NOT EXISTS (SELECT 1 FROM same s WHERE s.shape_a = l.shape_a AND s.shape_b = l.shape_b AND s.nb = r.node_id)"""


def _diff(w, a, b, step: int):
    ids = w.controls.select("shape_id").distinct()
    number = F.substring("shape_id", 4, 5).cast("int")
    pairs = ids.where(number % 2 == 0).select(F.col("shape_id").alias("shape_a"), F.concat(F.lit("678"), F.lpad((number + step).cast("string"), 5, "0")).alias("shape_b"))
    only_a, only_b = roads.diff_control_points(a, b, pairs.join(ids.select(F.col("shape_id").alias("shape_b")), "shape_b"), radius_m=30.0)
    return only_a.withColumn("side", F.lit("a")).unionByName(only_b.withColumn("side", F.lit("b")))


for _step in (1, 5):
    relation(f"shape_pairs{_step}", f"SELECT DISTINCT {shape('a.g')} AS shape_a, {shape('b.g')} AS shape_b FROM grp a JOIN grp b ON b.g = a.g + {_step} WHERE a.g % 2 = 0")


@query("diff_control_points", "shape_a shape_b side node_id control_type", _diff_sql("shape_pairs1", "controls", "controls"))
def _(w):
    return _diff(w, w.controls, w.controls, 1)


# Controls that compete for each other: each twice on one side, three times on the other, some metres apart; streets only at every third
_CLOSE = "SELECT shape_id, node_id*10 + j AS node_id, lat + j*{step} AS lat, lon, dist_m + j AS dist_m, control_type, CASE WHEN node_id % 3 = 0 THEN cross_street_names ELSE CAST([] AS VARCHAR[]) END AS cross_street_names FROM controls, (SELECT unnest(range({n})) AS j)"
relation("close_a", _CLOSE.format(step="0.00012 - (node_id % 4)*0.00005", n=2))
relation("close_b", _CLOSE.format(step="(-0.0001) + (node_id % 5)*0.00004", n=3))


@query("diff_close_controls", "shape_a shape_b side node_id control_type", _diff_sql("shape_pairs5", "close_a", "close_b"))
def _(w):
    def copies(n: int, shift):
        rows = w.controls.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return rows.select(
            "shape_id", (F.col("node_id") * 10 + F.col("j")).alias("node_id"), (F.col("lat") + shift(F.col("j"), F.col("node_id"))).alias("lat"), "lon", (F.col("dist_m") + F.col("j")).alias("dist_m"), "control_type",
            F.when(F.col("node_id") % 3 == 0, F.col("cross_street_names")).otherwise(F.array().cast("array<string>")).alias("cross_street_names"),
        )

    return _diff(w, copies(2, lambda j, k: j * 0.00012 - (k % 4) * 0.00005), copies(3, lambda j, k: j * -0.0001 + (k % 5) * 0.00004), 5)


@query("dedupe_osm_elements", "id n_nodes", "SELECT 100*(g+1) + w AS id, count(*) AS n_nodes FROM route_ways GROUP BY 1 UNION ALL SELECT 1000000 + 100*(g+1) + k, 1 FROM grp, kk WHERE k % 2 = 0")
def _(w):
    twice = _network(w).ways.withColumn("type", F.lit("way"))
    return roads.dedupe_osm(twice.unionByName(twice)).withColumn("n_nodes", F.size("nodes").cast("long"))


# Stops ---------------------------------------------------------------------------------

relation("places", """
SELECT shape_id, stop_id, name, dist_m, stop_seq, 42.02 - 0.006*(dist_m/668.0) AS lat, -87.67 + 0.02*(g % 5) + 0.0015 + 0.00001*(g % 9) AS lon FROM (SELECT *, CAST(stop_id AS BIGINT)//1000 AS g FROM stops)""")
relation("near_pts", "SELECT event_id, lat + CASE WHEN event_id % 50 = 0 THEN 0.35 ELSE 0.0 END AS lat, lon FROM pings")


def _points(w):
    return w.pings.select(F.col("event_id").alias("point_id"), (F.col("lat") + F.when(F.col("event_id") % 50 == 0, 0.35).otherwise(0.0)).alias("lat"), "lon")


@query("nearest_stops", "point_id rank dist_m:3", """
WITH d AS (SELECT p.event_id AS point_id, s.stop_id, 2*6371000.0*asin(sqrt(pow(sin(radians(s.lat-p.lat)/2),2) + cos(radians(p.lat))*cos(radians(s.lat))*pow(sin(radians(s.lon-p.lon)/2),2))) AS dist_m,
   abs(s.lat-p.lat) < 0.02 AND abs(s.lon-p.lon) < 0.028 AS boxed FROM near_pts p, places s),
n AS (SELECT point_id, count(*) FILTER (boxed) >= 10 AS enough FROM d GROUP BY 1)
SELECT point_id, rank, dist_m FROM (SELECT d.*, row_number() OVER (PARTITION BY d.point_id ORDER BY dist_m, stop_id) AS rank FROM d JOIN n USING (point_id) WHERE boxed OR NOT enough) WHERE rank <= 10""")
def _(w):
    return stops.nearest_stops(_points(w), derived.stop_places(w.spark, w.sf_dir), n=10)


@query("approaching_buses", "point_id n", """
WITH d AS (SELECT p.event_id AS point_id, s.stop_id, 2*6371000.0*asin(sqrt(pow(sin(radians(s.lat-p.lat)/2),2) + cos(radians(p.lat))*cos(radians(s.lat))*pow(sin(radians(s.lon-p.lon)/2),2))) AS dist_m FROM near_pts p, places s WHERE abs(s.lat-p.lat) < 0.02 AND abs(s.lon-p.lon) < 0.028),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist_m, stop_id) AS rank FROM d)
SELECT point_id, count(*) AS n FROM r WHERE rank <= 10 AND dist_m <= 140 AND CAST(stop_id AS INT) % 30 <= 15 GROUP BY 1""")
def _(w):
    near = stops.nearest_stops(_points(w), derived.stop_places(w.spark, w.sf_dir), n=10, max_m=140.0)
    preds = w.stops.select("stop_id", (F.col("stop_id").cast("int") % 30).alias("eta_min"), F.lit("B1").alias("vehicle_id"))
    return stops.approaching_buses(near, preds, max_m=140.0).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


def _lines(w):
    if not hasattr(w, "lines"):
        raw = w.shape_pts.select("shape_id", "seq", "lat", "lon")
        w.lines = stage(stops.pattern_lines(raw), "lines")
    return w.lines


relation("line_pts", """
SELECT shape_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, round(sum(step) OVER (PARTITION BY shape_id ORDER BY seq), 1) AS cum FROM (
 SELECT *, coalesce(2*6371000.0*asin(sqrt(pow(sin(radians(lat-pl)/2),2) + cos(radians(pl))*cos(radians(lat))*pow(sin(radians(lon-po)/2),2))), 0.0) AS step FROM (
  SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS po FROM shape_pts WINDOW w AS (PARTITION BY shape_id ORDER BY seq)))""")
relation("line_segs", "SELECT * FROM (SELECT shape_id, seq, lat AS la, lon AS lo, cum, lead(lat) OVER w AS lb, lead(lon) OVER w AS lob FROM line_pts WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) WHERE lb IS NOT NULL")
relation("progress", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(d2, 6), seq) AS rn FROM (
 SELECT event_id, shape_id, trip_id, event_type, seq, cum + f*sqrt((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)) AS progress_m, (px-ax-f*(bx-ax))*(px-ax-f*(bx-ax)) + (py-ay-f*("by"-ay))*(py-ay-f*("by"-ay)) AS d2 FROM (
  SELECT *, greatest(0.0, least(1.0, ((px-ax)*(bx-ax)+(py-ay)*("by"-ay))/((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)))) AS f FROM (
   SELECT p.event_id, p.shape_id, p.trip_id, p.event_type, s.seq, s.cum, p.lon*mx AS px, p.lat*110540.0 AS py, s.lo*mx AS ax, s.la*110540.0 AS ay, s.lob*mx AS bx, s.lb*110540.0 AS "by"
   FROM (SELECT *, 111320.0*cos(radians(lat)) AS mx FROM pings) p JOIN line_segs s ON s.shape_id = p.shape_id)))) WHERE rn = 1""")


def _located(w):
    lines = _lines(w)
    pings = w.pings.withColumn("pattern_id", F.substring("shape_id", 4, 5).cast("int").cast("string"))
    return stops.project_on_pattern(pings, lines.select("pattern_id", "line"))


@query("project_on_pattern", "event_id progress_m:2 offset_m:3", "SELECT *, sqrt(d2) AS offset_m FROM progress")
def _(w):
    return _located(w)


def _stop_lists(w):
    return stops.pattern_stop_lists(w.near_stops.withColumn("pattern_id", F.substring("shape_id", 4, 5).cast("int").cast("string")))


relation("next_stops", """
SELECT p.event_id, coalesce(a.stop_id, l.stop_id) AS sid, CASE WHEN p.event_id % 45 <= 30 THEN coalesce(a.stop_id, l.stop_id) END AS next_stop_id, CASE WHEN p.event_id % 45 <= 30 THEN coalesce(a.stop_seq, l.stop_seq) END AS next_seq, p.shape_id
FROM (SELECT *, progress_m - 27.43 AS at FROM progress) p ASOF LEFT JOIN (SELECT shape_id, dist_m, stop_id, stop_seq FROM stops) a ON a.shape_id = p.shape_id AND a.dist_m >= p.at
LEFT JOIN (SELECT shape_id, arg_max(stop_id, stop_seq) AS stop_id, max(stop_seq) AS stop_seq FROM stops GROUP BY 1) l ON l.shape_id = p.shape_id""")


def _next(w):
    return stops.next_stop(_located(w).withColumn("accuracy_m", (F.col("event_id") % 45).cast("double")), _stop_lists(w))


@query("next_stop", "event_id next_stop_id", "SELECT * FROM next_stops")
def _(w):
    return _next(w)


@query("upcoming_stops", "point_id place stop_id is_terminus", """
WITH u AS (SELECT n.event_id AS point_id, s.stop_id, row_number() OVER (PARTITION BY n.event_id ORDER BY s.stop_seq) AS rn, count(*) OVER (PARTITION BY n.event_id) AS c FROM next_stops n JOIN stops s ON s.shape_id = n.shape_id AND s.stop_seq >= n.next_seq)
SELECT point_id, CASE WHEN rn <= 3 THEN rn ELSE 4 END AS place, stop_id, rn > 3 AS is_terminus FROM u WHERE rn <= 3 OR rn = c""")
def _(w):
    return stops.upcoming_stops(_next(w).withColumnRenamed("event_id", "point_id"), _stop_lists(w))


@query("simplify_shape", "shape_id seq lat:6 lon:6", """
WITH RECURSIVE pts AS (SELECT p.shape_id, seq, lat, lon, lon*111320.0*cos(radians(lat0)) AS x, lat*110540.0 AS y FROM shape_pts p JOIN (SELECT shape_id, arg_min(lat, seq) AS lat0 FROM shape_pts GROUP BY 1) f USING (shape_id)),
chords AS (
 SELECT shape_id, min(seq) AS a, max(seq) AS b FROM pts GROUP BY 1
 UNION ALL
 SELECT shape_id, CASE WHEN side = 0 THEN a ELSE m END AS a, CASE WHEN side = 0 THEN m ELSE b END AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY shape_id, a, b ORDER BY off DESC, m) AS rn FROM (
   SELECT c.shape_id, c.a, c.b, p.seq AS m, sqrt(pow(p.x - pa.x - share*(pb.x - pa.x), 2) + pow(p.y - pa.y - share*(pb.y - pa.y), 2)) AS off
   FROM chords c JOIN pts pa ON pa.shape_id = c.shape_id AND pa.seq = c.a JOIN pts pb ON pb.shape_id = c.shape_id AND pb.seq = c.b JOIN pts p ON p.shape_id = c.shape_id AND p.seq > c.a AND p.seq < c.b,
   LATERAL (SELECT CASE WHEN pow(pb.x-pa.x, 2) + pow(pb.y-pa.y, 2) > 0 THEN greatest(0.0, least(1.0, ((p.x-pa.x)*(pb.x-pa.x) + (p.y-pa.y)*(pb.y-pa.y))/(pow(pb.x-pa.x, 2) + pow(pb.y-pa.y, 2)))) ELSE 0.0 END AS share) z) d) r,
  (VALUES (0), (1)) v(side) WHERE rn = 1 AND off > 40.0)
SELECT shape_id, seq, lat, lon FROM pts WHERE EXISTS (SELECT 1 FROM chords c WHERE c.shape_id = pts.shape_id AND seq IN (c.a, c.b))""")
def _(w):
    return stops.simplify_shape(w.shape_pts, eps_m=40.0)


@query("project_stops", "stop_id dist_m:1", """
SELECT stop_id, round(m, 1) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY round(d2, 6), seq) AS rn FROM (
 SELECT stop_id, seq, cum + f*sqrt((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)) AS m, (px-ax-f*(bx-ax))*(px-ax-f*(bx-ax)) + (py-ay-f*("by"-ay))*(py-ay-f*("by"-ay)) AS d2 FROM (
  SELECT *, greatest(0.0, least(1.0, ((px-ax)*(bx-ax)+(py-ay)*("by"-ay))/((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)))) AS f FROM (
   SELECT p.stop_id, s.seq, s.cum, p.lon*mx AS px, p.lat*110540.0 AS py, s.lo*mx AS ax, s.la*110540.0 AS ay, s.lob*mx AS bx, s.lb*110540.0 AS "by"
   FROM (SELECT *, 111320.0*cos(radians(lat)) AS mx FROM places) p JOIN line_segs s ON s.shape_id = p.shape_id)))) WHERE rn = 1""")
def _(w):
    lines = _lines(w)
    places = derived.stop_places(w.spark, w.sf_dir).withColumn("pattern_id", F.substring("shape_id", 4, 5).cast("int").cast("string"))
    return stops.project_stops(places.select("stop_id", "pattern_id", "lat", "lon", "dist_m"), lines)


@query("stop_bundles", "pattern_id n_stops n_near", """
SELECT CAST(CAST(substr(r.shape_id, 4) AS INT) AS VARCHAR) AS pattern_id, count(*) AS n_stops, count(*) FILTER (n.is_near_side AND c.shape_dist_ft IS NOT NULL) AS n_near
FROM (SELECT shape_id, min(trip_id) AS trip_id FROM gtfs_trips GROUP BY 1) r JOIN stop_times c ON c.trip_id = r.trip_id JOIN near_stops n ON n.stop_id = c.stop_id GROUP BY 1""")
def _(w):
    _, listed, _ = stops.stop_bundles(
        derived.gtfs_trips(w.spark, w.sf_dir), derived.gtfs_stop_times(w.spark, w.sf_dir), derived.stop_places(w.spark, w.sf_dir), w.shape_pts, w.controls
    )
    return listed.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_stops"), F.sum(F.col("is_near_side").cast("long")).alias("n_near"))
