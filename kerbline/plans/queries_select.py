"""Selection, source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.functions import curve, geo, text, timeutil
from kerbline.operators import select, stops
from kerbline.operators.ordered import cum_sum, islands, scan
from kerbline.operators.quantiles import quantiles
from kerbline.operators.stage import new_path
from kerbline.plans import derived
from kerbline.plans.oracle import relation, snap
from kerbline.plans.registry import query
from kerbline.plans.workspace import TRIP
from kerbline.sources import readers, schemas, sinks

# Archive scans --------------------------------------------------------------------

relation("archive", """
SELECT 'cta' AS agency, CAST(event_id AS VARCHAR) AS entity_id, bus_id AS vehicle_id, route_id, trip_id, ts AS "timestamp", lat AS latitude, lon AS longitude, event_id, c.copy,
  year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour FROM pings, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR event_id % 11 = 0""")


def _archive(w, route: str | None = None):
    """The archive as files by agency, year, month, day and hour."""
    if not hasattr(w, "archive_path"):
        path = new_path(w.spark, "archive")
        derived.archive_pings(w.spark, w.sf_dir).repartition("day", "hour").write.partitionBy("agency", "year", "month", "day", "hour").parquet(path)
        w.archive_path = path
    return readers.scan_archive(w.spark, w.archive_path, route)


@query("scan_archive", "entity_id vehicle_id route_id trip_id latitude:6 longitude:6 hour", "SELECT * FROM archive WHERE route_id = '22'")
def _(w):
    return _archive(w, "22")


@query("archive_hours", "agency year month day hour", "SELECT DISTINCT agency, year, month, day, hour FROM archive")
def _(w):
    _archive(w)
    return readers.archive_hours(w.spark, w.archive_path, "cta")


relation("recent_hours", "SELECT DISTINCT year, month, day, hour FROM archive ORDER BY 1 DESC, 2 DESC, 3 DESC, 4 DESC LIMIT 2")


@query("scan_recent_hours", "entity_id hour", "SELECT entity_id, a.hour FROM archive a JOIN recent_hours r ON a.year = r.year AND a.month = r.month AND a.day = r.day AND a.hour = r.hour")
def _(w):
    _archive(w)
    return readers.scan_recent_hours(w.spark, w.archive_path, 2)


@query("scan_hours_from", "entity_id hour", "SELECT entity_id, hour FROM archive WHERE make_timestamp(year, month, day, hour, 0, 0.0) >= TIMESTAMP '2024-01-01 13:00:00'")
def _(w):
    return readers.scan_hours_from(_archive(w), "2024-01-01 13:00:00")


relation("requests", "SELECT trip_id AS request_id, route_id, bus_id AS vehicle_id, trip_id, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) AS end_ms FROM pings GROUP BY route_id, bus_id, trip_id")


def _requests(w):
    return w.pings.groupBy("route_id", F.col("bus_id").alias("vehicle_id"), "trip_id").agg(
        F.unix_millis(F.min("ts")).alias("start_ms"), F.unix_millis(F.max("ts")).alias("end_ms")
    ).withColumn("request_id", F.col("trip_id"))


@query("hours_spanned", "request_id hour_ms", "SELECT request_id, unnest(range(start_ms // 3600000 - 1, end_ms // 3600000 + 2)) * 3600000 AS hour_ms FROM requests")
def _(w):
    return _requests(w).select("request_id", F.explode(readers.hours_spanned(F.col("start_ms"), F.col("end_ms"))).alias("h")).withColumn("hour_ms", F.unix_millis("h"))


@query("trip_pings", "request_id bus_id route_id avl_event_time latitude:6 longitude:6 epoch_ms", """
SELECT request_id, a.vehicle_id AS bus_id, a.route_id, strftime(a."timestamp", '%Y-%m-%d %H:%M:%S.%f') AS avl_event_time, latitude, longitude, (epoch_us(a."timestamp") // 1000) AS epoch_ms
FROM archive a JOIN requests r ON a.trip_id = r.trip_id AND a.vehicle_id = r.vehicle_id AND a.route_id = r.route_id""")
def _(w):
    return readers.trip_pings(_requests(w), _archive(w))


@query("write_avl_csv", "id bus_id avl_event_time route_id pattern_id trip_id heading garage", """
SELECT entity_id || '_' || strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') || 'Z' AS id, vehicle_id AS bus_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS avl_event_time,
  route_id, '3936' AS pattern_id, trip_id, '' AS heading, '' AS garage FROM archive""")
def _(w):
    return sinks.avl_rows(_archive(w), "3936")


@query("canonical_trace", "trip_id bus_id route_id pattern_id latitude:6 longitude:6 ms", "SELECT trip_id, bus_id, route_id, pattern_id, lat AS latitude, lon AS longitude, (epoch_us(ts) // 1000) AS ms FROM pings")
def _(w):
    raw = w.pings.select("trip_id", "bus_id", F.col("route_id").cast("int").alias("route_id"), "pattern_id", timeutil.event_time_text(F.col("ts")).alias("avl_event_time"),
                         F.col("lat").alias("latitude"), F.col("lon").cast("string").alias("longitude"))
    return schemas.canonical_trace(raw).withColumn("ms", F.unix_millis("avl_event_time"))


@query("scan_shapes", "shape_id seq lat:6 lon:6 dist_m:3", "SELECT * FROM shape_pts")
def _(w):
    return readers.shape_points(derived.shape_pts_ft(w.spark, w.sf_dir))


# Schedule ----------------------------------------------------------------------------

relation("gtfs_trips", "SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(22 + (o_custkey // 50) % 5 AS VARCHAR) AS route_id, '678' || lpad(CAST(o_custkey // 50 AS VARCHAR), 5, '0') AS shape_id, CAST(o_orderkey % 2 AS VARCHAR) AS direction_id FROM orders")
relation("stop_times", "SELECT t.trip_id, s.stop_id, s.stop_seq AS stop_sequence, CASE WHEN s.stop_seq % 17 <> 16 THEN round(s.dist_m*3.28084, 1) END AS shape_dist_ft FROM gtfs_trips t JOIN stops s ON s.shape_id = t.shape_id")


@query("list_shapes", "shape_id", "SELECT DISTINCT shape_id FROM gtfs_trips WHERE CAST(route_id AS INT) % 2 = 0")
def _(w):
    trips = derived.gtfs_trips(w.spark, w.sf_dir)
    routes = trips.select("route_id").distinct().withColumn("route_type", F.when(F.col("route_id").cast("int") % 2 == 0, 3).otherwise(1))
    return stops.list_shapes(trips, routes, 3)


@query("route_shape_map", "route_id shape_id", "SELECT * FROM route_shapes")
def _(w):
    return stops.route_shape_map(derived.gtfs_trips(w.spark, w.sf_dir))


@query("representative_trip", "shape_id trip_id", "SELECT shape_id, min(trip_id) AS trip_id FROM gtfs_trips GROUP BY 1")
def _(w):
    return stops.representative_trip(derived.gtfs_trips(w.spark, w.sf_dir), "shape_id")


@query("route_stops", "shape_id stop_id name stop_sequence dist_m:3", """
SELECT r.shape_id, c.stop_id, s.name, c.stop_sequence, c.shape_dist_ft/3.28084 AS dist_m FROM (SELECT shape_id, min(trip_id) AS trip_id FROM gtfs_trips GROUP BY 1) r
JOIN stop_times c ON c.trip_id = r.trip_id JOIN stops s ON s.stop_id = c.stop_id WHERE c.shape_dist_ft IS NOT NULL""")
def _(w):
    return stops.route_stops(derived.gtfs_trips(w.spark, w.sf_dir), derived.gtfs_stop_times(w.spark, w.sf_dir), w.stops)


# Filters -------------------------------------------------------------------------------


@query("filter_revenue", "o_orderkey route_id", """
SELECT * FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '22' WHEN 1 THEN '992' WHEN 2 THEN 'PI' || o_custkey WHEN 3 THEN 'DH1' WHEN 4 THEN '0' WHEN 5 THEN 'X49' ELSE 'PO9' END AS route_id FROM orders)
WHERE route_id IN ('22', 'X49')""")
def _(w):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = (F.when(o % 7 == 0, "22").when(o % 7 == 1, "992").when(o % 7 == 2, F.concat(F.lit("PI"), c)).when(o % 7 == 3, "DH1").when(o % 7 == 4, "0").when(o % 7 == 5, "X49").otherwise("PO9"))
    return select.filter_revenue(derived.table(w.spark, w.sf_dir, "orders").select("o_orderkey", kinds.alias("route_id")))


@query("filter_deadhead", "event_id route_id", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '992' ELSE route_id END AS route_id FROM pings WHERE event_id % 3 <> 0")
def _(w):
    return select.filter_deadhead(w.pings.withColumn("route_id", F.when(F.col("event_id") % 3 == 0, "992").otherwise(F.col("route_id"))))


@query("filter_route_pattern", "event_id", "SELECT event_id FROM pings WHERE route_id = '23' AND pattern_id = '1'")
def _(w):
    return select.filter_route_pattern(w.pings, "23", "1")


@query("filter_city_bbox", "event_id", "SELECT event_id FROM pings WHERE lat BETWEEN 41.9 AND 42.0 AND lon BETWEEN -87.68 AND -87.62")
def _(w):
    return select.filter_city_bbox(w.pings, 41.95, -87.65, 0.05, 0.03)


@query("filter_bus_stops", "shape_id stop_id", "SELECT shape_id, stop_id FROM stops WHERE stop_seq % 9 <> 8 AND CAST(stop_id AS INT) < 30000")
def _(w):
    return stops.filter_bus_stops(derived.stop_places(w.spark, w.sf_dir), "cta")


@query("dedupe_pings", "vehicle_id ms latitude:6 longitude:6 trip_id", """
SELECT vehicle_id, (epoch_us("timestamp") // 1000) AS ms, min(latitude) AS latitude, arg_min(longitude, (latitude, longitude)) AS longitude, arg_min(trip_id, (latitude, longitude)) AS trip_id
FROM archive GROUP BY vehicle_id, "timestamp" """)
def _(w):
    return select.dedupe_pings(_archive(w), "vehicle_id", "timestamp").withColumn("ms", F.unix_millis("timestamp"))


@query("drop_repeated_fixes", "event_id bus_id", """
SELECT event_id, bus_id FROM (SELECT *, lag(la) OVER w AS pl, lag(lo) OVER w AS po, row_number() OVER w AS rn FROM (SELECT *, round(lat, 2) AS la, round(lon, 2) AS lo FROM pings)
WINDOW w AS (PARTITION BY bus_id ORDER BY ts, event_id)) WHERE rn = 1 OR la IS DISTINCT FROM pl OR lo IS DISTINCT FROM po""")
def _(w):
    return select.drop_repeated_fixes(w.pings.withColumn("lat", F.round("lat", 2)).withColumn("lon", F.round("lon", 2)))


relation("acc_pings", "SELECT *, CASE WHEN event_id % 10 <> 0 THEN CAST((event_id*7) % 90 AS DOUBLE) END AS accuracy_m FROM clocked")


def _accurate(w):
    return w.clocked.withColumn("accuracy_m", F.when(F.col("event_id") % 10 != 0, ((F.col("event_id") * 7) % 90).cast("double")))


@query("filter_accuracy", "trip_id t:3", """
SELECT trip_id, t FROM (SELECT *, count(*) OVER (PARTITION BY trip_id) AS c FROM (SELECT DISTINCT trip_id, t FROM acc_pings WHERE accuracy_m IS NULL OR accuracy_m <= 50)) WHERE c >= 30""")
def _(w):
    rows = _accurate(w).select("trip_id", "t", "lat", "lon", "accuracy_m", "event_id")
    return select.filter_accuracy(rows, TRIP)


@query("pick_dense_trips", "trip_id n_pings median_acc_m:1", """
SELECT * FROM (SELECT trip_id, count(*) AS n_pings, coalesce(list_sort(list(accuracy_m) FILTER (accuracy_m IS NOT NULL))[count(accuracy_m)//2 + 1], 1e9) AS median_acc_m FROM acc_pings GROUP BY 1)
WHERE n_pings >= 60 AND median_acc_m <= 45""")
def _(w):
    return select.pick_dense_trips(_accurate(w), TRIP, 60, 45.0)


# Trip summaries ------------------------------------------------------------------------

_MED = "median({0}) OVER (PARTITION BY trip_id)"


@query("ping_gaps", "event_id gap_s:3", "SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trip_id ORDER BY ts, event_id)))/1e6 AS gap_s FROM pings")
def _(w):
    return select.ping_gaps(w.pings, TRIP)


relation("gap_rows", "SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trip_id ORDER BY ts, event_id)))/1e6 AS gap_s FROM pings")


@query("gap_stats", "trip_id n_pings max_gap_s:3 median_gap_s:3", "SELECT trip_id, count(*) AS n_pings, max(gap_s) AS max_gap_s, quantile_cont(gap_s, 0.5) AS median_gap_s FROM gap_rows GROUP BY 1")
def _(w):
    return select.gap_stats(w.pings, TRIP)


relation("summary", """
SELECT trip_id, min(bus_id) AS bus_id, count(*) AS n_pings, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(lat, (ts, event_id)) AS first_lat, arg_max(lat, (ts, event_id)) AS last_lat,
  arg_min(lat, (ts, event_id)) - arg_max(lat, (ts, event_id)) AS lat_span, (epoch_us(max(ts)) - epoch_us(min(ts)))/1e6 AS dur_s FROM pings GROUP BY 1""")


@query("trip_summary", "trip_id bus_id n_pings first_lat:6 last_lat:6 lat_span:6 dur_s:3", "SELECT * FROM summary")
def _(w):
    return select.trip_summary(w.pings, TRIP)


@query("trip_index", "trip_uid service_date n_pings dur_min:4 first_local", """
SELECT trip_id || '_' || bus_id || '_' || strftime(loc, '%Y-%m-%d') AS trip_uid, strftime(loc, '%Y-%m-%d') AS service_date, n_pings, dur_s/60 AS dur_min, strftime(loc, '%Y-%m-%d %H:%M:%S') AS first_local
FROM (SELECT *, first_ts - INTERVAL 6 HOUR AS loc FROM summary)""")
def _(w):
    return select.trip_index(w.pings)


relation("door_log", """
SELECT event_id, bus_id, trip_id, route_id, ts, CAST(3 + event_id % 3 AS INT) AS event_type, least(value, 400.0) AS dwell_s,
  CAST(CAST(pattern_id AS BIGINT)*1000 + 2*least(23, CAST(floor(true_m/667.92) AS BIGINT)) AS VARCHAR) AS stop_id,
  event_id % 5 AS fon, event_id % 2 AS ron, event_id % 3 AS foff, 0 AS roff, event_id % 40 AS passenger_load, min(ts) OVER (PARTITION BY trip_id) AS trip_start
FROM pings WHERE event_type = 'purchase'""")


def door_log(w):
    doors = derived.door_events(w.spark, w.sf_dir)
    start = doors.groupBy("trip_id").agg(F.min("ts").alias("trip_start"))
    return doors.join(start, "trip_id")


@query("trip_table", "trip_key route_id n_events n_door duration_s:3", """
SELECT bus_id || '_' || trip_id || '_' || strftime(min(ts), '%Y%m%d%H%M%S') AS trip_key, arg_min(route_id, (-rc, route_id)) AS route_id, count(*) AS n_events,
  CAST(sum(CASE WHEN event_type IN (3,4,5) THEN 1 ELSE 0 END) AS BIGINT) AS n_door, (epoch_us(max(ts)) - epoch_us(min(ts)))/1e6 AS duration_s
FROM (SELECT *, count(*) OVER (PARTITION BY bus_id, trip_id, trip_start, route_id) AS rc FROM (SELECT * REPLACE (CASE WHEN event_id % 9 < 4 THEN '151' ELSE route_id END AS route_id) FROM door_log)) GROUP BY bus_id, trip_id, trip_start""")
def _(w):
    return select.trip_table(door_log(w).withColumn("route_id", F.when(F.col("event_id") % 9 < 4, "151").otherwise(F.col("route_id"))))


# Gates -----------------------------------------------------------------------------------

relation("gate_match", snap("pings", "trip_id, bus_id, shape_id, event_id, ts, lat, lon", "event_id", 80.0))
relation("gate_rows", """
SELECT *, coalesce(sum(CAST(hit AS INT)) OVER (PARTITION BY trip_id, bus_id, sd ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trip_id, bus_id, sd ORDER BY ts, event_id)))/1e6 AS gap FROM (
 SELECT m.*, CAST(ts - INTERVAL 6 HOUR AS DATE) AS sd, dist_m >= len - 4000.0 AND on_route AS hit FROM gate_match m JOIN (SELECT shape_id, max(shape_len_m) AS len FROM shapes GROUP BY 1) l USING (shape_id))""")
relation("ledger", """
SELECT trip_id, bus_id, n_all, n_in, CASE WHEN n_all < 30 THEN 'too_few_pings' WHEN NOT d0 <= 600 THEN 'not_starting_at_origin' WHEN reached = 0 THEN 'no_terminal_reach' WHEN n_in < 30 THEN 'too_few_pings'
  WHEN gap > 200 THEN 'gap_too_long' WHEN dur <= 0 OR dur > 14400 THEN 'too_long' WHEN lat1 >= lat0 THEN 'not_sb' WHEN lat0 - lat1 < 0.1 THEN 'lat_span_too_small'
  WHEN epoch_us(t1)/1e6 > (SELECT epoch_us(max(ts))/1e6 FROM pings) - 300 THEN 'after_cutoff' ELSE 'kept' END AS reason FROM (
 SELECT trip_id, bus_id, count(*) AS n_all, arg_min(dist_m, (ts, event_id)) AS d0, max(CAST(hit AS INT)) AS reached, count(*) FILTER (before = 0) AS n_in, max(gap) FILTER (before = 0) AS gap,
  (epoch_us(max(ts) FILTER (before = 0)) - epoch_us(min(ts) FILTER (before = 0)))/1e6 AS dur, max(ts) FILTER (before = 0) AS t1,
  arg_min(lat, (ts, event_id)) FILTER (before = 0) AS lat0, arg_max(lat, (ts, event_id)) FILTER (before = 0) AS lat1 FROM gate_rows GROUP BY trip_id, bus_id, sd)""")


def _gated(w):
    return select.select_full_trips(w.pings, w.shapes, terminal_m=4000.0, max_gap_s=200.0, min_lat_span=0.1)


@query("select_full_trips", "trip_id bus_id n_all n_in reason", "SELECT * FROM ledger")
def _(w):
    return _gated(w)[1]


@query("gate_reasons", "reason n", "SELECT reason, count(*) AS n FROM ledger GROUP BY 1")
def _(w):
    return select.reason_counts(_gated(w)[1])


@query("truncate_at_terminal", "event_id dist_m:3", "SELECT g.event_id, g.dist_m FROM gate_rows g JOIN ledger l ON l.trip_id = g.trip_id AND l.bus_id = g.bus_id WHERE before = 0 AND reason = 'kept'")
def _(w):
    return _gated(w)[0]


@query("first_hit_truncate", "event_id", """
SELECT event_id FROM (SELECT *, coalesce(sum(CAST(d >= 8000 AS INT)) OVER (PARTITION BY trip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h, event_id AS e FROM trace) WHERE h = 0""")
def _(w):
    return select.first_hit_truncate(w.trace, TRIP, ["i"], F.floor(F.col("i") / 4096), F.col("d") >= 8000.0)


_DONE = "epoch_us(last_ts)/1e6 <= (SELECT epoch_us(max(ts))/1e6 FROM pings) - 300"


@query("select_latenight_trips", "trip_id n_pings dur_s:3", f"SELECT * FROM summary WHERE {_DONE} AND n_pings >= 30 AND dur_s > 0 AND dur_s <= 14400 AND last_lat < first_lat AND lat_span >= 0.12 AND (hour(first_ts - INTERVAL 6 HOUR) >= 7 OR hour(first_ts - INTERVAL 6 HOUR) < 5)")
def _(w):
    return select.select_latenight_trips(w.pings, from_hour=7, to_hour=5)


@query("select_recent_trips", "trip_id n_pings", f"(SELECT * FROM summary WHERE {_DONE} AND n_pings >= 30 AND dur_s > 0 AND dur_s <= 14400 AND lat_span >= 0.1 ORDER BY last_ts DESC, trip_id LIMIT 5) UNION SELECT * FROM summary WHERE trip_id IN ('T1', 'T2')")
def _(w):
    return select.select_recent_trips(w.pings, 5, min_lat_span=0.1, forced=["T1", "T2"])


@query("select_first_trips", "trip_id n_pings", f"SELECT * FROM summary WHERE {_DONE} AND first_ts >= TIMESTAMP '2024-01-01 12:03:00' AND dur_s <= 10800 ORDER BY first_ts, trip_id LIMIT 4")
def _(w):
    return select.select_first_trips(w.pings, "2024-01-01 12:03:00", 4)


relation("windows", "SELECT trip_id AS trip_key, bus_id, route_id, min(ts) + INTERVAL 10 MINUTE AS t_lo, min(ts) + INTERVAL 30 MINUTE AS t_hi, 1200.0 AS duration_s FROM pings GROUP BY trip_id, bus_id, route_id")
relation("windowed", "SELECT w.trip_key, p.event_id, p.ts, p.lat, p.lon, w.route_id FROM pings p JOIN windows w ON p.bus_id = w.bus_id AND epoch_us(p.ts)/1e6 BETWEEN epoch_us(w.t_lo)/1e6 - 60 AND epoch_us(w.t_hi)/1e6 + 60")


def windows_of(w):
    start = w.pings.groupBy(F.col("trip_id").alias("trip_key"), "bus_id", "route_id").agg(F.min("ts").alias("__t"))
    return start.select(
        "trip_key", "bus_id", "route_id", (F.col("__t") + F.expr("interval 10 minutes")).alias("t_lo"), (F.col("__t") + F.expr("interval 30 minutes")).alias("t_hi"),
        F.lit(1200.0).alias("duration_s"),
    )


@query("pings_in_trip_window", "trip_key event_id", "SELECT trip_key, event_id FROM windowed")
def _(w):
    return select.pings_in_trip_window(w.pings.drop("route_id"), windows_of(w))


relation("trimmed", """
SELECT r.* FROM pings r JOIN (SELECT trip_id, coalesce(min(CASE WHEN da > 400 THEN epoch_us(ts)/1e6 END), min(epoch_us(ts)/1e6)) - 20 AS lo, coalesce(max(CASE WHEN db > 400 THEN epoch_us(ts)/1e6 END), max(epoch_us(ts)/1e6)) + 20 AS hi FROM (
 SELECT *, 6371000.0*sqrt(pow(radians(lat)-radians(la),2) + pow((radians(lon)-radians(lo))*cos(radians(la)),2)) AS da, 6371000.0*sqrt(pow(radians(lat)-radians(lb),2) + pow((radians(lon)-radians(lob))*cos(radians(lb)),2)) AS db FROM (
  SELECT *, first_value(lat) OVER w AS la, first_value(lon) OVER w AS lo, last_value(lat) OVER w AS lb, last_value(lon) OVER w AS lob FROM pings
  WINDOW w AS (PARTITION BY trip_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) GROUP BY 1) e ON e.trip_id = r.trip_id AND epoch_us(r.ts)/1e6 BETWEEN e.lo AND e.hi""")


@query("trim_stationary_ends", "trip_id event_id", "SELECT * FROM trimmed")
def _(w):
    return select.trim_stationary_ends(w.pings, TRIP, 400.0)


@query("select_benchmark_trips", "trip_key n_pings reason", """
WITH g AS (SELECT trip_key, count(*) AS n, quantile_cont(gap, 0.5) AS med, max(gap) AS mx FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trip_key ORDER BY ts, event_id)))/1e6 AS gap FROM windowed) GROUP BY 1)
SELECT w.trip_key, coalesce(n, 0) AS n_pings, CASE WHEN coalesce(n, 0) < 120 THEN 'too_few_pings' WHEN med > 12 OR mx > 60 THEN 'cadence_gap' ELSE 'fit' END AS reason FROM windows w LEFT JOIN g USING (trip_key)""")
def _(w):
    rows = select.select_benchmark_trips(
        w.pings, windows_of(w), stops.route_shape_map(derived.gtfs_trips(w.spark, w.sf_dir)), w.shapes, min_pings=120, max_cadence_s=12.0, max_gap_s=60.0
    )
    early = F.col("reason").isin("too_few_pings", "cadence_gap", "bad_duration")
    return rows.withColumn("reason", F.when(early, F.col("reason")).otherwise("fit"))


@query("is_degenerate", "trip_id net_m:3 on_share:4 degenerate", """
SELECT *, net_m < 11000 OR on_share < 0.99 AS degenerate FROM (SELECT trip_id, arg_max(dist_m, (ts, event_id)) FILTER (on_route) - arg_min(dist_m, (ts, event_id)) FILTER (on_route) AS net_m, avg(CAST(on_route AS DOUBLE)) AS on_share FROM matched GROUP BY 1)""")
def _(w):
    return select.is_degenerate(w.matched, TRIP, 11000.0, 0.99)


@query("latest_n", "trip_id", "SELECT trip_id FROM summary ORDER BY last_ts DESC, trip_id LIMIT 7")
def _(w):
    return select.latest_n(select.trip_summary(w.pings, TRIP), "last_ts", 7, "trip_id")


@query("pick_trip_in_window", "bus_id trip_id n_pings inside", """
SELECT bus_id, trip_id, n_pings, inside FROM (SELECT *, row_number() OVER (PARTITION BY bus_id ORDER BY inside DESC, n_pings DESC, trip_id) AS rn FROM (
 SELECT *, first_ts >= TIMESTAMP '2024-01-01 12:01:00' AND last_ts <= TIMESTAMP '2024-01-01 13:10:00' AS inside FROM summary)) WHERE rn = 1""")
def _(w):
    return select.pick_trip_in_window(w.pings, "2024-01-01 12:01:00", "2024-01-01 13:10:00")


@query("sample_trips", "trip_id", "SELECT trip_id FROM summary ORDER BY md5(trip_id || ':7'), trip_id LIMIT 10")
def _(w):
    return select.sample_trips(select.trip_summary(w.pings, TRIP), 10, 7)


@query("sample_pings", "bus_id n", "SELECT bus_id, least(count(*), 100) AS n FROM pings GROUP BY 1")
def _(w):
    return select.sample_pings(w.pings, "bus_id", 100, 7).groupBy("bus_id").agg(F.count(F.lit(1)).alias("n"))


relation("clustered", """
SELECT *, CAST(sum(CASE WHEN gap_s > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY ts, event_id) AS BIGINT) AS cluster_no FROM gap_rows""")


@query("time_clusters", "event_id cluster_no", "SELECT * FROM clustered")
def _(w):
    return select.time_clusters(w.pings, TRIP, 120.0).withColumn("cluster_no", F.col("cluster_no").cast("long"))


relation("rides", "SELECT trip_id, min(ts) + INTERVAL 12 MINUTE AS start_ts, min(ts) + INTERVAL 25 MINUTE AS end_ts FROM pings GROUP BY 1")


def rides_of(w):
    first = w.pings.groupBy("trip_id").agg(F.min("ts").alias("__t"))
    return first.select("trip_id", (F.col("__t") + F.expr("interval 12 minutes")).alias("start_ts"), (F.col("__t") + F.expr("interval 25 minutes")).alias("end_ts"))


@query("best_cluster", "event_id", """
WITH near AS (SELECT p.*, r.start_ts, r.end_ts FROM pings p JOIN rides r USING (trip_id) WHERE epoch_us(ts)/1e6 BETWEEN epoch_us(start_ts)/1e6 - 600 AND epoch_us(end_ts)/1e6 + 600),
g AS (SELECT *, sum(CASE WHEN gap > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY ts, event_id) AS c FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trip_id ORDER BY ts, event_id)))/1e6 AS gap FROM near)),
o AS (SELECT trip_id, c, least(max(epoch_us(ts)), max(epoch_us(end_ts))) - greatest(min(epoch_us(ts)), max(epoch_us(start_ts))) AS ov FROM g GROUP BY 1, 2)
SELECT g.event_id FROM g JOIN (SELECT trip_id, c FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ov DESC, c) AS rn FROM o) WHERE rn = 1) b ON b.trip_id = g.trip_id AND b.c = g.c""")
def _(w):
    return select.best_cluster(w.pings, rides_of(w), TRIP, pad_before_s=600.0, pad_after_s=600.0, gap_s=90.0)


@query("islands", "trip_id i0 i1 n lo:3 first_d:3 last_d:3", """
SELECT trip_id, min(i) AS i0, max(i) AS i1, count(*) AS n, min(gap) AS lo, arg_min(d, i) AS first_d, arg_max(d, i) AS last_d FROM (
 SELECT *, i - row_number() OVER (PARTITION BY trip_id ORDER BY i) AS run FROM (SELECT *, t - lag(t) OVER (PARTITION BY trip_id ORDER BY i) AS gap FROM trace) WHERE event_id % 5 <> 0) GROUP BY trip_id, run""")
def _(w):
    from kerbline.operators.ordered import previous

    rows = scan(w.trace, TRIP, ["i"], F.floor(F.col("i") / 16), __p=previous(F.col("t"))).withColumn("gap", F.col("t") - F.col("__p"))
    return islands(rows, TRIP, "i", F.floor(F.col("i") / 16), F.col("event_id") % 5 != 0, {
        "i0": ("min", F.col("i")), "i1": ("max", F.col("i")), "n": ("sum", F.lit(1).cast("long")), "lo": ("min", F.col("gap")),
        "first_d": ("first", F.col("d")), "last_d": ("last", F.col("d")),
    })


@query("running_totals", "event_id total:3", "SELECT event_id, sum(value) OVER (PARTITION BY bus_id ORDER BY ts, event_id) AS total FROM pings")
def _(w):
    return scan(w.pings, ["bus_id"], ["ts", "event_id"], select.ts_slice(), total=cum_sum(F.col("value")))


@query("exact_quantiles", "bus_id p5:4 p50:4 p95:4", "SELECT bus_id, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM pings GROUP BY 1")
def _(w):
    return quantiles(w.pings, ["bus_id"], F.col("value"), {"p5": 0.05, "p50": 0.5, "p95": 0.95})


@query("filter_catalog", "trip_id day observer", """
SELECT trip_id, strftime(first_ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS day, 'Observer ' || bus_id AS observer FROM summary WHERE lower('Observer ' || bus_id) LIKE '%b3%' AND strftime(first_ts - INTERVAL 6 HOUR, '%Y-%m-%d') BETWEEN '2024-01-01' AND '2024-01-02'""")
def _(w):
    trips = select.trip_summary(w.pings, TRIP).select("trip_id", F.date_format(timeutil.to_local(F.col("first_ts")), "yyyy-MM-dd").alias("day"), F.concat(F.lit("Observer "), "bus_id").alias("observer"), F.col("trip_id").alias("label"))
    return select.filter_catalog(trips, "2024-01-01", "2024-01-02", "B3")


# Functions --------------------------------------------------------------------------------


@query("identifiers", "event_id shape pattern uid utc_uid key digits vehicle ok n_int:s", r"""
SELECT event_id, '678' || lpad(pattern_id, 5, '0') AS shape, CAST(CAST(substr(shape_id, 4) AS INT) AS VARCHAR) AS pattern, trip_id || '_' || bus_id || '_' || strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS uid,
  strftime(ts, '%Y%m%d') || '_' || trip_id AS utc_uid, bus_id || '_' || trip_id || '_' || strftime(ts, '%Y%m%d%H%M%S') AS key, substr(trip_id, 2) AS digits, bus_id AS vehicle, event_id < 100000 AS ok,
  CASE WHEN event_id % 2 = 0 THEN CAST(trunc(value) AS INT) ELSE 0 END AS n_int FROM pings""")
def _(w):
    ts = F.col("ts")
    return w.pings.select(
        "event_id", text.shape_id_for_pattern(F.col("pattern_id")).alias("shape"), text.pattern_of_shape(F.col("shape_id")).alias("pattern"),
        text.trip_uid(F.col("trip_id"), F.col("bus_id"), timeutil.local_date(ts)).alias("uid"), text.utc_day_uid(ts, F.col("trip_id")).alias("utc_uid"),
        text.trip_key(F.col("bus_id"), F.col("trip_id"), ts).alias("key"), text.trailing_digits(F.concat("trip_id", F.lit("_x"))).alias("digits"),
        text.strip_agency_prefix(F.concat(F.lit("MTA_"), "bus_id")).alias("vehicle"), text.valid_vehicle_id(F.col("event_id").cast("string")).alias("ok"),
        text.safe_int(F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("bad")).alias("n_int"),
    )


@query("geo_functions", "event_id haversine:3 equirect:3 mx:1 my:1 bearing:4", """
SELECT event_id, 2*6371000.0*asin(sqrt(pow(sin(radians(41.9-lat)/2),2) + cos(radians(lat))*cos(radians(41.9))*pow(sin(radians(-87.6-lon)/2),2))) AS haversine,
  6371000.0*sqrt(pow(radians(41.9-lat),2) + pow(radians(-87.6-lon)*cos(radians(lat+41.9)/2),2)) AS equirect, radians(lon)*6378137.0 AS mx, ln(tan(0.7853981633974483 + radians(lat)/2))*6378137.0 AS my,
  fmod(degrees(atan2(sin(radians(-87.6-lon))*cos(radians(41.9)), cos(radians(lat))*sin(radians(41.9)) - sin(radians(lat))*cos(radians(41.9))*cos(radians(-87.6-lon)))) + 360, 360) AS bearing FROM pings""")
def _(w):
    at = F.lit(41.9), F.lit(-87.6)
    lat, lon = F.col("lat"), F.col("lon")
    return w.pings.select("event_id", geo.haversine_m(lat, lon, *at).alias("haversine"), geo.equirect_m(lat, lon, *at).alias("equirect"), geo.web_mercator_x(lon).alias("mx"), geo.web_mercator_y(lat).alias("my"), geo.bearing_deg(lat, lon, *at).alias("bearing"))


@query("clock_functions", "event_id ms text_us clock hour_local day_local strict_ms back_ms", """
SELECT event_id, (epoch_us(ts) // 1000) AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS text_us, strftime(ts, '%H:%M:%S.%g') AS clock, hour(ts - INTERVAL 6 HOUR) AS hour_local, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS day_local,
  (epoch_us(ts) // 1000) AS strict_ms, (epoch_us(ts) // 1000) AS back_ms FROM pings""")
def _(w):
    ts = F.col("ts")
    local = timeutil.to_local(ts)
    return w.pings.select(
        "event_id", timeutil.epoch_ms(ts).alias("ms"), timeutil.event_time_text(ts).alias("text_us"), timeutil.clock_ms_text(ts).alias("clock"), timeutil.local_hour(ts).cast("long").alias("hour_local"),
        F.date_format(timeutil.local_date(ts), "yyyy-MM-dd").alias("day_local"), F.unix_millis(timeutil.local_to_utc_strict(local)).alias("strict_ms"), timeutil.local_text_to_epoch_ms(timeutil.event_time_text(local)).alias("back_ms"),
    )


@query("kernel_and_bandwidth", "event_id kernel:5 bw eta:s", """
SELECT event_id, CASE WHEN value < 100 THEN pow(1 - pow(value/100.0, 3), 3) ELSE 0.0 END AS kernel, CAST(round_even(greatest(5.0, least(20.0, 40.0/value)), 0) AS INT) AS bw,
  CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN CAST(event_id % 30 AS INT) END AS eta FROM events""")
def _(w):
    ev = derived.table(w.spark, w.sf_dir, "events")
    told = F.when(F.col("event_id") % 4 == 0, "due").when(F.col("event_id") % 4 == 1, F.concat((F.col("event_id") % 30).cast("string"), F.lit(" min"))).otherwise("delayed")
    return ev.select("event_id", curve.tricube(F.col("value") / 100.0).alias("kernel"), curve.bandwidth_for_cadence(F.col("value")).alias("bw"), text.eta_from_countdown(told).alias("eta"))


@query("write_trajectories", "trip_id chunk n t_sum:2 x_last:2", "SELECT trip_id, 0 AS chunk, count(*) AS n, sum(t) AS t_sum, max(x) AS x_last FROM pieces GROUP BY 1")
def _(w):
    rec = sinks.trajectory_records(w.pieces)
    return rec.select("trip_id", "chunk", F.size("t_knots").cast("long").alias("n"), F.aggregate("t_knots", F.lit(0.0), lambda a, v: a + v).alias("t_sum"), F.element_at("x_knots", -1).alias("x_last"))


@query("scan_trajectories", "trip_id k t:3 x:3 t_next:3 x_next:3", "SELECT * FROM pieces")
def _(w):
    rec = sinks.trajectory_records(w.pieces).join(w.pings.select("trip_id", "pattern_id").distinct(), "trip_id")
    return readers.knots_of_records(rec)


@query("incremental_keys", "trip_id", "SELECT DISTINCT trip_id FROM pings WHERE trip_id NOT IN (SELECT trip_id FROM slow)")
def _(w):
    return sinks.pending_keys(w.pings.select("trip_id").distinct(), w.events, TRIP)


