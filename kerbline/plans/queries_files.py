"""Sources and sinks on real files: each table is written in a source's format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import timeutil
from kerbline.operators.stage import new_path
from kerbline.plans import derived
from kerbline.plans.registry import query
from kerbline.plans.workspace import TRIP
from kerbline.sources import readers, sinks

PING = "trip_id bus_id route_id pattern_id us latitude:6 longitude:6"
_PINGS = "SELECT trip_id, bus_id, route_id, pattern_id, epoch_us(ts) AS us, lat AS latitude, lon AS longitude FROM pings"


def _written(w, name: str, write) -> str:
    path = new_path(w.spark, name)
    write(path)
    return path


def _location_file(w) -> str:
    if not hasattr(w, "location_file"):
        rows = w.pings.select(timeutil.event_time_text(F.col("ts")).alias("avl_event_time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "trip_id", "bus_id", "route_id", "pattern_id", F.lit("").alias("garage"))
        w.location_file = _written(w, "avl", lambda path: rows.write.option("header", True).csv(path))
    return w.location_file


def _canonical(rows: DataFrame) -> DataFrame:
    return rows.withColumn("us", F.unix_micros("avl_event_time"))


@query("scan_avl_csv", PING, _PINGS)
def _(w):
    return _canonical(readers.scan_avl_csv(w.spark, _location_file(w)))


@query("scan_phone_csv", PING, f"{_PINGS} WHERE route_id = '23'")
def _(w):
    return _canonical(readers.scan_phone_csv(w.spark, _location_file(w), route="23"))


@query("load_trace", "kind " + PING, f"SELECT 'avl_csv' AS kind, * FROM ({_PINGS}) UNION ALL SELECT 'phone_csv', * FROM ({_PINGS}) WHERE pattern_id = '3'")
def _(w):
    path = _location_file(w)
    specs = ({"kind": "avl_csv", "path": path}, {"kind": "phone_csv", "path": path, "pattern_id": "3"})
    parts = [_canonical(readers.load_trace(w.spark, spec)).withColumn("kind", F.lit(spec["kind"])) for spec in specs]
    return parts[0].unionByName(parts[1])


@query("scan_routes_trips", "route_id route_type trip_id shape_id", "SELECT DISTINCT route_id, 3 AS route_type, trip_id, shape_id FROM pings")
def _(w):
    folder = new_path(w.spark, "gtfs")
    w.pings.select("route_id").distinct().select("route_id", F.col("route_id").alias("route_short_name"), F.lit("x").alias("route_long_name"), F.lit("3").alias("route_type")).write.option("header", True).csv(f"{folder}/routes.txt")
    w.pings.select("route_id", "trip_id", "shape_id").distinct().select("route_id", F.lit("1").alias("service_id"), "trip_id", F.lit("0").alias("direction_id"), "shape_id").write.option("header", True).csv(f"{folder}/trips.txt")
    routes, trips = readers.scan_routes_trips(w.spark, folder)
    return trips.join(routes, "route_id")


@query("scan_vtrak_csv", "bus_id us latitude:6 longitude:6", "SELECT bus_id, epoch_us(ts) AS us, lat AS latitude, lon AS longitude FROM pings WHERE bus_id IN ('B1', 'B4')")
def _(w):
    rows = w.pings.select(F.col("bus_id").alias("VEH_ID"), timeutil.event_time_text(timeutil.to_local(F.col("ts"))).alias("AVL_EVENT_TIME"), F.col("lat").alias("LAT"), F.col("lon").alias("LON"))
    path = _written(w, "vtrak", lambda path: rows.write.option("header", True).csv(path))
    return readers.scan_vtrak_csv(w.spark, path, ["B1", "B4"]).withColumn("us", F.unix_micros("ts"))


@query("scan_highfreq", "veh_id sec", "SELECT DISTINCT substr(bus_id, 2) AS veh_id, epoch_us(ts) // 1000000 AS sec FROM pings")
def _(w):
    rows = w.pings.select(
        F.substring("bus_id", 2, 9).cast("double").alias("veH_ID"), F.date_format("ts", "MM-dd-yyyy HH:mm:ss").alias("dtime"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.lit(1.0).alias("heading"), F.lit(2.0).alias("speed"), F.date_format("ts", "yyyyMMdd").alias("day"),
    )
    path = _written(w, "dense", lambda path: rows.write.partitionBy("day").parquet(path))
    return readers.scan_highfreq(w.spark, path).withColumn("sec", F.unix_seconds("ping_dt"))


def _documents(w, documents: DataFrame, name: str) -> str:
    """One JSON document a line, in as many files as Spark has tasks; a document holds one shape or a bounded range of ids."""
    return _written(w, name, lambda path: documents.select(F.col("document").alias("value")).write.text(path))


def _by_shape(items: DataFrame) -> DataFrame:
    return items.select(F.to_json(F.create_map("shape_id", "items")).alias("document"))


@query("scan_control_points", "shape_id node_id lat:6 lon:6 dist_m:3 on_way_id control_type streets signalized", """
SELECT shape_id, node_id, lat, lon, dist_m, on_way_id, control_type, array_to_string(cross_street_names, '|') AS streets, false AS signalized FROM controls""")
def _(w):
    point = F.struct(F.col("node_id").alias("intersection_node_id"), "lat", "lon", F.col("dist_m").alias("dist_along_route_m"), "on_way_id", "control_type", "cross_street_names")
    path = _documents(w, _by_shape(w.controls.groupBy("shape_id").agg(F.collect_list(point).alias("items"))), "controls_json")
    return readers.scan_control_points(w.spark, path, lines=True).withColumn("streets", F.array_join("cross_street_names", "|"))


@query("scan_way_segments", "shape_id way_no way_id dist_start_m:3 dist_end_m:3 direction", "SELECT shape_id, way_no, way_id, dist_start_m, dist_end_m, 'forward' AS direction FROM way_segments")
def _(w):
    rows = derived.way_segments(w.spark, w.sf_dir)
    box = F.struct("way_no", F.struct("way_id", "dist_start_m", "dist_end_m", "direction").alias("w"))
    path = _documents(w, _by_shape(rows.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(box)), lambda b: b["w"]).alias("items"))), "ways_json")
    return readers.scan_way_segments(w.spark, path, lines=True)


@query("scan_osm", "kind id n_nodes highway", """
SELECT 'way' AS kind, 100*(g+1) + w AS id, CAST(count(*) AS BIGINT) AS n_nodes, 'primary' AS highway FROM route_ways GROUP BY g, w
UNION ALL SELECT 'way', 1000000 + 100*(g+1) + k, 1, 'secondary' FROM grp, kk WHERE k % 2 = 0""")
def _(w):
    ways = derived.osm_ways(w.spark, w.sf_dir).select(F.struct(F.lit("way").alias("type"), "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "nodes", "tags").alias("e"))
    # extracts overlap: each range of a thousand ids repeats the last hundred of the one before
    reach = F.when(F.col("e.id") % 1000 >= 900, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    per = ways.withColumn("later", F.explode(reach)).withColumn("range", F.floor(F.col("e.id") / 1000) + F.col("later")).groupBy("range").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("document"))
    found, _ = readers.scan_osm(w.spark, _documents(w, per, "osm_json"), lines=True)
    return found.select(F.lit("way").alias("kind"), "id", F.size("nodes").cast("long").alias("n_nodes"), F.col("tags")["highway"].alias("highway"))


@query("scan_freeflow", "seg_id t_ff:3", "SELECT shape_id || ':' || seg_id AS seg_id, t_ff FROM freeflow")
def _(w):
    item = F.struct(F.concat_ws(":", "shape_id", "seg_id"), "t_ff")
    per = w.freeflow.groupBy("shape_id").agg(F.to_json(F.map_from_entries(F.collect_list(item))).alias("document"))
    return readers.scan_freeflow(w.spark, _documents(w, per, "freeflow_json"), lines=True)


@query("write_trip_samples", "trip_id t:3 x:2 v_mph:2", "SELECT trip_id, t, x, v_mph FROM samples")
def _(w):
    path = _written(w, "samples_csv", lambda path: sinks.write_trip_samples(w.samples.select("trip_id", "t", "x", "v_mph"), path))
    return w.spark.read.option("header", True).schema("trip_id string, t double, x double, v_mph double, bucket int").csv(path)


@query("write_trip_decomposition", "trip_id seg_id t_obs:3 t_dwell:3", "SELECT trip_id, seg_id, t_obs, t_dwell FROM decomposed")
def _(w):
    rows = w.decomposed.select(*TRIP, "seg_id", "t_obs", "t_dwell")
    path = _written(w, "decomposition_json", lambda path: sinks.write_trip_decomposition(rows, path))
    return w.spark.read.schema(rows.schema).json(path)


@query("write_segment_aggregate", "shape_id seg_id n_trips", "SELECT shape_id, seg_id, n_trips FROM per_segment")
def _(w):
    rows = w.decomposed.groupBy("shape_id", "seg_id").agg(F.count("*").alias("n_trips"))
    path = _written(w, "segments_csv", lambda path: sinks.write_table(rows, path, "csv"))
    return w.spark.read.option("header", True).schema(rows.schema).csv(path)


@query("write_control_points", "shape_id place node_id dist_m:3", "SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY dist_m) - 1 AS place, node_id, dist_m FROM controls")
def _(w):
    path = _written(w, "controls_nested", lambda path: sinks.write_nested(w.controls.select("shape_id", "dist_m", "node_id", "lat", "lon"), path, "dist_m", "points"))
    return w.spark.read.parquet(path).select("shape_id", F.posexplode("points").alias("place", "p")).select("shape_id", "place", "p.node_id", "p.dist_m")


@query("write_payloads", "trip_id n_pings first_lat:6", "SELECT trip_id, count(*) AS n_pings, min(lat) AS first_lat FROM pings GROUP BY 1")
def _(w):
    rows = w.pings.groupBy("trip_id").agg(F.count("*").alias("n_pings"), F.min("lat").alias("first_lat"))
    path = _written(w, "payloads", lambda path: sinks.write_payloads(rows, path, "trip_id"))
    read = w.spark.read.schema("trip_id string, value string").json(path)
    return read.select("trip_id", F.from_json("value", "n_pings bigint, first_lat double").alias("v")).select("trip_id", "v.*")
