"""Readers, contracts and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from kerbline.functions import text, timeutil
from kerbline.sources import readers, schemas, sinks

HEAD = "bus_id,avl_event_time,route_id,pattern_id,trip_id,latitude,longitude\n"


def test_avl_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEAD + "7,2026-05-05 12:00:30.000000,22,3936,A,42.01,-87.6\n7,2026-05-05 12:00:00.000000,22,3936,A,42.02,-87.6\n7,2026-05-05 12:00:00.500000,992,1,B,1,1\n")
    rows = readers.scan_avl_csv(spark, str(path)).orderBy("avl_event_time").collect()
    assert [r.latitude for r in rows] == [42.02, 42.01] and {r.trip_id for r in rows} == {"A"}
    assert (rows[1].avl_event_time - rows[0].avl_event_time).total_seconds() == 30
    assert readers.scan_avl_csv(spark, str(path), drop_deadhead=False).count() == 3


def test_phone_csv_filters_and_registry(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("bus_id,avl_event_time,route_id,trip_id,latitude,longitude\n1,2026-05-05 12:00:00,22,A,42.0,-87.6\n1,2026-05-05 12:00:01,36,B,42.0,-87.6\n")
    rows = readers.load_trace(spark, {"kind": "phone_csv", "path": str(path), "route_id": "22", "pattern_id": "3936"}).collect()
    assert len(rows) == 1 and rows[0].pattern_id == "3936"
    with pytest.raises(ValueError, match="unknown trace source"):
        readers.load_trace(spark, {"kind": "nope"})


def test_contract(spark):
    raw = spark.createDataFrame([(5, "2026-05-05 12:00:00", 1.0, 2.0, 6, 7, 8)], "trip_id int, avl_event_time string, latitude double, longitude double, bus_id int, route_id int, pattern_id int")
    out = schemas.canonical_trace(raw)
    assert out.schema == schemas.CANONICAL and out.collect()[0].trip_id == "5"
    with pytest.raises(ValueError, match="longitude"):
        schemas.canonical_trace(raw.drop("longitude"))
    assert schemas.empty_trace(spark).count() == 0


def test_gtfs_tables(spark, tmp_path):
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon,shape_dist_traveled\nX,1,42,-87,0\nX,2,42.1,-87,328.084\nY,1,42,-87,0\nY,2,42.1,-87,\n")
    (tmp_path / "routes.txt").write_text("route_id,route_short_name,route_long_name,route_type\n22,22,Clark,3\nRed,Red,Red,1\n")
    (tmp_path / "trips.txt").write_text("route_id,service_id,trip_id,direction_id,shape_id\n22,1,t2,0,X\n22,1,t1,0,X\nRed,1,t3,0,Y\n22,1,t4,0,\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence,shape_dist_traveled\nt1,s2,2,328.084\nt1,s1,1,0\nt1,s3,3,\nt2,s9,1,0\n")
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon,location_type\ns1,First,42,-87,\ns2,Second,42,-87,\n")
    from kerbline.operators import stops

    pts = {(r.shape_id, r.seq): r.dist_m for r in readers.scan_shapes(spark, str(tmp_path)).collect()}
    assert pts[("X", 2)] == pytest.approx(100) and pts[("Y", 1)] is None
    routes, trips = readers.scan_routes_trips(spark, str(tmp_path))
    assert [r.shape_id for r in stops.list_shapes(trips, routes, 3).collect()] == ["X"]
    assert [r.shape_id for r in stops.list_shapes(trips, routes).collect()] == ["X", "Y"]
    got = stops.route_stops(trips.where("shape_id is not null"), readers.scan_stop_times(spark, str(tmp_path)), readers.scan_stops(spark, str(tmp_path)))
    assert [(r.stop_id, r.name, round(r.dist_m)) for r in got.where("shape_id = 'X'").orderBy("dist_m").collect()] == [("s1", "First", 0), ("s2", "Second", 100)]


def test_archive_and_avl_layout(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2026, 5, 5, 12, 0, 0)
    rows = [("cta", "e1", "v", "22", "t", at, 42.0, -87.6, 90.0, 2026, 5, 5, 12), ("cta", None, "v", "22", "t", at + dt.timedelta(seconds=30), 42.1, -87.6, None, 2026, 5, 5, 12),
            ("cta", "e3", "v", "22", "other", at, 1.0, 1.0, None, 2026, 5, 5, 13)]
    archive = spark.createDataFrame(rows, schemas.ARCHIVE_PING)
    archive.write.partitionBy("agency", "year", "month", "day", "hour").parquet(str(tmp_path / "arch"))
    read = readers.scan_archive(spark, str(tmp_path / "arch"), "22")
    assert [r.hour for r in readers.archive_hours(spark, str(tmp_path / "arch"), "cta").collect()] == [12, 13]
    assert readers.scan_recent_hours(spark, str(tmp_path / "arch"), 1).count() == 1
    plan = readers.scan_hours_from(read, "2026-05-05 13:00:00")
    assert plan.count() == 1 and "PartitionFilters: []" not in plan._jdf.queryExecution().executedPlan().toString()
    ms = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    ask = spark.createDataFrame([("r", "22", "v", "t", ms, ms + 60000), ("none", "22", "v", "x", ms, ms)], "request_id string, route_id string, vehicle_id string, trip_id string, start_ms long, end_ms long")
    got = readers.trip_pings(ask, read).orderBy("epoch_ms").collect()
    assert [r.epoch_ms - ms for r in got] == [0, 30000] and got[0].avl_event_time == "2026-05-05 12:00:00.000000"
    sinks.write_avl_csv(read.where("trip_id = 't'"), str(tmp_path / "out"), "3936")
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert tuple(back.columns) == schemas.AVL_COLUMNS and len(back.columns) == 25
    assert readers.scan_avl_csv(spark, str(tmp_path / "out")).count() == 2


def test_vtrak_and_highfreq(spark, tmp_path):
    (tmp_path / "v.csv").write_text("VEH_ID,AVL_EVENT_TIME,LAT,LON\n1,2026-11-01 01:30:00,42,-87\n1,2026-07-01 12:00:00,42,-87\n2,2026-07-01 12:00:00,42,-87\n")
    rows = readers.scan_vtrak_csv(spark, str(tmp_path / "v.csv"), [1]).collect()
    assert [str(r.ts) for r in rows] == ["2026-07-01 17:00:00"]
    src = spark.createDataFrame([(7.0, "07-01-2026 12:00:00", 42.0, -87.0, 0.0, 1.0), (7.0, "07-01-2026 12:00:00", 42.5, -87.0, 0.0, 1.0)], "veH_ID double, dtime string, latitude double, longitude double, heading double, speed double")
    src.write.parquet(str(tmp_path / "hf" / "2026-07-01"))
    got = readers.scan_highfreq(spark, str(tmp_path / "hf")).collect()
    assert len(got) == 1 and got[0].veh_id == "7" and got[0].latitude == 42.0


def test_door_observer_motion_meta(spark, tmp_path):
    (tmp_path / "d1.csv").write_text("bus_id,trip_id,trip_start_time,route_id,event_time,event_type,dwell_time,stop_id,stop_sequence,fon,ron,foff,roff,passenger_load\n1,t,2026-07-01 07:00:00.000,22,2026-07-01 07:05:00.000,3,bad,99,4,2,0,x,1,None\n")
    door = readers.scan_door_events(spark, str(tmp_path / "d1.csv")).collect()[0]
    assert (str(door.ts), door.dwell_s, door.fon, door.foff, door.passenger_load) == ("2026-07-01 12:05:00", 0.0, 2, 0, None)
    (tmp_path / "types.csv").write_text("id,description\n3,Serviced stop\nx,bad\n")
    assert [tuple(r) for r in readers.scan_event_types(spark, str(tmp_path / "types.csv")).collect()] == [(3, "Serviced stop")]
    (tmp_path / "o.csv").write_text(",".join(schemas.OBSERVER_CSV) + "\n" + "1,t,signal,,,,,hold,,2026-07-01 07:00:00.500,,,,,,,0,0\n")
    seen = readers.scan_observer_events(spark, str(tmp_path / "o.csv")).collect()[0]
    assert seen.label == "hold" and seen.end_ts is None and str(seen.start_ts).startswith("2026-07-01 12:00:00.5")
    trip = tmp_path / "rides" / "T1"
    trip.mkdir(parents=True)
    line = "2026-07-01 07:00:00.{:03d},{},0,0,0,0,0,20,0,0,0\n"
    (trip / "motion-0.csv").write_text("timestamp,ax,ay,az,gx,gy,gz,interval_ms,agx,agy,agz\n" + line.format(0, 1) + line.format(20, 2))
    (trip / "motion-1.csv").write_text(line.format(40, 3) + line.format(40, 4))
    got = readers.scan_motion(spark, str(tmp_path / "rides" / "*" / "motion-*.csv")).orderBy("t").collect()
    assert [(r.trip_id, round(r.t, 3), r.ax) for r in got] == [("T1", 0.0, 1.0), ("T1", 0.02, 2.0), ("T1", 0.04, 3.0)]
    (trip / "meta.json").write_text(json.dumps({"route_id": "22", "trip_id": "t", "start_t": 5}))
    meta = readers.scan_trip_meta(spark, str(tmp_path / "rides" / "*" / "meta.json")).collect()[0]
    assert (meta.key, meta.end_t) == ("T1", 3600005)


def test_nested_caches(spark, tmp_path):
    (tmp_path / "cp.json").write_text(json.dumps({"S": [{"intersection_node_id": 1, "lat": 1, "lon": 2, "dist_along_route_m": 3, "on_way_id": 4, "control_type": "stop", "cross_street_names": ["A"]}]}))
    cp = readers.scan_control_points(spark, str(tmp_path / "cp.json")).collect()[0]
    assert (cp.shape_id, cp.node_id, cp.markings, cp.has_island, cp.merged_node_ids) == ("S", 1, "", False, [])
    (tmp_path / "w.json").write_text(json.dumps({"S": [{"way_id": 1, "dist_start_m": 0, "dist_end_m": 5, "direction": "forward"}]}))
    assert readers.scan_way_segments(spark, str(tmp_path / "w.json")).collect()[0].way_id == 1
    (tmp_path / "osm.json").write_text(json.dumps({"elements": [{"type": "way", "id": 1, "nodes": [5, 6], "tags": {"highway": "primary"}}, {"type": "node", "id": 5, "lat": 1.0, "lon": 2.0}]}))
    ways, nodes = readers.scan_osm(spark, str(tmp_path / "osm.json"))
    assert ways.collect()[0].nodes == [5, 6] and nodes.collect()[0].tags == {}
    (tmp_path / "m.json").write_text(json.dumps({"S": {"shape": "_p~iF~ps|U", "edges": [{"way_id": 9, "names": ["A"], "forward": True, "begin_shape_index": 0, "end_shape_index": 1}]}}))
    edges, lines = readers.scan_matched_edges(spark, str(tmp_path / "m.json"))
    assert edges.collect()[0].way_id == 9 and lines.count() == 1
    (tmp_path / "ff.json").write_text(json.dumps({"SIG_1__SIG_2": 30.5}))
    assert [tuple(r) for r in readers.scan_freeflow(spark, str(tmp_path / "ff.json")).collect()] == [("SIG_1__SIG_2", 30.5)]


def test_trajectory_round_trip_and_size(spark, products, tmp_path):
    one = products.trace.select("trip_id").limit(1).collect()[0].trip_id
    pieces = products.pieces.where(F.col("trip_id") == one)
    ids = products.pings.where(F.col("trip_id") == one).groupBy("trip_id", "bus_id", "route_id", "pattern_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pings"), F.count(F.lit(1)).alias("n_on_route"))
    sinks.write_trajectories(sinks.trajectory_records(pieces, ids), str(tmp_path / "tr"))
    back = readers.scan_trajectories(spark, str(tmp_path / "tr"))
    joined = back.alias("b").join(pieces.alias("p"), ["trip_id", "k"])
    assert joined.count() == pieces.count() and joined.where("abs(b.x - p.x) > 1e-9 or abs(b.m - p.m) > 1e-9").count() == 0
    wide = spark.range(320).select(F.lit("T").alias("trip_id"), F.col("id").alias("k"), (F.rand(1) * 3000).alias("t"), F.rand(2).alias("x"), F.rand(3).alias("m"))
    sinks.write_trajectories(sinks.trajectory_records(wide, compact=True).coalesce(1), str(tmp_path / "c"), compact=True)
    assert sum(f.stat().st_size for f in (tmp_path / "c").glob("*.parquet")) < 20000


def test_daylight_saving_and_text_rules(spark):
    rows = spark.createDataFrame([("2026-03-08 02:30:00",), ("2026-11-01 01:30:00",), ("2026-11-01 02:30:00",), ("2026-07-01 12:00:00.250",)], "s string")
    strict = [r.u for r in rows.select(timeutil.local_to_utc_strict(timeutil.parse_local(F.col("s"))).alias("u")).collect()]
    assert strict[:2] == [None, None] and str(strict[2]) == "2026-11-01 08:30:00" and strict[3].microsecond == 250000
    names = spark.createDataFrame([("3936",), ("29251",), ("536",)], "p string").select(text.shape_id_for_pattern(F.col("p")).alias("s"), text.pattern_of_shape(text.shape_id_for_pattern(F.col("p"))).alias("b")).collect()
    assert [r.s for r in names] == ["67803936", "67829251", "67800536"] and [r.b for r in names] == ["3936", "29251", "536"]
    eta = spark.createDataFrame([("DUE",), ("7",), ("DLY",), (None,)], "e string").select(text.eta_from_countdown(F.col("e")).alias("m")).collect()
    assert [r.m for r in eta] == [0, 7, None, None]
    tags = "map('highway', 'crossing', '{}', '{}')"
    kinds = [spark.sql("select " + tags.format(k, v) + " as tags").select(text.crossing_type(F.col("tags")).alias("c")).collect()[0].c for k, v in
             (("crossing", "traffic_signals"), ("crossing_ref", "toucan"), ("crossing", "uncontrolled"), ("crossing:markings", "Ladder"), ("crossing", "unmarked"))]
    assert kinds == ["ped_crossing_signal", "ped_crossing_signal", "ped_crossing_marked", "ped_crossing_marked", None]
    truth = spark.createDataFrame([(None, "forward"), ("both", "reverse"), ("forward", "reverse"), ("backward", "reverse"), ("forward", "unknown"), ("odd", "forward")], "s string, t string")
    assert [r.a for r in truth.select(text.direction_applies(F.col("s"), F.col("t")).alias("a")).collect()] == [True, True, False, True, True, True]
