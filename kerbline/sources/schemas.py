"""Table contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = T.StructType([
    T.StructField("avl_event_time", T.TimestampType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("trip_id", T.StringType()), T.StructField("bus_id", T.StringType()),
    T.StructField("route_id", T.StringType()), T.StructField("pattern_id", T.StringType()),
])

# Column order of the flat vehicle location layout (fixed values).
AVL_COLUMNS = (
    "id", "bus_id", "avl_event_time", "bt_ver", "route_id", "pattern_id", "direction", "deviation", "speed", "operator_id",
    "last_ob_update", "garage", "run_id", "trip_id", "last_trip_update", "last_tp_passed", "last_tp_update", "latitude",
    "longitude", "heading", "onroute", "mmode", "last_mmode", "cta_inserted_dtm_usa_chi", "service_yearmo",
)

ARCHIVE_PING = (
    "agency string, entity_id string, vehicle_id string, route_id string, trip_id string, `timestamp` timestamp, "
    "latitude double, longitude double, bearing double, year int, month int, day int, hour int"
)
DOOR_CSV = (
    "bus_id", "trip_id", "trip_start_time", "route_id", "event_time", "event_type", "dwell_time", "stop_id", "stop_sequence",
    "fon", "ron", "foff", "roff", "passenger_load",
)
OBSERVER_CSV = (
    "event_id", "trip_id", "type", "direction", "stop_id", "stop_name", "near_side", "note", "parent_id", "start_time", "end_time",
    "start_lat", "start_lon", "end_lat", "end_lon", "duration_s", "pax_on", "pax_off",
)
MOTION = "`timestamp` string, ax double, ay double, az double, gx double, gy double, gz double, interval_ms double, agx double, agy double, agz double"
MOTION_COLUMNS = ("timestamp", "ax", "ay", "az", "gx", "gy", "gz", "interval_ms", "agx", "agy", "agz")
MOTION_CHANNELS = MOTION_COLUMNS[1:7]
META = "route_id string, pattern_id string, bus_id string, trip_id string, destination string, observer string, start_t bigint, end_t bigint"
#: Small files as rows: the trip whose folder holds the file, its name there, its text.
BUNDLE = "trip_id string, file string, value string"
NO_FOLDER = "__HIVE_DEFAULT_PARTITION__"
CONTROL_POINT = (
    "struct<intersection_node_id:bigint,lat:double,lon:double,dist_along_route_m:double,on_way_id:bigint,control_type:string,"
    "cross_street_names:array<string>,merged_node_ids:array<bigint>,anchor_intersection_node_id:bigint,signalized:boolean,"
    "markings:string,has_island:boolean>"
)
WAY_SEGMENT = "struct<way_id:bigint,dist_start_m:double,dist_end_m:double,direction:string,name:string,road_class:string>"
OSM_ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>"
MATCH_RESPONSE = (
    "struct<shape:string,edges:array<struct<way_id:bigint,names:array<string>,forward:boolean,road_class:string,"
    "begin_shape_index:int,end_shape_index:int>>>"
)
TRAJECTORY = (
    "trip_id string, bus_id string, route_id string, pattern_id string, first_ping_iso string, last_ping_iso string, "
    "n_pings_raw int, n_pings_on_route int, chunk int, t_knots array<double>, x_knots array<double>, slopes array<double>"
)


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def canonical_trace(df: DataFrame) -> DataFrame:
    """The ping contract: required columns, ids as text, time as timestamp."""
    require_columns(df, CANONICAL.names)

    def cast(field: T.StructField) -> Column:
        if field.name == "avl_event_time" and isinstance(df.schema[field.name].dataType, T.StringType):
            return F.try_to_timestamp(field.name).alias(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[cast(f) for f in CANONICAL])


def empty_trace(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANONICAL)


def pings_from_canonical(df: DataFrame) -> DataFrame:
    """Short column names that the operators use, with a row id for ties."""
    return df.select(
        "trip_id", "bus_id", "route_id", "pattern_id", F.col("avl_event_time").alias("ts"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"), F.xxhash64("trip_id", "bus_id", "avl_event_time", "latitude", "longitude").alias("event_id"),
    )
