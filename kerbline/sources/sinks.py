"""Writers. Arrays in documents have a bounded length; long trips span several rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from kerbline.constants import CATEGORIES
from kerbline.functions import timeutil
from kerbline.sources import schemas
from kerbline.sources.schemas import AVL_COLUMNS

KNOTS_PER_RECORD = 4096


def avl_rows(pings: DataFrame, pattern: str | None = None) -> DataFrame:
    """Feed pings in the flat 25-column layout; unknown columns are empty text."""
    known = {
        "id": F.concat(F.coalesce("entity_id", F.lit("")), F.lit("_"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")),
        "bus_id": F.col("vehicle_id"), "avl_event_time": timeutil.event_time_text(F.col("timestamp")), "route_id": F.col("route_id"),
        "pattern_id": F.lit(pattern) if pattern is not None else F.col("pattern_id"), "trip_id": F.col("trip_id"),
        "latitude": F.col("latitude").cast("string"), "longitude": F.col("longitude").cast("string"),
        "heading": F.coalesce(F.col("bearing").cast("string"), F.lit("")),
    }
    return pings.select(*[known.get(c, F.lit("")).alias(c) for c in AVL_COLUMNS])


def write_avl_csv(pings: DataFrame, path: str, pattern: str | None = None) -> None:
    avl_rows(pings, pattern).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def trajectory_records(pieces: DataFrame, trips: DataFrame | None = None, *, compact: bool = False) -> DataFrame:
    """Knots as arrays, one record per trip and stretch of 4096 knots.

    trips: trip_id, bus_id, route_id, pattern_id, first_ts, last_ts, n_pings,
    n_on_route. ``compact`` stores 32-bit floats.
    """
    kind = "array<float>" if compact else "array<double>"
    chunked = pieces.withColumn("chunk", F.floor(F.col("k") / KNOTS_PER_RECORD).cast("int"))
    boxed = chunked.groupBy("trip_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "x", "m"))).alias("p"))
    rows = boxed.select(
        "trip_id", "chunk", F.transform("p", lambda p: p["t"]).cast(kind).alias("t_knots"), F.transform("p", lambda p: p["x"]).cast(kind).alias("x_knots"),
        F.transform("p", lambda p: p["m"]).cast(kind).alias("slopes"),
    )
    if trips is None:
        return rows
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return rows.join(trips, "trip_id").select(
        "trip_id", "bus_id", "route_id", "pattern_id", F.date_format("first_ts", iso).alias("first_ping_iso"),
        F.date_format("last_ts", iso).alias("last_ping_iso"), F.col("n_pings").cast("int").alias("n_pings_raw"),
        F.col("n_on_route").cast("int").alias("n_pings_on_route"), "chunk", "t_knots", "x_knots", "slopes",
    )


def write_trajectories(records: DataFrame, path: str, *, compact: bool = False) -> None:
    writer = records.write.mode("overwrite")
    writer.parquet(path) if compact else writer.json(path)


BUCKETS = 64


def bucketed(rows: DataFrame, key: str, date: str | None = None, buckets: int = BUCKETS) -> DataFrameWriter:
    """Writer of rows under date (where there is one) and hash bucket of the key, keys together and in order.

    Folders grow with days, not with keys; a large bucket is split over several
    files by the adaptive rebalance.
    """
    placed = rows.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    folders = [date, "bucket"] if date else ["bucket"]
    return placed.hint("rebalance", *folders).sortWithinPartitions(*folders, key).write.mode("overwrite").partitionBy(*folders)


def write_trip_samples(samples: DataFrame, path: str, date: str | None = None) -> None:
    """Per-ping curve values by service date and trip bucket."""
    bucketed(samples, "trip_id", date).option("header", True).csv(path)


def trip_decomposition_rows(rows: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buckets and event counts per trip × segment, without the events."""
    by = [*keys, "shape_id", "seg_id"]
    return rows.join(counts.select(*by, *[f"n_{c}" for c in CATEGORIES]), by)


def write_trip_decomposition(rows: DataFrame, path: str, date: str | None = None) -> None:
    bucketed(rows, "trip_id", date).json(path)


def write_table(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Segment aggregates, free-flow tables, trip indexes."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def nested_by_shape(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows of each shape as one ordered array of structs (control points, way intervals)."""
    rest = [c for c in rows.columns if c not in ("shape_id", order)]
    return rows.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


def write_nested(rows: DataFrame, path: str, order: str, name: str) -> None:
    nested_by_shape(rows, order, name).write.mode("overwrite").parquet(path)


def payload_documents(rows: DataFrame, key: str) -> DataFrame:
    """One JSON document per row, keyed."""
    rest = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*rest)).alias("value"))


def write_payloads(rows: DataFrame, path: str, key: str) -> None:
    """Keys and their documents as lines of (key, value)."""
    bucketed(payload_documents(rows, key), key).json(path)


def write_catalog(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_stop_bundles(stops: DataFrame, listed: DataFrame, lines: DataFrame, path: str) -> None:
    """All stops, stops per pattern and line per pattern."""
    per = listed.groupBy("pattern_id").agg(F.array_sort(F.collect_list(
        F.struct("stop_seq", "stop_id", "name", "lat", "lon", "dist_m", "is_near_side")
    )).alias("stops"))
    stops.write.mode("overwrite").json(f"{path}/bus_stops")
    per.write.mode("overwrite").json(f"{path}/pattern_stops")
    lines.write.mode("overwrite").json(f"{path}/pattern_shapes")


def motion_files(readings: DataFrame) -> DataFrame:
    """Text of a recorder's append-only chunk files: trip_id, chunk, value; only a recording's first chunk has a header line.

    Chunks are of bounded length. readings: trip_id, chunk (from 1), line, ts (local clock), ax ay az gx gy gz.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    channels = schemas.MOTION_CHANNELS
    empty = [F.lit("")] * (len(schemas.MOTION_COLUMNS) - 1 - len(channels))
    lines = readings.select("trip_id", "chunk", "line", F.concat_ws(",", timeutil.event_time_text(F.col("ts")), *[number(c) for c in channels], *empty).alias("value"))
    headers = readings.where("chunk = 1").select("trip_id", "chunk").distinct().select("trip_id", "chunk", F.lit(-1).cast("long").alias("line"), F.lit(",".join(schemas.MOTION_COLUMNS)).alias("value"))
    named = lines.withColumn("line", F.col("line").cast("long")).unionByName(headers).withColumn("chunk", F.lpad(F.col("chunk").cast("string"), 6, "0"))
    # a chunk is one row, since a sort does not reach files that are split by columns
    return named.groupBy("trip_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))


def write_motion_chunks(readings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sensor readings as ``motion_files``, one folder a chunk."""
    motion_files(readings).select("value", "trip_id", "chunk").write.mode(mode).partitionBy("trip_id", "chunk").text(path)


def write_bundles(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small files (trip_id, file, value: their text) as rows, so that files on disk grow with bytes, not with trips or chunks.

    A null trip gets the name that its folder would have.
    """
    named = F.coalesce("trip_id", F.lit(schemas.NO_FOLDER)).alias("trip_id")
    files.select(named, F.col("file").cast("string").alias("file"), "value").write.mode(mode).parquet(path)


def write_motion_bundles(readings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sensor readings as ``motion_files``, many in one bundle."""
    write_bundles(motion_files(readings).withColumnRenamed("chunk", "file"), path, mode)


def pending_keys(keys: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys without a result yet."""
    return keys.join(done.select(*on).distinct(), list(on), "left_anti")
