"""Observed rides: door bands, observer bands, shared clock, payload documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import MPS_TO_MPH
from kerbline.operators import delay, smooth
from kerbline.operators.intervals import salted_join
from kerbline.operators.select import best_cluster, between, is_degenerate, seconds
from kerbline.operators.stage import stage

CHUNK = 4096


def passenger_metrics(doors: DataFrame) -> DataFrame:
    """Boardings, alightings, load before, dwell per passenger."""
    on, off = F.col("fon") + F.col("ron"), F.col("foff") + F.col("roff")
    flow = on + off
    return doors.withColumn("on_total", on).withColumn("off_total", off).withColumn("flow", flow).withColumn(
        "load_before", F.col("passenger_load") - (on - off)
    ).withColumn("dwell_per_pax", F.when(flow > 0, F.round(F.col("dwell_s") / flow, 1)))


def door_of_trip(doors: DataFrame, trips: DataFrame, types: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """Door rows of the listed trips: equal vehicle, trip and start."""
    return doors.where(F.col("event_type").isin(*types)).join(
        trips.select("bus_id", "trip_id", "trip_start", "trip_key"), ["bus_id", "trip_id", "trip_start"]
    )


def door_bands(
    doors: DataFrame, windows: DataFrame, stops: DataFrame, event_types: DataFrame, *, pad_s: float = 300.0, bucket_s: int = 3600
) -> DataFrame:
    """Serviced stops and any dwell of a vehicle on its route inside ride windows.

    windows: trip_key, bus_id, route_id, t0 (clock zero), lo, hi. Times are
    relative to t0. Joined by vehicle, route and hour bucket.
    """
    at = seconds(F.col("ts"))
    lo, hi = seconds(F.col("lo")) - pad_s, seconds(F.col("hi")) + pad_s
    spread = windows.withColumn("__b", F.explode(F.sequence(F.floor(lo / bucket_s), F.floor(hi / bucket_s))))
    dwell = F.greatest(F.lit(0.0), F.floor("dwell_s"))
    rows = (
        passenger_metrics(doors.withColumn("dwell_s", dwell)).drop("trip_id").withColumn("__b", F.floor(at / bucket_s))
        .join(spread, ["bus_id", "route_id", "__b"])
        .where((at >= lo) & (at <= hi) & ((F.col("event_type") == 3) | (F.col("dwell_s") > 0)))
    )
    named = rows.join(stops.select("stop_id", F.col("name").alias("__stop")), "stop_id", "left").join(
        event_types.select("event_type", F.col("description").alias("__desc")), "event_type", "left"
    )
    start = at - seconds(F.col("t0"))
    return named.select(
        "trip_key", "event_id", F.round(start, 1).alias("t_start"), F.round(start + F.col("dwell_s"), 1).alias("t_end"),
        F.when(F.col("event_type") == 3, "avl_stop").otherwise("avl_other").alias("category"),
        F.coalesce("__desc", F.concat(F.lit("event "), "event_type")).alias("event_desc"),
        F.coalesce("__stop", F.concat(F.lit("stop "), "stop_id")).alias("label"), "stop_id", "dwell_s",
        "load_before", F.col("passenger_load").alias("load_after"), "on_total", "off_total", "flow", "dwell_per_pax",
    )


def observer_bands(events: DataFrame, clocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hand-tagged delays on the shared clock; an open end stays null."""
    label = F.coalesce(F.nullif("stop_name", F.lit("")), F.nullif("note", F.lit("")), F.col("type"))
    return events.join(clocks.select(*keys, "t0"), list(keys)).select(
        *keys, F.round(between(F.col("start_ts"), F.col("t0")), 1).alias("t_start"),
        F.round(between(F.col("end_ts"), F.col("t0")), 1).alias("t_end"), F.col("type").alias("category"), label.alias("label"),
    )


def parent_event(events: DataFrame) -> DataFrame:
    """Events that point at another one take its stop."""
    parents = events.select(F.col("event_id").alias("parent_id"), F.col("stop_name").alias("__stop"))
    return events.join(parents, "parent_id", "left").withColumn("stop_name", F.coalesce("stop_name", "__stop")).drop("__stop").select(*events.columns)


def wall_clock_axis(starts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Earliest start over all sources per ride: t0. Each source: keys, source, start_ts."""
    every = starts[0]
    for more in starts[1:]:
        every = every.unionByName(more)
    first = every.groupBy(*keys).agg(F.min("start_ts").alias("t0"))
    offsets = every.groupBy(*keys, "source").agg(F.min("start_ts").alias("start_ts"))
    return offsets.join(first, list(keys)).withColumn("offset_s", between(F.col("start_ts"), F.col("t0")))


def ground_truth_bands(observed: DataFrame, inferred: DataFrame, doors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bands of the three sources in one timeline, tagged by role."""
    cols = [*keys, "t_start", "t_end", "category", "label"]
    parts = [d.select(*cols).withColumn("role", F.lit(r)) for d, r in ((observed, "observed"), (inferred, "inferred"), (doors, "door"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def isolate_ride(
    pings: DataFrame, rides: DataFrame, segments: DataFrame, keys: Sequence[str], *, pad_before_s: float = 5400.0, pad_after_s: float = 1800.0
) -> DataFrame:
    """Archive pings of each ride: wide window first, the strict one where the wide is degenerate.

    Rides that stay degenerate are dropped.
    """
    from kerbline.operators.mapmatch import snap_to_shape

    keys = list(keys)
    tries = []
    for rank, (before, after) in enumerate(((pad_before_s, pad_after_s), (0.0, 0.0))):
        part = best_cluster(pings, rides, keys, pad_before_s=before, pad_after_s=after)
        tries.append(part.withColumn("window_no", F.lit(rank)))
    both = stage(snap_to_shape(tries[0].unionByName(tries[1]), segments), "isolated")
    verdict = is_degenerate(both, [*keys, "window_no"])
    choice = verdict.where(~F.col("degenerate")).groupBy(*keys).agg(F.min("window_no").alias("window_no"))
    return salted_join(both, choice, [*keys, "window_no"], F.col("event_id"), "left_semi")


def attribution_by_distance(bands: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Band start and end as route distances on the trip's curve."""
    from kerbline.functions.curve import hermite
    from kerbline.operators.intervals import bins

    keys = list(keys)
    ends = bands.withColumn("band_no", F.xxhash64(*keys, "t_start", "t_end", "category"))
    marks = ends.select(*keys, "band_no", F.col("t_start").alias("at_t"), F.lit(0).alias("side")).unionByName(
        ends.select(*keys, "band_no", F.col("t_end").alias("at_t"), F.lit(1).alias("side"))
    )
    spans = pieces.select(*keys, "t", "x", "m", "t_next", "x_next", "m_next", "t_first", "t_last", "x_first", "x_last")
    limits = spans.groupBy(*keys).agg(F.min("t_first").alias("__a"), F.max("t_last").alias("__b"))
    placed = marks.join(limits, keys).withColumn("at_t", F.greatest("__a", F.least("__b", "at_t"))).withColumn("__bin", F.floor(F.col("at_t") / 600))
    cells = spans.withColumn("__bin", F.explode(bins(F.col("t"), F.coalesce("t_next", "t"), 600.0)))
    inside = (F.col("at_t") >= F.col("t")) & (F.col("t_next").isNull() | (F.col("at_t") < F.col("t_next")))
    found = placed.join(cells, [*keys, "__bin"]).where(inside).select(
        *keys, "band_no", "side", hermite(F.col("at_t"), *[F.col(c) for c in ("t", "x", "m", "t_next", "x_next", "m_next")]).alias("__x")
    )
    wide = found.groupBy(*keys, "band_no").agg(
        F.max(F.when(F.col("side") == 0, F.col("__x"))).alias("dist_start_m"), F.max(F.when(F.col("side") == 1, F.col("__x"))).alias("dist_end_m")
    )
    return ends.join(wide, [*keys, "band_no"]).drop("band_no")


def curve_document(pieces: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """The 1 Hz curve as rounded arrays, in chunks of bounded length."""
    grid = smooth.sample_trajectory(pieces, keys, dt=1.0, rule="span", floor_zero=True)
    points = grid.withColumn("chunk", F.floor(F.col("i") / chunk))
    boxed = F.array_sort(F.collect_list(F.struct("i", F.round("t", 1).alias("t"), F.round("x", 1).alias("d"), F.round("v_mph", 2).alias("v"))))
    return points.groupBy(*keys, "chunk").agg(boxed.alias("p")).select(
        *keys, "chunk", F.to_json(F.struct(
            F.transform("p", lambda p: p["t"]).alias("t"), F.transform("p", lambda p: p["d"]).alias("dist_m"),
            F.transform("p", lambda p: p["v"]).alias("speed_mph"),
        )).alias("curve"), F.size("p").cast("long").alias("n_points"),
    )


def band_document(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bands of a trip and hour as one JSON list."""
    cols = [c for c in bands.columns if c not in keys]
    part = bands.withColumn("hour_no", F.floor(F.col("t_start") / 3600))
    return part.groupBy(*keys, "hour_no").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("t_start", *[c for c in cols if c != "t_start"])))).alias("delays"),
        F.count(F.lit(1)).alias("n_delays"),
    )


def observed_trip_comparison(
    phone: DataFrame, archive: DataFrame, rides: DataFrame, doors: DataFrame, observed: DataFrame, segments_of_shapes: DataFrame,
    segs: DataFrame, zones: DataFrame, seg_controls: DataFrame, facilities: DataFrame, stops: DataFrame, event_types: DataFrame,
    keys: Sequence[str] = ("trip_id",), *, min_s: float = 10.0,
) -> dict[str, DataFrame]:
    """Four sources of every ride on one clock: curves, bands, clocks.

    ``phone`` is smoothed over 20 neighbours, the isolated ``archive`` over 5.
    """
    keys = list(keys)
    phone_pieces, phone_rejects = smooth.reconstruct(phone, segments_of_shapes, keys, bandwidth=20)
    isolated = isolate_ride(archive, rides, segments_of_shapes, keys)
    archive_in = stage(isolated.select(*archive.columns), "isolated")
    archive_pieces, _ = smooth.reconstruct(archive_in, segments_of_shapes, keys, bandwidth=5)
    starts = [
        phone.groupBy(*keys).agg(F.min("ts").alias("start_ts")).withColumn("source", F.lit("phone")),
        archive_in.groupBy(*keys).agg(F.min("ts").alias("start_ts")).withColumn("source", F.lit("archive")),
        observed.groupBy(*keys).agg(F.min("start_ts").alias("start_ts")).withColumn("source", F.lit("observer")),
    ]
    clocks = stage(wall_clock_axis(starts, keys), "clocks")
    out = {"clocks": clocks, "rejects": phone_rejects}
    for name, pieces in (("phone", phone_pieces), ("archive", archive_pieces)):
        pieces = stage(pieces, f"{name}_pieces")
        _, named = delay.decompose(pieces, segs, zones, seg_controls, None, keys, min_s=min_s)
        offset = clocks.where(F.col("source") == name).select(*keys, "offset_s")
        out[name] = pieces
        out[f"{name}_bands"] = delay.delay_bands(named.join(offset, keys), facilities, keys, F.col("offset_s"))
    zero = clocks.groupBy(*keys).agg(F.min("t0").alias("t0"))
    out["observed_bands"] = observer_bands(observed, zero, keys)
    spans = phone.groupBy(*keys, "bus_id", "route_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    windows = spans.join(zero, keys).withColumnRenamed(keys[0], "trip_key")
    bands = door_bands(doors, windows, stops, event_types)
    out["door_bands"] = bands.withColumnRenamed("trip_key", keys[0])
    return out


def speed_mph(column: Column) -> Column:
    return column * MPS_TO_MPH
