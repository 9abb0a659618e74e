"""Corridor and facility tables over many decomposed trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import CATEGORIES, M_PER_MI
from kerbline.functions import geo, text
from kerbline.operators.ordered import number_rows
from kerbline.operators.quantiles import quantiles
from kerbline.operators.segments import route_features

MEASURES = (
    "t_obs", "t_ff", "t_dwell", "d_signal", "d_signal_uniform", "d_signal_overflow", "d_crossing", "d_congestion",
    "t_dwell_core", "t_dwell_loss", "d_signal_uniform_core", "d_signal_uniform_loss", "d_signal_overflow_core",
    "d_signal_overflow_loss", "d_crossing_core", "d_crossing_loss", "t_dwell_near_signal",
)
QUARTILES = {"median_s": 0.5, "q25_s": 0.25, "q75_s": 0.75, "p95_s": 0.95}


def _known(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column))


def aggregate_trips(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of every measure per segment, over all trips."""
    stats = []
    for m in MEASURES:
        stats += [F.avg(_known(m)).alias(f"mean_{m}"), F.stddev_pop(_known(m)).alias(f"std_{m}")]
    out = rows.groupBy("shape_id", "seg_id").agg(
        F.count(F.lit(1)).alias("n_trips"), F.min("x_start").alias("x_start"), F.min("x_end").alias("x_end"), *stats
    )
    share = F.col("mean_t_dwell_near_signal") / F.nullif(F.col("mean_t_dwell"), F.lit(0.0))
    return out.withColumn("near_signal_share", F.coalesce(share, F.lit(0.0)))


def segment_payload(aggregate: DataFrame) -> DataFrame:
    """Mean minutes per segment; congestion split by sign."""
    near = F.col("mean_t_dwell_near_signal")
    congestion = F.col("mean_d_congestion")

    def minutes(c: Column, name: str) -> Column:
        return (c / 60).alias(name)

    return aggregate.select(
        "shape_id", "seg_id", F.col("x_start").alias("dist_start_m"), F.col("x_end").alias("dist_end_m"), "n_trips",
        minutes(F.col("mean_t_ff"), "t_ff_min"),
        minutes(F.greatest(F.lit(0.0), F.col("mean_t_dwell") - near), "t_dwell_clean_min"),
        minutes(near, "t_dwell_near_signal_min"),
        minutes(F.col("mean_d_signal_uniform"), "d_signal_uniform_min"),
        minutes(F.col("mean_d_signal_overflow"), "d_signal_overflow_min"),
        minutes(F.col("mean_d_crossing"), "d_crossing_min"),
        minutes(F.when(congestion.isNotNull(), F.greatest(F.lit(0.0), congestion)), "d_congestion_pos_min"),
        minutes(F.when(congestion.isNotNull(), F.greatest(F.lit(0.0), -congestion)), "d_congestion_neg_min"),
    )


def segments_lookup(segs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows per segment with the segment's place on the route."""
    return segs.select("shape_id", "seg_id", "up_node", "down_node").join(rows, ["shape_id", "seg_id"])


def facility_seconds(attributed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds per trip and facility, per trip, facility and cause, and the rest.

    ``level`` is facility, category or other; whole event durations count.
    """
    keys = list(keys)
    rest = F.col("facility_id").isNull() | (F.col("category") == "slowdown")
    named = attributed.where(~rest)
    sets = named.groupingSets(
        [[*keys, "shape_id", "facility_id"], [*keys, "shape_id", "facility_id", "category"]],
        *keys, "shape_id", "facility_id", "category",
    ).agg(F.sum("core_s").alias("seconds"), F.grouping("category").alias("__g"))
    split = sets.select(
        *keys, "shape_id", F.when(F.col("__g") == 1, "facility").otherwise("category").alias("level"),
        "facility_id", "category", "seconds",
    )
    other = attributed.groupBy(*keys, "shape_id").agg(F.sum(F.when(rest, F.col("core_s")).otherwise(0.0)).alias("seconds"))
    none = F.lit(None).cast("string")
    return split.unionByName(other.select(
        *keys, "shape_id", F.lit("other").alias("level"), none.alias("facility_id"), none.alias("category"), "seconds"
    ))


def _zero_filled(per_trip: DataFrame, by: Sequence[str], value: str, trips: DataFrame) -> DataFrame:
    """Statistics over every trip of the shape, trips without a row counting as 0.

    No trip × facility grid is built: the missing trips enter the percentiles as
    one counted zero per group and the moments through the trip count.
    """
    by = list(by)
    x = F.col(value)
    sums = per_trip.groupBy(*by).agg(
        F.sum(x).alias("total_s"), F.avg(x).alias("__mean"), F.var_pop(x).alias("__var"), F.count(F.lit(1)).alias("__rows"),
        F.sum((x > 0).cast("long")).alias("n"),
    )
    sized = sums.join(trips.select("shape_id", "n_trips"), "shape_id")
    zeros = sized.select(*by, (F.col("n_trips") - F.col("__rows")).alias("n"))
    spread = quantiles(per_trip, by, x, QUARTILES, zeros=zeros)
    mean = F.col("total_s") / F.col("n_trips")
    # rows and counted zeros are two groups: their own spread and that of their means
    share = F.col("__rows") / F.col("n_trips")
    out = sized.join(spread, by).withColumn("mean_s", mean).withColumn(
        "std_s", F.sqrt(share * F.col("__var") + share * (1 - share) * F.col("__mean") * F.col("__mean"))
    )
    return out.withColumn("buffer_s", F.greatest(F.lit(0.0), F.col("p95_s") - F.col("mean_s"))).select(
        *by, "n_trips", "n", "total_s", "mean_s", "std_s", "median_s", "q25_s", "q75_s", "p95_s", "buffer_s"
    )


def trips_per_shape(trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of trips of every shape, failed ones included."""
    return trips.select(*keys, "shape_id").distinct().groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_trips"))


def facility_stats(attributed: DataFrame, trips: DataFrame, facilities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delay statistics of facilities with any delay; ``trips`` holds (shape_id, n_trips)."""
    named = attributed.where(F.col("facility_id").isNotNull() & (F.col("category") != "slowdown"))
    per_trip = named.groupBy(*keys, "shape_id", "facility_id").agg(F.sum("core_s").alias("sec"))
    stats = _zero_filled(per_trip, ["shape_id", "facility_id"], "sec", trips)
    about = facilities.select("shape_id", "facility_id", "label", "kind", (F.col("dist_m") / M_PER_MI).alias("mile"))
    return about.join(stats.where(F.col("n") > 0), ["shape_id", "facility_id"])


def congestion_stats(rows: DataFrame, trips: DataFrame) -> DataFrame:
    """Statistics of the positive residual per segment, placed at its midpoint."""
    positive = rows.select(
        "shape_id", "seg_id", "x_start", "x_end", F.greatest(F.lit(0.0), "d_congestion").alias("sec"), "d_congestion"
    ).where(_known("d_congestion").isNotNull())
    stats = _zero_filled(positive, ["shape_id", "seg_id"], "sec", trips).where(F.col("n") > 0)
    place = rows.groupBy("shape_id", "seg_id").agg(((F.min("x_start") + F.min("x_end")) / 2 / M_PER_MI).alias("mile"))
    return place.join(stats, ["shape_id", "seg_id"])


def other_stats(attributed: DataFrame, trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unattributed seconds per trip: totals and quartiles per shape, zero-filled."""
    rest = F.col("facility_id").isNull() | (F.col("category") == "slowdown")
    per_trip = attributed.where(rest).groupBy(*keys, "shape_id").agg(F.sum("core_s").alias("sec"))
    return _zero_filled(per_trip, ["shape_id"], "sec", trips)


def category_totals(rows: DataFrame) -> DataFrame:
    """Corridor minutes per cause and shape; dwell split near-side and clean, congestion net."""
    minutes = rows.groupBy("shape_id").agg(
        F.sum("t_ff").alias("freeflow"), F.sum(F.greatest(F.lit(0.0), F.col("t_dwell") - F.col("t_dwell_near_signal"))).alias("dwell_clean"),
        F.sum("t_dwell_near_signal").alias("dwell_near_signal"), F.sum("d_signal_uniform").alias("signal_uniform"),
        F.sum("d_signal_overflow").alias("signal_overflow"), F.sum("d_crossing").alias("crossing"),
        F.sum("d_congestion").alias("congestion_net"),
    )
    names = ["freeflow", "dwell_clean", "dwell_near_signal", "signal_uniform", "signal_overflow", "crossing", "congestion_net"]
    return minutes.unpivot(["shape_id"], names, "cause", "seconds").select(
        "shape_id", "cause", (F.col("seconds") / 60).alias("minutes")
    )


def event_counts(attributed: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events per cause of every trip × segment, zeros included."""
    by = [*keys, "shape_id", "seg_id"]
    counts = attributed.groupBy(*by).pivot("category", list(CATEGORIES)).agg(F.count(F.lit(1)))
    return rows.select(*by).join(counts, by, "left").select(
        *by, *[F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c}") for c in CATEGORIES]
    )


def rank_facilities(stats: DataFrame, column: str, n: int | None = None, name: str = "rank") -> DataFrame:
    """Position by a statistic, largest first, per shape; optionally the first n."""
    place = stats.withColumn("__neg", -F.col(column))
    ranked = number_rows(place, ["shape_id"], ["__neg", "facility_id"], F.floor(F.col("__neg") / 60), name)
    ranked = ranked.withColumn(name, F.col(name) + 1).drop("__neg")
    return ranked if n is None else ranked.where(F.col(name) <= n)


def rest_bucket(stats: DataFrame, n: int = 50) -> DataFrame:
    """The n facilities with the largest mean and one combined row of the others."""
    ranked = rank_facilities(stats, "mean_s")
    cols = ["shape_id", "facility_id", "n", "total_s", "mean_s", "std_s"]
    rest = ranked.where(F.col("rank") > n).groupBy("shape_id").agg(
        F.concat(F.lit("other "), F.count(F.lit(1))).alias("facility_id"), F.lit(-1).cast("long").alias("n"),
        F.sum("total_s").alias("total_s"), F.sum("mean_s").alias("mean_s"),
        F.sqrt(F.sum(F.col("std_s") * F.col("std_s"))).alias("std_s"),
    )
    return ranked.where(F.col("rank") <= n).select(*cols).unionByName(rest.select(*cols))


def attributed_share(attributed: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each trip's run time spent at facilities, in slowdowns and moving."""
    run = pieces.groupBy(*keys).agg((F.max("t_last") - F.min("t_first")).alias("run_s"))
    spent = attributed.groupBy(*keys).agg(
        F.sum(F.when(F.col("category") != "slowdown", F.col("core_s")).otherwise(0.0)).alias("facility_s"),
        F.sum(F.when(F.col("category") == "slowdown", F.col("core_s")).otherwise(0.0)).alias("slowdown_s"),
    )
    whole = F.nullif(F.col("run_s"), F.lit(0.0))
    out = run.join(spent, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("facility_s", "slowdown_s")})
    return out.select(
        *keys, "run_s", (F.col("facility_s") / whole).alias("facility_share"), (F.col("slowdown_s") / whole).alias("slowdown_share"),
        (1 - (F.col("facility_s") + F.col("slowdown_s")) / whole).alias("moving_share"),
    )


def facility_lookup(features: DataFrame, stats: DataFrame, min_p95_s: float = 30.0) -> DataFrame:
    """Features with their statistics in minutes, zeros where nothing happened."""
    picked = stats.select("shape_id", "facility_id", "mean_s", "p95_s")
    joined = features.join(picked, ["shape_id", "facility_id"], "left")
    mean, p95 = F.coalesce("mean_s", F.lit(0.0)), F.coalesce("p95_s", F.lit(0.0))
    return joined.select(
        *features.columns, (mean / 60).alias("mean_min"), (p95 / 60).alias("p95_min"),
        (F.greatest(F.lit(0.0), p95 - mean) / 60).alias("buffer_min"), (p95 >= min_p95_s).alias("attributed"),
    )


def flag_referenced(features: DataFrame, delays: DataFrame, trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features of each trip's shape, flagged where a delay of that trip refers to them by its trailing digits."""
    keys = list(keys)
    each = trips.select(*keys, "shape_id").distinct().join(features, "shape_id").withColumn("__d", text.trailing_digits(F.col("facility_id")))
    wanted = delays.select(*keys, "shape_id", text.trailing_digits(F.col("facility_id")).alias("__d")).where(F.col("__d").isNotNull()).distinct()
    return each.join(wanted.withColumn("__hit", F.lit(True)), [*keys, "shape_id", "__d"], "left").select(
        *keys, *features.columns, F.coalesce("__hit", F.lit(False)).alias("attributed")
    )


def route_aggregate(
    rows: DataFrame, attributed: DataFrame, trips: DataFrame, facilities: DataFrame, controls: DataFrame,
    stops: DataFrame, shapes: DataFrame, keys: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(segment minutes, features with statistics) of every shape."""
    features = route_features(controls, stops, shapes)
    stats = facility_stats(attributed, trips, facilities, keys)
    return segment_payload(aggregate_trips(rows)), facility_lookup(features, stats)


def ping_density(pings: DataFrame, group: str, cell_m: float = 500.0) -> DataFrame:
    """Ping counts per square map cell."""
    return pings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(
        group, F.floor(geo.web_mercator_x(F.col("lon")) / cell_m).alias("cx"),
        F.floor(geo.web_mercator_y(F.col("lat")) / cell_m).alias("cy"),
    ).agg(F.count(F.lit(1)).alias("n"))
