"""How answers degrade with ping frequency, and how they compare with door events.

The level is one more key column, so all levels run in the same jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import (
    DOOR_ANY_S, DOOR_MAX_S, DOOR_MIN_S, DOOR_TOL_S, EVENT_MATCH_MIN_OVERLAP, MPS_TO_MPH, N_LEVELS, POS_TOL_M, SLOW_MPH, SPEED_TOL_MPH,
)
from kerbline.functions import curve
from kerbline.operators import delay, smooth
from kerbline.operators.intervals import overlap_join, overlap_seconds, salted_join
from kerbline.operators.ordered import cum_max, cum_sum, previous, scan, time_slice
from kerbline.operators.quantiles import quantiles
from kerbline.operators.stage import stage

LEVEL_KEYS = ["trip_id", "level"]


def every_nth(clocked: DataFrame, keys: Sequence[str], levels: int = N_LEVELS) -> DataFrame:
    """Each level k keeps every 2^k-th ping of a trip, the first one always.

    ``clocked`` holds ping_no, the zero-based position among all pings of a trip.
    """
    fits = F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.col("ping_no") % F.pow(F.lit(2.0), k).cast("long") == 0)
    return clocked.withColumn("level", F.explode(fits))


def number_pings(matched: DataFrame, keys: Sequence[str], tie: str = "event_id") -> DataFrame:
    at = matched.withColumn("__us", F.unix_micros("ts"))
    return scan(
        at, keys, ["__us", tie], F.floor(F.col("__us") / 7_200_000_000), ping_no=cum_sum(F.lit(1).cast("long"), strict=True)
    ).drop("__us")


def downsample_ladder(matched: DataFrame, *, levels: int = N_LEVELS, tie: str = "event_id") -> DataFrame:
    """Pings of every level with level clock, measured median cadence and bandwidth."""
    laddered = every_nth(number_pings(matched, ["trip_id"], tie), ["trip_id"], levels)
    clocked = stage(smooth.trip_clock(laddered, LEVEL_KEYS, tie), "ladder")
    gaps = scan(
        clocked.withColumn("__us", F.unix_micros("ts")).select(*LEVEL_KEYS, "__us", tie), LEVEL_KEYS, ["__us", tie],
        F.floor(F.col("__us") / 7_200_000_000), __p=previous(F.col("__us")),
    )
    cadence = quantiles(gaps, LEVEL_KEYS, (F.col("__us") - F.col("__p")) / 1e6, {"cadence_s": 0.5}, width=60.0)
    timed = salted_join(clocked, cadence, LEVEL_KEYS, F.col(tie), "left")
    measured = F.coalesce("cadence_s", 2.0 * F.pow(F.lit(2.0), F.col("level")))
    return timed.withColumn("bandwidth", curve.bandwidth_for_cadence(measured))


class Levels(dict):
    """Products by name, each built when it is first read, so a query writes only what it needs."""

    def __init__(self, builders: dict[str, Callable[[Levels], object]]):
        super().__init__()
        self.builders = builders

    def __missing__(self, name: str):
        self[name] = self.builders[name](self)
        return self[name]


def run_levels(
    ladder: DataFrame, segs: DataFrame, zones: DataFrame, seg_controls: DataFrame, *, min_s: float = 10.0
) -> Levels:
    """Pieces, samples, events, causes and segment rows of every (trip, level).

    Samples have a row for each second of each level, so they are never written: what reads them works on pieces.
    """
    return Levels({
        "pieces": lambda of: stage(smooth.smooth_pchip(smooth.on_route_trace(ladder), LEVEL_KEYS, bandwidth="bandwidth"), "level_pieces"),
        "samples": lambda of: smooth.sample_trajectory(of["pieces"], LEVEL_KEYS, rule="whole", floor_zero=True),
        "events": lambda of: stage(delay.curve_slow_events(of["pieces"], LEVEL_KEYS, min_s=min_s, rule="whole", floor_zero=True), "level_events"),
        "decomposed": lambda of: delay.decompose(of["pieces"], segs, zones, seg_controls, None, LEVEL_KEYS, dt=1.0, min_s=min_s),
        "attributed": lambda of: of["decomposed"][1],
        "rows": lambda of: stage(of["decomposed"][0], "level_rows"),
        "spans": lambda of: stage(common_span(of["pieces"]), "spans"),
        "failures": lambda of: smooth.rejects(ladder, LEVEL_KEYS),
    })


def _seconds(pieces: DataFrame) -> DataFrame:
    """Pieces with the whole seconds __a to __b that they own; the seconds of a curve are dealt to its pieces without overlap."""
    return smooth.owned_grid(pieces, rule="whole")


def _place(at: Column, curve_columns: Sequence[str]) -> tuple[Column, Column]:
    """Position and speed in mph, as in the levels' samples, of the piece with these columns."""
    piece = (at, *(F.col(c) for c in curve_columns))
    return curve.hermite(*piece), F.greatest(curve.hermite_speed(*piece) * MPS_TO_MPH, F.lit(0.0))


_PIECE = ("t", "x", "m", "t_next", "x_next", "m_next")
SECONDS_BIN = 600.0


def common_span(pieces: DataFrame) -> DataFrame:
    """Whole-second span shared by level 0 and each level: t_lo, t_hi."""
    spans = _seconds(pieces).groupBy(*LEVEL_KEYS).agg(F.min("__a").alias("a"), F.max("__b").alias("b"))
    base = spans.where(F.col("level") == 0).select("trip_id", F.col("a").alias("a0"), F.col("b").alias("b0"))
    return spans.join(base, "trip_id").select(
        *LEVEL_KEYS, F.greatest("a", "a0").alias("t_lo"), F.least("b", "b0").alias("t_hi")
    ).where(F.col("t_hi") > F.col("t_lo"))


def grid_components(pieces: DataFrame) -> DataFrame:
    """Position, speed and slow-state agreement with level 0, second by second.

    Pieces meet the pieces of level 0 that share seconds with them; the seconds are
    listed and summed inside the task of the pair.
    """
    every = _seconds(pieces).select(*LEVEL_KEYS, "__a", "__b", *_PIECE)
    base = _seconds(pieces.where(F.col("level") == 0)).select("trip_id", F.col("__a").alias("__a0"), F.col("__b").alias("__b0"), *[F.col(c).alias(f"{c}0") for c in _PIECE])
    met = overlap_join(every, base, ["trip_id"], ("__a", "__b"), ("__a0", "__b0"), SECONDS_BIN, touching=True)
    each = met.withColumn("i", F.explode(F.sequence(F.greatest("__a", "__a0"), F.least("__b", "__b0"))))
    at = F.col("i").cast("double")
    (x, v_mph), (x0, v0) = _place(at, _PIECE), _place(at, [f"{c}0" for c in _PIECE])
    both = each.select(*LEVEL_KEYS, "i", x.alias("x"), v_mph.alias("v_mph"), x0.alias("x0"), v0.alias("v0"))
    dx, dv = F.abs(F.col("x") - F.col("x0")), F.abs(F.col("v_mph") - F.col("v0"))
    b, v = F.col("v0") < SLOW_MPH, F.col("v_mph") < SLOW_MPH

    def count(c: Column, name: str) -> Column:
        return F.sum(c.cast("long")).alias(name)

    return both.groupBy(*LEVEL_KEYS).agg(
        F.count(F.lit(1)).alias("n_sec"), F.min("i").alias("__lo"), F.max("i").alias("__hi"), count(dx <= POS_TOL_M, "pos_ok"), F.sum(dx).alias("pos_abs_sum"),
        F.sum(dx * dx).alias("pos_sq_sum"), count(dv <= SPEED_TOL_MPH, "spd_ok"), F.sum(dv).alias("spd_abs_sum"),
        F.sum(dv * dv).alias("spd_sq_sum"), count(b & v, "tp"), count(~b & v, "fp"), count(b & ~v, "fn"),
    ).where(F.col("__hi") > F.col("__lo")).drop("__lo", "__hi")


def _inside_span(events: DataFrame, spans: DataFrame) -> DataFrame:
    covered = overlap_seconds(F.col("t_start"), F.col("t_end"), F.col("t_lo"), F.col("t_hi"))
    return events.join(spans, LEVEL_KEYS).where(covered >= 0.5 * (F.col("t_end") - F.col("t_start")))


def _bench_events(events: DataFrame, spans: DataFrame) -> DataFrame:
    base = events.where(F.col("level") == 0).drop("level")
    levels = spans.select("trip_id", "level", "t_lo", "t_hi")
    covered = overlap_seconds(F.col("t_start"), F.col("t_end"), F.col("t_lo"), F.col("t_hi"))
    return base.join(levels, "trip_id").where(covered >= 0.5 * (F.col("t_end") - F.col("t_start")))


def event_pairs(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Overlapping (level 0, level) event pairs that share half of the shorter one."""
    bench = _bench_events(events, spans).select(*LEVEL_KEYS, F.col("t_start").alias("b0"), F.col("t_end").alias("b1"))
    var = _inside_span(events, spans).select(*LEVEL_KEYS, F.col("t_start").alias("v0"), F.col("t_end").alias("v1"))
    pairs = overlap_join(bench, var, LEVEL_KEYS, ("b0", "b1"), ("v0", "v1"), 600.0)
    shared = overlap_seconds(F.col("b0"), F.col("b1"), F.col("v0"), F.col("v1"))
    shorter = F.least(F.col("b1") - F.col("b0"), F.col("v1") - F.col("v0"))
    return pairs.withColumn("overlap_s", shared).where(F.col("overlap_s") >= EVENT_MATCH_MIN_OVERLAP * shorter)


def match_events(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matches: largest overlap first, later events first on a tie.

    Pairs are cut into groups that share no event (gaps in the merged timeline),
    so each greedy fold sees one short stretch of one trip.
    """
    lo, hi = F.least("b0", "v0"), F.greatest("b1", "v1")
    rows = stage(pairs.withColumn("__lo", lo).withColumn("__hi", hi), "event_pairs")
    run = scan(rows, LEVEL_KEYS, ["__lo", "b0", "v0"], time_slice("__lo", 86400.0), __reach=cum_max(F.col("__hi"), strict=True))
    new = F.when(F.coalesce(F.col("__lo") < F.col("__reach"), F.lit(False)), 0).otherwise(1)
    grouped = scan(run, LEVEL_KEYS, ["__lo", "b0", "v0"], time_slice("__lo", 86400.0), __g=cum_sum(new))
    order = F.sort_array(F.collect_list(F.struct("overlap_s", "b0", "v0")), asc=False)
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("b"), empty.alias("v"), F.lit(0).alias("n"))

    def take(acc: Column, p: Column) -> Column:
        free = ~F.array_contains(acc["b"], p["b0"]) & ~F.array_contains(acc["v"], p["v0"])
        return F.when(free, F.struct(
            F.array_append(acc["b"], p["b0"]).alias("b"), F.array_append(acc["v"], p["v0"]).alias("v"), (acc["n"] + 1).alias("n")
        )).otherwise(acc)

    return grouped.groupBy(*LEVEL_KEYS, "__g").agg(order.alias("__p")).select(
        *LEVEL_KEYS, F.aggregate("__p", start, take)["n"].alias("n")
    ).groupBy(*LEVEL_KEYS).agg(F.sum("n").alias("n_match_ev"))


def event_components(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events of both sides inside the common span, and matched ones."""
    n_b = _bench_events(events, spans).groupBy(*LEVEL_KEYS).agg(F.count(F.lit(1)).alias("n_bench_ev"))
    n_v = _inside_span(events, spans).groupBy(*LEVEL_KEYS).agg(F.count(F.lit(1)).alias("n_var_ev"))
    out = spans.select(*LEVEL_KEYS)
    for part in (n_b, n_v, match_events(event_pairs(events, spans))):
        out = out.join(part, LEVEL_KEYS, "left")
    return out.na.fill(0)


def attribution_seconds(attributed: DataFrame, spans: DataFrame) -> DataFrame:
    """Seconds per (cause, facility) of level 0 and of each level, outer-joined."""
    inside = overlap_seconds(F.col("t_start"), F.col("t_end"), F.col("t_lo"), F.col("t_hi"))
    key = [*LEVEL_KEYS, "category", "facility_id"]
    base = attributed.where(F.col("level") == 0).drop("level")

    def total(rows: DataFrame, on, name: str) -> DataFrame:
        clipped = rows.join(spans, on).withColumn("__s", inside).where(F.col("__s") > 0)
        return clipped.withColumn("facility_id", F.coalesce("facility_id", F.lit(""))).groupBy(*key).agg(F.sum("__s").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    both = total(base, ["trip_id"], "bench").join(total(attributed, LEVEL_KEYS, "var"), key, "full")
    return both.na.fill(0, ["bench", "var", "n_bench", "n_var"])


def attribution_components(seconds_both: DataFrame, spans: DataFrame) -> DataFrame:
    sums = seconds_both.groupBy(*LEVEL_KEYS).agg(
        F.sum(F.least("bench", "var")).alias("attr_min_sum"), F.sum(F.greatest("bench", "var")).alias("attr_max_sum")
    )
    return spans.select(*LEVEL_KEYS).join(sums, LEVEL_KEYS, "left").na.fill(0.0)


def door_intervals(doors: DataFrame, clock: DataFrame, min_s: float, types: Sequence[int]) -> DataFrame:
    """Door-open spans in trip seconds. clock: trip_id, t_start (first ping)."""
    open_s = (F.unix_micros("ts") - F.unix_micros("t_start")) / 1e6
    good = doors.where(F.col("event_type").isin(*types) & F.col("dwell_s").between(min_s, DOOR_MAX_S))
    return good.join(clock, "trip_id").select(
        "trip_id", "event_id", "stop_id", open_s.alias("open_s"), (open_s + F.col("dwell_s")).alias("close_s")
    )


def door_speed_components(pieces: DataFrame, spans: DataFrame, doors: DataFrame) -> DataFrame:
    """Seconds with open doors, and those the curve holds below the slow limit."""
    cut = doors.join(spans, "trip_id").withColumn("__lo", F.greatest("open_s", "t_lo")).withColumn("__hi", F.least("close_s", "t_hi"))
    solid = cut.where(F.col("__hi") - F.col("__lo") >= DOOR_MIN_S)
    first, last = F.ceil("__lo"), F.floor("__hi")
    open_ = solid.select(*LEVEL_KEYS, first.alias("__first"), last.alias("__last")).where(F.col("__last") >= F.col("__first"))
    owned = _seconds(pieces).select(*LEVEL_KEYS, "__a", "__b", *_PIECE)
    met = overlap_join(open_, owned, LEVEL_KEYS, ("__first", "__last"), ("__a", "__b"), SECONDS_BIN, touching=True)
    each = met.withColumn("i", F.explode(F.sequence(F.greatest("__first", "__a"), F.least("__last", "__b"))))
    v_mph = _place(F.col("i").cast("double"), _PIECE)[1]
    sums = each.select(*LEVEL_KEYS, v_mph.alias("v_mph")).groupBy(*LEVEL_KEYS).agg(
        F.count(F.lit(1)).alias("door_sec"), F.sum((F.col("v_mph") < SLOW_MPH).cast("long")).alias("door_slow")
    )
    return spans.select(*LEVEL_KEYS).join(sums, LEVEL_KEYS, "left").na.fill(0)


def _dwell_claims(attributed: DataFrame, spans: DataFrame) -> DataFrame:
    inside = overlap_seconds(F.col("t_start"), F.col("t_end"), F.col("t_lo"), F.col("t_hi"))
    return attributed.where(F.col("category") == "dwell").join(spans, LEVEL_KEYS).where(inside > 0).select(
        *LEVEL_KEYS, F.col("t_start").alias("a0"), F.col("t_end").alias("a1"), "facility_id", "dwell_near_signal"
    )


def dwell_components(attributed: DataFrame, spans: DataFrame, serviced: DataFrame, any_door: DataFrame) -> DataFrame:
    """Recall of serviced stops and precision of claimed dwells, with near-side misses.

    ``serviced``: door spans of type 3 of at least 10 s. ``any_door``: any door
    activity of at least 5 s. A claim matches within 30 s.
    """
    claims = stage(_dwell_claims(attributed, spans), "claims")
    usable = ~F.col("stop_id").isin("", "None")
    targets = serviced.where(usable).join(spans, "trip_id").where(
        (F.col("open_s") >= F.col("t_lo")) & (F.col("close_s") <= F.col("t_hi"))
    ).select(*LEVEL_KEYS, "event_id", "stop_id", (F.col("open_s") - DOOR_TOL_S).alias("d0"), (F.col("close_s") + DOOR_TOL_S).alias("d1"))
    hits = overlap_join(targets, claims, LEVEL_KEYS, ("d0", "d1"), ("a0", "a1"), 600.0).groupBy(*LEVEL_KEYS, "event_id").agg(
        F.max((F.col("facility_id") == F.col("stop_id")).cast("long")).alias("same")
    ).groupBy(*LEVEL_KEYS).agg(F.sum("same").alias("dwell_match_id"), F.count(F.lit(1)).alias("dwell_match_time"))
    n_targets = targets.groupBy(*LEVEL_KEYS).agg(F.count(F.lit(1)).alias("dwell_targets"))
    acts = any_door.where(usable).select("trip_id", F.col("stop_id").alias("facility_id"), F.col("open_s").alias("o0"), F.col("close_s").alias("o1"))
    wide = claims.select(*LEVEL_KEYS, "facility_id", "a0", (F.col("a0") - DOOR_TOL_S).alias("w0"), (F.col("a1") + DOOR_TOL_S).alias("w1"))
    backed = overlap_join(wide, acts, ["trip_id", "facility_id"], ("w0", "w1"), ("o0", "o1"), 600.0).select(*LEVEL_KEYS, "a0").distinct().withColumn("__ok", F.lit(1))
    near = F.col("dwell_near_signal").cast("long")
    ok = F.coalesce("__ok", F.lit(0)).cast("long")
    n_claims = claims.join(backed, [*LEVEL_KEYS, "a0"], "left").groupBy(*LEVEL_KEYS).agg(
        F.count(F.lit(1)).alias("dwell_pred"), F.sum(ok).alias("dwell_pred_ok"), F.sum(near).alias("dwell_pred_near"), F.sum(near * (1 - ok)).alias("dwell_fp_near")
    )
    out = spans.select(*LEVEL_KEYS)
    for part in (n_targets, hits, n_claims):
        out = out.join(part, LEVEL_KEYS, "left")
    return out.na.fill(0)


def score(levels: Levels, doors: DataFrame, clock: DataFrame) -> DataFrame:
    """All additive components per (trip, level)."""
    spans, named = levels["spans"], levels["attributed"]
    parts = [
        event_components(levels["events"], spans), attribution_components(attribution_seconds(named, spans), spans),
        door_speed_components(levels["pieces"], spans, door_intervals(doors, clock, DOOR_MIN_S, (3, 4, 5))),
        dwell_components(named, spans, door_intervals(doors, clock, DOOR_MIN_S, (3,)), door_intervals(doors, clock, DOOR_ANY_S, (3, 4, 5))),
    ]
    out = grid_components(levels["pieces"])
    for part in parts:
        out = out.join(stage(part, "components"), LEVEL_KEYS, "left")
    return out


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def metric_columns() -> list[Column]:
    c = F.col
    return [
        (100 * _ratio(c("pos_ok"), c("n_sec"))).alias("m1_position_pct"), (100 * _ratio(c("spd_ok"), c("n_sec"))).alias("m2_speed_pct"),
        (100 * _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))).alias("m3_slow_f1"),
        (100 * _ratio(2 * c("n_match_ev"), c("n_bench_ev") + c("n_var_ev"))).alias("m4_event_f1"),
        (100 * _ratio(c("attr_min_sum"), c("attr_max_sum"))).alias("m5_jaccard"),
        (100 * _ratio(c("door_slow"), c("door_sec"))).alias("m6_door_speed_pct"),
        (100 * _ratio(c("dwell_match_id"), c("dwell_targets"))).alias("m7_recall_pct"),
        (100 * _ratio(c("dwell_match_time"), c("dwell_targets"))).alias("m7_recall_time_pct"),
        (100 * _ratio(c("dwell_pred_ok"), c("dwell_pred"))).alias("m7_precision_pct"),
        (100 * _ratio(c("dwell_pred_near"), c("dwell_pred"))).alias("m7_near_share_pct"),
        (100 * _ratio(c("dwell_fp_near"), c("dwell_pred") - c("dwell_pred_ok"))).alias("m7_near_fp_pct"),
        F.sqrt(_ratio(c("pos_sq_sum"), c("n_sec"))).alias("pos_rmse_m"), F.sqrt(_ratio(c("spd_sq_sum"), c("n_sec"))).alias("spd_rmse_mph"),
        _ratio(c("pos_abs_sum"), c("n_sec")).alias("pos_mae_m"), _ratio(c("spd_abs_sum"), c("n_sec")).alias("spd_mae_mph"),
    ]


def complete_trips(components: DataFrame, levels: int = N_LEVELS) -> DataFrame:
    """Trips that succeed at every level."""
    return components.groupBy("trip_id").agg(F.countDistinct("level").alias("n")).where(F.col("n") == levels).select("trip_id")


def level_success_rate(ladder: DataFrame, pieces: DataFrame) -> DataFrame:
    """Share of trips with a curve per level."""
    tried = ladder.select(*LEVEL_KEYS).distinct()
    done = pieces.select(*LEVEL_KEYS).distinct().withColumn("ok", F.lit(1))
    return tried.join(done, LEVEL_KEYS, "left").groupBy("level").agg(
        F.count(F.lit(1)).alias("n_trips"), F.count("ok").alias("n_ok"), F.avg(F.coalesce("ok", F.lit(0)).cast("double")).alias("ok_share")
    )


def pool_metrics(components: DataFrame) -> DataFrame:
    """Summed components, then ratios, per level."""
    cols = [c for c in components.columns if c not in LEVEL_KEYS]
    pooled = components.groupBy("level").agg(*[F.sum(c).alias(c) for c in cols])
    return pooled.select("level", *metric_columns())


def per_trip_metrics(components: DataFrame) -> DataFrame:
    return components.select(*LEVEL_KEYS, *metric_columns())


def iqr_by_level(metrics: DataFrame, column: str, *, normalise: bool = False) -> DataFrame:
    """Quartiles over trips per level, optionally relative to the trip's level 0."""
    rows = metrics.select(*LEVEL_KEYS, F.col(column).alias("__v"))
    if normalise:
        base = rows.where(F.col("level") == 0).select("trip_id", F.col("__v").alias("__b"))
        rows = rows.join(base, "trip_id").withColumn("__v", 100 * _ratio(F.col("__v"), F.col("__b")))
    return quantiles(rows, ["level"], F.col("__v"), {"q25": 0.25, "median": 0.5, "q75": 0.75})


def knee(pooled: DataFrame, columns: Sequence[str], share: float = 0.9) -> DataFrame:
    """Last level within ``share`` of level 0 per metric; null when it is the last level."""
    long = pooled.unpivot(["level"], list(columns), "metric", "value")
    base = long.where(F.col("level") == 0).select("metric", F.col("value").alias("v0"))
    stats = long.join(base, "metric").groupBy("metric").agg(
        F.max("level").alias("__last"), F.max(F.when(F.col("value") >= share * F.col("v0"), F.col("level"))).alias("__k")
    )
    return stats.select("metric", F.when(F.col("__k") < F.col("__last"), F.col("__k")).alias("knee_level"))


def segment_ledger(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Dwell and signal seconds of level 0 and each level on segments both cover."""
    spans = pieces.groupBy(*LEVEL_KEYS).agg(F.min("x_first").alias("a"), F.max("x_last").alias("b"))
    base_span = spans.where(F.col("level") == 0).select("trip_id", F.col("a").alias("a0"), F.col("b").alias("b0"))
    cover = spans.join(base_span, "trip_id").select(*LEVEL_KEYS, F.greatest("a", "a0").alias("x_lo"), F.least("b", "b0").alias("x_hi"))
    bench = rows.where(F.col("level") == 0).select("trip_id", "seg_id", F.col("t_dwell").alias("bench_dwell_s"), F.col("d_signal").alias("bench_signal_s"))
    var = rows.select(*LEVEL_KEYS, "seg_id", "x_start", "x_end", F.col("t_dwell").alias("var_dwell_s"), F.col("d_signal").alias("var_signal_s"))
    return var.join(cover, LEVEL_KEYS).where((F.col("x_start") >= F.col("x_lo")) & (F.col("x_end") <= F.col("x_hi"))).join(bench, ["trip_id", "seg_id"]).select(
        *LEVEL_KEYS, "seg_id", (F.col("x_end") - F.col("x_start")).alias("length_m"), "bench_dwell_s", "var_dwell_s", "bench_signal_s", "var_signal_s"
    )


def segment_agreement(ledger: DataFrame) -> DataFrame:
    """Agreement and non-zero error per level for dwell and signal seconds."""
    aggs = [F.count(F.lit(1)).alias("n_segments")]
    for c in ("dwell", "signal"):
        b, v = F.col(f"bench_{c}_s"), F.col(f"var_{c}_s")
        aggs += [
            (100 * F.sum(F.least(b, v)) / F.greatest(F.sum(F.greatest(b, v)), F.lit(1e-9))).alias(f"{c}_agree_pct"),
            F.coalesce(F.avg(F.when((b > 0) | (v > 0), F.abs(v - b))), F.lit(0.0)).alias(f"{c}_mae_s"),
            F.sum(b).alias(f"{c}_bench_s"), F.sum(v).alias(f"{c}_var_s"),
        ]
    return ledger.groupBy("level").agg(*aggs)


def scope_ladder(seconds_both: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Agreement at total, category and facility scope and per cause, by level.

    Seconds are first summed per trip at each scope, then pooled.
    """
    parts = []
    for scope, key in (("total", []), ("category", ["category"]), ("facility", ["category", "facility_id"])):
        per = seconds_both.groupBy(*LEVEL_KEYS, *key).agg(F.sum("bench").alias("b"), F.sum("var").alias("v"))
        parts.append(per.select(*LEVEL_KEYS, F.lit(scope).alias("scope"), F.least("b", "v").alias("lo"), F.greatest("b", "v").alias("hi"), "b", "v"))
    parts.append(seconds_both.select(
        *LEVEL_KEYS, F.concat(F.lit("cat:"), "category").alias("scope"), F.least("bench", "var").alias("lo"), F.greatest("bench", "var").alias("hi"),
        F.col("bench").alias("b"), F.col("var").alias("v"),
    ))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    by = ["level", "scope"]
    if routes is not None:
        rows, by = rows.join(routes, "trip_id"), [*by, "route_id"]
    return rows.groupBy(*by).agg(
        F.sum("lo").alias("s_min"), F.sum("hi").alias("s_max"), F.sum("b").alias("bench_s"), F.sum("v").alias("var_s")
    ).withColumn("agree_pct", 100 * _ratio(F.col("s_min"), F.col("s_max")))
