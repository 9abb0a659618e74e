"""Slow events, their causes, and travel time split by cause."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import (
    CREEP_MERGE_M, CROSSING_APPROACH_M, CRUISE_MPH, DENSE_DT_S, MIN_EVENT_S, MPS_TO_MPH, PAST_FACILITY_M,
    SIGNAL_APPROACH_M, SLOW_MPH,
)
from kerbline.functions import text
from kerbline.operators.intervals import hot_keys, overlap_join, overlap_seconds, split_join
from kerbline.operators.ordered import (
    following, islands, join_runs, last_known, next_known, previous, scan, sessions, time_slice, whole,
)
from kerbline.operators.quantiles import quantiles
from kerbline.operators.smooth import last_time_at, numbered_positions, owned_grid, sample_trajectory
from kerbline.operators.stage import stage

EVENT_BIN_S = 600.0
EVENT_SLICE_S = 86400.0
GRID_SLICE = 7200
POINTS_AT_ONCE = 1 << 18


def below_speed(limit: float = SLOW_MPH) -> Callable[..., Column]:
    """Default slow rule; any rule of (t, x, v_mph) columns can replace it."""
    return lambda t, x, v: v < limit


def slow_runs(samples: DataFrame, keys: Sequence[str], threshold: Callable[..., Column]) -> DataFrame:
    """Unbroken runs of slow samples."""
    return islands(
        samples, [*keys, "shape_id"], "i", F.floor(F.col("i") / GRID_SLICE),
        threshold(F.col("t"), F.col("x"), F.col("v_mph")), _run_facts(),
    )


def _run_facts() -> dict[str, tuple[str, Column]]:
    return {
        "t_start": ("min", F.col("t")), "t_end": ("max", F.col("t")),
        "x_start": ("first", F.col("x")), "x_end": ("last", F.col("x")),
        "min_v_mph": ("min", F.col("v_mph")),
    }


def _piece_runs(
    pieces: DataFrame, keys: Sequence[str], limit: float, dt: float, rule: str, floor_zero: bool, most: int = POINTS_AT_ONCE
) -> DataFrame:
    """Unbroken runs of slow grid points inside each piece, by index from __first to __last.

    The points are those of ``sample_trajectory``, with the same arithmetic, but only runs leave the
    worker; it holds ``most`` points at a time, and cuts runs there.
    """
    by, facts = [*keys, "shape_id"], list(_run_facts())
    curve = ["t", "x", "m", "t_next", "x_next", "m_next", "t_first", "t_last"]
    grid = owned_grid(pieces, dt=dt, rule=rule).select(*by, "__a", "__b", *[F.col(c).cast("double").alias(f"__{c}") for c in curve])

    def points(at: dict[str, np.ndarray], lo: int, hi: int):
        """Piece, index, time, position and speed of the points lo to hi of all points of a batch."""
        ends = at["ends"]
        p0, p1 = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right") + 1
        starts = np.maximum(ends[p0:p1] - at["size"][p0:p1], lo)
        p = np.repeat(np.arange(p0, p1), np.minimum(ends[p0:p1], hi) - starts)
        i = at["__a"][p] + np.arange(lo, hi) - (ends - at["size"])[p]
        t0, x0, m0, t1, x1, m1 = (at[f"__{c}"][p] for c in curve[:6])
        t = i.astype(float) if rule == "whole" else np.minimum(at["__t_first"][p] + i * float(dt), at["__t_last"][p])
        h = t1 - t0
        d = (x1 - x0) / h
        c2, c3 = (3 * d - 2 * m0 - m1) / h, (m0 + m1 - 2 * d) / (h * h)
        s = t - t0
        x, v = x0 + s * (m0 + s * (c2 + s * c3)), m0 + s * (2 * c2 + 3 * s * c3)
        x, v = np.where(np.isnan(x), x0, x), np.where(np.isnan(v), m0, v) * MPS_TO_MPH
        return p, i, t, x, np.maximum(v, 0.0) if floor_zero else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c.startswith("__")}
            at["size"] = at["__b"] - at["__a"] + 1
            at["ends"] = np.cumsum(at["size"])
            total = int(at["ends"][-1]) if len(at["ends"]) else 0
            for lo in range(0, total, most):
                with np.errstate(all="ignore"):
                    p, i, t, x, v = points(at, lo, min(lo + most, total))
                    hit = np.flatnonzero(v < limit)
                if not len(hit):
                    continue
                opens = np.append(True, (np.diff(hit) > 1) | (np.diff(p[hit]) > 0))
                first = np.flatnonzero(opens)
                a, b = hit[first], hit[np.append(first[1:], len(hit)) - 1]
                lowest = np.minimum.reduceat(v[hit], first)
                owner = pa.array(p[a])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(owner) for c in by], *[pa.array(z) for z in (i[a], i[b], t[a], t[b], x[a], x[b], lowest)]],
                    names=[*by, "__first", "__last", *facts],
                )

    named = [f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema if f.name in by]
    return grid.mapInArrow(run, ", ".join([*named, "__first bigint, __last bigint", *[f"{n} double" for n in facts]]))


def merge_close(runs: DataFrame, keys: Sequence[str], merge_m: float = CREEP_MERGE_M) -> DataFrame:
    """Join neighbouring runs when the vehicle crept less than ``merge_m`` between them."""
    by = [*keys, "shape_id"]
    grouped = sessions(
        runs, by, ["t_start"], time_slice("t_start", EVENT_SLICE_S),
        lambda prev: F.col("x_start") - prev >= merge_m, F.col("x_end"), "__event",
    )
    return grouped.groupBy(*by, "__event").agg(
        F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"),
        F.min_by("x_start", "t_start").alias("x_start"), F.max_by("x_end", "t_start").alias("x_end"),
        F.min("min_v_mph").alias("min_v_mph"),
    ).drop("__event")


def slow_events(
    samples: DataFrame, keys: Sequence[str], *, threshold: Callable[..., Column] | None = None,
    min_s: float = MIN_EVENT_S, merge_m: float = CREEP_MERGE_M,
) -> DataFrame:
    """Slow runs of at least ``min_s``, creeping neighbours merged."""
    runs = slow_runs(samples, keys, threshold or below_speed())
    return merge_close(runs.where(F.col("t_end") - F.col("t_start") >= min_s), keys, merge_m)


def curve_slow_events(
    pieces: DataFrame, keys: Sequence[str], *, limit: float = SLOW_MPH, min_s: float = MIN_EVENT_S, merge_m: float = CREEP_MERGE_M,
    dt: float = 1.0, rule: str = "clip", floor_zero: bool = False,
) -> DataFrame:
    """``slow_events`` of the grid that ``sample_trajectory`` makes of the pieces; its points are neither written nor shuffled."""
    parts = _piece_runs(pieces, keys, limit, dt, rule, floor_zero)
    runs = join_runs(parts, [*keys, "shape_id"], F.floor(F.col("__first") / (16 * GRID_SLICE)), _run_facts())
    return merge_close(runs.where(F.col("t_end") - F.col("t_start") >= min_s), keys, merge_m)


def loss_shoulders(
    samples: DataFrame, events: DataFrame, keys: Sequence[str], *, cruise_mph: float = CRUISE_MPH
) -> DataFrame:
    """Braking start and regained-speed end of every event: decel_lo, accel_hi.

    Braking reaches back while speed is below cruise and falls strictly toward
    the event; accelerating likewise. Empty shoulders equal the event bounds.
    """
    keys = list(keys)
    cut = F.floor(F.col("i") / GRID_SLICE)
    at = F.struct("t", "v_mph")
    near = scan(samples, keys, ["i"], cut, __p=previous(at), __q=following(at))
    v, p, q = F.col("v_mph"), F.col("__p"), F.col("__q")
    # A sample belongs to a falling (rising) flank when it is below cruise and
    # faster than the sample after (before) it; the first sample off the flank,
    # seen from the event, ends the shoulder.
    falling = (v < cruise_mph) & (v > q["v_mph"])
    rising = (v < cruise_mph) & (v > p["v_mph"])
    # It keeps the time of its neighbour toward the event, the last one on the flank, so no index is looked up again.
    flagged = near.withColumn("__ft", F.when(~F.coalesce(falling, F.lit(False)), F.struct(q["t"].alias("t")))).withColumn(
        "__rt", F.when(~F.coalesce(rising, F.lit(False)), F.struct(p["t"].alias("t")))
    )
    t = F.col("t")
    reach = scan(
        flagged.select(*keys, "i", "t", "__ft", "__rt"), keys, ["i"], cut,
        __fb=last_known(F.col("__ft"), strict=True), __ra=next_known(F.col("__rt"), strict=True),
        __t0=whole("min", F.when(F.col("i") == 0, t)), __t1=whole("max", t),
    )
    onto = F.when(F.col("__fb").isNull(), F.col("__t0")).otherwise(F.col("__fb")["t"])
    off = F.when(F.col("__ra").isNull(), F.col("__t1")).otherwise(F.col("__ra")["t"])
    sides = F.array(*[F.struct(F.col(c).alias("t"), F.lit(c).alias("side")) for c in ("t_start", "t_end")])
    marks = events.select(*keys, "t_start", "t_end", F.explode(sides).alias("__e")).select(*keys, "t_start", "t_end", "__e.t", "__e.side")
    found = marks.join(reach.select(*keys, "t", onto.alias("__lo"), off.alias("__hi")), [*keys, "t"]).groupBy(*keys, "t_start", "t_end").agg(
        F.max(F.when(F.col("side") == "t_start", F.col("__lo"))).alias("__lo_t"), F.max(F.when(F.col("side") == "t_end", F.col("__hi"))).alias("__hi_t"),
    )
    out = events.join(found, [*keys, "t_start", "t_end"], "left")
    return out.select(
        *events.columns,
        F.coalesce(F.least("__lo_t", "t_start"), "t_start").alias("decel_lo"),
        F.coalesce(F.greatest("__hi_t", "t_end"), "t_end").alias("accel_hi"),
    )


def segment_times(pieces: DataFrame, segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entry, exit and observed time of every trip on every segment of its shape."""
    keys = list(keys)
    ends = segs.select("shape_id", F.col("x_start").alias("pos_m")).union(
        segs.select("shape_id", F.col("x_end").alias("pos_m"))
    )
    hot = hot_keys(pieces, ["shape_id"])
    at = last_time_at(pieces, ends, keys, hot=hot).select(*keys, "shape_id", "place_no", "t_at")
    number = numbered_positions(ends)
    spans = segs.select("shape_id", "seg_id", "x_start", "x_end", "down_node")
    of = lambda end: spans.join(number, (spans["shape_id"] == number["shape_id"]) & (spans[end] == number["pos_m"])).select(spans["*"], "place_no", F.lit(end).alias("__end"))
    sides = stage(of("x_start").unionByName(of("x_end")), "sides")
    met = split_join(at, sides, ["shape_id", "place_no"], F.struct(*keys), hot)
    time = lambda end: F.max(F.when(F.col("__end") == end, F.col("t_at")))
    both = met.groupBy(*keys, "shape_id", "seg_id", "x_start", "x_end", "down_node").agg(time("x_start").alias("t_in"), time("x_end").alias("t_out"))
    return both.withColumn("t_obs", F.col("t_out") - F.col("t_in"))


def event_segments(events: DataFrame, times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every event with each segment it overlaps in time, and the seconds inside."""
    by = [*keys, "shape_id"]
    spans = times.select(*by, "seg_id", F.col("x_start").alias("seg_start"), F.col("x_end").alias("seg_end"), "down_node", "t_in", "t_out")
    pairs = overlap_join(events, spans, by, ("t_start", "t_end"), ("t_in", "t_out"), EVENT_BIN_S)
    return pairs.withColumn("in_seg_s", overlap_seconds(F.col("t_start"), F.col("t_end"), F.col("t_in"), F.col("t_out")))


def primary_segment(pairs: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segment with the largest time overlap; the earlier segment wins a tie."""
    best = F.struct((-F.col("in_seg_s")).alias("a"), F.col("seg_start").alias("b"))
    return pairs.groupBy(*keys, "shape_id", "t_start").agg(
        F.first("t_end").alias("t_end"), F.first("x_start").alias("x_start"), F.first("x_end").alias("x_end"),
        F.first("min_v_mph").alias("min_v_mph"),
        F.min_by(F.struct("seg_id", "seg_start", "seg_end", "down_node", "in_seg_s"), best).alias("__b"),
    ).select(
        *keys, "shape_id", "t_start", "t_end", "x_start", "x_end", "min_v_mph",
        "__b.seg_id", "__b.seg_start", "__b.seg_end", "__b.down_node", F.col("__b.in_seg_s").alias("in_primary_s"),
    )


def proximity_dwells(primary: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First stop, in route order, whose zone the event's span touches."""
    spans = zones.select(
        "shape_id", "seg_id", "stop_id", F.col("dist_m").alias("stop_m"), "is_near_side", "zone_lo", "zone_hi"
    ).where(F.col("zone_hi") >= F.col("zone_lo"))
    hit = overlap_join(
        primary, spans, ["shape_id", "seg_id"], ("x_start", "x_end"), ("zone_lo", "zone_hi"), 200.0, touching=True, hot=hot_keys(primary, ["shape_id", "seg_id"])
    )
    return hit.groupBy(*keys, "t_start").agg(
        F.min_by(F.struct("stop_id", "is_near_side"), F.struct("stop_m", "stop_id")).alias("__d")
    ).select(*keys, "t_start", F.col("__d.stop_id").alias("stop_id"), F.col("__d.is_near_side").alias("near_side"))


def door_dwells(
    primary: DataFrame, zones: DataFrame, doors: DataFrame, keys: Sequence[str], *, tol_s: float = 30.0
) -> DataFrame:
    """Stop of the door opening that overlaps the event, among the segment's stops.

    doors: keys, open_s, close_s, stop_id. Drop-in for the proximity rule.
    """
    padded = doors.select(
        *keys, "stop_id", (F.col("open_s") - tol_s).alias("open_s"), (F.col("close_s") + tol_s).alias("close_s")
    )
    hit = overlap_join(primary, padded, list(keys), ("t_start", "t_end"), ("open_s", "close_s"), EVENT_BIN_S)
    known = zones.select("shape_id", "seg_id", "stop_id", "is_near_side", F.col("dist_m").alias("stop_m"))
    return hit.join(known, ["shape_id", "seg_id", "stop_id"]).groupBy(*keys, "t_start").agg(
        F.min_by(F.struct("stop_id", "is_near_side"), F.struct("open_s", "stop_m", "stop_id")).alias("__d")
    ).select(*keys, "t_start", F.col("__d.stop_id").alias("stop_id"), F.col("__d.is_near_side").alias("near_side"))


def by_doors(doors: DataFrame, *, tol_s: float = 30.0) -> Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]:
    """A dwell rule that goes by door openings instead of stop zones."""
    return lambda primary, zones, keys: door_dwells(primary, zones, doors, keys, tol_s=tol_s)


def attribute_events(
    primary: DataFrame, dwells: DataFrame, seg_controls: DataFrame, keys: Sequence[str], *,
    crossing_m: float = CROSSING_APPROACH_M, signal_m: float = SIGNAL_APPROACH_M,
) -> DataFrame:
    """Cause of each event: dwell, then crossing, then signal, else slowdown."""
    keys = list(keys)
    zones = seg_controls.where(~text.is_signal(F.col("control_type"))).select(
        "shape_id", "seg_id", "node_id", F.col("dist_m").alias("cx_m"),
        (F.col("dist_m") - crossing_m).alias("__lo"), (F.col("dist_m") + PAST_FACILITY_M).alias("__hi"),
    )
    crossed = overlap_join(
        primary, zones, ["shape_id", "seg_id"], ("x_start", "x_end"), ("__lo", "__hi"), 200.0, touching=True, hot=hot_keys(primary, ["shape_id", "seg_id"])
    ).groupBy(*keys, "t_start").agg(F.min_by("node_id", F.struct("cx_m", "node_id")).alias("__cx"))
    joined = primary.join(dwells, [*keys, "t_start"], "left").join(crossed, [*keys, "t_start"], "left")
    dwell, cross = F.col("stop_id").isNotNull(), F.col("__cx").isNotNull()
    signal = (F.col("x_start") <= F.col("seg_end") + PAST_FACILITY_M) & (
        F.col("x_end") >= F.col("seg_end") - signal_m
    )
    return joined.select(
        *primary.columns,
        F.when(dwell, "dwell").when(cross, "crossing").when(signal, "signal_uniform").otherwise("slowdown").alias("category"),
        F.when(dwell, F.col("stop_id")).when(cross, text.crossing_id(F.col("__cx")))
        .when(signal, text.signal_id(F.col("down_node"))).alias("facility_id"),
        (dwell & F.coalesce("near_side", F.lit(False))).alias("dwell_near_signal"),
        (F.col("t_end") - F.col("t_start")).alias("core_s"),
    )


def overflow_pass(attributed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slowdowns that lead straight into a signal wait of their segment join that signal."""
    by = [*keys, "shape_id", "seg_id"]
    marked = F.when(F.col("category") != "slowdown", F.struct("category", "facility_id"))
    seen = scan(
        attributed, by, ["t_start"], time_slice("t_start", EVENT_SLICE_S),
        __n=next_known(marked, strict=True),
    )
    over = (F.col("category") == "slowdown") & F.coalesce(F.col("__n")["category"] == "signal_uniform", F.lit(False))
    return seen.withColumn("facility_id", F.when(over, F.col("__n")["facility_id"]).otherwise(F.col("facility_id"))).withColumn(
        "category", F.when(over, "signal_overflow").otherwise(F.col("category"))
    ).drop("__n").select(*attributed.columns)


def attributions(
    events: DataFrame, times: DataFrame, zones: DataFrame, seg_controls: DataFrame, keys: Sequence[str], *,
    dwell_rule: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] = proximity_dwells,
) -> tuple[DataFrame, DataFrame]:
    """(attributed events, event × segment pairs). ``dwell_rule`` is pluggable."""
    pairs = stage(event_segments(events, times, keys), "pairs")
    primary = stage(primary_segment(pairs, events, keys), "primary")
    named = attribute_events(primary, dwell_rule(primary, zones, keys), seg_controls, keys)
    return stage(overflow_pass(stage(named, "named"), keys), "attributed"), pairs


_BUCKETS = {"t_dwell": "dwell", "d_signal_uniform": "signal_uniform", "d_signal_overflow": "signal_overflow", "d_crossing": "crossing"}


def bucket_sums(
    attributed: DataFrame, pairs: DataFrame, keys: Sequence[str], times: DataFrame | None = None,
    shoulders: DataFrame | None = None,
) -> DataFrame:
    """Seconds per trip × segment × cause, each event clipped to the segment."""
    keys = list(keys)
    cause = attributed.select(*keys, "t_start", "category", "dwell_near_signal")
    core = pairs.join(cause, [*keys, "t_start"]).select(
        *keys, "shape_id", "seg_id", "category", "dwell_near_signal", F.col("in_seg_s").alias("core_s"), F.lit(0.0).alias("loss_s")
    )
    parts = core
    if shoulders is not None:
        wings = shoulders.select(*keys, "shape_id", "t_start", F.col("decel_lo").alias("w0"), F.col("t_start").alias("w1")).unionByName(
            shoulders.select(*keys, "shape_id", "t_start", F.col("t_end").alias("w0"), F.col("accel_hi").alias("w1"))
        ).where(F.col("w1") > F.col("w0")).join(cause, [*keys, "t_start"]).drop("t_start")
        spans = times.select(*keys, "shape_id", "seg_id", "t_in", "t_out")
        wing = overlap_join(wings, spans, [*keys, "shape_id"], ("w0", "w1"), ("t_in", "t_out"), EVENT_BIN_S)
        parts = core.unionByName(wing.select(
            *keys, "shape_id", "seg_id", "category", "dwell_near_signal", F.lit(0.0).alias("core_s"),
            overlap_seconds(F.col("w0"), F.col("w1"), F.col("t_in"), F.col("t_out")).alias("loss_s"),
        ))
    sums = []
    for name, category in _BUCKETS.items():
        hit = F.col("category") == category
        sums.append(F.sum(F.when(hit, F.col("core_s")).otherwise(0.0)).alias(f"{name}_core"))
        sums.append(F.sum(F.when(hit, F.col("loss_s")).otherwise(0.0)).alias(f"{name}_loss"))
    near = F.sum(F.when((F.col("category") == "dwell") & F.col("dwell_near_signal"), F.col("core_s") + F.col("loss_s")).otherwise(0.0))
    return parts.groupBy(*keys, "shape_id", "seg_id").agg(*sums, near.alias("t_dwell_near_signal"))


def segment_decomposition(
    times: DataFrame, buckets: DataFrame, freeflow: DataFrame | None, keys: Sequence[str]
) -> DataFrame:
    """t_obs = t_ff + t_dwell + d_signal + d_crossing + d_congestion per trip × segment."""
    by = [*keys, "shape_id", "seg_id"]
    rows = times.drop("down_node").join(buckets, by, "left")
    if freeflow is None:
        rows = rows.withColumn("t_ff", F.lit(None).cast("double"))
    else:
        rows = split_join(rows, freeflow.select("shape_id", "seg_id", "t_ff"), ["shape_id", "seg_id"], F.struct(*keys), hot_keys(times, ["shape_id", "seg_id"]), "left")
    cols = [f"{b}_{p}" for b in _BUCKETS for p in ("core", "loss")] + ["t_dwell_near_signal"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})
    rows = rows.withColumns({b: F.col(f"{b}_core") + F.col(f"{b}_loss") for b in _BUCKETS})
    rows = rows.withColumn("d_signal", F.col("d_signal_uniform") + F.col("d_signal_overflow"))
    rows = rows.withColumn("d_congestion", F.col("t_obs") - F.col("t_ff") - F.col("t_dwell") - F.col("d_signal") - F.col("d_crossing"))
    return rows.select(
        *keys, "shape_id", "seg_id", "x_start", "x_end", "t_in", "t_out", "t_obs", "t_ff", "t_dwell",
        "d_signal_uniform", "d_signal_overflow", "d_signal", "d_crossing", "d_congestion", *cols,
    )


def freeflow_table(times: DataFrame, *, p: float = 0.05) -> DataFrame:
    """Low percentile of positive observed times per segment: (shape_id, seg_id, t_ff)."""
    return quantiles(times.where(F.col("t_obs") > 0), ["shape_id", "seg_id"], F.col("t_obs"), {"t_ff": p})


def decompose(
    pieces: DataFrame, segs: DataFrame, zones: DataFrame, seg_controls: DataFrame, freeflow: DataFrame | None,
    keys: Sequence[str], *, dt: float = DENSE_DT_S, min_s: float = MIN_EVENT_S, include_loss: bool = False,
    cruise_mph: float = CRUISE_MPH, threshold: Callable[..., Column] | None = None,
    dwell_rule: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] = proximity_dwells,
    drop_untraversed: bool = False, times: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(segment rows, attributed events) of every trip at once."""
    samples = sample_trajectory(pieces, keys, dt=dt)
    if threshold is None:
        events = stage(curve_slow_events(pieces, keys, dt=dt, min_s=min_s), "events")
    else:
        events = stage(slow_events(samples, keys, threshold=threshold, min_s=min_s), "events")
    times = stage(segment_times(pieces, segs, keys), "segment_times") if times is None else times
    named, pairs = attributions(events, times, zones, seg_controls, keys, dwell_rule=dwell_rule)
    shoulders = None
    if include_loss:
        bounds = ["shape_id", "t_start", "t_end"]
        shoulders = stage(loss_shoulders(stage(samples.select(*keys, "i", "t", "v_mph"), "samples"), named.select(*keys, *bounds), keys, cruise_mph=cruise_mph), "shoulders")
        named = named.join(shoulders.select(*keys, "t_start", ((F.col("t_start") - F.col("decel_lo")) + (F.col("accel_hi") - F.col("t_end"))).alias("loss_s")), [*keys, "t_start"], "left")
    else:
        named = named.withColumn("loss_s", F.lit(0.0))
    rows = segment_decomposition(times, bucket_sums(named, pairs, keys, times, shoulders), freeflow, keys)
    return (rows.where(F.col("t_obs") > 0) if drop_untraversed else rows), named


def delay_bands(attributed: DataFrame, facilities: DataFrame, keys: Sequence[str], offset: Column | float = 0.0) -> DataFrame:
    """Events as labelled bands on a shared clock; near-signal dwells are their own kind."""
    shift = offset if isinstance(offset, Column) else F.lit(float(offset))
    category = F.when((F.col("category") == "dwell") & F.col("dwell_near_signal"), "dwell_near_signal").otherwise(F.col("category"))
    names = facilities.select("shape_id", "facility_id", "label")
    return attributed.join(names, ["shape_id", "facility_id"], "left").select(
        *keys, F.round(shift + F.col("t_start"), 1).alias("t_start"), F.round(shift + F.col("t_end"), 1).alias("t_end"),
        category.alias("category"), F.coalesce("label", F.lit("")).alias("label"), "facility_id", "seg_id",
        F.round("min_v_mph", 1).alias("min_v_mph"),
    )
