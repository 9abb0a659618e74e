"""Trajectories: local regression, monotone knots, Hermite pieces, sampling, inverse."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.constants import (
    BANDWIDTH, DEGREE, INVERSE_EPS_M, INVERSE_SAMPLES, M_PER_MI, MAX_PERP_M, MPS_TO_MPH,
)
from kerbline.functions import curve, timeutil
from kerbline.operators.intervals import HotKeys, bins, salted_join, split_join
from kerbline.operators.mapmatch import snap_to_shape
from kerbline.operators.ordered import (
    cum_max, cum_sum, following, last_known, next_known, previous, scan, time_slice, whole,
)
from kerbline.operators.stage import stage

BLOCK = 2048
INDEX_SLICE = 4096
POSITION_BIN_M = 500.0


def trip_clock(pings: DataFrame, keys: Sequence[str], tie: str = "event_id") -> DataFrame:
    """Relative seconds, totals and on-route position of every matched ping."""
    on = F.col("on_route").cast("long")
    timed = pings.withColumn("__us", F.unix_micros("ts"))
    numbered = scan(
        timed, keys, ["__us", tie], F.floor(F.col("__us") / 7_200_000_000),
        i=cum_sum(on, strict=True), n=whole("sum", on), n_pings=whole("sum", F.lit(1).cast("long")),
        t_start=whole("min", F.col("ts")),
    )
    return numbered.withColumn("t", timeutil.relative_seconds(F.col("ts"), F.col("t_start"))).drop("__us")


def _det(m: list[list[Column]]) -> Column:
    size = len(m)
    total = None
    for order in permutations(range(size)):
        swaps = sum(order[a] > order[b] for a in range(size) for b in range(a + 1, size))
        term = m[0][order[0]]
        for row in range(1, size):
            term = term * m[row][order[row]]
        total = (term if swaps % 2 == 0 else -term) if total is None else (
            total + term if swaps % 2 == 0 else total - term
        )
    return total


def locreg(
    trace: DataFrame, keys: Sequence[str], *, bandwidth: int | str = BANDWIDTH, degree: int = DEGREE,
    max_bandwidth: int = BANDWIDTH,
) -> DataFrame:
    """Local weighted polynomial of d over t at every row, as ``x_smooth``.

    ``trace`` holds t, d and the row's position i of n within its key. The
    window is index-contiguous. ``bandwidth`` may name a column no larger than
    ``max_bandwidth``. Rows are shuffled in blocks of fixed size with a halo.
    """
    keys = list(keys)
    reach = max_bandwidth if isinstance(bandwidth, str) else bandwidth
    width = F.col(bandwidth) if isinstance(bandwidth, str) else F.lit(bandwidth)
    home = F.floor(F.col("i") / BLOCK)
    inside = F.col("i") % BLOCK
    copies = F.array_compact(F.array(
        home, F.when((inside < reach) & (home > 0), home - 1), F.when(inside >= BLOCK - reach, home + 1),
    ))
    spread = trace.withColumn("__home", home).withColumn("__block", F.explode(copies))
    frame = Window.partitionBy(*keys, "__block").orderBy("i").rowsBetween(-(reach - 1), reach - 1)
    framed = spread.withColumn("__w", F.collect_list(F.struct("i", "t", "d")).over(frame)).where(
        F.col("__block") == F.col("__home")
    )
    bw = F.least(width.cast("long"), F.col("n"))
    lo = F.greatest(F.lit(0).cast("long"), F.col("i") - F.floor(bw / 2))
    lo = F.greatest(F.lit(0).cast("long"), F.least(lo + bw, F.col("n")) - bw)
    start = (lo - F.col("__w")[0]["i"] + 1).cast("int")
    cut = framed.withColumn("__w", F.slice(F.col("__w"), start, bw.cast("int")))
    if degree < 1:
        return cut.withColumn("x_smooth", F.col("__w")[0]["d"]).drop("__w", "__block", "__home")
    far = F.array_max(F.transform("__w", lambda c: F.abs(c["t"] - F.col("t"))))
    scaled = cut.withColumn("__h", F.greatest(far, F.lit(1e-9))).withColumn(
        "__w",
        F.transform("__w", lambda c: F.struct(
            ((c["t"] - F.col("t")) / F.col("__h")).alias("u"),
            curve.tricube((c["t"] - F.col("t")) / F.col("__h")).alias("w"),
            (c["d"] - F.col("d")).alias("y"),
        )),
    )
    names = [f"s{k}" for k in range(2 * degree + 1)] + [f"b{k}" for k in range(degree + 1)]
    zero = F.struct(*[F.lit(0.0).alias(n) for n in [*names, "c", "cy"]])

    def add(acc: Column, p: Column) -> Column:
        out, power = [], p["w"]
        powers = []
        for _ in range(2 * degree + 1):
            powers.append(power)
            power = power * p["u"]
        for k in range(2 * degree + 1):
            out.append((acc[f"s{k}"] + powers[k]).alias(f"s{k}"))
        for k in range(degree + 1):
            out.append((acc[f"b{k}"] + powers[k] * p["y"]).alias(f"b{k}"))
        here = F.when(p["u"] == 0, 1.0).otherwise(0.0)
        out.append((acc["c"] + here).alias("c"))
        out.append((acc["cy"] + here * p["y"]).alias("cy"))
        return F.struct(*out)

    distinct = F.size(F.array_distinct(
        F.transform(F.filter("__w", lambda p: p["w"] > 0), lambda p: p["u"])
    ))
    summed = scaled.withColumn("__m", F.aggregate("__w", zero, add)).withColumn("__k", distinct)
    m = F.col("__m")
    size = range(degree + 1)
    base = [[m[f"s{r + c}"] for c in size] for r in size]
    swapped = [[m[f"b{r}"] if c == 0 else m[f"s{r + c}"] for c in size] for r in size]
    value = F.when(F.col("__k") <= degree + 1, m["cy"] / m["c"]).otherwise(_det(swapped) / _det(base))
    return summed.withColumn("x_smooth", F.col("d") + value).drop(
        "__w", "__h", "__m", "__k", "__block", "__home"
    )


def monotone_pings(smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forward fill of decreases along the ping order: ``x_mono``."""
    return scan(
        smoothed, keys, ["i"], F.floor(F.col("i") / INDEX_SLICE), x_mono=cum_max(F.col("x_smooth"))
    )


def monotone_knots(mono: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One knot per distinct time. Averages of a non-decreasing series stay so."""
    return mono.groupBy(*keys, "shape_id", "t").agg(F.avg("x_mono").alias("x"))


def pchip_slopes(knots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hermite pieces: each knot with its slope, its next knot and the trip span.

    Columns t, x, m, a (acceleration at the knot), t_next, x_next, m_next (null
    on the last knot), k, n_knots, t_first, t_last.
    """
    keys = list(keys)
    at = F.struct("t", "x")
    near = scan(
        knots, keys, ["t"], time_slice("t"),
        __p=previous(at), __q=following(at), k=cum_sum(F.lit(1).cast("long"), strict=True),
        t_first=whole("min", F.col("t")), t_last=whole("max", F.col("t")),
        x_first=whole("min", F.col("x")), x_last=whole("max", F.col("x")),
        n_knots=whole("sum", F.lit(1).cast("long")),
    )
    wide = scan(near, keys, ["t"], time_slice("t"), __pp=previous(F.col("__p")), __qq=following(F.col("__q")))
    t, x = F.col("t"), F.col("x")
    p, q, pp, qq = (F.col(c) for c in ("__p", "__q", "__pp", "__qq"))
    h_l, h_r = t - p["t"], q["t"] - t
    d_l, d_r = (x - p["x"]) / h_l, (q["x"] - x) / h_r
    h_ll, h_rr = p["t"] - pp["t"], qq["t"] - q["t"]
    d_ll, d_rr = (p["x"] - pp["x"]) / h_ll, (qq["x"] - q["x"]) / h_rr
    m = (
        F.when(p.isNull() & q.isNull(), 0.0)
        .when(p.isNull() & qq.isNull(), d_r)
        .when(p.isNull(), curve.end_slope(h_r, d_r, h_rr, d_rr))
        .when(q.isNull() & pp.isNull(), d_l)
        .when(q.isNull(), curve.end_slope(h_l, d_l, h_ll, d_ll))
        .otherwise(curve.inner_slope(h_l, d_l, h_r, d_r))
    )
    m_next = (
        F.when(q.isNull(), F.lit(None).cast("double"))
        .when(qq.isNull() & p.isNull(), d_r)
        .when(qq.isNull(), curve.end_slope(h_r, d_r, h_l, d_l))
        .otherwise(curve.inner_slope(h_r, d_r, h_rr, d_rr))
    )
    m_prev = (
        F.when(pp.isNull() & q.isNull(), d_l)
        .when(pp.isNull(), curve.end_slope(h_l, d_l, h_r, d_r))
        .otherwise(curve.inner_slope(h_ll, d_ll, h_l, d_l))
    )
    sloped = wide.withColumn("m", m).withColumn("m_next", m_next).withColumn("__mp", m_prev)
    accel = F.when(
        q.isNotNull(), curve.hermite_accel(t, t, x, F.col("m"), q["t"], q["x"], F.col("m_next"))
    ).otherwise(curve.hermite_accel(t, p["t"], p["x"], F.col("__mp"), t, x, F.col("m")))
    return sloped.select(
        *keys, "shape_id", "k", "n_knots", "t", "x", "m", accel.alias("a"),
        q["t"].alias("t_next"), q["x"].alias("x_next"), "m_next",
        "t_first", "t_last", "x_first", "x_last",
    )


def on_route_trace(clocked: DataFrame) -> DataFrame:
    """On-route pings of trips that have at least two of them."""
    return clocked.where(F.col("on_route") & (F.col("n") >= 2)).withColumn("d", F.col("dist_m"))


def smooth_pchip(
    trace: DataFrame, keys: Sequence[str], *, bandwidth: int | str = BANDWIDTH, degree: int = DEGREE,
) -> DataFrame:
    """Regression, forward fill, distinct knots and slopes for every key."""
    smoothed = stage(locreg(trace, keys, bandwidth=bandwidth, degree=degree), "smoothed")
    knots = stage(monotone_knots(monotone_pings(smoothed, keys), keys), "knots")
    return pchip_slopes(knots, keys).where(F.col("n_knots") >= 2)


def rejects(clocked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trips that cannot be smoothed, with the reason."""
    trips = clocked.groupBy(*keys).agg(
        F.max("n_pings").alias("n_pings"), F.max("n").alias("n_on_route"),
        F.countDistinct(F.when(F.col("on_route"), F.col("t"))).alias("n_times"),
    )
    reason = F.when(F.col("n_on_route") < 2, "fewer than 2 on-route pings").when(
        F.col("n_times") < 2, "one distinct time"
    )
    return trips.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("n_times")


def reconstruct(
    pings: DataFrame, segments: DataFrame, keys: Sequence[str], *, bandwidth: int | str = BANDWIDTH,
    degree: int = DEGREE, max_perp_m: float = MAX_PERP_M, tie: str = "event_id",
    matcher: Callable[..., DataFrame] = snap_to_shape,
) -> tuple[DataFrame, DataFrame]:
    """Hermite pieces of every trip, and the rejected trips.

    ``matcher`` (pings, segments, max_perp_m=...) places pings on their shape: it adds dist_m, perp_m and on_route.
    """
    matched = stage(matcher(pings, segments, max_perp_m=max_perp_m), "matched")
    clocked = trip_clock(matched, keys, tie)
    pieces = smooth_pchip(on_route_trace(clocked), keys, bandwidth=bandwidth, degree=degree)
    return pieces, rejects(clocked, keys)


def _piece(t: Column) -> tuple[Column, ...]:
    return t, *(F.col(c) for c in ("t", "x", "m", "t_next", "x_next", "m_next"))


def _even_grid(n: int) -> tuple[Column, Column, Column]:
    """Step of n even samples and the index range that a piece owns."""
    t0, t1 = F.col("t_first"), F.col("t_last")
    step = (t1 - t0) / F.lit(float(n - 1))
    final = F.col("t_next").isNull()
    lo = F.when(final, F.lit(n - 1)).otherwise(F.ceil((F.col("t") - t0) / step))
    hi = F.when(final, F.lit(n - 1)).otherwise(
        F.least(F.ceil((F.col("t_next") - t0) / step) - 1, F.lit(n - 2))
    )
    return step, lo.cast("long"), hi.cast("long")


def _even_point(i: Column, n: int) -> Column:
    t = F.when(i == n - 1, F.col("t_last")).otherwise(F.col("t_first") + i * F.col("__step"))
    return F.struct(t.alias("t"), curve.hermite(*_piece(t)).alias("x"))


def _bisect(passed, n: int) -> Column:
    """Grid indices around the point where ``passed`` turns true within a piece.

    struct(a, b): a is the last index not passed (or one before the piece's own),
    b the first passed one (or one after). The curve does not decrease, so the
    piece's samples need not be listed.
    """
    start = F.struct((F.col("__lo") - 1).alias("a"), (F.col("__hi") + 1).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["a"] + acc["b"]) / 2)
        low = F.struct(mid.alias("a"), acc["b"].alias("b"))
        high = F.struct(acc["a"].alias("a"), mid.alias("b"))
        return F.when(acc["b"] - acc["a"] <= 1, acc).when(passed(_even_point(mid, n)), high).otherwise(low)

    steps = F.sequence(F.lit(1), F.lit(n.bit_length() + 1))
    return F.aggregate(steps, start, halve)


def _time_grid(dt: float, rule: str) -> tuple[Column, Column, Column]:
    """First and last grid index that a piece owns, and the time of index i."""
    t0, t1 = F.col("t_first"), F.col("t_last")
    final = F.col("t_next").isNull()
    if rule == "whole":
        first = F.ceil("t")
        last = F.when(final, F.floor("t")).otherwise(F.ceil("t_next") - 1)
        return first, last, F.col("i").cast("double")
    step = F.lit(float(dt))
    place = (F.col("t") - t0) / step
    end = F.ceil(place) if rule == "clip" else F.floor(place + 1e-9)
    last = F.when(final, end).otherwise(F.ceil((F.col("t_next") - t0) / step) - 1)
    return F.ceil(place), last, F.least(t0 + F.col("i") * step, t1)


def owned_grid(pieces: DataFrame, *, dt: float = 1.0, rule: str = "clip") -> DataFrame:
    """Pieces that own points of the grid of ``sample_trajectory``, from index ``__a`` to ``__b``."""
    first, last, _ = _time_grid(dt, rule)
    return pieces.withColumn("__a", first.cast("long")).withColumn("__b", last.cast("long")).where(F.col("__b") >= F.col("__a"))


def sample_trajectory(
    pieces: DataFrame, keys: Sequence[str], *, dt: float = 1.0, n: int | None = None, rule: str = "clip",
    floor_zero: bool = False,
) -> DataFrame:
    """Dense grid i, t, x, v_mph, a. Every piece emits its own grid points.

    ``clip``: t_first + i*dt, the last point clipped to t_last. ``span``: the
    same without the clipped point. ``whole``: whole seconds inside the span.
    With ``n``: n evenly spaced points.
    """
    if n is not None:
        t0, t1 = F.col("t_first"), F.col("t_last")
        final = F.col("t_next").isNull()
        step = (t1 - t0) / F.lit(float(n - 1))
        lo = F.ceil((F.col("t") - t0) / step)
        hi = F.least(F.ceil((F.col("t_next") - t0) / step) - 1, F.lit(n - 2))
        first, last = F.when(final, F.lit(n - 1)).otherwise(lo), F.when(final, F.lit(n - 1)).otherwise(hi)
        at = F.when(F.col("i") == n - 1, t1).otherwise(t0 + F.col("i") * step)
    else:
        first, last, at = _time_grid(dt, rule)
    grid = pieces.withColumn("__a", first.cast("long")).withColumn("__b", last.cast("long"))
    points = grid.where(F.col("__b") >= F.col("__a")).withColumn("i", F.explode(F.sequence("__a", "__b")))
    points = points.withColumn("__t", at)
    piece = _piece(F.col("__t"))
    speed = curve.hermite_speed(*piece) * MPS_TO_MPH
    return points.select(
        *keys, "shape_id", "i", F.col("__t").alias("t_s"), curve.hermite(*piece).alias("x_s"),
        (F.greatest(speed, F.lit(0.0)) if floor_zero else speed).alias("v_mph"),
        F.coalesce(curve.hermite_accel(*piece), F.col("a")).alias("a_s"),
    ).withColumnsRenamed({"t_s": "t", "x_s": "x", "a_s": "a"})


def at_pings(mono: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curve value, speed and acceleration at ping times (ping times are knots)."""
    keys = list(keys)
    knots = pieces.select(*keys, "t", F.col("x").alias("x_smooth"), F.col("m").alias("v_mps"), F.col("a").alias("a_mps2"))
    pings = mono.select(*keys, "i", "t", F.col("d").alias("d_raw"))
    return pings.join(knots, [*keys, "t"]).select(
        *keys, "i", "t", "d_raw", "x_smooth", "v_mps", (F.col("v_mps") * MPS_TO_MPH).alias("v_mph"),
        "a_mps2", (F.col("a_mps2") * MPS_TO_MPH).alias("a_mphps"),
    )


def numbered_positions(positions: DataFrame) -> DataFrame:
    """Distinct positions with their number along the shape, a whole number that rows can be joined by: shape_id, pos_m, place_no."""
    order = Window.partitionBy("shape_id").orderBy("pos_m")  # the positions of one shape
    return positions.select("shape_id", "pos_m").distinct().withColumn("place_no", F.row_number().over(order))


def last_time_at(
    pieces: DataFrame, positions: DataFrame, keys: Sequence[str], *, n: int = INVERSE_SAMPLES, hot: HotKeys | None = None
) -> DataFrame:
    """Last time each trip is at or below each position of its shape.

    Same answer as searching n even samples of the trip, but only the piece that
    crosses a position is sampled. ``positions``: shape_id, pos_m. A position
    never reached gives the end time, one already passed the start time. Rows of
    ``hot`` shapes are split. Adds ``place_no`` of ``numbered_positions``.
    """
    keys = list(keys)
    trip = F.struct(*keys)
    step, lo, hi = _even_grid(n)
    marked = pieces.withColumn("__step", step).withColumn("__lo", lo).withColumn("__hi", hi)
    has = F.col("__hi") >= F.col("__lo")
    marked = marked.withColumn("__head", F.when(has, _even_point(F.col("__lo"), n))).withColumn(
        "__tail", F.when(has, _even_point(F.col("__hi"), n))
    )
    linked = scan(
        marked, keys, ["t"], time_slice("t"),
        __before=last_known(F.col("__tail"), strict=True), __after=next_known(F.col("__head"), strict=True),
    )
    eps = INVERSE_EPS_M
    cells = linked.where(F.col("x_next") > F.col("x")).withColumn(
        "__bin", F.explode(bins(F.col("x") - eps, F.col("x_next"), POSITION_BIN_M))
    )
    places = stage(numbered_positions(positions), "positions")
    goal = places.withColumn("__bin", F.floor(F.col("pos_m") / POSITION_BIN_M))
    pos = F.col("pos_m")
    crossing = split_join(cells, goal, ["shape_id", "__bin"], trip, hot).where(
        (F.col("x") <= pos + eps) & (pos + eps < F.col("x_next"))
    )
    crossing = crossing.withColumn("__i", F.when(has, _bisect(lambda g: g["x"] > pos + eps, n)))
    below, above = F.col("__i")["a"], F.col("__i")["b"]
    crossing = crossing.withColumn(
        "__a", F.when(has & (below >= F.col("__lo")), _even_point(below, n)).otherwise(F.col("__before"))
    ).withColumn("__b", F.when(has & (above <= F.col("__hi")), _even_point(above, n)).otherwise(F.col("__after")))
    a, b = F.col("__a"), F.col("__b")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (pos - a["x"]) / (b["x"] - a["x"])))
    found = crossing.select(
        *keys, "place_no",
        F.when(b["x"] == a["x"], a["t"]).otherwise(a["t"] + share * (b["t"] - a["t"])).alias("__t"),
    )
    spans = pieces.groupBy(*keys, "shape_id").agg(
        F.min("x_first").alias("x_first"), F.max("x_last").alias("x_last"),
        F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last"),
    )
    return (
        split_join(spans, places, ["shape_id"], trip, hot)
        .join(found, [*keys, "place_no"], "left")
        .select(
            *keys, "shape_id", "pos_m", "place_no",
            F.when(F.col("x_last") < pos, F.col("t_last"))
            .when(F.col("x_first") >= pos, F.col("t_first"))
            .when(F.col("x_last") <= pos + eps, F.col("t_last"))
            .otherwise(F.col("__t")).alias("t_at"),
        )
    )


def run_summary(pieces: DataFrame, pings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pings, on-route pings, minutes, miles and mean speed per trip."""
    keys = list(keys)
    counts = pings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pings"), F.sum(F.col("on_route").cast("long")).alias("n_on_route")
    )
    spans = pieces.groupBy(*keys).agg(
        (F.max("t") - F.min("t")).alias("dur_s"), (F.max("x") - F.min("x")).alias("run_m")
    )
    return spans.join(counts, keys).select(
        *keys, "n_pings", "n_on_route", (F.col("dur_s") / 60).alias("minutes"),
        (F.col("run_m") / M_PER_MI).alias("miles"),
        (F.col("run_m") / F.nullif(F.col("dur_s"), F.lit(0.0)) * MPS_TO_MPH).alias("mean_mph"),
    )


def filter_max_duration(pieces: DataFrame, max_s: float = 7200.0) -> DataFrame:
    """Pieces of trips whose knots span at most ``max_s``."""
    return pieces.where(F.col("t_last") - F.col("t_first") <= max_s)


def departure_from_pings(
    pieces: DataFrame, keys: Sequence[str], move_m: float = 0.03 * M_PER_MI
) -> DataFrame:
    """Time of the last ping before the trip has moved ``move_m``; ping times are knots."""
    level = F.col("x_first") + move_m
    leaves = (F.col("x") < level) & (F.col("x_next") >= level)
    return pieces.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(leaves, F.col("t"))), F.min("t_first")).alias("depart_s")
    )


def departure_from_grid(
    pieces: DataFrame, keys: Sequence[str], move_m: float = 0.03 * M_PER_MI, n: int = INVERSE_SAMPLES
) -> DataFrame:
    """Time of the first of n even samples that has moved ``move_m``.

    Each piece offers its first sample above the level; no grid rows are made.
    """
    step, lo, hi = _even_grid(n)
    marked = pieces.withColumn("__step", step).withColumn("__lo", lo).withColumn("__hi", hi)
    level = F.col("x_first") + move_m
    marked = marked.withColumn("__i", _bisect(lambda g: g["x"] >= level, n)["b"])
    reached = F.when((F.col("__hi") >= F.col("__lo")) & (F.col("__i") <= F.col("__hi")), _even_point(F.col("__i"), n)["t"])
    return marked.groupBy(*keys).agg(F.coalesce(F.min(reached), F.min("t_first")).alias("depart_s"))


def align_departure(rows: DataFrame, departures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shift times so that every trip departs at zero."""
    return salted_join(rows, departures, keys, F.col("t")).withColumn("t_aligned", F.col("t") - F.col("depart_s"))


def trips_in_all_runs(runs: Sequence[DataFrame], exclude: Sequence[str] = ()) -> DataFrame:
    """Trips of any run (trip_id, bus_id), without those an excluded bus drove in some run."""
    every = runs[0].select("trip_id", "bus_id")
    for run in runs[1:]:
        every = every.unionByName(run.select("trip_id", "bus_id"))
    banned = every.where(F.col("bus_id").isin(*exclude)).select("trip_id")
    return every.select("trip_id").distinct().join(banned, "trip_id", "left_anti")


def compare_bandwidths(trace: DataFrame, keys: Sequence[str], bandwidths: Sequence[int]) -> DataFrame:
    """Pieces of every trip for several bandwidths, keyed by ``bandwidth``."""
    many = trace.withColumn("bandwidth", F.explode(F.array(*[F.lit(int(b)) for b in bandwidths])))
    widest = max(bandwidths)
    smoothed = stage(
        locreg(many, [*keys, "bandwidth"], bandwidth="bandwidth", max_bandwidth=widest), "smoothed"
    )
    by = [*keys, "bandwidth"]
    knots = stage(monotone_knots(monotone_pings(smoothed, by), by), "knots")
    return pchip_slopes(knots, by).where(F.col("n_knots") >= 2)
