"""Phone motion sensors against the GPS curve: filtering, episodes, forward axis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.constants import (
    GAP_SPLIT_S, GPS_BANDWIDTH, GRAVITY_DETECT, GRAVITY_HZ, HANDLING_DPS, HANDLING_HZ, HANDLING_PAD_S, MIN_SEGMENT_SAMPLES,
    MOVING_MPS, SUSTAINED_HZ,
)
from kerbline.functions import geo
from kerbline.operators import smooth
from kerbline.operators.intervals import point_join, salted_join
from kerbline.operators.mapmatch import cumulative_distance
from kerbline.operators.ordered import (
    all_of, asof, cum_sum, following, interpolate, islands, keyed_sessions, last_known, next_known, number_rows, previous, scan, sessions, time_slice, whole,
)
from kerbline.operators.quantiles import quantiles
from kerbline.operators.stage import stage

KEY = ["trip_id"]
SLICE_S = 600.0
BLOCK_S = 1800.0
ORDER = 4


def _slice() -> Column:
    return time_slice("t", SLICE_S)


# Streams ------------------------------------------------------------------------


def strictly_increasing(samples: DataFrame, keys: Sequence[str] = KEY, tie: str = "i") -> DataFrame:
    """Samples in time order, the first one of each time."""
    rest = [c for c in samples.columns if c not in (*keys, "t")]
    ordered = [tie, *[c for c in rest if c != tie]]
    return samples.groupBy(*keys, "t").agg(F.min(F.struct(*ordered)).alias("__s")).select(*keys, "t", *[F.col("__s")[c].alias(c) for c in rest]).select(*samples.columns)


def segment_gaps(samples: DataFrame, keys: Sequence[str] = KEY, gap_s: float = GAP_SPLIT_S) -> DataFrame:
    """Number the contiguous stretches: seg_no, n (row position), seg_first, seg_last, seg_size.

    All columns come from one exchange by key and slice; a row finds its stretch among the few that touch its slice.
    Rows without a key are left out.
    """
    keys = list(keys)
    known = samples.where(all_of([F.col(c).isNotNull() for c in keys]))
    placed = keyed_sessions(known, keys, ["t"], _slice(), lambda prev: F.col("t") - prev > gap_s, F.col("t"), "seg_no", "n")
    sizes = placed.groupBy(*keys, "seg_no").agg(
        F.min("t").alias("seg_first"), F.max("t").alias("seg_last"), F.count(F.lit(1)).alias("seg_size"), F.min("n").alias("seg_n0"), F.max("n").alias("seg_n1"),
        F.collect_set("__key").alias("__keys"),
    )
    facts = ["seg_first", "seg_last", "seg_size", "seg_n0", "seg_n1"]
    near = sizes.select(F.explode("__keys").alias("__key"), "seg_no", F.struct(*facts).alias("__s")).groupBy("__key").agg(
        F.map_from_entries(F.collect_list(F.struct("seg_no", "__s"))).alias("__m")
    )
    found = placed.join(near, "__key").withColumn("__s", F.col("__m")[F.col("seg_no")])
    rest = [c for c in samples.columns if c not in (*keys, "seg_no", "n")]
    return found.select(*keys, "seg_no", *rest, "n", *[F.col("__s")[c].alias(c) for c in facts])


def sample_rate(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Samples per second from the median step."""
    seen = scan(samples.select(*keys, "t"), keys, ["t"], _slice(), __p=previous(F.col("t")))
    step = quantiles(seen, keys, F.col("t") - F.col("__p"), {"step": 0.5}, width=0.01)
    return step.select(*keys, (1.0 / F.col("step")).alias("hz"))


# Low-pass -----------------------------------------------------------------------


@lru_cache(maxsize=64)
def _impulse(hz: float, cutoff: float) -> np.ndarray:
    """Impulse response of the digital order-4 Butterworth low-pass, down to 1e-12."""
    warped = 2 * hz * np.tan(np.pi * cutoff / hz)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, ORDER + 1) + ORDER - 1) / (2 * ORDER))
    z = (2 * hz + poles) / (2 * hz - poles)
    gain = np.real(np.prod(1 - z)) / 2**ORDER
    size = int(np.ceil(28.0 / -np.log(np.abs(z).max()))) + 16
    # partial fractions: each pole adds a geometric series, conjugate poles conjugate ones
    upper = z[z.imag > 0]
    share = np.array([gain * (1 + 1 / p) ** ORDER / np.prod(1 - z[z != p] / p) for p in upper])
    h = 2 * np.real(share[:, None] * np.exp(np.outer(np.log(upper), np.arange(size)))).sum(axis=0)
    h[0] = gain
    return h


def _one_way(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Causal filter along the last axis; the first value is taken to have lasted forever before.

    What lies before adds a constant, so only differences from it meet the response,
    and of that no more than there are values.
    """
    first, size = x[..., :1], x.shape[-1]
    taps = h[:size]
    wide = 1 << int(np.ceil(np.log2(size + len(taps))))
    moved = np.fft.irfft(np.fft.rfft(x - first, wide) * np.fft.rfft(taps, wide), wide)
    return first * h.sum() + moved[..., :size]


def _zero_phase(x: np.ndarray, h: np.ndarray, open_left: bool, open_right: bool) -> np.ndarray:
    """Forward and backward filter along the last axis; true ends are extended by odd reflection."""
    size = x.shape[-1]
    pad = min(3 * (ORDER + 1), size - 1)
    left = 2 * x[..., :1] - x[..., pad:0:-1] if not open_left and pad > 0 else x[..., :0]
    right = 2 * x[..., -1:] - x[..., -2:-pad - 2:-1] if not open_right and pad > 0 else x[..., :0]
    wide = np.concatenate([left, x, right], axis=-1)
    both = _one_way(_one_way(wide, h)[..., ::-1], h)[..., ::-1]
    return both[..., left.shape[-1]:left.shape[-1] + size]


def lowpass(samples: DataFrame, filters: dict[str, tuple[str, float]], keys: Sequence[str] = KEY) -> DataFrame:
    """Zero-phase order-4 low-pass of columns per contiguous stretch.

    ``filters`` names each new column with its source column and cutoff in Hz.
    ``samples`` comes from ``segment_gaps`` and holds hz. Stretches are filtered
    in time blocks with a halo as long as the slowest filter's memory (1e-10 of
    its response), so a long recording is never one group and one pass serves all
    filters. Short stretches give null.
    """
    keys = list(keys)
    slowest = min(cutoff for _, cutoff in filters.values())
    halo = 28.0 / (2 * np.pi * slowest * np.sin(np.pi / 8)) + 1.0
    home = F.floor(F.col("t") / BLOCK_S)
    first, last = F.floor(F.col("seg_first") / BLOCK_S), F.floor(F.col("seg_last") / BLOCK_S)
    near = F.sequence(
        F.greatest(first, F.floor((F.col("t") - halo) / BLOCK_S)), F.least(last, F.floor((F.col("t") + halo) / BLOCK_S))
    )
    columns = samples.columns
    spread = samples.withColumn("__home", home).withColumn("__block", F.explode(near))

    cutoffs = {cutoff: [name for name, (_, c) in filters.items() if c == cutoff] for _, cutoff in filters.values()}

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["n"].to_numpy(), kind="stable")
        rows = rows.take(order)
        own = rows["__home"].to_numpy() == rows["__block"].to_numpy()
        out = rows.select(columns).filter(pa.array(own))
        n, ends = rows["n"].to_numpy(), [rows[c][0].as_py() for c in ("seg_n0", "seg_n1", "seg_size", "hz")]
        found = {}
        if own.any() and ends[2] >= MIN_SEGMENT_SAMPLES:
            for cutoff, names in cutoffs.items():
                x = np.stack([rows[filters[name][0]].to_numpy().astype(float) for name in names])
                h = _impulse(float(ends[3]), cutoff)
                found |= zip(names, _zero_phase(x, h, n[0] > ends[0], n[-1] < ends[1])[:, own])
        for name in filters:
            values = pa.array(found[name], from_pandas=True) if name in found else pa.nulls(len(out), pa.float64())
            out = out.append_column(name, values)
        return out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema]
    schema = ", ".join([*fields, *[f"`{name}` double" for name in filters]])
    return spread.groupBy(*keys, "seg_no", "__block").applyInArrow(run, schema)


def norm(*columns: str) -> Column:
    total = None
    for c in columns:
        total = F.col(c) * F.col(c) if total is None else total + F.col(c) * F.col(c)
    return F.sqrt(total)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows that have both values; null where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def gravity_mode(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Whether a trip's accelerations still contain gravity (median magnitude above 5)."""
    median = quantiles(samples, keys, norm("ax", "ay", "az"), {"median_a": 0.5}, width=0.05)
    return median.withColumn("gravity_included", F.col("median_a") > GRAVITY_DETECT)


def sustained_motion(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Prepared sensor stream: sx, sy, sz, a_horiz, gyro_mag, handling and the raw rates.

    Accelerations are low-passed; where gravity is included, its direction is
    projected off. Handling marks a rotation above 60 degrees per second, padded.
    """
    keys = list(keys)
    clean = stage(segment_gaps(strictly_increasing(samples, keys), keys), "motion")
    rate = sample_rate(clean, keys)
    mode = gravity_mode(clean, keys)
    ready = stage(salted_join(clean, rate.join(mode, keys), keys, F.col("n")), "motion_ready")
    axes = ("ax", "ay", "az")
    filters = {f"{c}_lp": (c, SUSTAINED_HZ) for c in axes} | {f"{c}_g": (c, GRAVITY_HZ) for c in axes}
    filters |= {f"{c}_lp": (c, HANDLING_HZ) for c in ("gx", "gy", "gz")}
    joined = lowpass(ready, filters, keys)
    size = F.greatest(norm("ax_g", "ay_g", "az_g"), F.lit(1e-6))
    along = sum(((F.col(f"{a}_lp") - F.col(f"{a}_g")) * F.col(f"{a}_g") / size for a in ("ax", "ay", "az")), F.lit(0.0))
    flat = joined.withColumn("__v", along).withColumns({
        f"s{a[1]}": F.when(F.col("gravity_included"), F.col(f"{a}_lp") - F.col(f"{a}_g") - F.col("__v") * F.col(f"{a}_g") / size).otherwise(F.col(f"{a}_lp"))
        for a in ("ax", "ay", "az")
    })
    flat = flat.withColumn("a_horiz", norm("sx", "sy", "sz")).withColumn("gyro_mag", norm("gx_lp", "gy_lp", "gz_lp"))
    used = [f"{c}_{part}" for c in axes for part in ("g", "lp")] + ["gx_lp", "gy_lp", "gz_lp"]
    flat = stage(flat.drop("__v", *axes, *used, "median_a", "gravity_included"), "sustained")
    return handling_mask(flat, keys)


def handling_mask(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Samples within a second of a rotation that means the phone is being handled."""
    pad = F.bround(HANDLING_PAD_S * F.col("hz"), 0).cast("long")
    hit = F.when(F.col("gyro_mag") > HANDLING_DPS, F.col("n"))
    seen = scan(samples, keys, ["t"], _slice(), __b=last_known(hit), __a=next_known(hit))
    touched = (F.col("n") - F.col("__b") <= pad - 1) | (F.col("__a") - F.col("n") <= pad) | (F.col("gyro_mag") > HANDLING_DPS)
    return seen.withColumn("handling", F.coalesce(touched, F.lit(False))).drop("__b", "__a")


# GPS curve ------------------------------------------------------------------------


def path_speed(fixes: DataFrame, keys: Sequence[str] = KEY, bandwidth: int = GPS_BANDWIDTH) -> DataFrame:
    """Map-free speed and acceleration at every fix from the path length driven.

    fixes: keys, t, lat, lon with distinct times per key.
    """
    keys = list(keys)
    run = cumulative_distance(fixes, keys, "t", method="midlat", slices=time_slice("t"))
    placed = scan(
        stage(run, "path"), keys, ["t"], time_slice("t"), i=cum_sum(F.lit(1).cast("long"), strict=True), n=whole("sum", F.lit(1).cast("long"))
    ).withColumn("d", F.col("cum_m")).withColumn("shape_id", F.lit("path"))
    pieces = stage(smooth.smooth_pchip(placed, keys, bandwidth=bandwidth), "path_pieces")
    curve = pieces.select(*keys, "t", F.greatest("m", F.lit(0.0)).alias("v_mps"), F.col("a").alias("a_mps2"))
    return fixes.join(curve, [*keys, "t"], "left")


def yaw_rate(gps: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Smoothed change of track bearing per second and the moving flag at every fix.

    gps: keys, t, lat, lon, v_mps.
    """
    keys = list(keys)
    at = F.struct("lat", "lon")
    near = scan(gps, keys, ["t"], time_slice("t"), __p=previous(at), __q=following(at))
    p, q = F.col("__p"), F.col("__q")
    back = geo.bearing_deg(p["lat"], p["lon"], F.col("lat"), F.col("lon"))
    ahead = geo.bearing_deg(F.col("lat"), F.col("lon"), q["lat"], q["lon"])
    angled = near.withColumn("__b", F.when(p.isNotNull(), back).otherwise(ahead)).drop("__p", "__q")
    turned = scan(stage(angled, "bearing"), keys, ["t"], time_slice("t"), __pb=previous(F.col("__b")))
    raw = F.col("__b") - F.col("__pb")
    short = F.pmod(raw + 180.0, F.lit(360.0)) - 180.0
    step = F.coalesce(F.when((short == -180.0) & (raw > 0), 180.0).otherwise(short), F.lit(0.0))
    first = F.when(F.col("__pb").isNull(), F.col("__b")).otherwise(step)
    unwrapped = stage(scan(turned.withColumn("__s", first), keys, ["t"], time_slice("t"), bearing_deg=cum_sum(F.col("__s"))).drop("__b", "__pb", "__s"), "unwrapped")
    one = scan(unwrapped, keys, ["t"], time_slice("t"), __l=previous(F.col("bearing_deg")), __r=following(F.col("bearing_deg")))
    two = scan(one, keys, ["t"], time_slice("t"), __ll=previous(F.col("__l")), __rr=following(F.col("__r")))
    window = F.filter(F.array("__ll", "__l", "bearing_deg", "__r", "__rr"), lambda v: v.isNotNull())
    total = F.aggregate(window, F.lit(0.0), lambda acc, v: acc + v)
    flat = stage(two.withColumn("bearing_smooth", total / F.size(window)).drop("__l", "__r", "__ll", "__rr"), "bearing_smooth")
    box = F.struct("t", "bearing_smooth")
    ends = scan(flat, keys, ["t"], time_slice("t"), __p=previous(box), __q=following(box))
    b, p, q = F.col("bearing_smooth"), F.col("__p"), F.col("__q")
    hs, hd = F.col("t") - p["t"], q["t"] - F.col("t")
    central = (hs * hs * q["bearing_smooth"] + (hd * hd - hs * hs) * b - hd * hd * p["bearing_smooth"]) / (hs * hd * (hd + hs))
    rate = F.when(p.isNull(), (q["bearing_smooth"] - b) / hd).when(q.isNull(), (b - p["bearing_smooth"]) / hs).otherwise(central)
    return ends.withColumn("yaw_dps", rate).withColumn("moving", F.coalesce(F.col("v_mps") > MOVING_MPS, F.lit(False))).drop("__p", "__q")


def turn_events(gps: DataFrame, keys: Sequence[str] = KEY, *, min_dps: float = 4.0, min_s: float = 2.0) -> DataFrame:
    """Sustained turning while moving. gps comes from ``yaw_rate``."""
    placed = number_rows(gps, keys, ["t"], time_slice("t"), "i")
    runs = islands(
        placed, keys, "i", F.floor(F.col("i") / 4096), (F.abs("yaw_dps") > min_dps) & F.col("moving"),
        {"t_start": ("min", F.col("t")), "t_end": ("max", F.col("t"))},
    )
    return runs.where(F.col("t_end") - F.col("t_start") >= min_s)


def on_motion_clock(motion: DataFrame, gps: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Motion samples with GPS speed v, acceleration dvdt, yaw and lateral acceleration.

    Yaw is null where the vehicle is not moving.
    """
    track = gps.select(
        *keys, "t", F.coalesce("v_mps", F.lit(0.0)).alias("v"), F.coalesce("a_mps2", F.lit(0.0)).alias("dvdt"),
        F.col("yaw_dps").alias("yaw_all"), F.col("moving").cast("double").alias("mv"),
    )
    at = interpolate(motion, track, keys, "t", ["v", "dvdt", "yaw_all", "mv"], _slice(), tie=["v"])
    return at.withColumn("yaw", F.when(F.col("mv") > 0.5, F.col("yaw_all"))).withColumn("a_lat_gps", F.abs(F.col("v") * F.radians("yaw")))


# Episodes -----------------------------------------------------------------------


def classify_episodes(motion: DataFrame, keys: Sequence[str] = KEY, *, min_a: float = 0.35, min_s: float = 1.5) -> DataFrame:
    """Sustained acceleration runs by cause. motion comes from ``on_motion_clock``."""
    keys = list(keys)
    needed = motion.select(*keys, "n", "t", "a_horiz", "handling", "yaw", "a_lat_gps", "dvdt", "v")
    stepped = scan(needed, keys, ["t"], _slice(), __p=previous(F.col("t")))
    dt_yaw = F.coalesce((F.col("t") - F.col("__p")) * F.coalesce("yaw", F.lit(0.0)), F.lit(0.0))
    ready = stepped.withColumn("__w", dt_yaw)
    on = (F.col("a_horiz") > min_a) & ~F.col("handling")
    one = F.lit(1.0)
    runs = islands(
        ready, keys, "n", F.floor(F.col("n") / 32768), on,
        {
            "t_start": ("min", F.col("t")), "t_end": ("max", F.col("t")), "sa": ("sum", F.col("a_horiz")), "c": ("sum", one),
            "sl": ("sum", F.col("a_lat_gps")), "cl": ("sum", F.when(F.col("a_lat_gps").isNotNull(), one)),
            "sw": ("sum", F.col("__w")), "fw": ("first", F.col("__w")), "sd": ("sum", F.col("dvdt")), "sv": ("sum", F.col("v")),
        },
    ).where(F.col("t_end") - F.col("t_start") >= min_s)
    a_mean, lat = F.col("sa") / F.col("c"), F.col("sl") / F.col("cl")
    share = F.when(a_mean > 0, lat / a_mean)
    net, dv, v = F.col("sw") - F.col("fw"), F.col("sd") / F.col("c"), F.col("sv") / F.col("c")
    kind = (
        F.when(share.isNull(), F.when(v < 3.0, "low-speed").otherwise("unknown"))
        .when(share >= 0.6, F.when(F.abs(net) >= 45.0, "turn").otherwise("steering (curve/lane)"))
        .when(share <= 0.35, F.when(dv < -0.05, "brake").otherwise("accelerator"))
        .otherwise("mixed")
    )
    return runs.select(
        *keys, "t_start", "t_end", (F.col("t_end") - F.col("t_start")).alias("duration_s"), F.round(a_mean, 3).alias("a_mean"),
        F.round(lat, 3).alias("a_lat_mean"), F.round(share, 3).alias("steer_frac"), F.round(net, 1).alias("net_heading_deg"),
        F.round(dv, 3).alias("gps_dvdt"), kind.alias("kind"),
    )


def accel_vs_gps(motion: DataFrame, gps: DataFrame, keys: Sequence[str] = KEY, *, min_n: int = 30) -> DataFrame:
    """Correlation of sustained phone acceleration with GPS acceleration per trip."""
    keys = list(keys)
    known = gps.where(F.col("a_mps2").isNotNull()).select(*keys, "t", "a_mps2")
    good = motion.where(~F.col("handling") & F.col("a_horiz").isNotNull()).select(*keys, "t", F.col("a_horiz").alias("a_phone"))
    held = motion.select(*keys, "t", F.col("handling").cast("double").alias("held"))
    at = interpolate(known, good, keys, "t", ["a_phone"], _slice(), tie=["a_phone"])
    at = stage(interpolate(at, held, keys, "t", ["held"], _slice(), tie=["held"]), "accel")
    spans = motion.where(F.col("seg_size") >= MIN_SEGMENT_SAMPLES).select(*keys, "seg_first", "seg_last").distinct()
    covered = point_join(at, spans, keys, "t", ("seg_first", "seg_last"), SLICE_S, F.col("t").between(F.col("seg_first"), F.col("seg_last")))
    valid = covered.where(F.col("held") <= 0.25)
    stats = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"), correlation(F.col("a_phone"), F.abs(F.col("a_mps2"))).alias("r"))
    p95 = quantiles(motion.where(~F.col("handling")), keys, F.col("a_horiz"), {"p95_a": 0.95}, width=0.05)
    return p95.join(stats, keys, "left").select(
        *keys, F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.when(F.col("n_valid") > min_n, F.col("r")).alias("r"), "p95_a"
    )


# Forward axis -------------------------------------------------------------------


def forward_anchors(
    motion: DataFrame, keys: Sequence[str] = KEY, *, min_a: float = 0.5, min_dvdt: float = 0.25, max_steer: float = 0.3,
    min_s: float = 1.5, max_spread: float = 25.0,
) -> DataFrame:
    """Pedal-dominated windows: their mean signed direction, rows n0..n1 and middle."""
    keys = list(keys)
    lateral = F.abs(F.col("v") * F.radians("yaw_all"))
    on = (
        (F.col("a_horiz") > min_a) & (F.abs("dvdt") > min_dvdt) & (lateral < max_steer * F.greatest("a_horiz", F.lit(1e-6))) & ~F.col("handling")
    )
    w = F.col("a_horiz")
    runs = islands(
        motion, keys, "n", F.floor(F.col("n") / 32768), on,
        {
            "t0": ("min", F.col("t")), "t1": ("max", F.col("t")), "n0": ("min", F.col("n")), "n1": ("max", F.col("n")),
            "vx": ("sum", F.col("sx") * w), "vy": ("sum", F.col("sy") * w), "vz": ("sum", F.col("sz") * w),
            "sd": ("sum", F.col("dvdt")), "c": ("sum", F.lit(1.0)),
        },
    ).where(F.col("t1") - F.col("t0") >= min_s)
    size = F.greatest(norm("vx", "vy", "vz"), F.lit(1e-9))
    runs = stage(runs.select(
        *keys, "t0", "t1", "n0", "n1", (F.col("vx") / size).alias("mx"), (F.col("vy") / size).alias("my"), (F.col("vz") / size).alias("mz"),
        (F.col("sd") / F.col("c")).alias("dvdt_mean"),
    ), "anchor_runs")
    inside = point_join(
        motion.select(*keys, "n", "t", "sx", "sy", "sz", "a_horiz"), runs, keys, "n", ("n0", "n1"), 4096.0, F.col("n").between(F.col("n0"), F.col("n1"))
    )
    dot = (F.col("sx") * F.col("mx") + F.col("sy") * F.col("my") + F.col("sz") * F.col("mz")) / F.greatest("a_horiz", F.lit(1e-9))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    middle = F.floor((F.col("n0") + F.col("n1") + 1) / 2)
    spread = inside.groupBy(*keys, "n0").agg(F.stddev_pop(angle).alias("dir_std_deg"), F.max(F.when(F.col("n") == middle, F.col("t"))).alias("t_mid"))
    sign = F.signum("dvdt_mean")
    return runs.join(spread, [*keys, "n0"]).where((F.col("dir_std_deg") <= max_spread) & (sign != 0)).select(
        *keys, "n0", (F.col("n1") + 1).alias("n1"), middle.alias("n_mid"), "t_mid", (sign * F.col("mx")).alias("fx"), (sign * F.col("my")).alias("fy"),
        (sign * F.col("mz")).alias("fz"), "dir_std_deg", "dvdt_mean",
    )


AXIS_BLOCK = 4096
_AXIS = ["fx", "fy", "fz"]
_BEHIND = ["bx", "by", "bz"]


def _small_turns(rate: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Matrices that turn a direction against ``rate`` for the given times; none over gaps or unknown rates."""
    known = np.isfinite(rate).all(1) & (seconds < 1.0)
    x, y, z = (np.where(known[:, None], -rate * seconds[:, None], 0.0)).T
    one = np.ones_like(x)
    return np.stack([np.stack([one, -z, y], 1), np.stack([z, one, -x], 1), np.stack([-y, x, one], 1)], 1)


def _running_products(turns: np.ndarray) -> np.ndarray:
    """turns[k] @ ... @ turns[0] for every k, by doubling."""
    out, reach = turns.copy(), 1
    while reach < len(out):
        out[reach:] = out[reach:] @ out[:-reach]
        reach *= 2
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.clip(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9, None)


class _AxisBlock:
    """Samples of one block with the turns between them and the anchors that reach into it."""

    def __init__(self, rows: pd.DataFrame, sign: float):
        rows = rows.sort_values(["kind", "n"])
        near = rows[rows["kind"] == 0]
        block = near["block"].iloc[0]
        own = (near["n"] // AXIS_BLOCK == block).to_numpy()
        t, rate = near["t"].to_numpy(), near[["wx", "wy", "wz"]].to_numpy(float)
        gaps = np.diff(t)
        ahead = _small_turns(sign * rate, np.append(gaps, 9.0))
        behind = _small_turns(-sign * rate, np.append(9.0, gaps))
        self.last_open = not own[-1]  # a sample follows the block's last one
        self.n, self.t, self.ahead, self.behind = near["n"].to_numpy()[own], t[own], ahead[own], behind[own]
        anchors = rows[rows["kind"] == 1]
        self.windows = list(zip(anchors["n"], anchors["a0"], anchors["a1"], anchors[_AXIS].to_numpy(float)))
        self.marks = [(int(np.searchsorted(self.n, n)), f) for n, _, _, f in self.windows if n in self.n]

    def forward(self, start: np.ndarray) -> np.ndarray:
        """Direction after each sample's turn, from the anchor before it or from ``start``."""
        out = np.full((len(self.n), 3), np.nan)
        cuts = [(0, start), *self.marks]
        for (a, f), b in zip(cuts, [*[c for c, _ in self.marks], len(self.n)]):
            if b > a:
                out[a:b] = _unit(_running_products(self.ahead[a:b]) @ f)
        return out

    def backward(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(direction at each sample from the anchor after it or from ``end``, direction handed to the block before)."""
        out = np.full((len(self.n) + 1, 3), np.nan)
        cuts = [*self.marks, (len(self.n), end)]
        for (b, f), a in zip(cuts, [0, *[c + 1 for c, _ in self.marks]]):
            # row k + 1 of out belongs to sample k; the turn at a sample leads to the one before
            if b == len(self.n):
                out[b] = f
                b -= 1
            if b >= a:
                turned = _running_products(self.behind[a : b + 1][::-1]) @ f
                out[a : b + 1] = _unit(turned)[::-1]
        return out[1:], out[0]


def _block_edges(rows: pd.DataFrame, keys: list[str], sign: float) -> pd.DataFrame:
    """What a block does to a direction that passes through it, or hands on from its own anchors."""
    block = _AxisBlock(rows, sign)
    nothing = np.full(3, np.nan)
    row = rows[[*keys, "seg_no", "block"]].iloc[:1].copy()
    row["own"] = bool(block.marks)
    row["forward"] = [(block.forward(nothing)[-1] if block.marks else _running_products(block.ahead)[-1].ravel()).tolist()]
    row["backward"] = [(block.backward(nothing)[1] if block.marks else _running_products(block.behind[::-1])[-1].ravel()).tolist()]
    row["t0"], row["t1"] = (block.t[block.marks[-1][0]], block.t[block.marks[0][0]]) if block.marks else (np.nan, np.nan)
    return row


def _block_carries(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Directions and anchor times that enter each block of a recording from both sides; one row a block."""
    rows = rows.sort_values("block").reset_index(drop=True)

    def pass_on(order, values: str, time: str):
        held, at, out = np.full(3, np.nan), np.nan, {}
        for k in order:
            out[k] = (held, at)
            edge = np.array(rows.at[k, values], float)
            if rows.at[k, "own"]:
                held, at = edge, rows.at[k, time]
            else:
                held = _unit(edge.reshape(3, 3) @ held)
        return [out[k] for k in rows.index]

    enter, leave = pass_on(rows.index, "forward", "t0"), pass_on(rows.index[::-1], "backward", "t1")
    out = rows[[*keys, "seg_no", "block"]].copy()
    for names, values in ((_AXIS, enter), (_BEHIND, leave)):
        out[names] = np.array([v for v, _ in values])
    out["t0"], out["t1"] = [at for _, at in enter], [at for _, at in leave]
    return out


def _block_axes(rows: pd.DataFrame, keys: list[str], sign: float) -> pd.DataFrame:
    """Blended direction at each sample of a block that an anchor reaches."""
    block = _AxisBlock(rows, sign)
    carry = rows[rows["kind"] == 2].iloc[0]
    n, t = block.n, block.t
    ahead = block.forward(carry[_AXIS].to_numpy(float))
    behind, _ = block.backward(carry[_BEHIND].to_numpy(float))
    if not block.last_open:
        ahead[-1] = np.nan
    for mark, a0, a1, f in block.windows:
        ahead[(n >= a0) & (n < mark)] = f
        inside = (n >= mark) & (n < a1)
        ahead[inside & np.isnan(ahead[:, 0])] = f
        behind[inside & np.isnan(behind[:, 0])] = f
    centres = np.array([carry["t0"], *[t[k] for k, _ in block.marks], carry["t1"]])
    at = np.searchsorted(centres[1:-1], t)  # anchors of the block before each sample
    low, high = centres[at], centres[at + 1]
    later = np.where(np.isnan(low), 1.0, np.where(np.isnan(high), 0.0, (t - low) / np.clip(high - low, 1e-9, None)))
    later[[k for k, _ in block.marks]] = 1.0
    later = np.where(np.isnan(ahead[:, 0]), 1.0, np.where(np.isnan(behind[:, 0]), 0.0, later))[:, None]
    axis = _unit(np.where(later < 1, (1 - later) * np.nan_to_num(ahead), 0) + np.where(later > 0, later * np.nan_to_num(behind), 0))
    seen = np.isfinite(ahead[:, 0]) | np.isfinite(behind[:, 0])
    out = rows[rows["kind"] == 0]
    out = out[out["n"] // AXIS_BLOCK == out["block"]].sort_values("n")[[*keys, "n"]].copy()
    out[["ux", "uy", "uz"]] = axis
    return out[seen]


def propagate_axis(
    motion: DataFrame, anchors: DataFrame, keys: Sequence[str] = KEY, *, cutoff: float = SUSTAINED_HZ, omega_sign: float = 1.0
) -> DataFrame:
    """Forward axis ux, uy, uz at every sample of a contiguous recording that has an anchor.

    The axis is turned by the gyroscope from the anchors on both sides and blended
    by time. A turn is a matrix, so a block of samples is one product: blocks are
    reduced to it, one row a block is chained per recording, and each
    block then places its own samples from the directions that enter it.
    """
    keys = list(keys)
    base = motion.withColumn("wx", F.radians("gy")).withColumn("wy", F.radians("gz")).withColumn("wz", F.radians("gx"))
    rated = lowpass(base.select(*keys, "seg_no", "n", "t", "hz", "seg_first", "seg_last", "seg_n0", "seg_n1", "seg_size", "wx", "wy", "wz"), {f"{c}_o": (c, cutoff) for c in ("wx", "wy", "wz")}, keys)
    rated = rated.where(F.col("seg_size") >= MIN_SEGMENT_SAMPLES)
    segs = rated.select(*keys, "seg_no", "seg_n0", "seg_n1").distinct()
    owned = point_join(anchors, segs, keys, "n_mid", ("seg_n0", "seg_n1"), 32768.0, F.col("n_mid").between(F.col("seg_n0"), F.col("seg_n1")))
    block = F.floor(F.col("n") / AXIS_BLOCK)
    beside = F.array_compact(F.array(block, F.when(F.col("n") % AXIS_BLOCK == 0, block - 1), F.when(F.col("n") % AXIS_BLOCK == AXIS_BLOCK - 1, block + 1)))
    samples = rated.select(*keys, "seg_no", "n", "t", F.col("wx_o").alias("wx"), F.col("wy_o").alias("wy"), F.col("wz_o").alias("wz"), F.explode(beside).alias("block"))
    reached = F.sequence(F.floor(F.least("n0", "n_mid") / AXIS_BLOCK), F.floor(F.greatest(F.col("n1") - 1, F.col("n_mid")) / AXIS_BLOCK))
    marks = owned.select(*keys, "seg_no", F.col("n_mid").alias("n"), F.col("n0").alias("a0"), F.col("n1").alias("a1"), *_AXIS, F.explode(reached).alias("block"))
    # neighbours of a recording's first or last block are no blocks of it
    held = samples.where(block == F.col("block")).select(*keys, "seg_no", "block").distinct()
    parts = samples.withColumn("kind", F.lit(0)).unionByName(marks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = stage(parts.join(held, [*keys, "seg_no", "block"], "left_semi"), "axis_blocks")
    group = [*keys, "seg_no", "block"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in motion.schema if f.name in keys)
    whole = f"{fields}, seg_no {parts.schema['seg_no'].dataType.simpleString()}, block bigint"
    edges = parts.groupBy(*group).applyInPandas(
        lambda rows: _block_edges(rows, keys, omega_sign), f"{whole}, own boolean, forward array<double>, backward array<double>, t0 double, t1 double"
    )
    ways = ", ".join(f"{c} double" for c in (*_AXIS, *_BEHIND, "t0", "t1"))
    carries = edges.groupBy(*keys, "seg_no").applyInPandas(lambda rows: _block_carries(rows, keys), f"{whole}, {ways}")
    both = parts.unionByName(carries.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return both.groupBy(*group).applyInPandas(lambda rows: _block_axes(rows, keys, omega_sign), f"{fields}, n bigint, ux double, uy double, uz double")


def split_acceleration(motion: DataFrame, axis: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Signed acceleration along the axis and its lateral magnitude."""
    joined = motion.join(axis, [*keys, "n"], "left")
    along = F.col("sx") * F.col("ux") + F.col("sy") * F.col("uy") + F.col("sz") * F.col("uz")
    return joined.withColumn("a_long", along).withColumn(
        "a_lat", F.sqrt(F.greatest(F.lit(0.0), F.col("a_horiz") * F.col("a_horiz") - along * along))
    )


def time_since_anchor(motion: DataFrame, anchors: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Seconds to the nearest anchor middle, and whether the sample lies in an anchor window."""
    keys = list(keys)
    marks = anchors.select(*keys, F.col("t_mid").alias("t"), F.col("n0").alias("w0"), F.col("n1").alias("w1"))
    near = asof(motion, marks, keys, "t", _slice(), ["w0", "w1"], how="both", tie=["w0"])
    gap = F.least(F.col("t") - F.col("prev_t"), F.col("next_t") - F.col("t"))

    def within(side: str) -> Column:
        return F.coalesce((F.col("n") >= F.col(f"{side}_w0")) & (F.col("n") < F.col(f"{side}_w1")), F.lit(False))

    return near.withColumn("dt_anchor", gap).withColumn("in_anchor", within("prev") | within("next")).drop(
        "prev_t", "next_t", "prev_w0", "prev_w1", "next_w0", "next_w1"
    )


DRIFT_BINS = (0.0, 5.0, 10.0, 20.0, 40.0, 80.0, 1e9)


def _scored(split: DataFrame, min_a: float) -> DataFrame:
    return split.where(
        F.col("a_long").isNotNull() & ~F.isnan("a_long") & ~F.col("handling") & (F.col("mv") > 0.5) & ~F.col("in_anchor") & (F.abs("dvdt") > min_a)
    )


def fusion_scores(split: DataFrame, keys: Sequence[str] = KEY, *, min_a: float = 0.2, min_n: int = 100) -> DataFrame:
    """Correlation and sign agreement with GPS acceleration per trip."""
    ok = _scored(split, min_a).withColumn("__lat", F.abs(F.col("v") * F.radians("yaw_all")))
    lateral = F.col("__lat") > 0.1
    out = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_val"), correlation(F.col("a_long"), F.col("dvdt")).alias("r_long"),
        F.avg((F.signum("a_long") == F.signum("dvdt")).cast("double")).alias("sign_agree"),
        F.sum(lateral.cast("long")).alias("__nl"), correlation(F.when(lateral, F.col("a_lat")), F.when(lateral, F.col("__lat"))).alias("r_lat"),
    )
    enough = F.col("n_val") > min_n
    return out.select(
        *keys, "n_val", F.when(enough, F.col("r_long")).alias("r_long"), F.when(enough, F.col("sign_agree")).alias("sign_agree"),
        F.when(enough & (F.col("__nl") > min_n), F.col("r_lat")).alias("r_lat"),
    )


def drift_bins(split: DataFrame, keys: Sequence[str] = KEY, *, min_a: float = 0.2, min_n: int = 100) -> DataFrame:
    """Scores by time since the nearest anchor, per trip."""
    gap = F.col("dt_anchor")
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for a, b in zip(DRIFT_BINS, DRIFT_BINS[1:]):
        lo = F.when((gap >= a) & (gap < b), a).otherwise(lo)
        hi = F.when((gap >= a) & (gap < b), min(b, 1e6)).otherwise(hi)
    ok = _scored(split, min_a).withColumn("bin_lo_s", lo).withColumn("bin_hi_s", hi).where(F.col("bin_lo_s").isNotNull())
    return ok.groupBy(*keys, "bin_lo_s", "bin_hi_s").agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("a_long"), F.col("dvdt")).alias("r_long"), F.avg((F.signum("a_long") == F.signum("dvdt")).cast("double")).alias("sign_agree")
    ).where(F.col("n") >= min_n)


def weighted_pool(bins: DataFrame, by: Sequence[str], columns: Sequence[str], weight: str = "n") -> DataFrame:
    """Mean of columns weighted by n per bin."""
    w = F.col(weight)
    return bins.groupBy(*by).agg(
        F.sum(w).alias("n"), *[(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"{c}_wmean") for c in columns]
    )


def turn_contrast(split: DataFrame, turns: DataFrame, keys: Sequence[str] = KEY, *, min_n: int = 30) -> DataFrame:
    """Mean lateral acceleration inside turns over outside."""
    keys = list(keys)
    ok = split.where(F.col("a_lat").isNotNull() & ~F.isnan("a_lat") & ~F.col("handling") & (F.col("v") > MOVING_MPS)).select(*keys, "n", "t", "a_lat")
    hit = point_join(ok, turns, keys, "t", ("t_start", "t_end"), SLICE_S, F.col("t").between(F.col("t_start"), F.col("t_end"))).select(*keys, "n").distinct()
    marked = ok.join(hit.withColumn("__in", F.lit(True)), [*keys, "n"], "left")
    inside = F.coalesce("__in", F.lit(False))
    n_turns = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_turns"))
    return marked.groupBy(*keys).agg(
        F.sum(inside.cast("long")).alias("n_in"), F.sum((~inside).cast("long")).alias("n_out"),
        F.avg(F.when(inside, F.col("a_lat"))).alias("a_lat_in_turn"), F.avg(F.when(~inside, F.col("a_lat"))).alias("a_lat_outside"),
    ).where((F.col("n_in") >= min_n) & (F.col("n_out") >= min_n)).join(n_turns, keys).withColumn(
        "turn_contrast", F.col("a_lat_in_turn") / F.greatest("a_lat_outside", F.lit(1e-9))
    )
