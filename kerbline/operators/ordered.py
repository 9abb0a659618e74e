"""Ordered scans, runs, sessions and as-of joins that no single key can overload.

A plain ``Window.partitionBy(trip)`` puts a whole trip into one task. Here every
key is cut into slices of its order column. Each slice is scanned on its own,
one summary row per slice carries totals, and the carry of the earlier (or
later) slices is joined back. Rows are shuffled by (key, slice) only; windows
that span a key see one row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.constants import SLICE_S
from kerbline.operators.stage import stage

SLICE = "__slice"


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column
    strict: bool = False
    order: tuple[str, ...] | None = None  # its own order of the rows, within the same slices


def cum_sum(value: Column, strict: bool = False) -> Scan:
    """Running sum; ``strict`` leaves the current row out."""
    return Scan("sum", value, strict)


def cum_max(value: Column, strict: bool = False) -> Scan:
    return Scan("max", value, strict)


def last_known(value: Column, strict: bool = False) -> Scan:
    """Last non-null value at or before the row."""
    return Scan("last", value, strict)


def next_known(value: Column, strict: bool = False) -> Scan:
    """First non-null value at or after the row."""
    return Scan("next", value, strict)


def previous(value: Column) -> Scan:
    """Value on the row before, null on the first row. Structs keep inner nulls."""
    return Scan("lag", value)


def following(value: Column) -> Scan:
    return Scan("lead", value)


def whole(agg: str, value: Column) -> Scan:
    """``sum``, ``min`` or ``max`` over the whole key."""
    return Scan(f"whole_{agg}", value)


def time_slice(column: str, width: float = SLICE_S) -> Column:
    return F.floor(F.col(column) / F.lit(float(width)))


def _boxed(scan: Scan) -> Column:
    return F.struct(scan.value.alias("v")) if scan.kind in ("lag", "lead") else scan.value


def _local(scan: Scan, fwd: Window, back: Window) -> Column | None:
    start = Window.unboundedPreceding
    to = -1 if scan.strict else 0
    if scan.kind == "sum":
        return F.coalesce(F.sum(scan.value).over(fwd.rowsBetween(start, to)), F.lit(0))
    if scan.kind == "max":
        return F.max(scan.value).over(fwd.rowsBetween(start, to))
    if scan.kind == "last":
        return F.last(scan.value, ignorenulls=True).over(fwd.rowsBetween(start, to))
    if scan.kind == "next":
        return F.last(scan.value, ignorenulls=True).over(back.rowsBetween(start, to))
    if scan.kind == "lag":
        return F.lag(_boxed(scan)).over(fwd)
    if scan.kind == "lead":
        return F.lead(_boxed(scan)).over(fwd)
    return None


def _summary(scan: Scan, order: Sequence[str]) -> Column:
    box = _boxed(scan)
    at = F.when(box.isNotNull(), F.struct(*order))
    if scan.kind in ("sum", "whole_sum"):
        return F.sum(scan.value)
    if scan.kind in ("max", "whole_max"):
        return F.max(scan.value)
    if scan.kind == "whole_min":
        return F.min(scan.value)
    if scan.kind in ("last", "lag"):
        return F.max_by(box, at)
    return F.min_by(box, at)


def _carry(scan: Scan, column: str, by: Sequence[str]) -> Column:
    w = Window.partitionBy(*by)
    fwd = w.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    back = w.orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(column)
    if scan.kind == "sum":
        return F.coalesce(F.sum(value).over(fwd), F.lit(0))
    if scan.kind == "max":
        return F.max(value).over(fwd)
    if scan.kind in ("last", "lag"):
        return F.last(value, ignorenulls=True).over(fwd)
    if scan.kind in ("next", "lead"):
        return F.last(value, ignorenulls=True).over(back)
    return {"whole_sum": F.sum, "whole_min": F.min, "whole_max": F.max}[scan.kind](value).over(w)


def _merge(scan: Scan, local: str, carry: str) -> Column:
    here, before = F.col(local), F.col(carry)
    if scan.kind == "sum":
        return here + F.coalesce(before, F.lit(0))
    if scan.kind == "max":
        return F.greatest(here, before)
    if scan.kind in ("last", "next"):
        return F.coalesce(here, before)
    if scan.kind in ("lag", "lead"):
        return F.coalesce(here, before)["v"]
    return before


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slices: Column,
    *,
    staged: bool = False,
    **columns: Scan,
) -> DataFrame:
    """Add running columns per key. ``slices`` must not decrease along ``order``.

    ``order`` must be unique within a key. With ``staged`` the input is written
    first, so an expensive input is computed once for the two reads.
    """
    by, order = list(by), list(order)
    sliced = df.withColumn(SLICE, slices)
    if staged:
        sliced = stage(sliced, "scan")
    inside = Window.partitionBy(*by, SLICE)
    along = {n: list(s.order or order) for n, s in columns.items()}
    local = {
        n: _local(s, inside.orderBy(*along[n]), inside.orderBy(*[F.col(c).desc() for c in along[n]])) for n, s in columns.items()
    }
    rows = sliced.select("*", *[c.alias(f"__l_{n}") for n, c in local.items() if c is not None])
    totals = sliced.groupBy(*by, SLICE).agg(
        *[_summary(s, along[n]).alias(f"__t_{n}") for n, s in columns.items()]
    )
    carries = totals.select(
        *by, SLICE, *[_carry(s, f"__t_{n}", by).alias(f"__c_{n}") for n, s in columns.items()]
    )
    joined = rows.join(carries, [*by, SLICE], "left")
    kept = [c for c in df.columns if c not in columns]
    return joined.select(
        *kept, *[_merge(s, f"__l_{n}", f"__c_{n}").alias(n) for n, s in columns.items()]
    )


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], slices: Column, name: str, *,
    staged: bool = False,
) -> DataFrame:
    """Zero-based position of each row within its key."""
    return scan(
        df, by, order, slices, staged=staged, **{name: cum_sum(F.lit(1).cast("long"), strict=True)}
    )


_MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


def _run_aggs(aggs: dict[str, tuple[str, Column]], at_first: Column, at_last: Column):
    for name, (kind, value) in aggs.items():
        if kind == "first":
            yield F.min_by(value, at_first).alias(name)
        elif kind == "last":
            yield F.max_by(value, at_last).alias(name)
        else:
            yield _MERGE[kind](value).alias(name)


def islands(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    slices: Column,
    where: Column,
    aggs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Unbroken runs of rows that satisfy ``where``, one output row per run.

    ``index`` numbers the rows of a key without holes. Only matching rows are
    shuffled; each slice is reduced to its runs before runs are joined across
    slice borders. ``aggs`` maps a name to (min|max|sum|first|last, column).
    """
    by = list(by)
    hits = df.where(where).withColumn(SLICE, slices)
    w = Window.partitionBy(*by, SLICE).orderBy(index)
    local = hits.withColumn("__run", F.col(index) - F.row_number().over(w))
    runs = local.groupBy(*by, SLICE, "__run").agg(
        F.min(index).alias("__first"),
        F.max(index).alias("__last"),
        *_run_aggs(aggs, F.col(index), F.col(index)),
    ).drop("__run")
    return join_runs(runs.withColumnRenamed(SLICE, "__s"), by, F.floor(F.col("__s") / 16), aggs)


def join_runs(runs: DataFrame, by: Sequence[str], slices: Column, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Runs of ``__first`` to ``__last`` that follow each other without a hole become one; ``aggs`` as in ``islands``, over columns of their names."""
    numbered = sessions(
        runs, by, ["__first"], slices, lambda before: before + 1 != F.col("__first"), F.col("__last"), "__run",
    )
    again = {n: (k, F.col(n)) for n, (k, _) in aggs.items()}
    return numbered.groupBy(*by, "__run").agg(
        *_run_aggs(again, F.col("__first"), F.col("__last"))
    ).drop("__run")


def sessions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slices: Column,
    breaks: Callable[[Column], Column],
    value: Column,
    name: str = "session_no",
) -> DataFrame:
    """Number the groups that a break between neighbouring rows separates.

    ``breaks`` receives ``value`` of the row before (null on the first row) and
    may use all columns. Breaks inside a slice are counted where the slice lies;
    its first row carries their number and the slice's last value to the key's
    other slices; null keys are one key. Rows and first rows read one exchange, with all columns of
    ``df``: select what is needed before. ``order`` must be unique within a key.
    """
    kept = [c for c in df.columns if c != name]
    return keyed_sessions(df, by, order, slices, breaks, value, name).select(*kept, name)


def keyed_sessions(
    df: DataFrame, by: Sequence[str], order: Sequence[str], slices: Column, breaks: Callable[[Column], Column], value: Column,
    name: str, position: str | None = None,
) -> DataFrame:
    """``sessions`` with the rows still dealt by ``__key``, a struct of key and slice.

    ``position`` names a column for each row's zero-based place within its key.
    """
    by, order = list(by), list(order)
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    inside = Window.partitionBy("__key").orderBy(*order)
    across = Window.partitionBy(*by).orderBy(F.col("__key")[SLICE])

    def opens() -> Column:
        return F.when(F.coalesce(breaks(F.col("__prev")), F.lit(False)), 1).otherwise(0)

    seen = _dealt(df, by, slices).select(
        "*", value.alias("__v"), F.lag(value).over(inside).alias("__prev"), F.row_number().over(inside).alias("__n")
    ).withColumn("__o", F.when(F.col("__n") > 1, opens()).otherwise(0))
    local = seen.select(
        "*", F.sum("__o").over(inside.rowsBetween(start, 0)).alias("__l"), F.sum("__o").over(inside.rowsBetween(start, end)).alias("__total"),
        F.count(F.lit(1)).over(inside.rowsBetween(start, end)).alias("__rows"),
        F.last("__v").over(inside.rowsBetween(start, end)).alias("__end"),
    ).where(_every_column(df))
    heads = local.where(F.col("__n") == 1).withColumn("__prev", F.lag("__end").over(across)).withColumn("__o", opens())
    carries = heads.select(
        "__key", (F.sum("__o").over(across.rowsBetween(start, 0)) + F.coalesce(F.sum("__total").over(across.rowsBetween(start, -1)), F.lit(0))).alias("__c"),
        F.coalesce(F.sum("__rows").over(across.rowsBetween(start, -1)), F.lit(0)).alias("__past"),
    )
    kept = [c for c in df.columns if c not in (name, position)]
    place = [] if position is None else [(F.col("__past") + F.col("__n") - 1).alias(position)]
    return local.join(carries, "__key").select("__key", *kept, (F.col("__l") + F.col("__c")).alias(name), *place)


def _dealt(df: DataFrame, by: Sequence[str], slices: Column) -> DataFrame:
    """Rows dealt by key and slice. The struct is never null, so a join on it keeps
    null keys and adds no filter that would tell its two sides apart."""
    return df.withColumn("__key", F.struct(*by, slices.alias(SLICE))).repartition("__key")


def _every_column(df: DataFrame) -> Column:
    """True on every row, yet it names every column that has a hash.

    Above the windows of two branches it keeps both from pruning what they read,
    so the exchange below is the same in both and Spark runs it once.
    """
    named = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*named), F.lit(2)) < 2


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    slices: Column,
    values: Sequence[str],
    *,
    how: str = "backward",
    tie: Sequence[str] = (),
    tol: float | None = None,
) -> DataFrame:
    """Attach the neighbouring right row: backward, forward, nearest or both.

    Adds ``prev_*`` (last at or before) and/or ``next_*`` (first at or after);
    nearest keeps the closer one under the plain names and prefers the earlier
    row on a tie. ``tie`` orders right rows that share a position.
    """
    by = list(by)
    payload = F.struct(F.col(on).alias(on), *values)
    extra = [c for c in left.columns if c not in by and c != on]
    lhs = left.select(*by, on, F.struct(*extra).alias("__row") if extra else F.lit(1).alias("__row"))
    box = right.select(*by, on, payload.alias("__r"), *tie)
    pad = [F.lit(None).cast(box.schema[c].dataType).alias(c) for c in tie]
    row_type = lhs.schema["__row"].dataType
    both = box.select(
        *by, on, "__r", F.lit(None).cast(row_type).alias("__row"), F.lit(0).alias("__side"), *tie
    ).unionByName(
        lhs.select(
            *by, on, F.lit(None).cast(box.schema["__r"].dataType).alias("__r"), "__row",
            F.lit(1).alias("__side"), *pad,
        )
    )
    want_prev = how in ("backward", "nearest", "both")
    want_next = how in ("forward", "nearest", "both")
    # Right rows sort before left rows of the same position going backward and
    # after them going forward, so an equal position counts on either side.
    onward = [on, "__side", *tie]
    wanted = {}
    if want_prev:
        wanted["__p"] = last_known(F.col("__r"))
    if want_next:
        both = both.withColumn("__rside", -F.col("__side"))
        wanted["__n"] = replace(next_known(F.col("__r")), order=(on, "__rside", *tie))
    out = scan(both, by, onward, slices, **wanted)
    out = out.where(F.col("__side") == 1)
    if tol is not None:
        if want_prev:
            out = out.withColumn("__p", F.when(F.col(on) - F.col("__p")[on] <= tol, F.col("__p")))
        if want_next:
            out = out.withColumn("__n", F.when(F.col("__n")[on] - F.col(on) <= tol, F.col("__n")))
    kept = [*by, on, *[F.col("__row")[c].alias(c) for c in extra]]
    if how == "nearest":
        nearer = F.when(
            F.col("__n").isNull()
            | (F.col(on) - F.col("__p")[on] <= F.col("__n")[on] - F.col(on)),
            F.col("__p"),
        ).otherwise(F.col("__n"))
        return out.withColumn("__b", nearer).select(
            *kept, F.col("__b")[on].alias(f"match_{on}"), *[F.col("__b")[v].alias(v) for v in values]
        )
    added = []
    if want_prev:
        added += [F.col("__p")[v].alias(f"prev_{v}") for v in [on, *values]]
    if want_next:
        added += [F.col("__n")[v].alias(f"next_{v}") for v in [on, *values]]
    return out.select(*kept, *added)


def interpolate(
    left: DataFrame, right: DataFrame, by: Sequence[str], x: str, values: Sequence[str],
    slices: Column, tie: Sequence[str] = (),
) -> DataFrame:
    """Piecewise linear lookup of right ``values`` at left ``x``, clamped at both ends."""
    near = asof(left, right, by, x, slices, values, how="both", tie=tie)
    x0, x1 = F.col(f"prev_{x}"), F.col(f"next_{x}")
    share = F.when(x1 > x0, (F.col(x) - x0) / (x1 - x0)).otherwise(0.0)
    out = near
    for v in values:
        a, b = F.col(f"prev_{v}"), F.col(f"next_{v}")
        out = out.withColumn(v, F.coalesce(a + share * (b - a), a, b))
    drop = [f"{p}_{c}" for p in ("prev", "next") for c in [x, *values]]
    return out.drop(*drop)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
