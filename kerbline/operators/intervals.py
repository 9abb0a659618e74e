"""Interval joins on an equi key plus a coarse bin of the axis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_TASK = 1 << 22
MOST_HOT_KEYS = 10_000


def bins(lo: Column, hi: Column, width: float) -> Column:
    """Array of the bins that [lo, hi] touches; empty when hi < lo."""
    first = F.floor(lo / F.lit(float(width)))
    last = F.floor(hi / F.lit(float(width)))
    return F.when(last >= first, F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>")
    )


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than a task should hold, and into how many parts each is split."""

    on: tuple[str, ...]
    parts: DataFrame


def hot_keys(facts: DataFrame, on: Sequence[str], *, rows_a_task: int = ROWS_A_TASK, most: int = MOST_HOT_KEYS) -> HotKeys | None:
    """The keys of ``facts`` whose measured number of rows asks for a split; None without any.

    A key's parts follow its count. Of more than ``most`` such keys those with fewest
    rows stay whole, so the table of the others is small at any size of the input.
    """
    counts = facts.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_a_task)
    found = counts.orderBy(F.desc("__n")).limit(most + 1).collect()
    share = found[most]["__n"] if len(found) > most else rows_a_task
    kept = [(*r[:-1], -(-r["__n"] // share)) for r in found[:most]]
    if not kept:
        return None
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema.fields[:-1])
    return HotKeys(tuple(on), facts.sparkSession.createDataFrame(kept, f"{types}, __parts int"))


def dealt(facts: DataFrame, dims: DataFrame, spread: Column, hot: HotKeys | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(facts, dims, further join columns): rows of hot keys in parts by ``spread``, their rows of ``dims`` once for each part."""
    if hot is None:
        return facts, dims, []
    on, parts = list(hot.on), F.coalesce("__parts", F.lit(1))
    table = F.broadcast(hot.parts)  # at most MOST_HOT_KEYS rows
    lhs = facts.join(table, on, "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    rhs = dims.join(table, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return lhs, rhs, ["__part"]


def split_join(facts: DataFrame, dims: DataFrame, on: Sequence[str], spread: Column, hot: HotKeys | None, how: str = "inner") -> DataFrame:
    """Join of rows with a table per key; keys in ``hot`` are split as measured, others are joined as they are."""
    lhs, rhs, more = dealt(facts, dims, spread, hot)
    return lhs.join(rhs, [*on, *more], how).drop("__part")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
    *,
    touching: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Inner join of rows whose spans overlap; equal column names must be in ``by``.

    Both sides are spread over bins of ``width``, so a key with many spans is
    spread too; rows of ``hot`` keys of the left side, measured on some of ``by``, are
    split further. A pair is kept only in the bin where its overlap starts.
    """
    l0, l1 = (F.col(c) for c in left_span)
    r0, r1 = (F.col(c) for c in right_span)
    left, right, more = dealt(left, right, F.struct(*left_span, *[c for c in left.columns if c.endswith("_id") and c not in by]), hot)
    lhs = left.withColumn("__bin", F.explode(bins(l0, l1, width)))
    rhs = right.withColumn("__bin", F.explode(bins(r0, r1, width)))
    start, end = F.greatest(l0, r0), F.least(l1, r1)
    meets = (start <= end) if touching else (start < end)
    home = F.floor(start / F.lit(float(width))) == F.col("__bin")
    return lhs.join(rhs, [*by, *more, "__bin"]).where(meets & home).drop("__bin", "__part")


def point_join(
    points: DataFrame,
    spans: DataFrame,
    by: Sequence[str],
    point: str,
    span: tuple[str, str],
    width: float,
    keep: Column,
) -> DataFrame:
    """Inner join of points with the spans for which ``keep`` holds."""
    lhs = points.withColumn("__bin", F.floor(F.col(point) / F.lit(float(width))))
    rhs = spans.withColumn("__bin", F.explode(bins(F.col(span[0]), F.col(span[1]), width)))
    return lhs.join(rhs, [*by, "__bin"]).where(keep).drop("__bin")


def salted_join(
    facts: DataFrame, dims: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", salt: int = 8
) -> DataFrame:
    """Join of rows with a table per key that splits a hot key over ``salt`` tasks.

    ``spread`` is any column that varies within a key. Each row of ``dims`` is
    copied ``salt`` times; Spark still broadcasts it when it is small enough.
    """
    lhs = facts.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salt)))
    rhs = dims.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    return lhs.join(rhs, [*on, "__salt"], how).drop("__salt")


def salted_left_join(
    facts: DataFrame, dims: DataFrame, on: Sequence[str], spread: Column, salt: int = 8
) -> DataFrame:
    return salted_join(facts, dims, on, spread, "left", salt)
