"""Exact interpolated percentiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ordered import cum_sum, scan, whole


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column,
    probs: dict[str, float],
    *,
    width: float = 1.0,
    zeros: DataFrame | None = None,
    staged: bool = False,
) -> DataFrame:
    """Linear percentiles per key, as numpy computes them; nulls are ignored.

    Equal values are counted before the shuffle, ranks come from running counts
    over value slices of ``width``. ``zeros`` (by, n) adds n zero values per key
    as one counted row.
    """
    by = list(by)
    counts = df.select(*by, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counts = counts.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    if zeros is not None:
        extra = zeros.where(F.col("n") > 0).select(
            *by, F.lit(0.0).alias("__v"), F.col("n").cast("long").alias("__c")
        )
        counts = counts.unionByName(extra).groupBy(*by, "__v").agg(F.sum("__c").alias("__c"))
    ranked = scan(
        counts, by, ["__v"], F.floor(F.col("__v") / F.lit(float(width))), staged=staged,
        __hi=cum_sum(F.col("__c")), __n=whole("sum", F.col("__c")),
    )
    last = F.col("__hi") - 1
    first = F.col("__hi") - F.col("__c")
    picks = []
    for name, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= rank) & (rank <= last), F.col("__v"))).alias(f"__{name}_{side}"))
    picked = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *picks)
    out = []
    for name, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return picked.select(*by, *out)
