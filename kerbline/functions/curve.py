"""Cubic Hermite pieces and kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tricube(u: Column) -> Column:
    a = F.abs(u)
    c = 1 - a * a * a
    return F.when(a < 1, c * c * c).otherwise(0.0)


def _cubic(t0: Column, x0: Column, m0: Column, t1: Column, x1: Column, m1: Column):
    h = t1 - t0
    d = (x1 - x0) / h
    c2 = (3 * d - 2 * m0 - m1) / h
    c3 = (m0 + m1 - 2 * d) / (h * h)
    return c2, c3


def hermite(t, t0, x0, m0, t1, x1, m1) -> Column:
    """Value of the piece at t; the piece's left value where it has no right end."""
    c2, c3 = _cubic(t0, x0, m0, t1, x1, m1)
    s = t - t0
    return F.coalesce(x0 + s * (m0 + s * (c2 + s * c3)), x0)


def hermite_speed(t, t0, x0, m0, t1, x1, m1) -> Column:
    c2, c3 = _cubic(t0, x0, m0, t1, x1, m1)
    s = t - t0
    return F.coalesce(m0 + s * (2 * c2 + 3 * s * c3), m0)


def hermite_accel(t, t0, x0, m0, t1, x1, m1) -> Column:
    c2, c3 = _cubic(t0, x0, m0, t1, x1, m1)
    return 2 * c2 + 6 * (t - t0) * c3


def inner_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Weighted harmonic mean of two chord slopes, 0 where they disagree in sign."""
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, 0.0).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))


def end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Three-point end slope limited to keep the shape; h0, d0 touch the end."""
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(F.signum(m) != F.signum(d0), 0.0)
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0)
        .otherwise(m)
    )


def bandwidth_for_cadence(cadence: Column) -> Column:
    """Neighbours that fill about 40 s, between 5 and 20, halves to even; 20 where the cadence is 0."""
    fill = F.try_divide(F.lit(40.0), cadence)  # null at 0, which least() passes over
    return F.bround(F.greatest(F.lit(5.0), F.least(F.lit(20.0), fill)), 0).cast("int")
