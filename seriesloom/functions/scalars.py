"""Scalar expressions: clamping, easing, the three roundings, clocks and digests (FN-01, FN-02, FN-15, FN-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` held within ``[low, high]``; null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(low: float, high: float, x: Column) -> Column:
    """0 below ``low``, 1 above ``high``, and 3t^2 - 2t^3 between."""
    t = clamp((x - F.lit(low)) / F.lit(high - low), 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def round_up_half(x: Column, places: int = 0) -> Column:
    """Halves go towards positive infinity (-2.5 becomes -2), unlike ``F.round``."""
    f = F.lit(float(10**places))
    return F.floor(x * f + F.lit(0.5)).cast("double") / f


def round_half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def soft_clamp(x: Column, low: float, high: float, knee: float) -> Column:
    """``x`` within the limits less the knee; beyond, it bends by tanh and never passes the limit."""
    over, under = x - F.lit(high - knee), F.lit(low + knee) - x
    return (
        F.when(over > 0, F.lit(high - knee) + F.lit(knee) * F.tanh(over / F.lit(knee)))
        .when(under > 0, F.lit(low + knee) - F.lit(knee) * F.tanh(under / F.lit(knee)))
        .otherwise(x)
    )


def frame_at(seconds: Column, fps: float) -> Column:
    """The frame that is on screen at a time."""
    return F.floor(seconds * F.lit(fps)).cast("long")


def wrap_angle(x: Column) -> Column:
    """The same angle within [-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def config_digest(options: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of an options text."""
    return F.substring(F.sha2(options.cast("binary"), 256), 1, 16)
