"""Runs, gaps and their filling on a dense grid (WIN-02, WIN-03, WIN-05 to WIN-08, WIN-17, WIN-18, WIN-28 to WIN-30, AGG-01).

All are windows over one (series, k) sort order. "The next valid row" is the last
one of the descending window, as a frame that ends at the series' end is costly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quaternions import slerp
from ..functions.scalars import smoothstep

#: Longest gap between two valid rows that is filled in (fixed value).
SHORT_GAP = 8


def _up(series: str, order: str = "k"):
    return W.partitionBy(series).orderBy(order)


def before_and_after(df: DataFrame, series: str, value: Column, order: str = "k", names: tuple[str, str] = ("before", "after"), own: bool = False) -> DataFrame:
    """The last value that is not null before each row and the first after it (or at it, with ``own``)."""
    reach = 0 if own else -1
    down = W.partitionBy(series).orderBy(F.desc(order))
    out = df.withColumn("_val", value)
    out = out.withColumn(names[0], F.last("_val", True).over(_up(series, order).rowsBetween(W.unboundedPreceding, reach)))
    return out.withColumn(names[1], F.last("_val", True).over(down.rowsBetween(W.unboundedPreceding, reach))).drop("_val")


def islands(df: DataFrame, series: str, state: Column, order: str = "k", name: str = "island") -> DataFrame:
    """Numbers the runs of rows with one state, from 1 in each series."""
    w = _up(series, order)
    out = df.withColumn("_s", state)
    changed = F.coalesce(~F.col("_s").eqNullSafe(F.lag("_s").over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    return out.withColumn("_c", changed.cast("long")).withColumn(name, F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s", "_c")


def runs(df: DataFrame, series: str, state: Column, order: str = "k") -> DataFrame:
    """Every run as ``state, start, end`` (end exclusive)."""
    named = df.withColumn("state", state)
    return islands(named, series, F.col("state"), order).groupBy(series, "island", "state").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("island")


def gap_classes(df: DataFrame, series: str, valid: Column, short: int = SHORT_GAP, order: str = "k") -> DataFrame:
    """Every invalid run with its length and kind: ``short`` (bounded on both sides, at most ``short`` rows), ``long`` or ``edge``."""
    every = runs(df, series, F.coalesce(valid, F.lit(False)), order).withColumn("_n", F.max("end").over(W.partitionBy(series)))
    holes = every.where(~F.col("state")).drop("state")
    length = F.col("end") - F.col("start")
    kind = F.when((F.col("start") == 0) | (F.col("end") == F.col("_n")), "edge").when(length <= short, "short").otherwise("long")
    return holes.select(series, "start", "end", length.alias("length"), kind.alias("kind"))


def detection_stats(df: DataFrame, series: str, present: Column, order: str = "k") -> DataFrame:
    """Per series: rows, rows present, their share (4 places, halves to even), missing runs and the longest of them."""
    all_runs = runs(df, series, F.coalesce(present, F.lit(False)), order).withColumn("_n", F.col("end") - F.col("start"))
    held = F.coalesce(F.sum(F.when(F.col("state"), F.col("_n"))), F.lit(0))
    return all_runs.groupBy(series).agg(
        F.sum("_n").alias("frames"),
        held.alias("detected"),
        F.bround(held / F.sum("_n"), 4).alias("ratio"),
        F.count_if(~F.col("state")).alias("missing_runs"),
        F.coalesce(F.max(F.when(~F.col("state"), F.col("_n"))), F.lit(0)).alias("longest_missing"),
    )


def hold_edges(df: DataFrame, series: str, value: str, order: str = "k") -> DataFrame:
    """Rows before the first value get it, rows after the last value that one; gaps between stay null."""
    found = before_and_after(df, series, F.col(value), order)
    held = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before"))
    return found.withColumn(value, F.coalesce(F.col(value), held)).drop("before", "after")


def hold_nearest(df: DataFrame, series: str, value: str, order: str = "k") -> DataFrame:
    """Null rows get the value of the nearest row that has one; ties go to the earlier."""
    found = before_and_after(df, series, F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("k"), F.col(value).alias("v"))), order)
    later = F.col("before").isNull() | (F.col("after.k") - F.col(order) < F.col(order) - F.col("before.k"))
    nearest = F.when(F.coalesce(later, F.lit(False)), F.col("after.v")).otherwise(F.col("before.v"))
    return found.withColumn(value, F.coalesce(F.col(value), nearest)).drop("before", "after")


def carry_forward(df: DataFrame, series: str, value: str, order: str = "k") -> DataFrame:
    """Null rows get the last value before them."""
    return df.withColumn(value, F.last(value, True).over(_up(series, order).rowsBetween(W.unboundedPreceding, 0)))


def pchip_fill(df: DataFrame, series: str, value: str, order: str = "k", edges: bool = False) -> DataFrame:
    """Fills null rows between values by monotone cubics (Fritsch-Carlson), which never overshoot.

    A knot's slope is the weighted harmonic mean of the secants on both sides, 0
    where they disagree in sign, and the only secant at either end. With
    ``edges``, rows outside the first and last value hold it. A series with fewer
    than two values is left as it is (but for its edges).
    """
    knot = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    out = before_and_after(df, series, knot, order, ("_p", "_q"))
    h0, h1 = F.col(order) - F.col("_p.x"), F.col("_q.x") - F.col(order)
    s0, s1 = (F.col(value) - F.col("_p.y")) / h0, (F.col("_q.y") - F.col(value)) / h1
    w0, w1 = h1 * 2 + h0, h1 + h0 * 2
    slope = F.when(F.col("_p").isNull(), s1).when(F.col("_q").isNull(), s0).when(s0 * s1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / s0 + w1 / s1))
    sloped = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y"), slope.alias("m")))
    out = before_and_after(out.withColumn("_k", sloped), series, F.col("_k"), order, ("_p", "_q"))
    h = F.col("_q.x") - F.col("_p.x")
    t = (F.col(order) - F.col("_p.x")) / h
    t2 = t * t
    t3 = t2 * t
    inner = (t3 * 2 - t2 * 3 + 1) * F.col("_p.y") + (t3 - t2 * 2 + t) * h * F.col("_p.m") + (t2 * 3 - t3 * 2) * F.col("_q.y") + (t3 - t2) * h * F.col("_q.m")
    filled = F.coalesce(F.col(value), inner, *([F.col("_p.y"), F.col("_q.y")] if edges else []))
    return out.withColumn(value, filled).drop("_p", "_q", "_k")


def slerp_fill(df: DataFrame, series: str, rotation: str, order: str = "k", edges: bool = True) -> DataFrame:
    """Fills null rotations along the arc between those around them; at the edges the nearest is held."""
    found = before_and_after(df, series, F.when(F.col(rotation).isNotNull(), F.struct(F.col(order).alias("k"), F.col(rotation).alias("q"))), order)
    t = (F.col(order) - F.col("before.k")) / (F.col("after.k") - F.col("before.k"))
    filled = F.coalesce(F.col(rotation), slerp(F.col("before.q"), F.col("after.q"), t), *([F.col("before.q"), F.col("after.q")] if edges else []))
    return found.withColumn(rotation, filled).drop("before", "after")


def long_gap_weights(df: DataFrame, series: str, valid: Column, hold: int, blend: int, reacquire: int, order: str = "k") -> DataFrame:
    """In every gap the weights of the value before, the value after and the rest value, and the state they make.

    The value before is held for ``hold`` rows and fades over ``blend`` more; the
    value after fades in over the last ``reacquire`` rows; rest takes what is left.
    """
    found = before_and_after(df, series, F.when(valid, F.col(order)), order, ("_a", "_b"))
    wa = F.when(F.col("_a").isNotNull(), 1 - smoothstep(hold, hold + blend, F.col(order) - F.col("_a"))).otherwise(0.0)
    wb = F.when(F.col("_b").isNotNull(), 1 - smoothstep(0, reacquire, F.col("_b") - F.col(order))).otherwise(0.0)
    out = found.withColumn("w_before", F.when(~valid, wa)).withColumn("w_after", F.when(~valid, wb))
    measured = F.least(F.lit(1.0), F.col("w_before") + F.col("w_after"))
    out = out.withColumn("w_rest", F.greatest(F.lit(0.0), 1 - F.col("w_before") - F.col("w_after")))
    return out.withColumn("state", F.when(valid, "tracked").when(measured >= 0.999, "held").when(measured > 0, "fallback").otherwise("absent")).drop("_a", "_b")


def transitions(df: DataFrame, series: str, flag: Column, order: str = "k") -> DataFrame:
    """Rows at which a flag changes, as ``event`` enter or leave; a series starts without the flag."""
    w = _up(series, order)
    now = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    was = F.coalesce(F.lag("_f").over(w), F.lit(False))
    return now.withColumn("event", F.when(F.col("_f") & ~was, "enter").when(~F.col("_f") & was, "leave")).where("event is not null").drop("_f")


def centred_average(df: DataFrame, series: str, value: str, window: int, order: str = "k") -> DataFrame:
    """``smooth``: mean of ``window`` rows about each row, the end rows repeated beyond the ends."""
    half = window // 2
    w = _up(series, order)
    span = w.rowsBetween(-half, window - 1 - half)
    whole = W.partitionBy(series).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(series)))
    out = out.withColumn("_first", F.first(value).over(whole)).withColumn("_last", F.last(value).over(whole))
    before = F.greatest(F.lit(half) - F.col("_i"), F.lit(0))
    after = F.greatest(F.col("_i") + (window - 1 - half) - (F.col("_n") - 1), F.lit(0))
    total = F.sum(value).over(span) + before * F.col("_first") + after * F.col("_last")
    return out.withColumn("smooth", total / window).drop("_i", "_n", "_first", "_last")
