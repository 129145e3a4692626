"""Outliers, spikes and jumps (WIN-04, WIN-24 to WIN-26, STM-04, STM-05, FLT-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import MAD_SCALE, array_median, array_median_upper, finite


def hampel(df: DataFrame, series: str, value: str, valid: Column, half: int, sigmas: float, floor: float, order: str = "k") -> DataFrame:
    """``outlier``: a valid value further from the median of the valid ones within ``half`` rows than sigmas times their spread.

    The spread is the scaled median absolute deviation, at least ``floor`` in all;
    fewer than four valid values in reach flag nothing. Windows hold at most
    2 half + 1 values.
    """
    w = W.partitionBy(series).orderBy(order).rowsBetween(-half, half)
    out = df.withColumn("_near", F.collect_list(F.when(valid, F.col(value))).over(w))
    out = out.withColumn("_m", array_median(F.col("_near")))
    spread = array_median(F.transform("_near", lambda v: F.abs(v - F.col("_m")))) * MAD_SCALE
    far = F.abs(F.col(value) - F.col("_m")) > F.greatest(spread * sigmas, F.lit(floor))
    return out.withColumn("outlier", F.coalesce(valid & (F.size("_near") >= 4) & far, F.lit(False))).drop("_near", "_m")


def median_gate(df: DataFrame, series: str, value: str, size: int, sigmas: float, floor: float, order: str = "k") -> DataFrame:
    """``gated``: a value too far from the (upper) median of the ``size`` raw values before it becomes that median."""
    w = W.partitionBy(series).orderBy(order).rowsBetween(-size, -1)
    out = df.withColumn("_near", F.collect_list(value).over(w)).withColumn("_m", array_median_upper(F.col("_near")))
    spread = array_median_upper(F.transform("_near", lambda v: F.abs(v - F.col("_m")))) * MAD_SCALE
    far = (F.size("_near") >= 3) & (F.abs(F.col(value) - F.col("_m")) > F.greatest(spread * sigmas, F.lit(floor)))
    return out.withColumn("gated", F.when(far, F.col("_m")).otherwise(F.col(value))).drop("_near", "_m")


def rolling_quantile(df: DataFrame, series: str, value: str, capacity: int, p: float, fallback: float = 0.0, order: str = "k", name: str = "rolling") -> DataFrame:
    """Interpolated quantile of the last ``capacity`` rows' finite values; the fallback if there are none."""
    w = W.partitionBy(series).orderBy(order).rowsBetween(1 - capacity, 0)
    return df.withColumn(name, F.coalesce(F.percentile(finite(F.col(value)), min(max(p, 0.0), 1.0)).over(w), F.lit(fallback)))


def spikes(df: DataFrame, series: str, value: str, threshold: float, order: str = "k") -> DataFrame:
    """``spike``: one row off both neighbours by more than the threshold, while these agree to half of it."""
    w = W.partitionBy(series).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    x = F.col(value)
    test = (F.abs(x - before) > threshold) & (F.abs(x - after) > threshold) & (F.abs(after - before) < threshold / 2)
    return df.withColumn("spike", F.coalesce(test, F.lit(False)))


def classify_jumps(df: DataFrame, series: str, position: list[str], fast: float, most: float, ratio: float, order: str = "k") -> DataFrame:
    """``jump`` (distance from the row before) and its ``kind``: ``teleport``, ``fast`` or null.

    Over ``fast``, a jump is a teleport if it is ``ratio`` times both neighbours, if
    the next jump leads back, or if it is over ``most``.
    """
    w = W.partitionBy(series).orderBy(order)

    def distance(n: int, base: int) -> Column:
        total = F.lit(0.0)
        for p in position:
            d = (F.lead(p, n).over(w) if n else F.col(p)) - F.lag(p, base).over(w)
            total = total + d * d
        return F.sqrt(total)

    out = df.withColumn("jump", distance(0, 1)).withColumn("_skip", distance(1, 1))
    out = out.withColumn("_before", F.coalesce(F.lag("jump").over(w), F.lit(0.0))).withColumn("_after", F.coalesce(F.lead("jump").over(w), F.lit(0.0)))
    d = F.col("jump")
    alone = d > F.greatest("_before", "_after") * ratio
    back = (F.col("_after") > fast) & (F.col("_skip") < F.least(d, F.col("_after")) * 0.5)
    kind = F.when(d > fast, F.when(alone | F.coalesce(back, F.lit(False)) | (d > most), "teleport").otherwise("fast"))
    return out.withColumn("kind", kind).drop("_skip", "_before", "_after")


def residual_gate(df: DataFrame, group: str, residual: str, p: float = 0.99, times: float = 1.5) -> DataFrame:
    """``accepted``: finite and at most ``times`` the group's interpolated quantile. The quantile is one row per group; a null group is a group."""
    limits = df.groupBy(F.col(group).alias("_g")).agg((F.percentile(finite(F.col(residual)), p) * times).alias("_limit"))
    return df.join(limits, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("accepted", F.coalesce(finite(F.col(residual)) <= F.col("_limit"), F.lit(False))).drop("_limit")
