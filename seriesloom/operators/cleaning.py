"""Steps around the cleaning of a recording (FLT-02, FLT-03, FLT-08, FLT-09, WIN-19, WIN-21, WIN-22, WIN-23, JN-10, JN-12, JN-14, AGG-13, AGG-21, AGG-23, AGG-25, VAL-05, PRJ-13).

Windows share one (series, order) exchange; order statistics go by rank. A null
series is a series of its own; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..functions.selection import rank_quantiles
from .folds import carry
from .scans import zero_phase

#: Rows that a bridge over a jump takes before it and after it (fixed values).
BRIDGE_BEFORE, BRIDGE_AFTER = 7, 6

#: Samples that a calibrated median needs (fixed value).
LEAST_SAMPLES = 20

#: Dearest a hypothesis' own cost can be, in units of the cost scale (fixed value).
DEAREST = 30.0


def outside_share(points: Column, margin: float = 0.0) -> Column:
    """Share of the points (arrays x, y, ...) beyond the unit square by more than ``margin``; null for no points."""

    def outside(p: Column) -> Column:
        return (F.get(p, F.lit(0)) < -margin) | (F.get(p, F.lit(0)) > 1 + margin) | (F.get(p, F.lit(1)) < -margin) | (F.get(p, F.lit(1)) > 1 + margin)

    return F.when(F.size(points) > 0, F.size(F.filter(points, outside)) / F.size(points))


def first_failure(**tests: Column) -> Column:
    """The name of the first test, in the order given, that a row fails by being true; null if none is. A null test is not true."""
    return F.coalesce(*(F.when(t, F.lit(n)) for n, t in tests.items()))


def every_nth(df: DataFrame, series: str, order: list[str], n: int) -> DataFrame:
    """The first row of each series and every n-th after it; ``order`` must be unique for a stable result."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(series).orderBy(*order)) - 1).where(F.col("_n") % n == 0).drop("_n")


def sample_and_hold(df: DataFrame, series: str, order: str, value: str, present: Column, stride: int, name: str = "held") -> DataFrame:
    """The value of the last row taken: of the rows ``present``, the first and every ``stride``-th; null before the first of them.

    A row that is taken with a null value gives null until the next.
    """
    w = W.partitionBy(series).orderBy(order)
    out = df.withColumn("_p", F.coalesce(present, F.lit(False)))
    before = F.coalesce(F.count_if("_p").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("_t", F.when(F.col("_p") & (before % stride == 0), F.struct(F.col(value).alias("v"))))
    return out.withColumn(name, F.last("_t", True).over(w.rowsBetween(W.unboundedPreceding, 0))["v"]).drop("_p", "_t")


def bridges(df: DataFrame, series: str, order: str, angle: str, least: float, name: str = "bridged") -> DataFrame:
    """A half cosine over the rows about every step of ``least`` or more, from the angle at its start to that at its end.

    A row within reach of several steps follows the last of them; rows without one,
    and steps to or from a null, give null. All angles read are the given ones.
    """
    w = W.partitionBy(series).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(series)))
    low, high = F.greatest(F.col("_i") - BRIDGE_BEFORE, F.lit(0)), F.least(F.col("_i") + BRIDGE_AFTER, F.col("_n") - 1)
    a = F.when(F.col("_i") >= BRIDGE_BEFORE, F.lag(angle, BRIDGE_BEFORE).over(w)).otherwise(F.first(angle).over(whole))
    b = F.when(F.col("_i") + BRIDGE_AFTER < F.col("_n"), F.lead(angle, BRIDGE_AFTER).over(w)).otherwise(F.last(angle).over(whole))
    jump = F.abs(F.col(angle) - F.lag(angle).over(w)) >= least
    out = out.withColumn("_j", F.when(jump, F.struct(low.alias("low"), high.alias("high"), a.alias("a"), b.alias("b"))))
    out = out.withColumn("_e", F.last("_j", True).over(w.rowsBetween(-BRIDGE_AFTER, BRIDGE_BEFORE)))
    e = F.col("_e")
    weight = F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(math.pi) * (F.col("_i") - e["low"]) / (e["high"] - e["low"]))
    return out.withColumn(name, e["a"] * (F.lit(1.0) - weight) + e["b"] * weight).drop("_i", "_n", "_j", "_e")


def cross_fade(df: DataFrame, series: str, order: str, first: str, second: str, present: Column, cutoff: float, rate: float, name: str = "faded") -> DataFrame:
    """``first`` where it is present and ``second`` elsewhere, mixed by the smoothed presence so that a change of source never jumps.

    The weight is the zero-phase low-pass of 0 and 1, held within them. Fill
    ``first`` before: it is read a little beyond where it is present.
    """
    mask = df.withColumn("_m", F.when(F.coalesce(present, F.lit(False)), 1.0).otherwise(0.0))
    out = zero_phase(mask, series, order, "_m", cutoff, rate, "_w").withColumn("_w", clamp(F.col("_w"), 0.0, 1.0))
    return out.withColumn(name, F.col(first) * F.col("_w") + F.col(second) * (F.lit(1.0) - F.col("_w"))).drop("_m", "_w")


def choose_hypotheses(df: DataFrame, series: str, order: str, rotations: str, costs: str, sigma: float, cost_scale: float, reject: float, name: str = "choice") -> DataFrame:
    """The cheapest path through each row's hypotheses, or -1 where a row is better rejected (or has none).

    ``rotations`` holds unit quaternions and ``costs`` as many own costs. A step costs
    the square of its angle over sigma, which grows with the root of the rows since
    the last one that has hypotheses (``order`` counts them); ``reject`` is the price of leaving a row
    out, which keeps the rotation of its cheapest predecessor. Ties go to the first.
    """

    def angle(a: list[float], b: list[float]) -> float:
        return 2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(a, b)))))

    def forward(state, k, turns, prices):
        if not turns:
            return state, (None, None)
        own = [min(p / cost_scale, DEAREST) for p in prices]
        if state is None:
            layer = [*((c, q) for c, q in zip(own, turns)), (reject, turns[0])]
            back = [0] * len(layer)
        else:
            at, before = state
            reach = sigma * math.sqrt(max(1, k - at))
            layer, back = [], []
            for c, q in zip(own, turns):
                through = [cost + (angle(turn, q) / reach) ** 2 for cost, turn in before]
                best = min(range(len(through)), key=through.__getitem__)
                layer.append((through[best] + c, q))
                back.append(best)
            best = min(range(len(before)), key=lambda i: before[i][0])
            layer.append((before[best][0] + reject, before[best][1]))
            back.append(best)
        return (k, layer), (back, [cost for cost, _ in layer])

    def backward(state, back, total):
        if back is None:
            return state, (-1,)
        here = min(range(len(total)), key=total.__getitem__) if state is None else state
        return back[here], (-1 if here == len(total) - 1 else here,)

    out = carry(df, series, [order], [order, rotations, costs], "_back array<int>, _total array<double>", lambda: None, forward)
    return carry(out, series, [order], ["_back", "_total"], f"{name} int", lambda: None, backward, descending=True, placed=True).drop("_back", "_total")


def anchored_path(df: DataFrame, series: str, order: list[str], costs: str, needed: Column, offsets: list[float], smooth: float, anchored: bool = True, name: str = "offset") -> DataFrame:
    """The cheapest path through the candidate offsets of every row: its ``costs`` plus ``smooth`` times the squared steps.

    A series no row of which is ``needed`` stays at 0 and is not searched. Rows
    without costs, and both ends if ``anchored``, are held at the offset 0, which must be among the offsets. Ties go to the first.
    """
    grid = np.asarray(offsets, float)
    home = offsets.index(0.0)
    move = smooth * (grid[None, :] - grid[:, None]) ** 2
    fixed = np.where(grid == 0, 0.0, 1e6)
    w = W.partitionBy(series).orderBy(*order)
    down = W.partitionBy(series).orderBy(*(F.desc(o) for o in order))
    out = df.withColumn("_go", F.max(F.coalesce(needed, F.lit(False))).over(W.partitionBy(series)))
    out = out.withColumn("_end", F.lit(anchored) & ((F.row_number().over(w) == 1) | (F.row_number().over(down) == 1)))

    def forward(total, go, end, cost):
        if not go:
            return None, (None, None)
        own = fixed if end or cost is None else np.asarray(cost, float)
        if total is None:
            return own, ([home] * len(grid), own.tolist())
        through = total[:, None] + move
        back = through.argmin(axis=0)
        total = through[back, np.arange(len(grid))] + own
        return total, (back.tolist(), total.tolist())

    def backward(state, back, total):
        if back is None:
            return None, (0.0,)
        here = int(np.argmin(total)) if state is None else state
        return int(back[here]), (offsets[here],)

    out = carry(out, series, order, ["_go", "_end", costs], "_back array<int>, _total array<double>", lambda: None, forward)
    return carry(out, series, order, ["_back", "_total"], f"{name} double", lambda: None, backward, descending=True, placed=True).drop("_back", "_total", "_go", "_end")


def aligned(streams: dict[str, DataFrame], series: str, slot: str) -> DataFrame:
    """One row per series and slot that any stream has, with each stream's other columns as a struct of its name (null if it has none there).

    One union and one aggregate instead of a chain of outer joins, so one exchange
    whatever the number of streams. Of repeated rows the least is kept.
    """
    kinds = {n: "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in s.schema.fields if f.name not in (series, slot)) + ">" for n, s in streams.items()}

    def wide(name: str, stream: DataFrame) -> DataFrame:
        rest = [c for c in stream.columns if c not in (series, slot)]
        return stream.select(series, slot, *((F.struct(*rest) if n == name else F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()))

    every = reduce(DataFrame.unionByName, (wide(n, s) for n, s in streams.items()))
    return every.groupBy(series, slot).agg(*(F.min(n).alias(n) for n in streams))


def before_after(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Both sides' measures by key, and the difference ``after - before``; a key of one side only has nulls for the other. Keys must be unique; null keys do not meet."""
    one = before.select(key, *(F.col(m).alias(f"{m}_before") for m in measures))
    other = after.select(key, *(F.col(m).alias(f"{m}_after") for m in measures))
    both = one.join(other, key, "full")
    return both.select(key, *(c for m in measures for c in (f"{m}_before", f"{m}_after", (F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_change"))))


def or_rest(df: DataFrame, bone: str, value: str, rest: DataFrame, rest_value: str) -> DataFrame:
    """Null values become the rest value of their bone, a column of ``rest`` (one row per bone); null if that has none."""
    pose = rest.select(F.col(bone), F.col(rest_value).alias("_rest"))
    return df.join(pose, bone, "left").withColumn(value, F.coalesce(F.col(value), F.col("_rest"))).drop("_rest")


def guarded_medians(df: DataFrame, group: str, value: str, least: int = LEAST_SAMPLES) -> DataFrame:
    """Per group the samples, the mean of the middle two and the upper median; the medians are null below ``least`` samples. Null values are no samples, and groups of them alone are left out."""
    ranks = rank_quantiles(df, [group], value, {"_low": "floor((n - 1) / 2)", "_high": "floor(n / 2)", "_last": "n - 1"})
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("samples"))
    both = ranks.join(counts, F.col(group).eqNullSafe(F.col("_g")))
    enough = F.col("samples") >= least
    return both.select(group, "samples", F.when(enough, (F.col("_low") + F.col("_high")) / 2).alias("median_mid"), F.when(enough, F.col("_high")).alias("median_upper"))


def timing_summary(df: DataFrame, group: str, value: str, p: float = 0.95) -> DataFrame:
    """Per group the mean, the value at floor(p (n - 1)) and the greatest; nulls aside, groups of nulls alone are left out."""
    high = rank_quantiles(df, [group], value, {"high": f"floor({p!r}D * (n - 1))"}).withColumnRenamed(group, "_g")
    told = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))
    return told.join(high, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def nearest_entry(df: DataFrame, group: str, x: str, reference: float, place: str, value: str) -> DataFrame:
    """Per group the ``value`` of the entry whose ``x`` is nearest to the reference; the first by ``place`` among equals. Entries without x are left out."""
    return df.where(F.col(x).isNotNull()).groupBy(group).agg(F.min_by(value, F.struct(F.abs(F.col(x) - reference), F.col(place))).alias(value))


def playback_minutes(df: DataFrame, group: str, frames: str, fps: float) -> DataFrame:
    """Per group the minutes that all its frames play, halves up, at least 1."""
    return df.groupBy(group).agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.sum(frames), F.lit(0)) / fps / 60 + 0.5)).cast("long").alias("minutes"))


def contiguous(df: DataFrame, series: str, place: str) -> DataFrame:
    """Per series whether its places are 0, 1, 2 ... without holes or repeats, and the first row (from 0) that is not in its place. A null place never is."""
    numbered = df.select(series, F.col(place).alias("_p"), (F.row_number().over(W.partitionBy(series).orderBy(F.col(place).asc_nulls_last())) - 1).cast("long").alias("_i"))
    wrong = F.min(F.when(~F.coalesce(F.col("_p") == F.col("_i"), F.lit(False)), F.col("_i")))
    return numbered.groupBy(series).agg(wrong.isNull().alias("contiguous"), wrong.alias("first_wrong"))
