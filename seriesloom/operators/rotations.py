"""Operators over series of rotations (WIN-11, WIN-13, WIN-15, WIN-16, AGG-04, AGG-17, AGG-18, JN-07, FN-10; STM-02, STM-03 and STM-11 over tables)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quaternions import angle_between, at, dot, norm, scale, slerp, unit
from ..functions.scalars import wrap_angle
from . import scans
from .folds import LEAST_DT, USUAL_DT, carry
from .identities import finite_or_null
from .timeline import around


def align(df: DataFrame, series: str, order: str, rotation: str) -> DataFrame:
    """Signs such that neighbours share a hemisphere.

    A row's sign is the parity of the changes of hemisphere up to it: one running
    sum instead of a loop. Null rotations stay null, and the rows around them are neighbours.
    """
    w = W.partitionBy(series).orderBy(order)
    before = F.last(rotation, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = df.withColumn("_flip", F.coalesce((dot(F.col(rotation), before) < 0).cast("int"), F.lit(0)))
    odd = F.sum("_flip").over(w.rowsBetween(W.unboundedPreceding, 0)) % 2 == 1
    return out.withColumn(rotation, F.when(odd, scale(F.col(rotation), F.lit(-1.0))).otherwise(F.col(rotation))).drop("_flip")


def unwrap(df: DataFrame, series: str, order: str, angle: str) -> DataFrame:
    """Angles without jumps: the first one plus the running sum of the wrapped steps."""
    w = W.partitionBy(series).orderBy(order)
    out = df.withColumn("_d", F.coalesce(wrap_angle(F.col(angle) - F.lag(angle).over(w)), F.col(angle)))
    return out.withColumn(angle, F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def angle_steps(df: DataFrame, series: str, order: str, rotation: str, name: str = "step") -> DataFrame:
    """Radians from the row before; null at the first."""
    w = W.partitionBy(series).orderBy(order)
    return df.withColumn(name, angle_between(F.col(rotation), F.lag(rotation).over(w)))


def numeric_checks(df: DataFrame, series: str, order: str, rotation: str) -> DataFrame:
    """Per series: rows, components that are not finite, greatest error of the norm, changes of hemisphere."""
    w = W.partitionBy(series).orderBy(order)
    infinite = F.lit(float("inf"))
    bad = F.size(F.filter(rotation, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)))
    told = df.select(series, bad.alias("_bad"), F.when(bad == 0, F.abs(norm(F.col(rotation)) - 1)).alias("_error"), (dot(F.col(rotation), F.lag(rotation).over(w)) < 0).alias("_flip"))
    return told.groupBy(series).agg(F.count("*").alias("rows"), F.sum("_bad").alias("not_finite"), F.max("_error").alias("norm_error"), F.count_if("_flip").alias("flips"))


def sample_rotation(points: DataFrame, samples: DataFrame, series: str, seconds: str, rotation: str, period: float) -> DataFrame:
    """The rotation at any time, along the arc between the samples around it; held at both ends. See ``timeline.around``."""
    return around(points, samples, series, seconds, rotation, period, slerp)


def _of_moments(moments: DataFrame, keys: str, size: int, name: str) -> DataFrame:
    """The greatest eigenvector of each row's symmetric matrix, of which the columns m00, m01, ... are the upper half; null where a part is."""
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    key_type = moments.schema[keys].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(pairs))], axis=1).reshape(batch.num_rows, -1)
            good = np.isfinite(parts).all(axis=1)
            matrix = np.zeros((int(good.sum()), size, size))
            for k, (i, j) in enumerate(pairs):
                matrix[:, i, j] = matrix[:, j, i] = parts[good, k]
            vectors = np.linalg.eigh(matrix)[1][:, :, -1] if len(matrix) else np.zeros((0, size))
            # of v and -v, the one whose last part that isn't 0 is positive
            for v in vectors:
                big = [x for x in v if abs(x) > 1e-12]
                if big and big[-1] < 0:
                    v *= -1
            found = iter(vectors.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([next(found) if g else None for g in good], pa.list_(pa.float64()))], names=[keys, name])

    columns = [f"m{i}{j}" for i, j in pairs]
    return moments.select(keys, *columns).mapInArrow(run, f"{keys} {key_type}, {name} array<double>")


def _moments(df: DataFrame, keys: str, vector: str, size: int) -> DataFrame:
    v = finite_or_null(F.slice(F.col(vector), 1, size))
    return df.groupBy(keys).agg(*(F.sum(at(v, i) * at(v, j)).alias(f"m{i}{j}") for i in range(size) for j in range(i, size)))


def average(df: DataFrame, group: str, rotation: str, name: str = "average") -> DataFrame:
    """The mean rotation (Markley): the greatest eigenvector of the summed outer products, ten sums per group.

    Rotations that are null or have a part that is null, NaN or infinite are left out; a group
    without any other gets null. Where two directions are equally far along, either may be told.
    """
    return _of_moments(_moments(df, group, rotation, 4), group, 4, name)


def dominant_axis(df: DataFrame, group: str, vector: str, name: str = "axis") -> DataFrame:
    """The line that a group's 3-vectors follow most: the greatest eigenvector of six sums. Odd vectors and groups as in ``average``."""
    return _of_moments(_moments(df, group, vector, 3), group, 3, name)


def fitted_rotation(df: DataFrame, group: str, source: str, target: str, name: str = "rotation") -> DataFrame:
    """The rotation that takes the ``source`` points nearest to the ``target`` points (Horn), both about their means.

    Fifteen sums per group give the 4x4 matrix whose greatest eigenvector it is. Pairs
    with a point that is null or not finite are left out; a group without pairs gets null.
    """
    p, q = finite_or_null(F.slice(F.col(source), 1, 3)), finite_or_null(F.slice(F.col(target), 1, 3))
    p, q = F.when(q.isNotNull(), p), F.when(p.isNotNull(), q)
    sums = df.groupBy(group).agg(
        F.count(p).alias("n"), *(F.sum(at(p, i)).alias(f"p{i}") for i in range(3)), *(F.sum(at(q, i)).alias(f"q{i}") for i in range(3)),
        *(F.sum(at(p, i) * at(q, j)).alias(f"s{i}{j}") for i in range(3) for j in range(3)),
    )
    s = {(i, j): F.col(f"s{i}{j}") - F.col(f"p{i}") * F.col(f"q{j}") / F.col("n") for i in range(3) for j in range(3)}
    # rows and columns in the order x, y, z, w
    matrix = {
        "m00": s[0, 0] - s[1, 1] - s[2, 2], "m01": s[0, 1] + s[1, 0], "m02": s[2, 0] + s[0, 2], "m03": s[1, 2] - s[2, 1],
        "m11": s[1, 1] - s[0, 0] - s[2, 2], "m12": s[1, 2] + s[2, 1], "m13": s[2, 0] - s[0, 2],
        "m22": s[2, 2] - s[0, 0] - s[1, 1], "m23": s[0, 1] - s[1, 0], "m33": s[0, 0] + s[1, 1] + s[2, 2],
    }
    return _of_moments(sums.select(group, *(c.alias(k) for k, c in matrix.items())), group, 4, name)


def normalised(df: DataFrame, rotation: str) -> DataFrame:
    return df.withColumn(rotation, unit(F.col(rotation)))


# ---- filters of rotations


def zero_phase(df: DataFrame, series: str, order: str, rotation: str, cutoff: float, rate: float, name: str = "smooth", block: float = scans.BLOCK) -> DataFrame:
    """Low-pass without lag: signs aligned, the four components filtered side by side both ways, norm 1 again.

    See ``scans.zero_phase``. Null rotations, and such with a part that is not finite, stay
    null; series of fewer than three rotations stay as they are.
    """
    aligned = align(df.withColumn(name, finite_or_null(F.col(rotation))), series, order, name)
    filtered = scans.zero_phase(aligned.withColumn("_given", F.col(name)), series, order, "_given", cutoff, rate, "_filtered", block)
    few = F.count("_given").over(W.partitionBy(series)) < 3
    return filtered.withColumn(name, F.when(few, F.when(F.col("_given").isNotNull(), F.col(rotation))).otherwise(unit(F.col("_filtered")))).drop("_given", "_filtered")


def _turned(a: list[float], b: list[float], most: float) -> list[float]:
    """``b``, or the rotation at ``most`` radians from ``a`` on the shorter arc to ``b``."""
    cosine = sum(x * y for x, y in zip(a, b))
    half = math.acos(min(1.0, abs(cosine)))
    if 2 * half <= most:
        return b
    t, sign = most / (2 * half), math.copysign(1.0, cosine)
    wa, wb = math.sin((1 - t) * half) / math.sin(half), sign * math.sin(t * half) / math.sin(half)
    return [x * wa + y * wb for x, y in zip(a, b)]


def limit_rate(df: DataFrame, series: str, order: list[str], rotation: str, most: float, name: str = "limited") -> DataFrame:
    """Symmetric limit of ``most`` radians a row: halfway between a limited forward and a limited backward pass. Null rotations stay null."""

    def step(before, q):
        y = q if before is None or q is None else _turned(before, q, most)
        return (before if y is None else y), (y,)

    forward = carry(df, series, order, [rotation], "_forward array<double>", lambda: None, step)
    both = carry(forward, series, order, [rotation], "_backward array<double>", lambda: None, step, descending=True, placed=True)
    return both.withColumn(name, unit(slerp(F.col("_forward"), F.col("_backward"), F.lit(0.5)))).drop("_forward", "_backward")


def limit_step(state: tuple | None, q: list[float] | None, t: float, rate: float) -> tuple[tuple | None, tuple]:
    """One row of the causal limit; the state is (rotation, time). Streams take the same step."""
    if q is None:
        return state, (None,)
    y = q if state is None else _turned(state[0], q, rate * max(t - state[1], LEAST_DT))
    return (y, t), (y,)


def limited_steps(df: DataFrame, series: str, order: list[str], rotation: str, seconds: str, rate: float, name: str = "limited") -> DataFrame:
    """Causal limit of ``rate`` radians a second. Null rotations give null and change nothing; where time doesn't rise, the shortest step counts."""
    return carry(df, series, order, [rotation, seconds], f"{name} array<double>", lambda: None, lambda state, q, t: limit_step(state, q, t, rate))


def _unit(q: list[float]) -> list[float]:
    size = math.sqrt(sum(x * x for x in q))
    return [x / size for x in q]


def one_euro_step(state: tuple | None, q: list[float] | None, t: float, min_cutoff: float, beta: float, derivative_cutoff: float) -> tuple[tuple | None, tuple]:
    """One row of the One Euro filter of rotations; the state is (rotation, speed, time). Streams take the same step."""
    if q is None:
        return state, (state[0] if state else None,)
    if state is None:
        value = _unit(q)
        return (value, 0.0, t), (value,)
    value, speed, before = state
    dt = t - before
    dt = max(dt if dt > 0 else USUAL_DT, LEAST_DT)

    def weight(cutoff: float) -> float:
        return 1 / (1 + 1 / (2 * math.pi * cutoff) / dt)

    angle = 2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(value, q)))))
    speed += weight(derivative_cutoff) * (angle / dt - speed)
    if angle > 1e-9:
        value = _unit(_turned(value, q, angle * weight(min_cutoff + beta * abs(speed))))
    return (value, speed, t), (value,)


def one_euro(df: DataFrame, series: str, order: list[str], rotation: str, seconds: str, min_cutoff: float = 1.0, beta: float = 0.0, derivative_cutoff: float = 1.0, name: str = "smooth") -> DataFrame:
    """The One Euro filter of unit quaternions: each output lies on the shorter arc from the last output to the row; null rotations repeat it."""

    def step(state, q, t):
        return one_euro_step(state, q, t, min_cutoff, beta, derivative_cutoff)

    return carry(df, series, order, [rotation, seconds], f"{name} array<double>", lambda: None, step)


# ---- easing to the last target


@dataclass(frozen=True)
class Easing:
    """How rotations follow targets from tick to tick (STM-11); times are whole milliseconds.

    At every tick the rotation closes 1 - exp(-period / tau) of the arc to the last
    target. A target older than ``stale`` gives way to ``rest``; once nearer to rest than
    ``near`` radians, the series is at rest and has no further ticks until a target
    comes, from which on it starts anew from rest. What is shown is ``strength`` of the
    arc from rest to the rotation.
    """

    period: int
    tau: float = 0.035
    strength: float = 1.0
    stale: int = 1_500
    near: float = 1e-3
    rest: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0)

    def tick_at(self, at: int) -> int:
        """The first tick that isn't before a time."""
        return -(-at // self.period) * self.period

    def step(self, state: tuple | None, tick: int, target: list[float] | None, since: int | None) -> tuple[tuple | None, tuple]:
        """One tick with the last target up to it; the state is (tick, rotation, target, when it came, awake)."""
        if target is None or since is None:
            return state, (None, None)
        # a series starts at rest, and again after it has come to rest
        current = list(state[1]) if state is not None and state[4] else list(self.rest)
        stale = tick - since > self.stale
        goal = list(self.rest) if stale else target
        half = math.acos(min(1.0, abs(sum(x * y for x, y in zip(current, goal)))))
        current = _unit(_turned(current, goal, 2 * half * (1 - math.exp(-(self.period / 1000) / max(1e-3, self.tau)))))
        left = 2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(current, self.rest)))))
        awake = not (stale and left < self.near)
        if not awake:
            current = list(self.rest)
        s = min(1.0, max(0.0, self.strength))
        angle = 2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(self.rest, current)))))
        shown = current if s == 1 or angle < 1e-9 else _unit(_turned(list(self.rest), current, s * angle))
        return (tick, current, target, since, awake), (shown, stale)

    def ticks_until(self, state: tuple | None, waiting: list[tuple[int, list[float]]], until: int) -> tuple[list[tuple], tuple | None, list, int | None]:
        """Ticks up to ``until`` with the targets that wait (in order of time): rows, the state, targets still waiting, the next tick."""
        rows: list[tuple] = []
        while True:
            awake = state is not None and state[4]
            if not awake and not waiting:
                return rows, state, waiting, None
            tick = state[0] + self.period if awake else self.tick_at(waiting[0][0])
            if not awake and state is not None:
                tick = max(tick, state[0] + self.period)
            if tick > until:
                return rows, state, waiting, tick
            due = [w for w in waiting if w[0] <= tick]
            waiting = waiting[len(due) :]
            since, target = due[-1] if due else (state[3], state[2])
            state, (shown, stale) = self.step(state, tick, target, since)
            rows.append((tick, shown, stale))


def eased(targets: DataFrame, ticks: DataFrame, series: str, millis: str, rotation: str, ease: Easing) -> DataFrame:
    """``series, tick, eased, stale`` for every tick at which a series is awake: the batch form of the stream of the same name.

    ``targets`` has ``series, millis, rotation``, ``ticks`` a row ``series, tick`` for every
    multiple of the period that is asked for. The last target up to each tick is
    found by one sort of both together. Null targets and times are left out, of equal
    times the target that comes last in order counts; a series without targets has no rows.
    """
    given = targets.where(F.col(millis).isNotNull() & F.col(rotation).isNotNull()).select(series, F.col(millis).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(millis).cast("long").alias("since"), F.col(rotation).alias("target")).alias("_t"))
    asked = ticks.select(series, F.col("tick").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(given.schema["_t"].dataType).alias("_t"))
    w = W.partitionBy(series).orderBy("_at", "_kind", "_t").rowsBetween(W.unboundedPreceding, 0)
    both = given.unionByName(asked).withColumn("_t", F.last("_t", ignorenulls=True).over(w)).where("_kind = 1").select(series, F.col("_at").alias("tick"), F.col("_t.target").alias("_target"), F.col("_t.since").alias("_since"))

    def step(state, tick, target, since):
        # asleep until a target comes that is newer than the last tick
        if state is not None and not state[4] and since is not None and since <= state[0]:
            return state, (None, None)
        return ease.step(state, tick, target, since)

    out = carry(both, series, ["tick"], ["tick", "_target", "_since"], "eased array<double>, stale boolean", lambda: None, step)
    return out.where("eased is not null").select(series, "tick", "eased", "stale")
