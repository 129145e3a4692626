"""Recurrences that SQL windows cannot express, streamed over sorted partitions (WIN-12, WIN-20, STM-01, STM-03, STM-06, TOP-05; on rotations: ``rotations``; linear filters: ``scans``).

``carry`` deals every series to one partition, sorts it there and streams the
rows in Arrow batches through a small step function; what a task holds is one
batch and one state, whatever the length of the series. A filter that runs both
ways is two such passes, the second in falling order over the same partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shortest and assumed time steps, in seconds (fixed values).
LEAST_DT, USUAL_DT = 1 / 240, 1 / 30


def carry(df: DataFrame, series: str, order: list[str], inputs: list[str], outputs: str, start: Callable[[], object], step: Callable, descending: bool = False, placed: bool = False) -> DataFrame:
    """Adds columns that ``step(state, *input values) -> (state, outputs)`` makes row by row within each series.

    ``outputs`` is their schema, ``start`` makes a series' first state. With
    ``placed`` the rows lie in their partitions already, as after another ``carry``.
    Otherwise a window deals and sorts them: rows that lie by series stay where they are,
    in as many tasks as they were dealt to.
    """
    named = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    at = {c: k for k, c in enumerate(df.columns)}
    key = f"c{at[series]}"
    kinds = [F.desc(f"c{at[o]}") if descending else F.asc(f"c{at[o]}") for o in order]
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([*named.schema.fields, *added.fields])
    last = len(named.columns)
    dealt = named if placed else named.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*kinds)))
    dealt = dealt.sortWithinPartitions(key, *kinds)
    places, key_place, names = [at[c] for c in inputs], at[series], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added.fields]
        state, current, fresh = None, None, True
        for batch in batches:
            keys = batch.column(key_place).to_pylist()
            made: list[tuple] = []
            for name, *values in zip(keys, *(batch.column(p).to_pylist() for p in places)):
                if fresh or name != current:
                    state, current, fresh = start(), name, False
                state, out = step(state, *values)
                made.append(out)
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *columns], names=names)

    return dealt.mapInArrow(run, schema).toDF(*df.columns, *added.names)


# ---- steps that batch and streaming share


def one_euro_step(state: tuple | None, x: float | None, t: float, min_cutoff: float, beta: float, derivative_cutoff: float) -> tuple[tuple | None, float]:
    """One sample of the One Euro filter (Casiez et al., 2012); the state is (value, derivative, time)."""
    if x is None or not math.isfinite(x):
        return state, state[0] if state else 0.0
    if state is None:
        return (x, 0.0, t), x
    value, slope, before = state
    dt = t - before
    dt = max(dt if dt > 0 else USUAL_DT, LEAST_DT)

    def weight(cutoff: float) -> float:
        return 1 / (1 + 1 / (2 * math.pi * cutoff) / dt)

    slope += weight(derivative_cutoff) * ((x - value) / dt - slope)
    value += weight(min_cutoff + beta * abs(slope)) * (x - value)
    return (value, slope, t), value


def limit_step(before: float | None, x: float, rate: float, dt: float) -> float:
    """``x``, at most ``rate`` per second away from the value before."""
    if before is None or not math.isfinite(before):
        return x
    most = rate * max(dt, LEAST_DT)
    return before + max(-most, min(most, x - before))


# ---- operators


def exponential_average(df: DataFrame, series: str, order: list[str], value: str, weight: float, name: str = "average") -> DataFrame:
    """``average += weight (value - average)``, from the first value on; null values leave it as it is."""

    def step(state, x):
        if x is not None:
            state = x if state is None else state + weight * (x - state)
        return state, (state,)

    return carry(df, series, order, [value], f"{name} double", lambda: None, step)


def one_euro(df: DataFrame, series: str, order: list[str], value: str, seconds: str, min_cutoff: float = 1.0, beta: float = 0.0, derivative_cutoff: float = 1.0, name: str = "smooth") -> DataFrame:
    """The One Euro filter of every series; values that are not finite repeat the last output (0 if there is none)."""

    def step(state, x, t):
        state, y = one_euro_step(state, x, t, min_cutoff, beta, derivative_cutoff)
        return state, (y,)

    return carry(df, series, order, [value, seconds], f"{name} double", lambda: None, step)


def limited_steps(df: DataFrame, series: str, order: list[str], value: str, seconds: str, rate: float, name: str = "limited") -> DataFrame:
    """Causal rate limit: no output is more than rate * dt from the one before. Null values give null and change nothing."""

    def step(state, x, t):
        if x is None:
            return state, (None,)
        y = x if state is None else limit_step(state[0], x, rate, t - state[1])
        return (y, t), (y,)

    return carry(df, series, order, [value, seconds], f"{name} double", lambda: None, step)


def limit_rate(df: DataFrame, series: str, order: list[str], value: str, most: float, name: str = "limited") -> DataFrame:
    """Symmetric rate limit: the mean of a clamped forward and a clamped backward pass, so that nothing lags."""

    def step(before, x):
        y = x if before is None or x is None else before + max(-most, min(most, x - before))
        return (before if y is None else y), (y,)

    forward = carry(df, series, order, [value], "_forward double", lambda: None, step)
    both = carry(forward, series, order, [value], "_backward double", lambda: None, step, descending=True, placed=True)
    return both.withColumn(name, (F.col("_forward") + F.col("_backward")) * 0.5).drop("_forward", "_backward")


def viterbi(df: DataFrame, series: str, order: list[str], costs: str, angles: list[float], sigma: float, name: str = "choice") -> DataFrame:
    """The cheapest path through candidate angles: each row's ``costs`` plus the squared wrapped step over sigma.

    Forwards, each row gets its back pointers; backwards, the path follows them.
    Ties go to the first candidate. A row without costs costs nothing.
    """
    grid = np.asarray(angles, float)
    difference = grid[None, :] - grid[:, None]
    move = (np.arctan2(np.sin(difference), np.cos(difference)) / sigma) ** 2

    def forward(total, cost):
        own = np.zeros(len(grid)) if cost is None else np.asarray(cost, float)
        if total is None:
            return own, ([0] * len(grid), own.tolist())
        through = total[:, None] + move
        back = through.argmin(axis=0)
        total = through[back, np.arange(len(grid))] + own
        return total, (back.tolist(), total.tolist())

    def backward(state, back, total):
        here = int(np.argmin(total)) if state is None else state
        return int(back[here]), (here,)

    out = carry(df, series, order, [costs], "_back array<int>, _total array<double>", lambda: None, forward)
    return carry(out, series, order, ["_back", "_total"], f"{name} int", lambda: None, backward, descending=True, placed=True).drop("_back", "_total")


def greedy_picks(df: DataFrame, series: str, score: str, order: str, apart: int, most: int) -> DataFrame:
    """Rows picked by falling score, each at least ``apart`` + 1 from all picked before it, ``most`` per series.

    Ties go to the smaller place. The state is the places picked, so at most ``most``.
    """

    def step(picked, k):
        if len(picked) >= most or any(abs(k - p) <= apart for p in picked):
            return picked, (None,)
        return [*picked, k], (len(picked) + 1,)

    scored = df.where(F.col(score).isNotNull()).withColumn("_s", -F.col(score))
    out = carry(scored, series, ["_s", order], [order], "pick int", list, step)
    return out.where("pick is not null").drop("_s")


def clear_lone_turns(df: DataFrame, series: str, order: list[str], rotation: str, valid: str, far: float, near: float, reach: int = 3, name: str = "kept") -> DataFrame:
    """Whether a valid rotation stays: not if it is ``far`` off the valid ones before and after, which agree within ``near`` (radians).

    Neighbours are looked for within ``reach`` rows. A row that is cleared is no
    neighbour of later ones, and so rows must be judged in order.
    """
    w = W.partitionBy(series).orderBy(*order)
    ahead = df.withColumn("_ahead", F.filter(F.array(*(F.when(F.lead(valid, k).over(w), F.lead(rotation, k).over(w)) for k in range(1, reach + 1))), lambda q: q.isNotNull()))

    def angle(a, b):
        return 2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(a, b)))))

    def step(behind, q, ok, after):
        before = next((p for p in behind if p is not None), None)
        lone = bool(ok) and before is not None and bool(after) and angle(q, before) > far and angle(q, after[0]) > far and angle(before, after[0]) < near
        keep = bool(ok) and not lone
        return [q if keep else None, *behind][:reach], (keep,)

    return carry(ahead, series, order, [rotation, valid, "_ahead"], f"{name} boolean", list, step).drop("_ahead")
