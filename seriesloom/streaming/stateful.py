"""Causal filters over streams (STM-01, STM-03 for numbers, STM-04 to STM-06, STM-15), with the steps of the batch operators.

State per series is a few numbers or a window of fixed size. Rows of one trigger
are taken in time order; a row that is older than the state's time (late), or has
none, is dropped and told in ``late``, as a causal filter cannot go back. Filters of
rotations, and such with typed state and timers: ``typed``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.quantiles import MAD_SCALE
from ..operators.folds import limit_step, one_euro_step


def causal(stream: DataFrame, series: str, seconds: str, value: str, step: Callable[[object, float | None, float], tuple[object, float | None]], name: str) -> DataFrame:
    """``series, seconds, value, name, late`` for every row of a stream; the state is what ``step`` returns, kept as JSON."""
    key_type = stream.schema[series].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"t": None, "s": None}
        rows = pd.concat(list(frames)).sort_values([seconds, value], kind="stable")
        out, late = [], []
        for t, x in zip(rows[seconds].tolist(), rows[value].tolist()):
            # a row without a time has no place in the order
            old = t is None or math.isnan(t) or held["t"] is not None and t < held["t"]
            late.append(old)
            if old:
                out.append(None)
                continue
            x = None if x is None or (isinstance(x, float) and math.isnan(x)) else x
            held["s"], y = step(held["s"], x, t)
            held["t"] = t
            out.append(y)
        state.update((json.dumps(held),))
        yield pd.DataFrame({series: key[0], seconds: rows[seconds].to_numpy(), value: rows[value].to_numpy(), name: pd.array(out, "Float64").astype(object), "late": late})

    schema = f"{series} {key_type}, {seconds} double, {value} double, {name} double, late boolean"
    return stream.select(series, seconds, value).groupBy(series).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def one_euro(stream: DataFrame, series: str, seconds: str, value: str, min_cutoff: float = 1.0, beta: float = 0.0, derivative_cutoff: float = 1.0) -> DataFrame:
    """The One Euro filter of every series; the same as the batch operator on the same rows."""

    def step(state, x, t):
        return one_euro_step(tuple(state) if state else None, x, t, min_cutoff, beta, derivative_cutoff)

    return causal(stream, series, seconds, value, step, "smooth")


def exponential_average(stream: DataFrame, series: str, seconds: str, value: str, weight: float) -> DataFrame:
    def step(state, x, t):
        if x is not None:
            state = x if state is None else state + weight * (x - state)
        return state, state

    return causal(stream, series, seconds, value, step, "average")


def limited_steps(stream: DataFrame, series: str, seconds: str, value: str, rate: float) -> DataFrame:
    def step(state, x, t):
        if x is None:
            return state, None
        y = x if state is None else limit_step(state[0], x, rate, t - state[1])
        return (y, t), y

    return causal(stream, series, seconds, value, step, "limited")


def median_gate(stream: DataFrame, series: str, seconds: str, value: str, size: int, sigmas: float, floor: float) -> DataFrame:
    """A value too far from the (upper) median of the ``size`` raw values before it becomes that median."""

    def step(near, x, t):
        near = near or []
        if x is None:
            return near, None
        ranked = sorted(near)
        y = x
        if len(ranked) >= 3:
            median = ranked[len(ranked) // 2]
            spread = sorted(abs(v - median) for v in ranked)[len(ranked) // 2] * MAD_SCALE
            if abs(x - median) > max(spread * sigmas, floor):
                y = median
        return [*near, x][-size:], y

    return causal(stream, series, seconds, value, step, "gated")


def rolling_quantile(stream: DataFrame, series: str, seconds: str, value: str, capacity: int, p: float, fallback: float = 0.0) -> DataFrame:
    """Interpolated quantile of the last ``capacity`` values."""

    def step(near, x, t):
        near = [*(near or []), x][-capacity:] if x is not None else (near or [])
        if not near:
            return near, fallback
        ranked = sorted(near)
        place = min(max(p, 0.0), 1.0) * (len(ranked) - 1)
        low = math.floor(place)
        high = min(low + 1, len(ranked) - 1)
        return near, ranked[low] + (ranked[high] - ranked[low]) * (place - low)

    return causal(stream, series, seconds, value, step, "rolling")


def availability(stream: DataFrame, series: str, seconds: str, value: str, tau: float) -> DataFrame:
    """A weight that goes to 1 while values come and to 0 while they are null: each step closes 1 - exp(-dt / tau) of the way."""

    def step(state, x, t):
        weight, before = state or (0.0, t)
        weight += (1 - math.exp(-max(t - before, 0.0) / tau)) * ((0.0 if x is None else 1.0) - weight)
        return (weight, t), weight

    return causal(stream, series, seconds, value, step, "weight")
