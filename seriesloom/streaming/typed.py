"""Filters of rotations, identities and easing over streams, with typed state (WIN-32, STM-02, STM-03, STM-11).

State per series is one typed row that the state store keeps and a restart finds
again; a step is the batch operator's own. The session needs a state store that
holds such state (``STATE_STORE``). Rows of one trigger are taken in time order; a
row that is older than the state's time, or has none, is told in ``late`` and
changes nothing, as a causal filter cannot go back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import identities, rotations

#: The setting under which the store of typed state is chosen, and the store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(value):
    """A value of a pandas row as Python has it: lists for arrays, None for missing ones."""
    if isinstance(value, (np.ndarray, list, tuple)):
        return [_plain(v) for v in value]
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return value.item() if isinstance(value, np.generic) else value


class _Fold(StatefulProcessor):
    """One typed state of a series: the last time and what the step keeps."""

    def __init__(self, key: str, seconds: str, inputs: list[str], outputs: list[str], state: str, step: Callable) -> None:
        self.key, self.seconds, self.inputs, self.outputs, self.state, self.step = key, seconds, inputs, outputs, state, step

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", f"at double, {self.state}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).set_axis([self.key, self.seconds, *self.inputs], axis=1)
        frame = frame.sort_values(self.seconds, kind="stable", na_position="last")
        held = self.held.get()
        at, state = (held[0], tuple(_plain(v) for v in held[1:])) if held is not None else (None, None)
        told, late = [], []
        for t, *values in zip(frame[self.seconds], *(frame[c] for c in self.inputs)):
            t = _plain(t)
            late.append(t is None or at is not None and t < at)
            if late[-1]:
                told.append((None,) * len(self.outputs))
                continue
            state, out = self.step(state, *(_plain(v) for v in values), t)
            told.append(out)
            at = t
        if at is not None and state is not None:
            self.held.update((at, *state))
        columns = {self.key: [key[0]] * len(frame), self.seconds: frame[self.seconds].to_numpy()}
        columns |= {c: frame[c].to_numpy() for c in self.inputs}
        columns |= {c: pd.Series([r[k] for r in told], dtype=object) for k, c in enumerate(self.outputs)}
        yield pd.DataFrame(columns | {"late": late})

    def close(self) -> None:
        pass


def folded(stream: DataFrame, series: str, seconds: str, inputs: list[str], outputs: str, state: str, step: Callable) -> DataFrame:
    """``series, seconds``, the inputs, the outputs and ``late`` for every row of a stream.

    ``step(state, *input values, seconds) -> (state, outputs)``; the state is None or a
    tuple of the columns that ``state`` names. A series before its first value that
    makes a state has none.
    """
    types = {f.name: f.dataType for f in stream.schema.fields}
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([T.StructField(c, types[c]) for c in (series, seconds, *inputs)] + added.fields + [T.StructField("late", T.BooleanType())])
    processor = _Fold(series, seconds, inputs, added.names, state, step)
    return stream.select(series, seconds, *inputs).groupBy(series).transformWithStateInPandas(processor, schema, "Append", "None")


def one_euro(stream: DataFrame, series: str, seconds: str, rotation: str, min_cutoff: float = 1.0, beta: float = 0.0, derivative_cutoff: float = 1.0) -> DataFrame:
    """The One Euro filter of unit quaternions in ``smooth``; the same as ``rotations.one_euro`` on the same rows."""

    def step(state, q, t):
        return rotations.one_euro_step(state, q, t, min_cutoff, beta, derivative_cutoff)

    return folded(stream, series, seconds, [rotation], "smooth array<double>", "value array<double>, speed double, time double", step)


def limited_steps(stream: DataFrame, series: str, seconds: str, rotation: str, rate: float) -> DataFrame:
    """At most ``rate`` radians a second, in ``limited``; the same as ``rotations.limited_steps`` on the same rows."""

    def step(state, q, t):
        return rotations.limit_step(state, q, t, rate)

    return folded(stream, series, seconds, [rotation], "limited array<double>", "value array<double>, time double", step)


def identities_of(stream: DataFrame, series: str, seconds: str, left: str, right: str, left_anchor: str, right_anchor: str, aspect: float = 1.0) -> DataFrame:
    """Marks and sides of every frame; the same as ``identities.resolve`` on the same rows."""

    def step(state, *values):
        return identities.identity_step(state, *values[:-1], aspect=aspect)

    return folded(stream, series, seconds, [left, right, left_anchor, right_anchor], identities.OUTPUTS, "left array<double>, right array<double>", step)


class _Ease(StatefulProcessor):
    """Targets that wait for their tick, and where the series is; timers on event time tell the ticks between and after targets."""

    def __init__(self, key: str, millis: str, rotation: str, ease: rotations.Easing) -> None:
        self.key, self.millis, self.rotation, self.ease = key, millis, rotation, ease

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, target array<double>")
        # the last tick told, the rotation there, its target and when that came; at rest there is no next tick
        self.held = handle.getValueState("held", "tick long, current array<double>, target array<double>, since long, awake boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # columns come by place: their names may be lost behind a watermark
        frame = pd.concat(list(rows)).set_axis([self.key, "_time", self.millis, self.rotation], axis=1)
        held = self.held.get()
        told_to = held[0] if held is not None else None
        first = None
        for at, q in zip(frame[self.millis], frame[self.rotation]):
            at, q = _plain(at), _plain(q)
            # a target from before a told tick can change nothing any more
            if at is not None and q is not None and None not in q and (told_to is None or at > told_to):
                self.waiting.appendValue((int(at), q))
                first = int(at) if first is None else min(first, int(at))
        if first is not None and not (held is not None and held[4]):
            self.handle.registerTimer(self.ease.tick_at(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((int(a), [float(x) for x in q]) for a, q in self.waiting.get()) if self.waiting.exists() else []
        held = self.held.get()
        state = (int(held[0]), _plain(held[1]), _plain(held[2]), int(held[3]), bool(held[4])) if held is not None else None
        rows, state, waiting, following = self.ease.ticks_until(state, waiting, until)
        self.waiting.clear()
        if waiting:
            self.waiting.put(waiting)
        if state is not None:
            self.held.update(state)
        if following is not None:
            self.handle.registerTimer(following)
        if rows:
            yield pd.DataFrame({self.key: [key[0]] * len(rows), "tick": [r[0] for r in rows], "eased": [r[1] for r in rows], "stale": [r[2] for r in rows]})

    def close(self) -> None:
        pass


def eased(stream: DataFrame, series: str, time: str, rotation: str, ease: rotations.Easing, delay: str = "0 seconds") -> DataFrame:
    """Rows ``series, tick`` (milliseconds), ``eased, stale`` at every tick from a target on until the series has come to rest.

    ``time`` is a timestamp. Rows without input come from timers on event time: a tick is
    told once the watermark (``delay`` behind the greatest time) has passed it. A target
    counts from the first tick that isn't before it; ``ease`` says how rotations follow,
    when targets are stale and where rest is. Null targets and such that come after
    their tick was told change nothing.
    """
    timed = stream.select(F.col(series), F.col(time).alias("_time"), F.unix_millis(time).alias("_at"), F.col(rotation).alias("_q")).withWatermark("_time", delay)
    key_type = stream.schema[series].dataType.simpleString()
    processor = _Ease(series, "_at", "_q", ease)
    schema = f"{series} {key_type}, tick long, eased array<double>, stale boolean"
    return timed.groupBy(series).transformWithStateInPandas(processor, schema, "Append", "EventTime")
