"""Linear filters as scans, so that one long series is many tasks (WIN-09, WIN-10, WIN-11).

A second-order filter's state after a block of rows is a fixed matrix times the
state before it, plus what the block adds from a standing start; both ways of a
zero-phase filter are linear in that state. So blocks are filtered on their own
in numpy, what they add is put together in order (two numbers a block and
direction), and a second pass filters each block from its right state. Rows are
never dealt by series alone: a block is a stretch of the order column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of odd reflection beyond each end of a filtered series (fixed value).
PAD = 18
#: Rows that one matrix product filters.
TILE = 64


def butterworth(cutoff: float, rate: float) -> tuple[list[float], list[float]]:
    """Second-order low-pass by the bilinear transform: (b0, b1, b2) and (a1, a2)."""
    k = math.tan(math.pi * min(max(cutoff, 1e-3), rate / 2 * 0.98) / rate)
    scale = 1 / (1 + math.sqrt(2) * k + k * k)
    b = k * k * scale
    return [b, 2 * b, b], [2 * (k * k - 1) * scale, (1 - math.sqrt(2) * k + k * k) * scale]


class Filter:
    """A second-order filter in transposed direct form, over columns of numbers; a state is two rows."""

    def __init__(self, b: tuple[float, ...], a: tuple[float, ...]) -> None:
        (b0, b1, b2), (a1, a2) = b, a
        self.b0 = b0
        self.turn = np.array([[-a1, 1.0], [-a2, 0.0]])
        self.feed = np.array([b1 - a1 * b0, b2 - a2 * b0])
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        self.rest = np.array([b1 - a1 * gain + b2 - a2 * gain, b2 - a2 * gain])
        powers = [np.eye(2)]
        for _ in range(TILE):
            powers.append(self.turn @ powers[-1])
        self.powers = powers
        # of a tile: outputs from its inputs, outputs from the state before, the state behind from its inputs
        impulse = [b0, *((powers[k] @ self.feed)[0] for k in range(TILE - 1))]
        self.inputs = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(TILE)] for i in range(TILE)])
        self.states = np.array([powers[i][0] for i in range(TILE)])
        self.behind = np.array([powers[TILE - 1 - j] @ self.feed for j in range(TILE)]).T
        self._crossed: dict[int, np.ndarray] = {}

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs for the rows of ``x`` (n, columns) from a state (2, columns), and the state behind them."""
        n, columns = x.shape
        whole = n // TILE
        out = np.empty_like(x)
        if whole:
            tiles = x[: whole * TILE].reshape(whole, TILE, columns)
            added = np.einsum("sj,tjc->tsc", self.behind, tiles)
            before = np.empty((whole, 2, columns))
            for t in range(whole):
                before[t] = state
                state = self.powers[TILE] @ state + added[t]
            out[: whole * TILE] = (np.einsum("ij,tjc->tic", self.inputs, tiles) + np.einsum("is,tsc->tic", self.states, before)).reshape(-1, columns)
        left = n - whole * TILE
        if left:
            last = x[whole * TILE :]
            out[whole * TILE :] = self.inputs[:left, :left] @ last + self.states[:left] @ state
            state = self.powers[left] @ state + self.behind[:, TILE - left :] @ last
        return out, state

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.turn, n)

    def crossed(self, n: int) -> np.ndarray:
        """How the state before n rows, filtered forwards, shows in the state that filtering their outputs backwards leaves."""
        if n not in self._crossed:
            if len(self._crossed) > 4096:
                self._crossed.clear()
            silent = np.zeros((n, 2))
            alone, _ = self.run(silent, np.eye(2))
            self._crossed[n] = self.run(alone[::-1], np.zeros((2, 2)))[1]
        return self._crossed[n]


@lru_cache(maxsize=8)
def _low_pass(cutoff: float, rate: float) -> Filter:
    b, a = butterworth(cutoff, rate)
    return Filter(tuple(b), tuple(a))


def _block_ends(flt: Filter, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a block adds from a standing start: the state behind it forwards, and behind its outputs backwards."""
    zero = np.zeros((2, x.shape[1]))
    out, forwards = flt.run(x, zero)
    return forwards, flt.run(out[::-1], zero)[1]


def _series_states(flt: Filter, sizes: list[int], forwards: list[np.ndarray], backwards: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each block's state before it, forwards and backwards.

    ``first`` and ``last`` are the series' outermost rows, reflected oddly at both ends:
    the filter runs over the reflection before the first row, and on over the one
    behind the last, from whose end it runs back.
    """
    pad = len(first) - 1
    low = 2 * first[0] - first[1 : pad + 1][::-1]
    high = 2 * last[-1] - last[len(last) - 1 - pad : len(last) - 1][::-1]
    state = flt.run(low, np.outer(flt.rest, low[0]))[1]
    before = []
    for n, added in zip(sizes, forwards):
        before.append(state)
        state = flt.power(n) @ state + added
    beyond = flt.run(high, state)[0]
    back = flt.run(beyond[::-1], np.outer(flt.rest, beyond[-1]))[1]
    behind = []
    for n, own, added in zip(reversed(sizes), reversed(before), reversed(backwards)):
        behind.append(back)
        back = flt.power(n) @ back + added + flt.crossed(n) @ own
    return list(zip(before, reversed(behind)))


#: Blocks hold about so many steps of the order column.
BLOCK = 1 << 16


def zero_phase(df: DataFrame, series: str, order: str, value: str, cutoff: float, rate: float, name: str = "smooth", block: float = BLOCK) -> DataFrame:
    """Low-pass without lag: a Butterworth pass forwards, another backwards, over a series reflected at both ends.

    ``value`` is a number or an array of numbers, whose parts are filtered side by side.
    ``order`` is a number, unique in a series; a block holds the rows of ``block`` steps of
    it, so that a long series is many tasks, and no more than a block lies in memory.
    Two shuffles by block, whatever the series' length; what is put together per
    series is a few numbers a block.

    Rows whose value is null (or has a part that is null, NaN or infinite) get null, and the
    filter goes on behind them as if they weren't there. Series of fewer than three
    values stay as they are. A null series or order is a series and place of its own.
    An empty table gives no rows.
    """
    is_array = isinstance(df.schema[value].dataType, T.ArrayType)
    parts = F.col(value).cast("array<double>") if is_array else F.array(F.col(value).cast("double"))
    good = F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # columns by place, so that no name of the table's can clash
    at = {c: f"c{k}" for k, c in enumerate(df.columns)}
    rows = df.select(
        *(F.col(c).alias(at[c]) for c in df.columns),
        F.col(series).alias("_s"),
        F.floor(F.coalesce(F.col(order).cast("double"), F.lit(0.0)) / F.lit(float(block))).cast("long").alias("_b"),
        F.col(order).cast("double").alias("_o"),
        F.when(good, parts).alias("_x"),
    )
    key = rows.schema["_s"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        """The batches cut and gathered by block (the values of ``columns``)."""
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
            start = 0
            while start < len(keys):
                stop = start
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if held and keys[start] != current:
                    yield current, held
                    held = []
                current = keys[start]
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield current, held

    def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows that have one, and which rows do; rows of other widths than the first have none."""
        ok = column.is_valid().to_numpy()
        own = column.drop_null()
        width = np.diff(np.append(0, np.cumsum(pc.list_value_length(own).to_numpy())))
        if len(width) and not (width == width[0]).all():
            raise ValueError("values of different widths in one block")
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in own.chunks]) if len(own) else np.zeros(0)
        return flat.reshape(len(own), width[0] if len(width) else 1), ok

    ends_schema = f"s {key}, b long, n long, width int, forwards array<double>, backwards array<double>, first array<double>, last array<double>"
    doubles = pa.list_(pa.float64())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flt = _low_pass(cutoff, rate)
        for (name_, number), held in pieces(batches, (0, 1)):
            x, _ = matrix(pa.chunked_array([h.column(2) for h in held]))
            if len(x):
                forwards, backwards = _block_ends(flt, x)
                yield pa.RecordBatch.from_arrays(
                    [held[0].column(0).slice(0, 1), pa.array([number], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([x.shape[1]], pa.int32())]
                    + [pa.array([v.ravel().tolist()], doubles) for v in (forwards, backwards, x[: PAD + 1], x[-PAD - 1 :])],
                    names=["s", "b", "n", "width", "forwards", "backwards", "first", "last"],
                )

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flt = _low_pass(cutoff, rate)
        for _, held in pieces(batches, (0,)):
            # a few numbers a block: the blocks of one series
            table = pa.Table.from_batches(held).to_pydict()
            width = table["width"][0]
            shaped = {c: [np.array(v).reshape(-1, width) for v in table[c]] for c in ("forwards", "backwards", "first", "last")}
            total = sum(table["n"])
            if total < 3:
                continue
            pad = min(PAD, total - 1)
            first, last = np.concatenate(shaped["first"][: PAD + 1])[: pad + 1], np.concatenate(shaped["last"][-PAD - 1 :])[-pad - 1 :]
            made = _series_states(flt, table["n"], shaped["forwards"], shaped["backwards"], first, last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table["s"], held[0].column(0).type), pa.array(table["b"], pa.int64()), pa.array([m[0].ravel().tolist() for m in made], doubles), pa.array([m[1].ravel().tolist() for m in made], doubles)],
                names=["s", "b", "before", "behind"],
            )

    blocks = rows.select("_s", "_b", "_x", "_o").repartition("_s", "_b").sortWithinPartitions("_s", "_b", "_o").mapInArrow(ends, ends_schema)
    put = blocks.repartition("s").sortWithinPartitions("s", "b").mapInArrow(states, f"s {key}, b long, before array<double>, behind array<double>")
    joined = rows.join(put, F.col("_s").eqNullSafe(F.col("s")) & (F.col("_b") == F.col("b")), "left").drop("s", "b")
    schema = T.StructType([*joined.select([c for c in joined.columns if c not in ("before", "behind")]).schema.fields, T.StructField("_y", T.ArrayType(T.DoubleType()))])
    at_s, at_b, at_x, at_before = (joined.columns.index(c) for c in ("_s", "_b", "_x", "before"))

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flt = _low_pass(cutoff, rate)
        for _, held in pieces(batches, (at_s, at_b)):
            column = pa.chunked_array([h.column(at_x) for h in held])
            x, ok = matrix(column)
            before, behind = (held[0].column(at_before + k)[0].as_py() for k in (0, 1))
            if before is not None and len(x):
                out = flt.run(x, np.array(before).reshape(2, -1))[0]
                x = flt.run(out[::-1], np.array(behind).reshape(2, -1))[0][::-1]
            offsets = np.concatenate([[0], np.cumsum(np.where(ok, x.shape[1], 0))]).astype(np.int32)
            y = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()), mask=pa.array(~ok))
            start = 0
            for h in held:
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(h.columns) if k not in (at_before, at_before + 1)), y.slice(start, h.num_rows)], names=schema.names)
                start += h.num_rows

    out = joined.repartition("_s", "_b").sortWithinPartitions("_s", "_b", "_o").mapInArrow(smooth, schema)
    told = F.col("_y") if is_array else F.get("_y", F.lit(0))
    return out.select(*(F.col(at[c]).alias(c) for c in df.columns), told.alias(name))
