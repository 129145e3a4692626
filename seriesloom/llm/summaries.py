"""Fixed-size summaries of a column of 64-bit hashes, made by tasks and merged in chunks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a summary that are sent and merged together.
CHUNK_CELLS = 1 << 14
CHUNK_SCHEMA = "chunk int, cells binary"


def chunk_rows(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A summary's chunks that hold anything, packed."""
    for k in range(0, len(cells), CHUNK_CELLS):
        part = cells[k : k + CHUNK_CELLS]
        if part.any():
            yield k // CHUNK_CELLS, zlib.compress(part.tobytes(), 1)


def merged(chunks: DataFrame, size: int, dtype: str, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray] | None = None, out_dtype: str | None = None) -> np.ndarray:
    """Merge the tasks' chunks (of ``dtype``) and bring the one summary of ``size`` cells to the driver.

    Each merging task streams over its chunks and holds one array per chunk number.
    ``finish`` turns a merged chunk into what is sent, of ``out_dtype``.
    """
    sent = out_dtype or dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(raw), dtype)
                held[k] = combine(held[k], part) if k in held else part
        if held:
            done = [(finish(v) if finish else v).astype(sent, copy=False) for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in done], pa.binary())], names=["chunk", "cells"])

    out = np.zeros(size, sent)
    for k, raw in chunks.repartition("chunk").mapInArrow(run, CHUNK_SCHEMA).collect():
        part = np.frombuffer(zlib.decompress(raw), sent)
        out[k * CHUNK_CELLS : k * CHUNK_CELLS + len(part)] = part
    return out


class Sieve:
    """A Bloom filter of at most ``MOST_BYTES``: it lets everything pass that was put in, and most else not.

    It only spares a shuffle; an exact join follows wherever it is used, so
    results are the same when more is put in than it can tell apart.
    """

    MOST_BYTES = 1 << 25

    def __init__(self, count: int) -> None:
        wanted = max(1 << 14, 2 * count)
        self.size = min(self.MOST_BYTES, 1 << (wanted - 1).bit_length())
        self.bits: np.ndarray = np.zeros(self.size, np.uint8)

    def _places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.size * 8 - 1)
        return values & mask, (values >> np.uint64(32)) & mask

    def put(self, values: np.ndarray) -> None:
        for place in self._places(values):
            np.bitwise_or.at(self.bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def passes(self, values: np.ndarray) -> np.ndarray:
        one, two = ((self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 for place in self._places(values))
        return (one & two).astype(bool)


def sieve_of(values: DataFrame) -> Sieve:
    """A sieve of the values of a frame's only column (long)."""
    out = Sieve(values.count())
    size = out.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sieve(0)
        own.size, own.bits = size, np.zeros(size, np.uint8)
        for batch in batches:
            own.put(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        rows = list(chunk_rows(own.bits))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "cells"])

    out.bits = merged(values.mapInArrow(run, CHUNK_SCHEMA), size, "uint8", np.bitwise_or)
    return out
