"""Packing of tokenised documents into fixed windows by an order-preserving dynamic program."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices
from .word_table import WordTable

#: Tokens of one packing unit; windows never span two units, so a task holds one unit at a time.
UNIT_TOKENS = 1 << 20
#: What a cut costs, in tokens of padding: none between documents, little after a sentence, more elsewhere.
SENTENCE_CUT, FORCED_CUT = 12.0, 40.0
#: What a window costs besides its padding, so that short windows of a free length stay few.
WINDOW_COST = 24.0

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _jumps(places: np.ndarray, free: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """For every place the places that lie a free length before it: where its own begin in the list, and the list."""
    to, by = [], []
    for size in free:
        k = np.searchsorted(places, places - size)
        met = np.flatnonzero(places[k] == places - size)
        to.append(met)
        by.append(k[met])
    at = np.concatenate(to) if to else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(places) + 1))
    return starts.tolist(), (np.concatenate(by)[order] if by else at).tolist()


def choose_cuts(places: list[int], penalties: list[float], window: int, free: tuple[int, ...] = ()) -> list[int]:
    """Cut positions from ``places`` (ascending, first 0, gaps at most ``window``) of least total cost.

    A window from i to j costs its padding ``window - (j - i)`` (none at a length in
    ``free``), ``WINDOW_COST`` and the penalty of cutting at j. As the padding is
    linear, ``f(j) = penalty(j) + window - j + min(f(i) + i)`` over the places
    within reach, whose minimum a monotone queue keeps in constant time. Places at
    a free length apart are found for all places together beforehand.
    """
    n = len(places)
    best = [0.0] * n
    back = [0] * n
    starts, jumps = _jumps(np.asarray(places, np.int64), free)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    jump = 0
    for j in range(1, n):
        here = places[j]
        reach = here - window
        while places[queue[0][1]] < reach:
            queue.popleft()
        key, i = queue[0]
        cost = key + window - here
        stop = starts[j + 1]
        while jump < stop:
            k = jumps[jump]
            if best[k] < cost:
                cost, i = best[k], k
            jump += 1
        cost += penalties[j] + WINDOW_COST
        best[j], back[j] = cost, i
        key = cost + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def _places(lengths: np.ndarray, sentence_ends: list[np.ndarray], window: int, step: int) -> tuple[list[int], list[float]]:
    """Places to cut a unit: document ends, sentence ends, and every ``step`` tokens of longer sentences."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    cost = np.zeros(total + 1, np.float32)
    for s, e, n in zip(sentence_ends, ends, lengths):
        cost[s + (e - n)] = SENTENCE_CUT
    cost[ends] = -1.0
    cost[0] = -1.0
    known = np.flatnonzero(cost)
    long_gaps = np.flatnonzero(np.diff(known) > step)
    extra = [np.arange(known[g] + step, known[g + 1], step) for g in long_gaps]
    tail = np.array([total - (1 << k) for k in range(int(window).bit_length()) if total > (1 << k)], np.int64)
    for forced in (tail, *extra):
        cost[forced[cost[forced] == 0]] = FORCED_CUT
    grid = np.flatnonzero(cost)
    penalty = np.maximum(cost[grid], 0.0)
    return grid.tolist(), penalty.tolist()


def pack_unit(lengths: list[int], sentence_ends: list[np.ndarray], window: int, step: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) of one unit of documents of these lengths, in order."""
    free = tuple(1 << k for k in range(int(window).bit_length()) if 1 << k < window)
    places, penalties = _places(np.array(lengths, np.int64), sentence_ends, window, step)
    cuts = choose_cuts(places, penalties, window, free)
    pieces, w, window_start = [], 0, 0
    position = 0
    for k, n in enumerate(lengths):
        start = 0
        while start < n:
            while cuts[w] <= position:
                window_start = cuts[w]
                w += 1
            take = min(n - start, cuts[w] - position)
            pieces.append((k, start, take, w, position - window_start))
            start += take
            position += take
    return pieces


@dataclass
class _Part:
    """Consecutive ids of one document that lie in one unit; ``start`` of ``total`` ids lie before them."""

    key: int | None
    ids: np.ndarray
    ends: np.ndarray
    start: int
    total: int


def _parts(key: int | None, ids: np.ndarray, ends: np.ndarray, unit: int) -> Iterator[_Part]:
    """A document's parts: itself or, if it has more ids than a unit, stretches of about a unit cut at sentence ends."""
    start, n = 0, len(ids)
    while n - start > unit:
        within = ends[(ends > start + unit // 2) & (ends <= start + unit)]
        cut = int(within[-1]) if len(within) else start + unit
        yield _Part(key, ids[start:cut], ends[(ends > start) & (ends <= cut)] - start, start, n)
        start = cut
    yield _Part(key, ids[start:], ends[ends > start] - start, start, n)


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = 2048, end_id: int = 1, unit_tokens: int = UNIT_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack every document's token ids, in the table's order, into windows of at most ``window`` tokens.

    One row per piece: the document's key, ``start`` (ids of the document before
    the piece), ``length``, ``doc_tokens`` (with the end id), ``sequence_id``,
    ``offset`` in that sequence, and ``ids`` (little-endian unsigned 32-bit).
    Each id lies in exactly one piece and sequences have no gaps. Tasks pack
    their own scan split in units of ``unit_tokens`` without a shuffle; sequence
    ids join the partition's number with a running count, and so a task that is
    run again gives the same rows.

    Null and empty texts are documents of the end id alone. A document of more ids
    than a unit is packed in stretches of about a unit. A null key stays null,
    repeated rows are packed once per row, an empty table gives no rows, and
    further columns of the input are ignored.
    """
    step = max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(tokenizer_file)
        base = TaskContext.get().partitionId() << 36
        parts: list[_Part] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            pieces = pack_unit([len(p.ids) for p in parts], [p.ends for p in parts], window, step)
            for a in range(0, len(pieces), 4096):
                told = pieces[a : a + 4096]
                own = [parts[p[0]] for p in told]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d.key for d in own], pa.int64()),
                        pa.array([d.start + p[1] for d, p in zip(own, told)], pa.int64()),
                        pa.array([p[2] for p in told], pa.int64()),
                        pa.array([d.total for d in own], pa.int64()),
                        pa.array([base + p[3] for p in told], pa.int64()),
                        pa.array([p[4] for p in told], pa.int64()),
                        pa.array([d.ids[p[1] : p[1] + p[2]].astype("<u4", copy=False).tobytes() for d, p in zip(own, told)], pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            base += pieces[-1][3] + 1
            parts.clear()
            held = 0

        for batch, texts in text_slices(batches):
            keys = batch.column(0).to_pylist()
            for key, (ids, ends) in zip(keys, table.encode([t.decode("utf-8", "replace") for t in texts])):
                for part in _parts(key, np.append(ids, np.uint32(end_id)), ends, unit_tokens):
                    parts.append(part)
                    held += len(part.ids)
                    if held >= unit_tokens:
                        yield from flush()
        if parts:
            yield from flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
