"""Sentencepiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices
from .token_counts import marks_are_walls, piece_model

#: Distinct chunks held at most before the table starts anew; bounds memory only.
TABLE_CHUNKS = 600_000
#: Longer chunks are segmented each time and not held.
TABLE_CHUNK_CHARS = 64

SCHEMA = "doc_id long, ids array<int>, decoded string"

#: A run of spaces or marks with what follows it, up to the next run.
_CHUNK = re.compile("[ ▁]+[^ ▁]*")


class ChunkTable:
    """Ids and decoded text of each distinct chunk, segmented once.

    A chunk is a run of white space marks with the characters up to the next
    run. No piece of the model holds a mark after another character (checked
    when the table is made), so no token reaches over a chunk's edge and a text's
    ids are its chunks' ids in order. The library sets a mark before every text
    that isn't empty; a chunk is therefore keyed and encoded without its first
    mark, which the library puts back.
    """

    def __init__(self, model_file: str) -> None:
        self.model = piece_model(model_file)
        if not marks_are_walls(model_file):
            raise ValueError(f"pieces of {model_file} cross white space marks; chunks cannot be segmented alone")
        self.mark = self.model.piece_to_id("▁")
        self.end = self.model.eos_id()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0
        self.decoded: list[str] = []

    def _learn(self, fresh: list[str]) -> None:
        ids = [x or [self.mark] for x in self.model.encode(fresh, num_threads=1)]
        # decoding drops the first mark of a text, so each chunk is decoded behind a mark of its own
        self.decoded += self.model.decode([[self.mark, *x] for x in ids])
        counts = np.array([len(x) for x in ids], np.int64)
        new = np.concatenate([np.array(x, np.int32) for x in ids])
        first, last = len(self.number), len(self.number) + len(fresh)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.flat[self.used : self.used + len(new)] = new
        self.begin[first:last] = self.used + np.cumsum(counts) - counts
        self.count[first:last] = counts
        self.used += len(new)
        self.number.update(zip(fresh, range(first, last)))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's chunks without their first marks."""
        if "▁" in text or "  " in text or text[:1] == " ":
            return [c[1:] for c in _CHUNK.findall(" " + text)]
        return text.split(" ") if text else []

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, each text's end among them, and the decoded texts."""
        if len(self.number) > TABLE_CHUNKS:
            self._clear()
        parts = [self.chunks(t) for t in texts]
        chunks = [c for p in parts for c in p]
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.number]
        if fresh:
            self._learn(fresh)
        numbers = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        for c in fresh:
            if len(c) > TABLE_CHUNK_CHARS:
                self.number[("gone", self.number.pop(c))] = -1
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.begin[numbers] - (ends - counts), counts)]
        sizes = np.cumsum([0, *map(len, parts)])
        text_ends = np.concatenate([[0], ends])[sizes[1:]] if texts else np.zeros(0, np.int64)
        of = self.decoded
        listed = numbers.tolist()
        decoded = ["".join([of[k] for k in listed[a:b]])[1:] for a, b in zip(sizes[:-1], sizes[1:])]
        return ids, text_ends, decoded


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's ids with the end id behind them, and the text that decoding them gives.

    The same as the library's ``encode`` (no sampling, no begin id) and ``decode``,
    but each distinct chunk of a worker is segmented and decoded once. Rows are
    independent; nothing is shuffled.

    Null and empty texts give the end id alone and an empty decoded text. A null
    key stays null, repeated rows give repeated rows, an empty table gives none,
    and further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file)
        for part, raw in text_slices(batches):
            ids, ends, decoded = table.codes([t.decode("utf-8", "replace") for t in raw])
            with_end = np.insert(ids, ends, table.end)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(with_end)), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
