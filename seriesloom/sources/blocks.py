"""One word out of a motion library's binary block, by the bytes that hold it (SRC-07).

The block holds little-endian 16-bit quaternions laid out as variant, frame, bone; an
index tells where each word's frames lie. As a Spark data source, filters on variant and
word are pushed into the reader, which then plans byte ranges of these words alone:

    spark.dataSource.register(MotionBlocks)
    spark.read.format("motion_blocks").option("index", ...).option("data", ...).load().where("word = 'tree'")
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Without this setting of the session, filters stay above the reader, which then reads all words.
PUSHDOWN = ("spark.sql.python.filterPushdown.enabled", "true")
SCHEMA = "variant string, word string, frame int, bone string, q array<double>"
#: Words that lie side by side are read together up to this many bytes.
RANGE_BYTES = 8 << 20
#: Frames that are handed on in one batch.
BATCH_FRAMES = 512


def _open(path: str):
    """A file of any file system that Arrow knows by its address; a plain path is a local one."""
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


@dataclass
class Words(InputPartition):
    """Words of one variant, one after the other from byte ``start``: (word, frames)."""

    variant: str
    start: int
    words: list[tuple[str, int]]


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        with _open(options["index"]) as f:
            index = json.loads(f.readall())
        self.data = options["data"]
        self.bones, self.variants, self.total = index["bones"], index["variants"], index["totalFrames"]
        self.words = sorted(((w["frameOffset"], w["frameCount"], w["word"]) for w in index["words"]), key=lambda w: w[:2])
        self.asked: dict[str, set[str] | None] = {"variant": None, "word": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if column in self.asked:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                before = self.asked[column]
                self.asked[column] = values if before is None else before & values
            else:
                yield f

    def partitions(self) -> list[Words]:
        width = 8 * len(self.bones)
        out: list[Words] = []
        for number, variant in enumerate(self.variants):
            if self.asked["variant"] is not None and variant not in self.asked["variant"]:
                continue
            end = None
            for offset, frames, word in self.words:
                if self.asked["word"] is not None and word not in self.asked["word"]:
                    continue
                start = (number * self.total + offset) * width
                if out and start == end and out[-1].variant == variant and start + frames * width - out[-1].start <= RANGE_BYTES:
                    out[-1].words.append((word, frames))
                else:
                    out.append(Words(variant, start, [(word, frames)]))
                end = start + frames * width
        # Spark wants a partition at least; this one holds no words
        return out or [Words("", 0, [])]

    def read(self, partition: Words) -> Iterator[pa.RecordBatch]:
        width = 8 * len(self.bones)
        at = partition.start
        if not partition.words:
            return
        with _open(self.data) as f:
            for word, frames in partition.words:
                for first in range(0, frames, BATCH_FRAMES):
                    many = min(BATCH_FRAMES, frames - first)
                    raw = f.read_at(many * width, at)
                    at += len(raw)
                    if len(raw) < many * width:
                        raise ValueError(f"the block ends within the word {word!r}")
                    q = np.frombuffer(raw, "<i2").astype(float).reshape(-1, 4)
                    size = np.sqrt((q * q).sum(axis=1, keepdims=True))
                    q = q / np.where(size > 0, size, 1.0)
                    rows = len(q)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([partition.variant] * rows), pa.array([word] * rows), pa.array(np.repeat(np.arange(first, first + many, dtype=np.int32), len(self.bones))),
                            pa.array(self.bones * many), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 4), pa.array(q.ravel())),
                        ],
                        names=["variant", "word", "frame", "bone", "q"],
                    )


class MotionBlocks(DataSource):
    """Frames of the words in a block (options ``index`` and ``data``), as unit quaternions; a quaternion of zeros stays zeros.

    A word that the index doesn't list gives no rows; an index that reaches beyond the block ends the job.
    """

    @classmethod
    def name(cls) -> str:
        return "motion_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)
