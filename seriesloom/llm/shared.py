"""Small helpers that several text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these (ASCII white space).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Text is handled in slices of about this many bytes, so memory follows the slice, not the batch.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where none is, and only in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="seriesloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, label: str, planning: dict[str, str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: what follows survives lost executors without recomputing.

    ``planning`` are settings of the session for this one job, put back afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in planning or {}}
    try:
        for k, v in (planning or {}).items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    settled = spark.read.schema(df.schema).parquet(path)
    _places[settled] = path
    return settled


#: Where each settled frame lies.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*settled: DataFrame) -> None:
    """Delete the files of settled frames of which everything that was made is written elsewhere."""
    for df in settled:
        place = _places.pop(df, None)
        if place:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it holds more than one in so many of all rows, so there are never more hot keys than this.
HOT_SHARE = 1_000
#: Keys of fewer rows are never hot.
HOT_LEAST = 256


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> dict[int, int]:
    """The hot keys of a column (long, nulls aside), at most ``HOT_SHARE`` of them, and into how many parts each is to be cut.

    A part holds about as many rows as a key may have without being hot. ``total`` is the number of rows, where it is known.
    """
    if total is not None and total <= HOT_LEAST:
        return {}
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > HOT_LEAST)
    many = counts.orderBy(F.desc("count"), key).limit(HOT_SHARE).collect()
    if not many:
        return {}
    most = max((rows.count() if total is None else total) // HOT_SHARE, HOT_LEAST)
    return {r[0]: -(-r[1] // most) for r in many if r[1] > most}


def parts_of(spark: SparkSession, hot: dict[int, int], key: str) -> DataFrame:
    """The hot keys and their ``parts`` as a frame for a broadcast; its size is bounded by ``HOT_SHARE``."""
    return F.broadcast(spark.createDataFrame(list(hot.items()), f"{key} long, parts long"))


def spread_join(rows: DataFrame, values: DataFrame, key: str, total: int | None = None, nulls: bool = False) -> DataFrame:
    """``rows`` left-joined with ``values``, which has a row per key at most, so that no hot key meets in one task.

    Rows of hot keys (see ``hot_keys``) and without a key meet the hot keys' values
    by a broadcast of at most ``HOT_SHARE`` rows, the others by a shuffle. ``nulls``
    tells that there may be rows without a key.
    """
    hot = list(hot_keys(rows, key, total))
    if not hot:
        known = rows.where(F.col(key).isNotNull()).join(values, key, "left")
        return known.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if nulls else known
    apart = F.col(key).isNull() | F.col(key).isin(hot)
    few = values.where(F.col(key).isin(hot))
    return rows.where(~apart).join(values, key, "left").unionByName(rows.where(apart).join(F.broadcast(few), key, "left"))


def map_batches(df: DataFrame, columns: list, schema, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over only the named input columns."""
    return df.select(*columns).mapInArrow(function, schema)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame with its columns called c0, c1, ..., so that no name can clash, and their types as a schema string."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields))


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to about ``limit``; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


#: How many times smaller than its text a packed one is taken to be.
PACKED_SHARE = 4


def give_back() -> None:
    """Return freed memory to the system, as workers are used again and what each holds for later would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # only where the C library has it
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], text: int = -1, packed: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row slices of bounded text volume with their texts as UTF-8; a null text counts as empty. ``packed`` texts are unpacked by zlib."""
    give_back()
    for batch in batches:
        column = batch.column(text if text >= 0 else batch.num_columns - 1)
        raw = column.cast(pa.large_binary())
        sizes = [0 if n is None else n for n in pc.binary_length(raw).to_pylist()]
        for a, b in slices(sizes, SLICE_BYTES // PACKED_SHARE if packed else SLICE_BYTES):
            part = batch.slice(a, b - a)
            texts = [x or b"" for x in raw.slice(a, b - a).to_pylist()]
            yield part, [zlib.decompress(x) if x else x for x in texts] if packed else texts
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit values (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Words:
    """Words of a slice of texts as arrays: ``doc``, ``start``, ``end`` (bytes in ``data``) and 64-bit ``hash``.

    A-Z count as a-z. Words end at ASCII white space only, and never reach over
    a text's end. Two different words share a hash with probability about 2**-64.
    """

    def __init__(self, texts: list[bytes], lower: bool = True) -> None:
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.data = _LOWER[joined] if lower else joined
        space = _IS_SPACE[joined]
        edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        self.start, self.end = edges[::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.bounds = np.searchsorted(self.start, np.concatenate([[0], ends])) if texts else np.zeros(1, np.int64)
        if len(joined):
            up, down = _power_tables(len(joined) + 1)
            total = np.zeros(len(joined) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * up[: len(joined)], out=total[1:])
            self.hash = mix64((total[self.end] - total[self.start]) * down[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)


class HashIndex:
    """Places of 64-bit hashes in an array (of distinct ones), found for many at once; -1 for those not in it.

    An open table of four slots or more a hash, so that few are looked at twice.
    """

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.append(hashes.astype(np.uint64), np.uint64(0))
        size = 1 << max(4, (4 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = np.int64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        todo = np.arange(len(hashes))
        place = (hashes.astype(np.uint64) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slots[place] < 0
            self.slots[place[free]] = todo[free]
            left = self.slots[place] != todo
            todo, place = todo[left], place[left] + 1 & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> self.shift).astype(np.int64)
        out = self.slots[place].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        place = place[todo]
        while len(todo):
            place = place + 1 & self.mask
            out[todo] = self.slots[place]
            wrong = (out[todo] >= 0) & (self.hashes[out[todo]] != hashes[todo])
            todo, place = todo[wrong], place[wrong]
        return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text with fewer words has its whole word sequence as one shingle; one without words has none.
    """
    words = Words(texts)
    h, n = words.hash, len(words.hash)
    out: list[np.ndarray] = []
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(_ODD) + h[k : k + len(rolled)]
    rolled = mix64(rolled + np.uint64(width))
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            value = np.zeros(1, np.uint64)
            for x in h[a:b]:
                value = value * np.uint64(_ODD) + x
            out.append(mix64(value + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def crc_fold(column, modulus: int):
    """``crc32`` of the column written as text, modulo ``modulus`` (null stays null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def read_only_path(name_or_path: str) -> str:
    """A tokenizer file: an existing path as it is, a bare name from the installed public files."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
