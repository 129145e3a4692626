"""Document fingerprints: quartile digests of hashed byte triplets."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES

BUCKETS = 256
#: A difference of this or more counts as no likeness; unrelated texts differ by less than that on average.
MOST_DIFFERENCE = 400
#: Byte triplets counted at each place of a four-byte window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_WINDOW = 4
_TABLES = np.random.default_rng(104729).integers(0, 256, (len(TRIPLETS), 3, 256), dtype=np.uint8)
_LEAST_KEY = -(1 << 63)


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of bytes per text: checksum, length class, two quartile ratios in one byte, and two bits per bucket.

    A bucket's two bits tell in which quarter of the text's bucket counts its own
    count lies. Texts of fewer than four bytes have empty buckets.
    """
    out = np.zeros((len(texts), 3 + BUCKETS // 4), np.uint8)
    raw = np.frombuffer(b"".join([*texts, b"\0" * _WINDOW]), np.uint8)
    n = len(raw) - _WINDOW + 1
    hashed = []
    for (a, b, c), table in zip(TRIPLETS, _TABLES):
        hashed.append(table[0][raw[a : a + n]] ^ table[1][raw[b : b + n]] ^ table[2][raw[c : c + n]])
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    at = 0
    for k, text in enumerate(texts):
        last = at + len(text) - _WINDOW + 1
        if last > at:
            for h in hashed:
                counts[k] += np.bincount(h[at:last], minlength=BUCKETS)
        at += len(text)
        out[k, 0] = zlib.crc32(text) & 255
        out[k, 1] = min(255, int(math.log(len(text)) / math.log(1.1))) if text else 0
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, [BUCKETS * q // 4 - 1]] for q in (1, 2, 3))
    ratio = [np.minimum(15, 16 * q[:, 0] // np.maximum(q3[:, 0] + 1, 1)) for q in (q1, q2)]
    out[:, 2] = ratio[0] * 16 + ratio[1]
    quarter = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(len(texts), -1, 4)
    out[:, 3:] = quarter[:, :, 0] | quarter[:, :, 1] << 2 | quarter[:, :, 2] << 4 | quarter[:, :, 3] << 6
    return out


_PAIR = np.array([[0, 1, 2, 5], [1, 0, 1, 2], [2, 1, 0, 1], [5, 2, 1, 0]], np.int64)
_BYTE_PAIR = np.zeros((256, 256), np.uint8)
for _shift in (0, 2, 4, 6):
    _codes = np.arange(256) >> _shift & 3
    _BYTE_PAIR += _PAIR[_codes[:, None], _codes[None, :]].astype(np.uint8)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The difference score of digests row by row: 0 for equal ones, opposite quarters weigh most."""
    body = _BYTE_PAIR[a[:, 3:], b[:, 3:]].sum(axis=1, dtype=np.int64)
    length = np.abs(a[:, 1].astype(np.int64) - b[:, 1])
    ratio = np.abs((a[:, 2] >> 4).astype(np.int64) - (b[:, 2] >> 4)) + np.abs((a[:, 2] & 15).astype(np.int64) - (b[:, 2] & 15))
    return body + np.minimum(2 * length, 60) + 2 * ratio + (a[:, 0] != b[:, 0])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, falling with the difference to 0 at ``MOST_DIFFERENCE``."""
    return 1.0 - np.minimum(differences(a, b), MOST_DIFFERENCE) / MOST_DIFFERENCE


def _range_number(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key, by two short searches."""
    width = max(1, math.isqrt(len(bounds)))
    rows = [bounds[a : a + width] for a in range(0, len(bounds), width)]
    if not rows:
        return F.lit(0)
    firsts = F.lit([r[0] for r in rows])
    row = F.size(F.filter(firsts, lambda b: b <= key))
    within = F.size(F.filter(F.element_at(F.lit(rows), F.greatest(row, F.lit(1))), lambda b: b <= key))
    return F.when(row == 0, 0).otherwise((row - 1) * width + within).cast("int")


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", pieces: int | None = None) -> DataFrame:
    """Rows dealt so that every task sees runs of documents in key order, each run closed by the document after it.

    Columns ``piece, ahead, key, doc_id, text``, sorted by all but doc_id within
    partitions; rows with ``ahead`` are the copies that close a run. The runs'
    bounds are quantiles of the key, and what the driver holds is one bound and
    one least key per run. After the last document comes the first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST_KEY)).alias("key"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces or 4 * tasks
    # ids alone are read here; the quantiles only balance the runs, any bounds would be right
    quantiles = rows.select("key").where(F.col("key") > _LEAST_KEY).approxQuantile("key", [k / pieces for k in range(1, pieces)], 0.25 / pieces)
    bounds = sorted({int(q) for q in quantiles})
    rows = rows.withColumn("piece", _range_number(F.col("key"), bounds))
    heads = {r[0]: r[1] for r in rows.groupBy("piece").agg(F.min("key").alias("least")).collect()}
    filled = sorted(heads)
    before = {p: filled[k - 1] for k, p in enumerate(filled)}
    count = len(bounds) + 1
    head = F.element_at(F.lit([heads.get(p, _LEAST_KEY) for p in range(count)]), F.col("piece") + 1)
    earlier = F.element_at(F.lit([before.get(p, -1) for p in range(count)]), F.col("piece") + 1)
    own = F.struct(F.col("piece"), F.lit(False).alias("ahead"))
    ahead = F.struct(earlier.alias("piece"), F.lit(True).alias("ahead"))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("key") == head, F.array(own, ahead)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("at.piece").alias("piece"), F.col("at.ahead").alias("ahead"), "key", "doc_id", "text")
    return dealt.repartition(tasks, "piece").sortWithinPartitions("piece", "ahead", "key", "text")


def edited_text(own: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text's start."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Digest every whole text and its edited text, and compare with the edited and the next document's.

    The next document is the one with the next greater key; after the last comes
    the first, and a single document is its own next. Null keys come first;
    rows with equal keys follow each other by their texts. Null texts count as
    empty; two empty texts are fully alike. An empty table gives no rows, further
    columns are ignored. Returns ``n_chars``, the ``edited`` text, both
    fingerprints (hexadecimal) and both likenesses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, str]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            texts = [r[3] for r in held]
            own = digests([t.encode("utf-8") for t in texts])
            # a row is told once its follower is known; copies that close a run are not told
            told = [k for k in range(len(held) - 1) if not held[k][1]]
            if told:
                changed = [edited_text(texts[k], texts[k + 1]) for k in told]
                new = digests([t.encode("utf-8") for t in changed])
                mine, following = own[told], own[[k + 1 for k in told]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[k][2] for k in told], pa.int64()),
                        pa.array([len(texts[k]) for k in told], pa.int64()),
                        pa.array(changed, pa.string()),
                        pa.array([r.tobytes().hex() for r in mine]),
                        pa.array([r.tobytes().hex() for r in new]),
                        pa.array(likeness(mine, new)),
                        pa.array(likeness(mine, following)),
                    ],
                    names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            held = held[-1:]
            size = sum(len(r[3]) for r in held)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append(row)
                size += len(row[3])
                if size > SLICE_BYTES and len(held) > 1:
                    yield from flush()
        if len(held) > 1:
            yield from flush()

    return with_next(docs, text, key).select("piece", "ahead", "doc_id", "text").mapInArrow(run, SCHEMA)
