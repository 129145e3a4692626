"""Files with digests of their bytes, and records that must have been made from them (SRC-02, VAL-02)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are unpacked at a time.
PIECE = 1 << 20


def unpacked(content: bytes) -> bytes:
    """The bytes, or what they pack if they begin as gzip does; several packed members follow each other."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        for k in range(0, len(rest), PIECE):
            out.append(member.decompress(rest[k : k + PIECE]))
            if member.eof:
                rest = member.unused_data + rest[k + PIECE :]
                break
        else:
            raise ValueError("packed bytes end too early")
    return b"".join(out)


def read_with_digests(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``path, stored_sha256, sha256, bytes, text`` of every file, packed or not; with a ``schema`` also the text parsed as JSON in ``record``.

    The digests are those of the bytes as they are stored and as they are unpacked,
    taken in the tasks that read the files. A file is one row, so it has to fit a task
    (Spark's binary reader takes up to 2 GB). A text that is no JSON of the schema
    gives a null record; bytes that aren't UTF-8 are replaced in the text, not in the digest.
    Files without any bytes have no row, as Spark's reader passes them over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                stored = batch.column(1)[k].as_py()
                plain = unpacked(stored)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([hashlib.sha256(stored).hexdigest()]), pa.array([hashlib.sha256(plain).hexdigest()]), pa.array([len(plain)], pa.int64()), pa.array([plain.decode("utf-8", "replace")])],
                    names=["path", "stored_sha256", "sha256", "bytes", "text"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(run, "path string, stored_sha256 string, sha256 string, bytes long, text string")
    return out if schema is None else out.withColumn("record", F.from_json("text", schema))


def enforced(records: DataFrame, sides: dict[str, tuple[Column, Column]], name: str = "lineage") -> DataFrame:
    """The records with a column ``name`` that is true, or a failed job that says which side doesn't match.

    ``sides`` maps what is compared (rig, run, video, take) to the digest that a record
    claims and the one that was found. A null on either side doesn't match. The column is
    an expression like others: where it isn't read, nothing is checked.
    """
    checks = F.lit(True)
    for side, (claimed, found) in reversed(sides.items()):
        short = lambda c: F.coalesce(F.substring(c, 1, 12), F.lit("nothing"))
        message = F.concat(F.lit(f"lineage of {side}: made from "), short(claimed), F.lit(", found "), short(found))
        checks = F.when(F.coalesce(claimed == found, F.lit(False)), checks).otherwise(F.raise_error(message).cast("boolean"))
    return records.withColumn(name, checks)


def matched(records: DataFrame, sources: DataFrame, key: str, side: str, claimed: str, digest: str = "sha256") -> DataFrame:
    """The records joined with their sources by ``key`` and enforced: a record without its source doesn't match."""
    found = sources.select(F.col(key), F.col(digest).alias("_found"))
    return enforced(records.join(found, key, "left"), {side: (F.col(claimed), F.col("_found"))}).drop("_found")


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row, ``keys``: how many distinct keys both have; or a failed job that names the first that only one has."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    each = sides.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    told = each.agg(F.count("*").alias("_n"), F.min(F.when(F.col("_r") == 0, F.col(key).cast("string"))).alias("_left"), F.min(F.when(F.col("_l") == 0, F.col(key).cast("string"))).alias("_right"))
    alone = F.coalesce(F.concat(F.lit("only the first side has "), F.col("_left")), F.concat(F.lit("only the second side has "), F.col("_right")))
    return told.select(F.when(alone.isNull(), F.col("_n")).otherwise(F.raise_error(alone).cast("long")).alias("keys"))
