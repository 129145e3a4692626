"""Reading and writing of the data model's files (SRC-01, SRC-03, SRC-05 to SRC-07, SRC-12 to SRC-14, SNK-04, SNK-05, SNK-08)."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import round_up_half

_FLAT = "array<double>"
RAW_SCHEMA = f"schema string, schemaVersion int, clipId string, layout struct<faceIndices: array<int>>, frames array<struct<i: int, pts: bigint, t: double, pose: {_FLAT}, poseWorld: {_FLAT}, leftHand: {_FLAT}, rightHand: {_FLAT}, face: {_FLAT}>>"
#: Numbers per point of each stream (fixed values).
STRIDES = {"pose": 5, "poseWorld": 3, "leftHand": 3, "rightHand": 3, "face": 3}
REVIEW_SCHEMA = "map<string, struct<decision: string, sequenceId: string, notes: string, reviewer: string, at: string>>"


def points(flat: Column, stride: int) -> Column:
    """A flat array as an array of (x, y, z) points; null if it is null, not a multiple of the stride or not all finite."""
    good = (F.size(flat) % stride == 0) & F.forall(flat, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(flat) / stride - 1, F.lit(0)).cast("int")), lambda k: k * stride < F.size(flat))
    return F.when(good, F.transform(places, lambda k: F.struct(F.get(flat, k * stride).alias("x"), F.get(flat, k * stride + 1).alias("y"), F.get(flat, k * stride + 2).alias("z"))))


def read_raw_clips(spark: SparkSession, path: str) -> DataFrame:
    """A row per decoded frame of raw clip files (JSON, gzip by extension), streams unpacked to points, the face keyed by mesh index.

    The schema is given, nothing is inferred. A clip is one JSON value and so one task.
    """
    clips = spark.read.schema(RAW_SCHEMA).option("multiLine", True).json(path)
    frames = clips.select("clipId", F.col("layout.faceIndices").alias("_f"), F.inline("frames"))
    out = frames.select("clipId", "i", "pts", "t", "_f", *(points(F.col(c), n).alias(c) for c, n in STRIDES.items()))
    return out.withColumn("face", F.when(F.size("_f") == F.size("face"), F.map_from_arrays("_f", "face"))).drop("_f")


def parse_reviews(texts: DataFrame, text: str = "json") -> DataFrame:
    """Review records of stored JSON objects; malformed texts and records without a valid decision or take are left out."""
    parsed = texts.select(F.explode(F.from_json(F.col(text), REVIEW_SCHEMA)).alias("gloss", "r"))
    good = parsed.where(F.col("r.decision").isin("approved", "rejected") & F.col("r.sequenceId").isNotNull())
    return good.select("gloss", F.col("r.sequenceId").alias("sequence_id"), F.col("r.decision").alias("decision"), *(F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in ("notes", "reviewer", "at")))


def write_tracks(tracks: DataFrame, path: str, places: int = 6) -> None:
    """Motion tracks (``clip, bone, path, values``) as Parquet, rounded with halves up, one folder per clip."""
    rounded = tracks.withColumn("values", F.transform("values", lambda v: round_up_half(v, places)))
    rounded.write.partitionBy("clip").mode("overwrite").parquet(path)


def read_tracks(spark: SparkSession, path: str, clips: list[str] | None = None) -> DataFrame:
    """Motion tracks; the clips asked for are found by their folders."""
    tracks = spark.read.parquet(path)
    return tracks if clips is None else tracks.where(F.col("clip").isin(clips))


def append_stage_report(report: DataFrame, path: str) -> None:
    """Adds stage figures keyed by (clip, stage); readers take the last of a key (``relations.latest``)."""
    report.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def write_library(frames: DataFrame, path: str) -> None:
    """Library frames (``variant, word, frame, bone, q`` of 16-bit parts), one folder per variant, words together."""
    frames.repartition("variant", "word").sortWithinPartitions("variant", "word", "frame", "bone").write.partitionBy("variant").mode("overwrite").parquet(path)


#: Words of a library's layout at most: it goes to every task.
MOST_WORDS = 1_000_000


def read_library_blocks(spark: SparkSession, path: str, layout: DataFrame, bones: list[str]) -> DataFrame:
    """Frames out of binary blocks of little-endian 16-bit quaternions laid out as variant, frame, bone.

    ``layout`` (``variant, word, offset, frames``, offsets in frames) goes to the
    tasks that read the files, which cut the words out; it may have ``MOST_WORDS``
    rows, and more are refused. Every file is read by this layout.
    """
    rows = layout.select("variant", "word", F.col("offset").cast("long"), F.col("frames").cast("int")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a layout of more than {MOST_WORDS} words")
    words = spark.sparkContext.broadcast([tuple(r) for r in rows])
    width = 8 * len(bones)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (x for batch in batches for x in batch.column(0).to_pylist()):
            for variant, word, offset, count in words.value:
                block = content[offset * width : (offset + count) * width]
                q = np.frombuffer(block, "<i2").reshape(count, len(bones), 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([variant] * count * len(bones)), pa.array([word] * count * len(bones)),
                        pa.array(np.repeat(np.arange(count, dtype=np.int32), len(bones))), pa.array(bones * count), pa.array(q.reshape(-1, 4).tolist(), pa.list_(pa.int16())),
                    ],
                    names=["variant", "word", "frame", "bone", "q"],
                )

    return files.mapInArrow(run, "variant string, word string, frame int, bone string, q array<smallint>")


def read_rig(spark: SparkSession, path: str) -> DataFrame:
    """``idx, node, parent, translation, rotation, is_joint`` of a binary glTF file's nodes (some tens of rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                magic, version, _ = struct.unpack_from("<4sII", content)
                if magic != b"glTF" or version != 2:
                    raise ValueError("not a binary glTF 2 file")
                size, kind = struct.unpack_from("<II", content, 12)
                if kind != 0x4E4F534A:
                    raise ValueError("the first chunk is not JSON")
                scene = json.loads(content[20 : 20 + size])
                nodes = scene.get("nodes", [])
                parent = {c: k for k, n in enumerate(nodes) for c in n.get("children", [])}
                joints = {j for s in scene.get("skins", []) for j in s["joints"]}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(nodes)), pa.int32()), pa.array([n.get("name") for n in nodes], pa.string()), pa.array([nodes[parent[k]].get("name") if k in parent else None for k in range(len(nodes))], pa.string()),
                        pa.array([n.get("translation", [0.0, 0.0, 0.0]) for n in nodes], pa.list_(pa.float64())), pa.array([n.get("rotation", [0.0, 0.0, 0.0, 1.0]) for n in nodes], pa.list_(pa.float64())), pa.array([k in joints for k in range(len(nodes))]),
                    ],
                    names=["idx", "node", "parent", "translation", "rotation", "is_joint"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "idx int, node string, parent string, translation array<double>, rotation array<double>, is_joint boolean")
