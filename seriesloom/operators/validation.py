"""Faults of motion files and library indexes as rows (VAL-01, VAL-03), the order of controlled bones (TOP-07), filters by chunks (SRC-17, SET-04)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timeline import chunks_with_halo

# Numbers per frame of a track, and the least frames of a word.
STRIDES, WORD_LEAST = {"rotation": 4, "translation": 3}, 2


def _faults(df: DataFrame, keys: list[str], **tests: Column) -> DataFrame:
    """``keys, fault``: a row for each test that a row fails; a null test fails."""
    names = F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(names).alias("fault"))


def motion_faults(files: DataFrame, tracks: DataFrame, schema: str, version: int) -> DataFrame:
    """``clip, bone, path, fault`` of motion files that don't hold together; none for sound ones.

    ``files`` has ``clip, schema, version, fps, frames``, ``tracks`` has ``clip, bone, path, values``.
    Kinds: ``schema``, ``version``, ``fps`` (positive and finite), ``frames`` (one at least), ``no tracks``,
    ``length`` (four numbers a frame for rotations, three for others). A null where a number is
    due is a fault; tracks of a clip without a file are faults (``no file``).
    """
    fps = F.col("fps").cast("double")
    of_files = _faults(
        files, ["clip"], schema=F.col("schema") == schema, version=F.col("version") == version, fps=(fps > 0) & (fps < F.lit(float("inf"))) & ~F.isnan(fps), frames=F.col("frames") >= 1
    ).select("clip", F.lit(None).cast("string").alias("bone"), F.lit(None).cast("string").alias("path"), "fault")
    kept = tracks.select("clip").distinct()
    empty = files.select("clip").join(kept, "clip", "left_anti").select("clip", F.lit(None).cast("string").alias("bone"), F.lit(None).cast("string").alias("path"), F.lit("no tracks").alias("fault"))
    stride = F.when(F.col("path") == "rotation", F.lit(STRIDES["rotation"])).otherwise(F.lit(STRIDES["translation"]))
    with_file = tracks.join(files.select("clip", "frames", F.lit(True).alias("_file")), "clip", "left")
    right = F.size("values") == stride * F.col("frames")
    of_tracks = with_file.withColumn("fault", F.when(F.col("_file").isNull(), "no file").when(~F.coalesce(right, F.lit(False)), "length")).where("fault is not null").select("clip", "bone", "path", "fault")
    return of_files.unionByName(empty).unionByName(of_tracks)


def index_faults(words: DataFrame, data: DataFrame) -> DataFrame:
    """``library, word, fault`` of library indexes; none for sound ones.

    ``words`` has ``library, place, word, offset, frames, hold_in, stroke, hold_out``, ``data`` one row per library:
    ``library, fps, bones, variants, frames, values``. Kinds: ``word`` (occurs before in the library), ``offset`` (isn't the
    frames of all words before it), ``timing`` (fewer than two frames, or parts that don't add up), of libraries
    ``fps``, ``bones``, ``variants``, ``words`` (none), ``frames`` (words cover others than the data), ``values``.
    Offsets are one running sum per library. A null number is a fault of the rule that needs it.
    """
    w = W.partitionBy("library").orderBy("place", "word")
    told = words.withColumn("_before", F.coalesce(F.sum("frames").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    told = told.withColumn("_nth", F.row_number().over(W.partitionBy("library", "word").orderBy("place")))
    adds = (F.col("frames") >= WORD_LEAST) & (F.col("hold_in") + F.col("stroke") + F.col("hold_out") == F.col("frames"))
    of_words = _faults(told, ["library", "word"], word=F.col("_nth") == 1, offset=F.col("offset") == F.col("_before"), timing=adds)
    covered = words.groupBy(F.col("library").alias("_l")).agg(F.sum("frames").alias("_covered"), F.count("*").alias("_words"))
    both = data.join(covered, F.col("library") == F.col("_l"), "left")
    fps = F.col("fps").cast("double")
    of_data = _faults(
        both, ["library"], fps=(fps > 0) & (fps < F.lit(float("inf"))) & ~F.isnan(fps), bones=F.col("bones") > 0, variants=F.col("variants") > 0, words=F.col("_words") > 0,
        frames=F.coalesce("_covered", F.lit(0)) == F.col("frames"), values=F.col("values") == F.col("variants") * F.col("frames") * F.col("bones") * 4,
    )
    return of_words.unionByName(of_data.select("library", F.lit(None).cast("string").alias("word"), "fault"))


def controlled_order(bones: DataFrame, rig: DataFrame, bone: str, node: str, index: str) -> DataFrame:
    """``bone, place``: the distinct bones that the rig has, in its order. The rig has some tens of nodes, so it is one small window."""
    known = bones.select(F.col(bone).alias("bone")).distinct().join(rig.select(F.col(node).alias("bone"), F.col(index).alias("_i")), "bone")
    return known.select("bone", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_i", "bone")).cast("long") - 1).alias("place"))


def by_chunks(df: DataFrame, series: str, place: str, size: int, halo: int, filtered: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """A causal filter over chunks of a series, each warmed up by the ``halo`` places before it, and the chunks put together again.

    ``filtered`` takes the frame and the name of the column that stands for the series, and keeps the
    others. A filter that forgets within the halo gives what it gives on whole series, but a long series is many
    tasks. Places are whole numbers from 0, unique in a series; the halo may not be longer than a chunk.
    """
    if halo > size:
        raise ValueError("a halo may not be longer than a chunk")
    dealt = chunks_with_halo(df, place, size, halo).withColumn("_piece", F.struct(series, "chunk"))
    return filtered(dealt, "_piece").where("not warm").drop("chunk", "warm", "_piece")
