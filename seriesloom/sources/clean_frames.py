"""A store of clean frames that series windows read without an exchange (SNK-03, SRC-04, SRC-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quaternions import unit
from ..functions.scalars import round_up_half

#: What the store calls itself; readers refuse others.
SCHEMA_NAME, SCHEMA_VERSION = "clean-frames", "1"
#: Decimal places of stored numbers (fixed value).
PLACES = 5


def rounded(value: Column, kind: T.DataType, places: int = PLACES) -> Column:
    """Every fraction in a value of any nesting rounded with halves up; keys of maps and other types stay as they are."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return round_up_half(value.cast("double"), places).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: rounded(v, kind.elementType, places))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: rounded(v, kind.valueType, places))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(rounded(value[f.name], f.dataType, places).alias(f.name) for f in kind.fields)))
    return value


def write_clean(frames: DataFrame, name: str, raw: tuple[str, ...] = (), buckets: int = 64, path: str | None = None) -> None:
    """Saves frames (``clip, k`` and any others) as a table in buckets by clip, each sorted by (clip, k), one file a bucket.

    Numbers are rounded to five places but for the columns named in ``raw``. Windows over
    ``clip`` ordered by ``k`` then read the table without shuffling it. One shuffle; a
    clip is one bucket's, as its windows need it in one place anyway.
    """
    columns = [F.col(f.name) if f.name in (*raw, "clip", "k") else rounded(F.col(f.name), f.dataType).alias(f.name) for f in frames.schema.fields]
    dealt = frames.select(*columns).repartition(buckets, "clip").sortWithinPartitions("clip", "k")
    writer = dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, "clip").sortBy("clip", "k")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    frames.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('schema' = '{SCHEMA_NAME}', 'schemaVersion' = '{SCHEMA_VERSION}')")


def read_clean(spark: SparkSession, name: str) -> DataFrame:
    """The stored frames; a table of another kind or version is refused."""
    kept = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if (kept.get("schema"), kept.get("schemaVersion")) != (SCHEMA_NAME, SCHEMA_VERSION):
        raise ValueError(f"{name} is not a table of {SCHEMA_NAME} {SCHEMA_VERSION}")
    return spark.table(name)


def source_pose(frames: DataFrame) -> DataFrame:
    """What a solver reads of a frame: the body, each hand's weight, rotation (norm 1) and parameters, the face with its rotation at norm 1.

    Other fields aren't read from the files. A rotation of norm 0 becomes null, as does what is null.
    """

    def hand(side: str) -> Column:
        h = F.col("hands")[side]
        return F.when(h.isNotNull(), F.struct(h["palm_weight"].alias("palm_weight"), unit(h["rotation"]).alias("rotation"), h["params"].alias("params"))).alias(side)

    body = [f.name for f in frames.schema["body"].dataType.fields if f.name != "valid"]
    face = [f.name for f in frames.schema["face"].dataType.fields if f.name not in ("valid", "rotation")]
    return frames.select(
        "clip", "k",
        F.struct(*(F.col(f"body.{f}").alias(f) for f in body)).alias("body"),
        F.struct(hand("left"), hand("right")).alias("hands"),
        F.struct(unit(F.col("face.rotation")).alias("rotation"), *(F.col(f"face.{f}").alias(f) for f in face)).alias("face"),
    )


def playback_timeline(frames: DataFrame) -> DataFrame:
    """``clip, k, t, source, shown``: the source frame of each slot, and for slots without one the last one before it, or else the first one behind."""
    from pyspark.sql import Window as W

    w = W.partitionBy("clip").orderBy("k")
    before = F.last("source", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    behind = F.first("source", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return frames.select("clip", "k", "t", "source", F.coalesce(before, behind).alias("shown"))
