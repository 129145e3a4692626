"""Time: irregular frames on a uniform grid, look-ups in it, and chunks with halos (WIN-01, WIN-27, AGG-02, JN-07 to JN-09, SET-03, SET-06, SRC-17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.selection import linear_quantiles


def number_rows(df: DataFrame, series: str, order: list[str], name: str = "i") -> DataFrame:
    """Each row's place in its series, from 0; ``order`` must be unique within a series for a stable result."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(series).orderBy(*order)) - 1).cast("long"))


def to_slots(df: DataFrame, series: str, place: str, seconds: str, period: float) -> DataFrame:
    """Every frame's slot ``k`` on a grid of one slot per ``period`` seconds.

    A frame goes to the slot nearest to its time (halves up) or, if a frame before
    it has taken that one, to the next that is free. As slots are taken in order,
    k is the running maximum of (nearest slot - place) plus place: one window, no
    loop. ``late`` marks frames a period or more off their slot, ``backward``
    those that do not follow the frame before in time. Null times stay null.
    """
    w = W.partitionBy(series).orderBy(place)
    wanted = F.floor(F.col(seconds) / F.lit(period) + F.lit(0.5)).cast("long")
    k = F.col(place) + F.max(wanted - F.col(place)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("k", F.when(F.col(seconds).isNotNull(), k))
    out = out.withColumn("late", F.abs(F.col(seconds) - F.col("k") * F.lit(period)) >= F.lit(period))
    return out.withColumn("backward", F.coalesce(F.col(seconds) <= F.lag(seconds).over(w), F.lit(False)))


#: Slots that one row of the grid lists at once.
GRID_CHUNK = 4_096

#: No slot lies beyond this one (the last whole number that a double tells from the next).
FARTHEST = float(2**53)


def dense_grid(slots: DataFrame, series: str, columns: list[str]) -> DataFrame:
    """A row for every slot from 0 to the series' last, with nulls where no frame lies.

    Every frame makes the slots up to the frame after it (the first one also those
    before it), so the grid needs the frames' own order and no join, and a null
    series is a series. A long gap is listed in chunks, so no array follows its
    length. Frames without a slot make none; several frames of a slot each keep a row.
    """
    w = W.partitionBy(series).orderBy("k")
    known = slots.where(F.col("k").isNotNull()).select(series, "k", *columns)
    known = known.withColumn("_from", F.when(F.lag("k").over(w).isNull(), F.lit(0).cast("long")).otherwise(F.col("k")))
    known = known.withColumn("_to", F.greatest(F.coalesce(F.lead("k").over(w) - 1, F.col("k")), F.col("k")))
    parts = known.withColumn("_part", F.explode(F.sequence("_from", "_to", F.lit(GRID_CHUNK).cast("long"))))
    listed = parts.withColumn("_slot", F.explode(F.sequence("_part", F.least(F.col("_part") + (GRID_CHUNK - 1), F.col("_to")))))
    own = F.col("_slot") == F.col("k")
    return listed.select(series, F.col("_slot").alias("k"), *(F.when(own, F.col(c)).alias(c) for c in columns))


def timing_report(df: DataFrame, series: str, order: list[str], seconds: str, nominal: float | None = None) -> DataFrame:
    """Per series: rows, average rate, least and greatest step, repeated times, variable rate, gaps over 1.5 nominal steps.

    Without a nominal step the series' median step serves, found by rank (see ``selection``).
    A null time has no step; a series of one row has no steps and no gaps. An empty table gives no rows.
    """
    w = W.partitionBy(series).orderBy(*order)
    steps = df.select(series, F.col(seconds).alias("_t"), (F.col(seconds) - F.lag(seconds).over(w)).alias("_d"))
    if nominal is None:
        usual = linear_quantiles(steps, [series], "_d", {"_n": 0.5}).withColumnRenamed(series, "_s")
        steps = steps.join(usual, F.col(series).eqNullSafe(F.col("_s")), "left").drop("_s")
    else:
        steps = steps.withColumn("_n", F.lit(nominal))
    span = F.max("_t") - F.min("_t")
    return steps.groupBy(series).agg(
        F.count("*").alias("frames"),
        F.when(span > 0, (F.count("*") - 1) / span).alias("average_rate"),
        F.min("_d").alias("least_step"),
        F.max("_d").alias("greatest_step"),
        F.count_if(F.col("_d") == 0).alias("repeated_times"),
        F.coalesce(F.max("_d") - F.min("_d") > 0.002, F.lit(False)).alias("variable_rate"),
        F.count_if(F.col("_d") > F.col("_n") * 1.5).alias("gaps"),
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key, the first one by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def nearest_source(grid: DataFrame, series: str, source: str, seconds: str, period: float) -> DataFrame:
    """``shows``: the slot's own source or, if it has none, the nearer in time of those before and after; ties go to the earlier."""
    own = F.when(F.col(source).isNotNull(), F.struct(F.col(source).alias("source"), F.col(seconds).alias("t")))
    up, down = W.partitionBy(series).orderBy("k"), W.partitionBy(series).orderBy(F.desc("k"))
    out = grid.withColumn("_b", F.last(own, True).over(up.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("_a", F.last(own, True).over(down.rowsBetween(W.unboundedPreceding, 0)))
    now = F.col("k") * F.lit(period)
    use_after = F.col("_b").isNull() | (F.abs(F.col("_a.t") - now) < F.abs(F.col("_b.t") - now))
    return out.withColumn("shows", F.when(F.coalesce(use_after, F.lit(False)), F.col("_a.source")).otherwise(F.col("_b.source"))).drop("_a", "_b")


def around(points: DataFrame, samples: DataFrame, series: str, seconds: str, value: str, period: float, made: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``points`` with ``value``: ``made`` of the samples in the slots before and after each point's time, and the share of the way.

    ``samples`` has one row per slot ``k``. Times before slot 0 are at it, times after the
    series' last slot (null ones too) at that one; a slot without a sample gives null. Points of a
    null series, or of one without samples, are left out. One sort of both sides together:
    no join, so nothing is broadcast however small the planner takes the samples for.
    """
    exact = F.greatest(F.least(F.col(seconds) / F.lit(period), F.lit(FARTHEST)), F.lit(0.0))
    sample = F.struct(F.col("k").cast("long").alias("k"), F.col(value).alias("v"))
    kind = f"struct<k:bigint,v:{samples.schema[value].dataType.simpleString()}>"
    held = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in points.schema.fields) + ">"
    marks = samples.where(F.col(series).isNotNull()).select(series, F.col("k").cast("long").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("double").alias("_x"), sample.alias("_s"), F.lit(None).cast(held).alias("_p"))
    asked = points.where(F.col(series).isNotNull()).select(F.col(series).cast(samples.schema[series].dataType), F.floor(exact).cast("long").alias("_at"), F.lit(1).alias("_side"), exact.alias("_x"), F.lit(None).cast(kind).alias("_s"), F.struct(*points.columns).alias("_p"))
    up = W.partitionBy(series).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(series).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("_b", F.last("_s", True).over(up)).withColumn("_a", F.last("_s", True).over(down))
    found = both.where("_side = 1 and (_a is not null or _b is not null)")
    end = F.col("_a").isNull()
    low = F.when(end | (F.col("_b.k") == F.col("_at")), F.col("_b.v"))
    high = F.when(end, F.col("_b.v")).when(F.col("_a.k") == F.col("_at") + 1, F.col("_a.v"))
    share = F.when(end, F.lit(0.0)).otherwise(F.col("_x") - F.col("_at"))
    return found.select(*(F.col(f"_p.{c}").alias(c) for c in points.columns if c != value), made(low, high, share).alias(value))


def sample_at(points: DataFrame, samples: DataFrame, series: str, seconds: str, value: str, period: float) -> DataFrame:
    """The series' value at any time, between the two samples around it, held at both ends. See ``around``."""
    return around(points, samples, series, seconds, value, period, lambda low, high, share: low + (high - low) * share)


def sequence_offsets(items: DataFrame, series: str, order: list[str], length: str) -> DataFrame:
    """``start`` and ``end`` of every item when a series' items are laid end to end."""
    w = W.partitionBy(series).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - F.col(length))


def segment_at(points: DataFrame, segments: DataFrame, series: str, frame: str, start: str = "start", name: str = "segment") -> DataFrame:
    """The segment that holds each point: the last that starts at or before it; later points are in the last segment.

    One sort of both sides together instead of a range join.
    """
    marks = segments.select(series, F.col(start).cast("long").alias("_at"), F.lit(0).alias("_side"), F.col(name).alias("_s"), F.lit(None).cast("struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in points.schema.fields) + ">").alias("_p"))
    asked = points.select(series, F.col(frame).cast("long").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(segments.schema[name].dataType).alias("_s"), F.struct(*points.columns).alias("_p"))
    w = W.partitionBy(series).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("_s", F.last("_s", True).over(w)).where("_side = 1")
    return found.select("_p.*", F.col("_s").alias(name))


def chunks_with_halo(df: DataFrame, place: str, size: int, halo: int) -> DataFrame:
    """Rows dealt to ``chunk`` of ``size`` places, each preceded by the ``halo`` rows before it (``warm``).

    A filter that forgets within the halo then gives the same on every chunk alone,
    so a single long series spreads over many tasks.
    """
    own = F.floor(F.col(place) / size).cast("long")
    into_halo = F.col(place) % size >= size - halo
    copies = F.when(into_halo, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("warm")), F.struct((own + 1).alias("chunk"), F.lit(True).alias("warm")))).otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("warm"))))
    return df.select("*", F.inline(copies))


def steps(df: DataFrame, series: str, order: str, value: str, period: float) -> DataFrame:
    """``step`` (absolute change), ``velocity`` and ``acceleration`` from row to row; null where there is no row before."""
    w = W.partitionBy(series).orderBy(order)
    out = df.withColumn("step", F.abs(F.col(value) - F.lag(value).over(w)))
    out = out.withColumn("velocity", F.col("step") / F.lit(period))
    return out.withColumn("acceleration", F.abs(F.col("step") - F.lag("step").over(w)) / F.lit(period * period))


def source_order(df: DataFrame, series: str, order: str, source: str) -> DataFrame:
    """``in_order``: whether a row's source follows the last one before it, rows without source aside."""
    w = W.partitionBy(series).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.last(source, True).over(w)
    return df.withColumn("in_order", F.coalesce(F.col(source) > before, F.lit(True)))
