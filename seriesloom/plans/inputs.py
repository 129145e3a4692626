"""The driver's tables seen as series, rotations and library records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quaternions import unit
from ..operators import timeline

#: One slot per hour.
HOUR = 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events of a task of the series queries; a grid has some eleven slots for each.
TASK_EVENTS = 20_000


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a series: ``user_id, event_id, event_type, value, t`` (seconds from the first) and ``i``.

    Whole users are dealt to as many tasks as their number of events asks for. The planner would deal
    them by bytes shuffled, which tell nothing of the grids and costs that are made of them later.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    source = table(spark, sf_dir, "events")
    tasks = max(spark.sparkContext.defaultParallelism, -(-source.count() // TASK_EVENTS))
    events = source.select("user_id", "event_id", "event_type", "value", micros.alias("us")).repartition(tasks, "user_id")
    from pyspark.sql import Window as W

    events = events.withColumn("t", (F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / F.lit(1e6))
    return timeline.number_rows(events, "user_id", ["us", "event_id"]).drop("us")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.to_slots(rows(spark, sf_dir), "user_id", "i", "t", HOUR)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of every user, with the event that fell on it; errors are not valid."""
    full = timeline.dense_grid(slots(spark, sf_dir), "user_id", ["event_id", "event_type", "value", "t"])
    return full.withColumn("valid", F.col("value").isNotNull() & (F.coalesce(F.col("event_type"), F.lit("")) != "error"))


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, vec_id, q``: the first four components of each embedding, at norm 1."""
    parts = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", unit(parts).alias("q"))


# ---- the same for DuckDB

ROWS = """rows_ AS MATERIALIZED (
    SELECT user_id, event_id, event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
    FROM events)"""
SLOTS = f"""{ROWS}, slots AS MATERIALIZED (
    SELECT *, i + max(floor(t / 3600.0::DOUBLE + 0.5::DOUBLE)::BIGINT - i) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM rows_)"""
GRID = f"""{SLOTS}, grid AS MATERIALIZED (
    SELECT u.user_id, u.k, s.event_id, s.event_type, s.value, s.t, s.value IS NOT NULL AND coalesce(s.event_type, '') <> 'error' AS valid
    FROM (SELECT user_id, unnest(generate_series(0, max(k))) AS k FROM slots GROUP BY user_id) u LEFT JOIN slots s ON s.user_id = u.user_id AND s.k = u.k)"""
ROTATIONS = """raw_q AS (
    SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings),
rot AS MATERIALIZED (
    SELECT label, vec_id, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM raw_q) WHERE n > 0)"""


def r6(expression: str) -> str:
    """SQL that rounds to six places, halves up."""
    return f"(floor(({expression}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE)"
