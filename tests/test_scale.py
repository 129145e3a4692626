"""Steps that must stay right, or small, where tables are large."""

from __future__ import annotations

import contextlib
import datetime
import io

from pyspark.sql import functions as F

from seriesloom.operators import folds, gaps, timeline
from seriesloom.plans import catalogue, inputs

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_samples_are_looked_up_without_a_broadcast(spark):
    samples = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 3, 9.0), ("b", 0, None), ("b", 1, 5.0), (None, 0, 7.0)], "s string, k long, v double")
    times = [("a", 0, -5.0), ("a", 1, 0.5), ("a", 2, 1.5), ("a", 3, 2.5), ("a", 4, 3.0), ("a", 5, 99.0), ("a", 6, None), ("b", 7, 0.0), ("b", 8, 1.0), ("b", 9, 1e300), ("c", 10, 0.0), (None, 11, 0.0)]
    points = spark.createDataFrame(times, "s string, i int, t double")
    got = timeline.sample_at(points, samples, "s", "t", "v", 1.0)
    assert {r.i: r.v for r in got.collect()} == {0: 1.0, 1: 2.0, 2: None, 3: None, 4: 9.0, 5: 9.0, 6: 9.0, 7: None, 8: 5.0, 9: 5.0}
    assert "Broadcast" not in plan(got)


def test_fast_motion_follows_ids_exactly(spark, tmp_path):
    # (20 - 7) / 10 - 1 is not (10 - 7) / 10 in floating point
    vectors = [(10, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5], 7), (20, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5], 7), (31, [0.0] * 6 + [0.5], 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.ratio, r.explained) for r in catalogue.QUERIES["fast_motion"](spark, str(tmp_path)).collect()}
    assert got == {10: (None, None), 20: (0.5, True), 31: (None, None)}


def test_turns_of_large_values_are_limited_alike(spark, tmp_path):
    values = [5.0, 700.0, 20.0, 1e9, -1e9, None, float("nan"), 3.0, 650.0, 650.0, 0.0]
    rows = [(k, datetime.datetime(2024, 1, 1, 0, 0, k), 1, "view", v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["limited_turns"](spark, str(tmp_path)).collect()] == [(1, 11, 11)]


def test_tasks_follow_the_number_of_events(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_EVENTS", 500)
    events = inputs.table(spark, SF, "events").count()
    placed = inputs.rows(spark, SF)
    assert placed.rdd.getNumPartitions() == -(-events // 500)
    # whole users, in the partitions they were dealt to, also behind a grid
    for made in (inputs.grid(spark, SF), gaps.carry_forward(inputs.grid(spark, SF), "user_id", "value")):
        assert made.rdd.getNumPartitions() == placed.rdd.getNumPartitions()
        assert made.select("user_id", F.spark_partition_id().alias("p")).distinct().groupBy("user_id").count().where("count > 1").count() == 0


def test_folds_leave_rows_in_their_tasks(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_EVENTS", 500)
    placed = inputs.rows(spark, SF)
    folded = folds.exponential_average(placed, "user_id", ["i"], "value", 0.5)
    assert folded.rdd.getNumPartitions() == placed.rdd.getNumPartitions()
    assert plan(folded).count("Exchange") == plan(placed).count("Exchange")
