"""Streams give what the batch operators give on the same rows, and a prefix of the stream gives a prefix."""

from __future__ import annotations

import random

import pytest

from seriesloom.operators import folds, robust
from seriesloom.streaming import stateful

SCHEMA = "s int, t double, x double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(s, round(k / 30 + rng.random() / 100, 6), rng.gauss(0, 1) * (20 if rng.random() < 0.1 else 1)) for s in (1, 2) for k in range(40)]


def streamed(spark, rows, tmp_path, make, cuts=(0.4, 0.8, 2.0)):
    """Runs the stream over the rows in files by time."""
    source = str(tmp_path / "in")
    low = -1.0
    for high in cuts:
        part = [r for r in rows if low <= r[1] < high]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        low = high
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    run = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start()
    run.awaitTermination(180)
    return {(r[0], r[1]): r[3] for r in spark.read.parquet(out).collect()}


CASES = {
    "one_euro": (lambda s: stateful.one_euro(s, "s", "t", "x", 1.0, 0.5), lambda b: folds.one_euro(b, "s", ["t"], "x", "t", 1.0, 0.5), "smooth"),
    "average": (lambda s: stateful.exponential_average(s, "s", "t", "x", 0.18), lambda b: folds.exponential_average(b, "s", ["t"], "x", 0.18), "average"),
    "limited": (lambda s: stateful.limited_steps(s, "s", "t", "x", 5.0), lambda b: folds.limited_steps(b, "s", ["t"], "x", "t", 5.0), "limited"),
    "gate": (lambda s: stateful.median_gate(s, "s", "t", "x", 9, 3.0, 0.5), lambda b: robust.median_gate(b, "s", "x", 9, 3.0, 0.5, "t"), "gated"),
    "rolling": (lambda s: stateful.rolling_quantile(s, "s", "t", "x", 10, 0.9), lambda b: robust.rolling_quantile(b, "s", "x", 10, 0.9, order="t"), "rolling"),
}


@pytest.mark.parametrize("case", CASES)
def test_stream_equals_batch(spark, rows, tmp_path, case):
    stream, batch, name = CASES[case]
    want = {(r.s, r.t): r[name] for r in batch(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = streamed(spark, rows, tmp_path, stream)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_availability_rises_and_falls(spark, tmp_path):
    rows = [(1, k / 10, 1.0 if k < 10 else None) for k in range(20)]
    got = streamed(spark, rows, tmp_path, lambda s: stateful.availability(s, "s", "t", "x", 0.3))
    weights = [got[1, k / 10] for k in range(20)]
    assert weights[9] > 0.9 and weights[19] < 0.1 and sorted(weights[:10]) == weights[:10]
