"""Block-wise zero-phase filters against the recurrence row by row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import scans


def plain(xs, cutoff, rate):
    """Both passes over the padded series, one row at a time; None stays None."""
    own = [x for x in xs if x is not None and math.isfinite(x)]
    if len(own) < 3:
        return [x if x is not None and math.isfinite(x) else None for x in xs]
    (b0, b1, b2), (a1, a2) = scans.butterworth(cutoff, rate)
    pad = min(18, len(own) - 1)
    padded = [2 * own[0] - x for x in own[pad:0:-1]] + own + [2 * own[-1] - x for x in own[-2 : -pad - 2 : -1]]

    def one_way(values):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * gain) * values[0]
        z1 = (b1 - a1 * gain) * values[0] + z2
        out = []
        for x in values:
            y = b0 * x + z1
            z1, z2 = b1 * x - a1 * y + z2, b2 * x - a2 * y
            out.append(y)
        return out

    smooth = iter(one_way(one_way(padded)[::-1])[::-1][pad : pad + len(own)])
    return [next(smooth) if x is not None and math.isfinite(x) else None for x in xs]


@pytest.mark.parametrize("block", [1 << 16, 7, 50])
def test_series_of_all_lengths(spark, block):
    rng = random.Random(5)
    rows, want = [], {}
    for s, n in enumerate((1, 2, 3, 4, 18, 19, 40, 63, 64, 65, 300)):
        xs = [None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else rng.gauss(0, 1) + k / 10 for k in range(n)]
        places = sorted(rng.sample(range(3 * n), n))
        name = None if s == 10 else f"s{s}"
        rows += [(name, k, x, s) for k, x in zip(places, xs)]
        want |= dict(zip([(name, k) for k in places], plain(xs, 4.0, 30.0)))
    frame = spark.createDataFrame(rows, "c2 string, c0 int, before double, _x int").repartition(5)
    got = scans.zero_phase(frame, "c2", "c0", "before", 4.0, 30.0, block=block)
    assert got.columns == [*frame.columns, "smooth"]
    found = {(r.c2, r.c0): r.smooth for r in got.collect()}
    assert found.keys() == want.keys()
    for k, y in want.items():
        assert (found[k] is None) == (y is None) and (y is None or abs(found[k] - y) < 1e-9), (k, found[k], y)
    assert scans.zero_phase(frame.limit(0), "c2", "c0", "before", 4.0, 30.0).count() == 0


def test_arrays_are_filtered_by_part(spark):
    rng = random.Random(6)
    xs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(90)]
    xs[10] = None
    xs[20] = [1.0, None, 2.0, 3.0]
    frame = spark.createDataFrame([(1, k, x) for k, x in enumerate(xs)], "s int, k int, q array<double>")
    got = {r.k: r.smooth for r in scans.zero_phase(frame, "s", "k", "q", 6.0, 30.0, block=16).collect()}
    assert got[10] is got[20] is None
    for part in range(4):
        want = plain([None if x is None or None in x else x[part] for x in xs], 6.0, 30.0)
        assert all(y is None or abs(got[k][part] - y) < 1e-9 for k, y in enumerate(want))


def test_one_long_series_is_many_tasks(spark):
    """A series of 600,000 rows: the same as the recurrence, in blocks that several tasks filter."""
    n = 600_000
    frame = spark.range(n).select(F.lit("one").alias("s"), F.col("id").alias("k"), (F.sin(F.col("id") / 50) + F.rand(3)).alias("x")).withColumn("task", F.lit(0))
    rows = frame.select("k", "x").toPandas().sort_values("k")
    told = scans.zero_phase(frame, "s", "k", "x", 3.0, 30.0, block=20_000).withColumn("task", F.spark_partition_id())
    got = told.select("k", "smooth", "task").toPandas().sort_values("k")
    want = np.array(plain(rows["x"].tolist(), 3.0, 30.0))
    assert np.abs(got["smooth"].to_numpy() - want).max() < 1e-9
    assert got["task"].nunique() > 3
