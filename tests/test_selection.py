"""Distributed selection against sorting."""

from __future__ import annotations

import math
import random

import pytest

from seriesloom.functions import selection

PLACES = {"low": "floor((n - 1) / 2)", "high": "floor(n / 2)", "q": "floor(0.9D * (n - 1))", "first": "0", "last": "n - 1", "beyond": "n"}


def groups():
    rng = random.Random(12)
    return {
        "spread": [rng.gauss(0, 1) for _ in range(3_000)],
        "one value": [7.0] * 2_000,
        "mostly one": [1.0] * 1_500 + [rng.random() for _ in range(400)] + [5.0],
        "few values": [float(rng.randint(0, 3)) for _ in range(1_000)],
        None: [rng.gauss(5, 3) for _ in range(900)],
        "small": [3.0, 1.0, 2.0],
        "single": [4.0],
        "odd": [float("nan"), float("inf"), -float("inf"), 1.0, 2.0] * 100,
    }


def key(x):
    return (1, 0.0) if math.isnan(x) else (0, x)


@pytest.mark.parametrize("least", [1_000_000, 600, 0])
def test_ranks(spark, least, monkeypatch):
    monkeypatch.setattr(selection, "RANGES", 16)
    rows = [(g, v, 1) for g, vs in groups().items() for v in [*vs, None]] + [("nothing", None, 1)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "n string, _v double, a int").repartition(6)
    got = {r.n: r for r in selection.rank_quantiles(frame, ["n"], "_v", PLACES, least).collect()}
    assert got.keys() == groups().keys()
    for g, vs in groups().items():
        ordered, n = sorted(vs, key=key), len(vs)
        want = {"low": ordered[(n - 1) // 2], "high": ordered[n // 2], "q": ordered[math.floor(0.9 * (n - 1))], "first": ordered[0], "last": ordered[-1], "beyond": None}
        assert all(repr(got[g][k]) == repr(v) for k, v in want.items()), (g, got[g], want)


@pytest.mark.parametrize("least", [1_000_000, 600])
def test_linear(spark, least):
    frame = spark.createDataFrame([(g, v) for g, vs in groups().items() for v in vs], "g string, x double").repartition(3)
    got = {r.g: (r.a, r.b) for r in selection.linear_quantiles(frame, ["g"], "x", {"a": 0.1, "b": 0.95}, least).collect()}
    for g, vs in groups().items():
        own = sorted(v for v in vs if math.isfinite(v))
        for p, found in zip((0.1, 0.95), got[g]):
            place = p * (len(own) - 1)
            low = math.floor(place)
            want = own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (place - low)
            assert found == pytest.approx(want, abs=1e-12)
    assert selection.linear_quantiles(frame.limit(0), ["g"], "x", {"a": 0.5}).count() == 0


def test_a_huge_group_is_not_sorted_whole(spark):
    """No window over the whole group: what is ranked is a range of it, and two groupings at once work too."""
    frame = spark.range(200_000).selectExpr("'g' AS a", "id % 2 AS b", "(id * 7919) % 200003 AS x")
    told = selection.rank_quantiles(frame, ["a", "b"], "x", {"mid": "floor(n / 2)"}, 50_000)
    values = {k: sorted((i * 7919) % 200003 for i in range(k, 200_000, 2)) for k in (0, 1)}
    assert {r.b: r.mid for r in told.collect()} == {k: v[len(v) // 2] for k, v in values.items()}
    plan = told._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_range" in w for w in windows)
