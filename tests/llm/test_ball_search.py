from __future__ import annotations

import math
import random

import numpy as np

from seriesloom.llm import ball_search


def brute(rows, k, every):
    good = {}
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in clean:
        if i % every == 0:
            good[i] = max(good.get(i, v), v)
    out = []
    for q, v in good.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) if i % 3 else rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(i + 1000, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000, None), (None, [1.0] * 6), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (2200, [1.0, 2.0]), (2201, [3.0, 2.0]), (50, [9.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, shard int").repartition(4)
    got = sorted(tuple(r)[:4] for r in ball_search.top_k(frame, k=5, every=50).collect())

    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(as_float, 5, 50)
    assert got == want
    for least, most in ((300, 65_536), (90, 100)):  # 3 and 8 shards, so several waves
        assert sorted(tuple(r)[:4] for r in ball_search.top_k(frame, k=5, every=50, shard_least=least, shard_most=most).collect()) == want


def test_repeated_rows_count_each_in_several_shards(spark):
    """Rows that repeat in other shards are results of their own."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(1, 1500)]
    rows += [(900_000 + k // 2, [3.0 + k // 2] * 8) for k in range(24)] + [(0, [1.0] * 8), (0, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want = brute(rows, 5, 50)
    assert [r[2] for r in want if r[0] == 0] == [900_011, 900_011, 900_010, 900_010, 900_009]
    for least in (2_048, 500, 190):
        got = ball_search.top_k(frame, k=5, every=50, shard_least=least, shard_most=600).collect()
        assert sorted(tuple(r)[:4] for r in got) == want
    assert all(5 <= r.compared < len(rows) for r in got if r.query_id == 0)


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**20 + k), float(-k), 1.0]) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:4] for r in ball_search.top_k(frame, k=4, every=20, scale=256).collect())
    assert got == brute(rows, 4, 20) and min(r[3] for r in got) > 2**55


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ball_search.top_k(spark.createDataFrame([], schema)).count() == 0
    assert ball_search.top_k(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    assert [tuple(r)[:4] for r in ball_search.top_k(spark.createDataFrame([(50, [1.0]), (3, [0.5])], schema)).collect()] == [(50, 1, 3, 256 * 128)]


def test_clustered_vectors_are_mostly_left_out(spark):
    """Exact over eight shards and more, with products computed for less than a third of the vectors."""
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(40, 16)) * 3
    rows = [(k, (middles[rng.integers(40)] + rng.normal(size=16) * 0.1).astype(np.float32).tolist()) for k in range(8_000)]
    rows += [(10_000 + k, [0.5] * 16) for k in range(2_000)]  # one vector that repeats
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = ball_search.top_k(frame, k=5, every=500, shard_least=500, shard_most=1_250).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute(rows, 5, 500)
    compared = {r.query_id: r.compared for r in got}
    share = sum(compared.values()) / len(compared) / len(rows)
    assert share < 0.3, share


def test_bounds_hold():
    rng = np.random.default_rng(12)
    for scale in (0.0, 1.0, 300.0):
        vectors = np.floor(rng.normal(size=(3_000, 5)) * 50 + scale * rng.normal(size=5)).astype(np.int64)
        tree = ball_search.BallTree.unpack(ball_search.BallTree.build(np.arange(3_000), vectors, leaf=16).pack())
        queries = np.concatenate([vectors[:40], rng.integers(-99, 99, (40, 5)), np.zeros((1, 5), np.int64)]).astype(float)
        bounds = ball_search.upper_bounds(queries, tree.centre, tree.radius, tree.nearest, tree.farthest, tree.spread)
        for n, (low, high) in enumerate(zip(tree.low, tree.high)):
            assert ((tree.real[low:high] @ queries.T).max(axis=0) <= bounds[:, n]).all()


def test_shards_by_place_are_even():
    """No shard holds much more than its share, whatever repeats."""
    rng = np.random.default_rng(13)
    sample = np.concatenate([np.floor(rng.normal(size=(700, 4)) * 100), np.tile([7.0, 7.0, 7.0, 7.0], (300, 1))])
    planes = ball_search.Planes(sample, 8)
    counts = np.bincount(planes.cell(sample), minlength=planes.cells)
    assert counts.sum() == 1_000 and planes.cells >= 6 and (counts[counts != counts.max()] <= 200).all()
    assert ball_search.Planes(np.ones((50, 3)), 4).cells == 1
