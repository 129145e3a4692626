"""The steps around cleaning: a plain version of the path through hypotheses, and odd rows."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from seriesloom.operators import cleaning


def turn(a):
    return [0.0, 0.0, math.sin(a / 2), math.cos(a / 2)]


def walked(picks, rows, sigma, scale, reject):
    """The price of one row of picks, rejects keeping the rotation that led to them."""
    total, at, held = 0.0, None, None
    for (k, turns, costs), p in zip(rows, picks):
        if p < 0:
            total, held = total + reject, turns[0] if held is None else held
        else:
            if held is not None:
                angle = 2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(held, turns[p])))))
                total += (angle / (sigma * math.sqrt(max(1, k - at)))) ** 2
            total, held = total + min(costs[p] / scale, 30.0), turns[p]
        at = k
    return total


def test_path_without_worthwhile_rejects_is_the_cheapest(spark):
    rng = random.Random(5)
    for trial in range(3):
        places = sorted(rng.sample(range(14), 7))
        rows = [(k, [turn(rng.uniform(-2, 2)), turn(rng.uniform(-2, 2))], [rng.random(), rng.random()]) for k in places]
        gaps = [(k, None, None) for k in range(14) if k not in places]
        df = spark.createDataFrame([(1, *r) for r in rows + gaps], "s int, k long, turns array<array<double>>, costs array<double>")
        got = {r.k: r.choice for r in cleaning.choose_hypotheses(df, "s", "k", "turns", "costs", 0.7, 0.2, 1e6).collect()}
        best = min(itertools.product(range(2), repeat=7), key=lambda p: walked(p, rows, 0.7, 0.2, 1e6))
        assert [got[k] for k in places] == list(best)
        assert all(got[k] == -1 for k, *_ in gaps)


def test_a_row_that_fits_nothing_is_rejected(spark):
    rows = [(1, k, [turn(2.5 if k == 5 else 0.1), turn(-2.5 if k == 5 else 3.0)], [0.0, 0.0]) for k in range(10)] + [(None, 0, [turn(1.0)], [0.5])]
    df = spark.createDataFrame(rows, "s int, k long, turns array<array<double>>, costs array<double>")
    got = cleaning.choose_hypotheses(df, "s", "k", "turns", "costs", 0.3, 1.0, 4.0).collect()
    assert {r.k: r.choice for r in got if r.s == 1} == {k: -1 if k == 5 else 0 for k in range(10)}
    assert [r.choice for r in got if r.s is None] == [0]


def test_anchored_path_is_the_cheapest(spark):
    rng = random.Random(9)
    offsets, rows = [-1.0, 0.0, 1.0], []
    for s in (1, 2):
        rows += [(s, k, None if k == 3 else [rng.random() for _ in offsets], s == 1 and k == 2) for k in range(7)]
    df = spark.createDataFrame([*rows, (None, 0, [0.1, 0.5, 0.2], True)], "s int, k long, costs array<double>, bad boolean")
    for ends in (True, False):
        told = cleaning.anchored_path(df, "s", ["k"], "costs", F.col("bad"), offsets, 0.3, ends).orderBy("s", "k").collect()
        own = [[1e6 * (o != 0) for o in offsets] if c is None or (ends and k in (0, 6)) else c for s, k, c, _ in rows if s == 1]
        price = lambda p: sum(own[k][j] for k, j in enumerate(p)) + 0.3 * sum((offsets[a] - offsets[b]) ** 2 for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = min(itertools.product(range(3), repeat=7), key=price)
        assert [r.offset for r in told if r.s == 1] == [offsets[j] for j in best]
        assert {r.offset for r in told if r.s == 2} == {0.0}
        assert [r.offset for r in told if r.s is None] == [0.0 if ends else -1.0]


def test_bridge_spans_the_step_and_later_ones_win(spark):
    xs = [0.0] * 20 + [100.0] * 20
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(xs)], "s int, k long, x double")
    got = [r.bridged for r in cleaning.bridges(df, "s", "k", "x", 60.0).orderBy("k").collect()]
    assert [k for k, v in enumerate(got) if v is not None] == list(range(13, 27))
    assert got[13] == 0.0 and got[26] == 100.0 and all(a <= b for a, b in zip(got[13:27], got[14:27]))
    two = xs[:20] + [100.0] * 5 + [0.0] * 15
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(two)], "s int, k long, x double")
    got = [r.bridged for r in cleaning.bridges(df, "s", "k", "x", 60.0).orderBy("k").collect()]
    assert got[18] == 0.0 and abs(got[31]) < 1e-9 and got[17] < 35.0


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "s int, k long, x double")
    assert cleaning.bridges(empty, "s", "k", "x", 1.0).count() == cleaning.contiguous(empty, "s", "k").count() == cleaning.timing_summary(empty, "s", "x").count() == 0
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (1, 0, 2.0), (1, 2, 3.0), (2, None, None), (3, 0, 1.0), (3, 0, 1.0)], "s int, k long, x double")
    told = {r.s: (r.contiguous, r.first_wrong) for r in cleaning.contiguous(df, "s", "k").collect()}
    assert told == {None: (True, None), 1: (False, 1), 2: (False, 0), 3: (False, 1)}
    summary = {r.s: (r.n, r.mean, r.high) for r in cleaning.timing_summary(df, "s", "x").collect()}
    assert summary == {None: (1, 1.0, 1.0), 1: (2, 2.5, 2.0), 3: (2, 1.0, 1.0)}
    medians = {r.s: (r.samples, r.median_mid) for r in cleaning.guarded_medians(df, "s", "x", 2).collect()}
    assert medians == {None: (1, None), 1: (2, 2.5), 3: (2, 1.0)}
    held = cleaning.sample_and_hold(df, "s", "k", "x", F.col("x").isNotNull(), 2).where("s = 1").orderBy("k").collect()
    assert [r.held for r in held] == [2.0, 2.0]
    wide = cleaning.aligned({"a": df, "b": df.where("s = 3")}, "s", "k")
    assert {(r.s, r.k, r.a is None, r.b is None) for r in wide.collect()} == {(None, 0, False, True), (None, 1, False, True), (1, 0, False, True), (1, 2, False, True), (2, None, False, True), (3, 0, False, False)}
    share = spark.createDataFrame([([[0.5, 0.5], [1.2, 0.0]],), ([],), (None,)], "p array<array<double>>").select(cleaning.outside_share(F.col("p")).alias("v")).collect()
    assert [r.v for r in share] == [0.5, None, None]
