"""Identities with memory against a plain version; typed streams against the batch operators, over a restart from their checkpoint."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import identities, rotations
from seriesloom.streaming import typed

HAND = "array<double>"
FRAMES = f"s string, t double, l {HAND}, r {HAND}, la {HAND}, ra {HAND}"


@pytest.fixture(scope="module")
def session(spark):
    before = spark.conf.get(typed.STATE_STORE[0])
    spark.conf.set(*typed.STATE_STORE)
    yield spark
    spark.conf.set(typed.STATE_STORE[0], before)


def frames(n=120, seed=4):
    """Hands that cross, hide, and are found twice."""
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        for k in range(n):
            places = {"left": (0.3 + 0.2 * math.sin(k / 9), 0.5), "right": (0.6 - 0.2 * math.sin(k / 7), 0.52)}
            hand = lambda p: [p[0] + rng.gauss(0, 0.01), p[1] + rng.gauss(0, 0.01), 0.05, p[0] + rng.gauss(0, 0.01), p[1] - 0.08]
            l, r = hand(places["left"]), hand(places["right"])
            kind = rng.random()
            if kind < 0.15:
                l, r = r, l
            elif kind < 0.3:
                l = list(r)
            elif kind < 0.4:
                l, r = None, hand(places["left"])
            elif kind < 0.5:
                l, r = hand(places["right"]), None
            elif kind < 0.55:
                l = r = None
            la = None if rng.random() < 0.3 else [places["left"][0], 0.5]
            ra = None if rng.random() < 0.3 else [places["right"][0], 0.52]
            rows.append((s, k / 30, l, r, la, ra))
    return rows


def plain_marks(rows):
    """The rules said as costs of all ways to name the hands of a frame."""
    out, places = [], {}
    for s, t, l, r, la, ra in sorted(rows, key=lambda x: (repr(x[0]), x[1])):
        last = places.setdefault(s, {"L": None, "R": None})
        near = {"L": la, "R": ra}

        def cost(h, side):
            known = [(1.0, near[side])] * (near[side] is not None) + [(0.5, last[side])] * (last[side] is not None)
            if not known:
                return None
            return sum(w * math.hypot(h[0] - p[0], h[1] - p[1]) / h[2] for w, p in known) / sum(w for w, _ in known)

        took, mark, side = {"L": ("left", l) if l else None, "R": ("right", r) if r else None}, None, None
        if l and r:
            small = min(l[2], r[2])
            if math.dist(l[:2], r[:2]) < 0.35 * small and math.dist(l[3:], r[3:]) < 0.5 * small:
                cl, cr = cost(l, "L"), cost(r, "R")
                worse = "R" if (1 if cl is None else cl) <= (1 if cr is None else cr) else "L"
                took[worse], mark, side = None, "drop", {"L": "left", "R": "right"}[worse]
            else:
                all_costs = [cost(l, "L"), cost(r, "R"), cost(l, "R"), cost(r, "L")]
                if None not in all_costs:
                    keep, swap = sum(all_costs[:2]), sum(all_costs[2:])
                    if 2 * swap < keep and keep - swap > 1.2:
                        took, mark = {"L": took["R"], "R": took["L"]}, "swap"
        elif l or r:
            own, other = ("L", "R") if l else ("R", "L")
            a, b = cost(l or r, own), cost(l or r, other)
            if a is not None and b is not None and b < 0.4 * a and a - b > 1.5:
                took, mark, side = {other: took[own], own: None}, "relabel", {"L": "left", "R": "right"}[other]
        for k in "LR":
            if took[k]:
                last[k] = took[k][1][:2]
        out.append((s, t, took["L"] and took["L"][0], took["R"] and took["R"][0], mark, side))
    return sorted(out, key=repr)


def test_identities_against_plain_rules(spark):
    rows = frames()
    frame = spark.createDataFrame(rows, FRAMES).repartition(4)
    got = identities.resolve(frame, "s", ["t"], "l", "r", "la", "ra")
    assert sorted(((r.s, r.t, r.left_from, r.right_from, r.mark, r.mark_side) for r in got.collect()), key=repr) == plain_marks(rows)
    counts = {r.s: (r.swaps, r.drops, r.relabels) for r in identities.mark_counts(got, "s").collect()}
    assert all(min(c) > 0 for c in counts.values())
    assert identities.resolve(frame.limit(0), "s", ["t"], "l", "r", "la", "ra").count() == 0


def test_one_hand_twice_and_alike(spark):
    """A tie drops the right hand; without any memory nothing is swapped or relabelled."""
    same = [0.5, 0.5, 0.1, 0.5, 0.4]
    far = [0.9, 0.5, 0.1, 0.9, 0.4]
    rows = [("x", 0.0, same, same, None, None), ("y", 0.0, far, same, None, None), ("z", 0.0, same, None, [0.5, 0.5], None), ("w", 0.0, None, None, None, None)]
    got = {r.s: (r.left_from, r.right_from, r.mark, r.mark_side) for r in identities.resolve(spark.createDataFrame(rows, FRAMES), "s", ["t"], "l", "r", "la", "ra").collect()}
    assert got == {"x": ("left", None, "drop", "right"), "y": ("left", "right", None, None), "z": ("left", None, None, None), "w": (None, None, None, None)}


def test_features_of_hands(spark):
    points = [(0.1 * k, 0.2 * k) for k in range(21)]
    made = spark.createDataFrame([(1, points), (2, points[:10]), (3, None), (4, [(float("nan"), 0.0)] * 21)], "i int, p array<struct<x:double,y:double>>").select("i", identities.hand(F.col("p")).alias("h"))
    got = {r.i: r.h for r in made.collect()}
    assert got[2] is got[3] is got[4] is None
    assert got[1] == pytest.approx([0.0, 0.0, math.hypot(0.9, 1.8), 1.2, 2.4])
    seen = spark.createDataFrame([(0.5, 0.5, 0.4), (0.5, 0.5, 0.35), (1.06, 0.5, 1.0), (None, 0.5, 1.0)], "x double, y double, v double").select(identities.anchor(F.col("x"), F.col("y"), F.col("v")).alias("a")).collect()
    assert [r.a for r in seen] == [[0.5, 0.5], None, None, None]


def run_in_two(session, frame, order, tmp_path, make, cut):
    """Streams the first part, stops, and goes on from the checkpoint with the second."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (frame.where(F.col(order) < cut), frame.where(F.col(order) >= cut)):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = session.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start()
        run.awaitTermination(240)
        assert run.exception() is None
    return session.read.parquet(out).collect()


def rotation_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        q = [0.0, 0.0, 0.0, 1.0]
        for k in range(40):
            q = [x + rng.gauss(0, 0.2) for x in q]
            size = math.sqrt(sum(x * x for x in q))
            q = [x / size * (-1 if rng.random() < 0.2 else 1) for x in q]
            rows.append((s, round(k / 30 + rng.random() / 100, 6), None if rng.random() < 0.1 else q))
    return rows


@pytest.mark.parametrize("case", ["one_euro", "limited", "identities"])
def test_streams_equal_batch_after_a_restart(session, tmp_path, case):
    if case == "identities":
        frame = session.createDataFrame([r for r in frames(40) if r[0]], FRAMES)
        want = {(r.s, r.t): (r.left_from, r.right_from, r.mark, r.mark_side) for r in identities.resolve(frame, "s", ["t"], "l", "r", "la", "ra").collect()}
        got = run_in_two(session, frame, "t", tmp_path, lambda x: typed.identities_of(x, "s", "t", "l", "r", "la", "ra"), 0.7)
        assert {(r.s, r.t): (r.left_from, r.right_from, r.mark, r.mark_side) for r in got} == want and not any(r.late for r in got)
        return
    frame = session.createDataFrame(rotation_rows(), "s string, t double, q array<double>")
    if case == "one_euro":
        want = {(r.s, r.t): r.smooth for r in rotations.one_euro(frame, "s", ["t"], "q", "t", 1.0, 0.5).collect()}
        got = {(r.s, r.t): r.smooth for r in run_in_two(session, frame, "t", tmp_path, lambda x: typed.one_euro(x, "s", "t", "q", 1.0, 0.5), 0.6)}
    else:
        want = {(r.s, r.t): r.limited for r in rotations.limited_steps(frame, "s", ["t"], "q", "t", 3.0).collect()}
        got = {(r.s, r.t): r.limited for r in run_in_two(session, frame, "t", tmp_path, lambda x: typed.limited_steps(x, "s", "t", "q", 3.0), 0.6)}
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k], abs=1e-12))


def test_rows_late_or_without_time_change_nothing(session, tmp_path):
    rows = [("a", 1.0, [0.0, 0.0, 0.0, 1.0], 1), ("a", None, [1.0, 0.0, 0.0, 0.0], 1), ("a", 0.5, [0.0, 1.0, 0.0, 0.0], 2), ("a", 2.0, [0.0, 0.0, 0.0, 1.0], 2)]
    frame = session.createDataFrame(rows, "s string, t double, q array<double>, part int")
    got = run_in_two(session, frame, "part", tmp_path, lambda x: typed.limited_steps(x, "s", "t", "q", 1.0), 2)
    assert sorted((repr(r.t), r.late, r.limited) for r in got) == [("0.5", True, None), ("1.0", False, [0.0, 0.0, 0.0, 1.0]), ("2.0", False, [0.0, 0.0, 0.0, 1.0]), ("None", True, None)]


def about(angle, axis=(0.0, 0.0, 1.0)):
    return [a * math.sin(angle / 2) for a in axis] + [math.cos(angle / 2)]


TARGETS = [("a", 5, about(1.0)), ("a", 180, about(2.0)), ("a", 4_015, about(-1.0)), ("b", 90, about(0.5)), ("b", 95, about(0.7)), ("z", 9_000, about(0.1))]


def test_easing_goes_to_rest_in_batch_and_stream(session, tmp_path):
    ease = rotations.Easing(period=50, tau=0.2)
    frame = session.createDataFrame(TARGETS, "s string, ms long, q array<double>")
    ticks = session.createDataFrame([(s, k * 50) for s in "abz" for k in range(170)], "s string, tick long")
    want = {(r.s, r.tick): (r.eased, r.stale) for r in rotations.eased(frame, ticks, "s", "ms", "q", ease).collect()}
    assert not any(s == "z" for s, _ in want)
    # towards each target, stale after 1,500 ms, then at rest and silent until the next target
    own = sorted(k for s, k in want if s == "a")
    assert own[0] == 50 and want["a", 50][0] == pytest.approx(about(1 - math.exp(-0.25)))
    assert not want["a", 1_650][1] and want["a", 1_700][1]
    gap = next(k for k, following in zip(own, own[1:]) if following > k + 50)
    assert gap < 4_000 and want["a", gap][0] == [0.0, 0.0, 0.0, 1.0] and 4_050 in own
    timed = frame.withColumn("at", F.timestamp_millis("ms")).select("s", "at", "q", "ms")
    got = run_in_two(session, timed, "ms", tmp_path, lambda x: typed.eased(x, "s", "at", "q", ease), 4_000)
    told = {(r.s, r.tick): (r.eased, r.stale) for r in got if r.tick < 8_500 and r.s != "z"}
    assert told.keys() == want.keys()
    for k in want:
        assert told[k][0] == pytest.approx(want[k][0], abs=1e-12) and told[k][1] == want[k][1]


def test_easing_strength_and_odd_targets(spark):
    ease = rotations.Easing(period=100, tau=1e-9, strength=0.5)
    frame = spark.createDataFrame([("a", 0, about(1.0)), ("a", None, about(3.0)), ("a", 50, None)], "s string, ms long, q array<double>")
    ticks = spark.createDataFrame([("a", k * 100) for k in range(3)], "s string, tick long")
    got = [r.eased for r in rotations.eased(frame, ticks, "s", "ms", "q", ease).orderBy("tick").collect()]
    assert all(q == pytest.approx(about(0.5), abs=1e-9) for q in got) and len(got) == 3
    assert rotations.eased(frame.limit(0), ticks, "s", "ms", "q", ease).count() == 0
