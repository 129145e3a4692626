"""Odd rows of points, calibration, review scores and picks; examples of the small functions; lone turns against a plain version."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import landmarks, scalars, text
from seriesloom.operators import calibration, folds, lookup, reviewing
from seriesloom.sources import records

P = "struct<x: double, y: double, z: double>"


def test_points_that_are_missing(spark):
    rows = [(1, [(0.5, 0.25, 0.1)] * 3, None), (2, None, (1.0, 2.0, 3.0)), (3, [], None)]
    frame = spark.createDataFrame(rows, f"i int, p array<{P}>, m {P}")
    got = {r.i: r for r in frame.select("i", landmarks.subset(F.col("p"), [1, 5]).alias("s"), landmarks.to_model(landmarks.at(F.col("p"), 0), 100.0, 50.0, 2.0).alias("t"), landmarks.from_model(F.col("m"), 100.0, 50.0).alias("b"), landmarks.hand_centroid(F.col("p"), F.col("m"), 1.0, 1.0, F.lit(1.0), 1.0).alias("c")).collect()}
    assert got[1].s[1].x == 0.5 and got[1].s[5] is None and got[2].s is None and got[3].s == {1: None, 5: None}
    assert tuple(got[1].t) == (50.0, -12.5, -20.0) and got[2].t is None and tuple(got[2].b) == (0.01, -0.04, -0.03) and got[1].b is None
    assert got[1].c is got[2].c is got[3].c is None


def test_bodies_that_are_too_short(spark):
    Q = "struct<x: double, y: double, z: double, visibility: double>"
    full = [(k / 33, 0.5, 0.0, None if k == 15 else 1.0) for k in range(33)]
    frame = spark.createDataFrame([(1, full, full), (2, full[:32], full), (3, None, full)], f"i int, p array<{Q}>, w array<{Q}>")
    none = F.lit(None).cast("struct<x: double, y: double>")
    got = {r.i: r.b for r in frame.select("i", landmarks.body_sample(F.col("p"), F.col("w"), {"left": none, "right": none}, 1.0, 1.0, F.lit(1.0), F.lit(1.0)).alias("b")).collect()}
    assert got[2] is got[3] is None
    assert got[1].left.wrist_confidence == 0.0 and got[1].right.wrist_confidence == 1.0 and got[1].left.wrist_source == "pose" and got[1].valid


def test_params_round_trip(spark):
    frame = spark.createDataFrame([([float(k) for k in range(21)],), ([1.0],), (None,)], "v array<double>")
    got = [r.f for r in frame.select(landmarks.flat_params(landmarks.nested_params(F.col("v"))).alias("f")).collect()]
    assert got == [[float(k) for k in range(21)], [1.0] + [None] * 20, None]


def test_calibration_filters(spark):
    hands = [(1, [(0.0, 1.0, 0.0)] * 21), (2, [(0.5, 0.5, 0.0)] * 20 + [(1.01, 0.5, 0.0)]), (3, []), (4, None), (5, [None] * 21)]
    got = spark.createDataFrame(hands, f"i int, p array<{P}>").select("i", calibration.wholly_in_frame(F.col("p")).alias("ok")).collect()
    assert {r.i for r in got if r.ok} == {1}
    facing = spark.createDataFrame([((0.0, 0.0, -0.6),), ((0.8, 0.0, 0.55),), (None,)], f"n {P}").select(calibration.faces_camera(F.col("n")).alias("f")).collect()
    assert [r.f for r in facing] == [True, False, False]
    straight = spark.createDataFrame([(0.4, -0.4), (0.44, 0.0), (None, 0.0)], "a double, b double").select(calibration.is_straight(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in straight] == [True, False, False]


def test_segments_and_widths(spark):
    line = [(k * 0.1, 0.0, 0.0) for k in range(21)]
    deep = [(k * 0.1, 0.0, k * 0.05) for k in range(21)]
    flat = [(0.0, 0.0, 0.0)] * 21
    frame = spark.createDataFrame([("a", line), ("a", deep), ("b", flat), ("b", None)], f"g string, p array<{P}>")
    samples = calibration.segment_samples(frame, "p", ["g"]).collect()
    assert len(samples) == 15 and all(r.g == "a" and r.share == pytest.approx(0.1 / 0.9) for r in samples)
    Q = "struct<x: double, y: double, z: double, visibility: double>"
    body = [("a", (0.0, 0.0, 0.0, 0.9), (0.5, 0.0, 0.0, 0.5)), ("a", (0.0, 0.0, 0.0, 0.9), (0.1, 0.0, 0.0, 0.5)), ("b", (0.0, 0.0, 0.0, 0.4), (0.5, 0.0, 0.0, 0.9)), (None, (0.0, 0.0, 0.0, 1.0), (0.3, 0.4, 0.0, 1.0))]
    told = {r.g: (r.shoulder_px, r.shoulder_m) for r in calibration.shoulder_widths(spark.createDataFrame(body, f"g string, l {Q}, r {Q}"), "g", "l", "r", "l", "r", 10.0, 10.0).collect()}
    assert told["a"] == (5.0, 0.5) and told["b"] == (None, None) and told[None] == pytest.approx((5.0, 0.5))


def plain_picks(rows, apart, looked_at):
    out = []
    for clip in {r[0] for r in rows}:
        chosen = []
        for place in sorted({r[2] for r in rows if r[0] == clip}):
            own = sorted((-r[4], r[1], r[3]) for r in rows if r[0] == clip and r[2] == place and r[4] is not None and math.isfinite(r[4]))[:looked_at]
            for _, k, label in own:
                if all(abs(k - c) > apart for c in chosen):
                    chosen.append(k)
                    out.append((clip, label, k))
                    break
    return sorted(out, key=repr)


def test_picks_against_plain(spark):
    rng = random.Random(7)
    rows = [(c, k, p, f"kind {p}", None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else rng.randint(0, 6) / 2) for c in ("x", "y", None) for k in range(60) for p in range(5)]
    frame = spark.createDataFrame(rows, "clip string, k int, place int, label string, score double").repartition(4)
    for apart, looked_at in ((9, 2_000), (14, 3), (100, 2_000)):
        got = reviewing.labelled_picks(frame, "clip", "k", "place", "label", "score", apart, looked_at)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_picks(rows, apart, looked_at)


def test_scores_of_untracked_frames(spark):
    angles = [70.0, 80.0, 90.0, 75.0]
    frame = spark.createDataFrame([("c", 0, angles, angles, True), ("c", 1, angles, angles, None), ("c", 2, None, None, True), ("c", 3, [1.0] * 4, [2.0] * 4, True)], "c string, k int, b array<double>, m array<double>, on boolean")
    got = {r.k: (r.fast, r.fist, r.pointing, r.open) for r in reviewing.finger_scores(frame, "c", "k", "b", "m", "on").collect()}
    assert got == {0: (0.0, 70.0, None, None), 1: (None,) * 4, 2: (None,) * 4, 3: (89.0, None, None, -3.0)}


# ---- a turn that neither neighbour shares, judged row by row


def test_lone_turns_against_plain(spark):
    rng = random.Random(19)
    turn = lambda a: [0.0, 0.0, math.sin(a / 2), math.cos(a / 2)]
    rows = []
    for s in ("a", "b", None):
        for k in range(60):
            rows.append((s, k, turn(rng.choice([0.0, 0.1, 2.0, 2.6]) + rng.gauss(0, 0.05)), rng.random() > 0.2))
    frame = spark.createDataFrame(rows, "s string, k int, q array<double>, ok boolean").repartition(3)
    got = {(r.s, r.k): r.kept for r in folds.clear_lone_turns(frame, "s", ["k"], "q", "ok", far=1.2, near=0.8).collect()}
    angle = lambda a, b: 2 * math.acos(min(1.0, abs(sum(x * y for x, y in zip(a, b)))))
    want = {}
    for s in ("a", "b", None):
        own = [r for r in rows if r[0] == s]
        valid = [r[3] for r in own]
        for k, (_, _, q, _) in enumerate(own):
            before = [own[j][2] for j in range(k - 1, max(k - 4, -1), -1) if valid[j]]
            behind = [own[j][2] for j in range(k + 1, min(k + 4, 60)) if own[j][3]]
            if valid[k] and before and behind and angle(q, before[0]) > 1.2 and angle(q, behind[0]) > 1.2 and angle(before[0], behind[0]) < 0.8:
                valid[k] = False
            want[s, k] = valid[k]
    assert got == want and sum(want.values()) < sum(r[3] for r in rows)


# ---- the small functions


def test_small_functions(spark):
    frame = spark.createDataFrame([("approved", 0.49, "a=1"), ("APPROVED", 0.5, ""), (None, None, None)], "s string, t double, o string")
    got = frame.select(text.coerce(F.col("s"), ["approved", "rejected"], "open").alias("s"), scalars.frame_at(F.col("t"), 30.0).alias("f"), scalars.config_digest(F.col("o")).alias("d")).collect()
    assert [r.s for r in got] == ["approved", "open", "open"] and [r.f for r in got] == [14, 15, None]
    assert [r.d for r in got] == [hashlib.sha256(b"a=1").hexdigest()[:16], hashlib.sha256(b"").hexdigest()[:16], None]


def test_tracks_round_trip(spark, tmp_path):
    rows = [("c1", "hip", "rotation", [0.1234565, -0.0000005, 1.0]), ("c1", "arm", "rotation", []), ("c2", "hip", "rotation", None), ("c3", "hip", "translation", [None, 2.0])]
    records.write_tracks(spark.createDataFrame(rows, "clip string, bone string, path string, values array<double>"), str(tmp_path / "t"))
    got = {(r.clip, r.bone): r["values"] for r in records.read_tracks(spark, str(tmp_path / "t"), ["c1", "c3"]).collect()}
    assert got == {("c1", "hip"): [math.floor(0.1234565 * 1e6 + 0.5) / 1e6, 0.0, 1.0], ("c1", "arm"): [], ("c3", "hip"): [None, 2.0]}
    assert records.read_tracks(spark, str(tmp_path / "t")).count() == 4
    plan = records.read_tracks(spark, str(tmp_path / "t"), ["c1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(clip" in plan or "PartitionFilters: [clip" in plan


def test_stage_reports_are_appended(spark, tmp_path):
    for figure in (1.0, 2.0):
        records.append_stage_report(spark.createDataFrame([("c", "solve", figure)], "clip string, stage string, seconds double"), str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r")).orderBy("at").collect()
    assert [r.seconds for r in got] == [1.0, 2.0] and all(r["at"] is not None for r in got)


@pytest.mark.parametrize("most", [100_000, 1])
def test_phrases_by_table_and_by_join(spark, most):
    phrases = spark.createDataFrame([("thank you", "T"), ("thank", "K"), ("you very much", "Y"), ("ice cream", "I"), ("a b c d", "LONG")], "phrase string, gloss string")
    texts = spark.createDataFrame([(1, "Thank you very much, ICE -- cream"), (1, "thank  you"), (None, "a b c d"), (2, ""), (3, None), (4, " -- ")], "k int, t string")
    got = lookup.find_phrases(texts, ["k"], "t", phrases, most=most).collect()
    want = [(1, 0, "Thank you", "T"), (1, 2, "very", None), (1, 3, "much,", None), (1, 4, "ICE", None), (1, 6, "cream", None), (1, 0, "thank you", "T")]
    want += [(None, k, c, None) for k, c in enumerate("abcd")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
