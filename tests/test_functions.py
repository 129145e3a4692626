"""Analytic expectations and odd rows of the column functions and operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import quaternions as q
from seriesloom.functions.scalars import round_up_half, soft_clamp
from seriesloom.functions.text import bone_class, csv_cell, normalise_word
from seriesloom.operators import folds, gaps, lookup, relations, robust, rotations, scans, timeline
from seriesloom.sources import records


def values(spark, xs, valid=None):
    return spark.createDataFrame([(1, k, x, True if valid is None else valid[k]) for k, x in enumerate(xs)], "s int, k long, x double, ok boolean")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("s", "k").collect()]


def test_rounding_and_clamping(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (0.15,)], "x double").select(round_up_half(F.col("x")).alias("r")).collect()
    assert [r.r for r in got] == [-2.0, 3.0, 0.0]
    soft = spark.createDataFrame([(0.0,), (5.0,), (50.0,)], "x double").select(soft_clamp(F.col("x"), 1.0, 9.0, 1.0).alias("r")).collect()
    assert 1.0 <= soft[0].r < 2.0 and soft[1].r == 5.0 and 8.0 < soft[2].r <= 9.0


def test_swing_and_twist_make_the_rotation(spark):
    rng = random.Random(7)
    unit = lambda n: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rng.gauss(0, 1) for _ in range(n)])
    rows = spark.createDataFrame([(unit(3), unit(4)) for _ in range(100)], "a array<double>, q array<double>")
    parts = rows.withColumn("s", q.swing(F.col("q"), F.col("a"))).withColumn("t", q.twist(F.col("q"), F.col("a")))
    made = parts.select(q.let(F.col("s"), lambda s: q.let(F.col("t"), lambda t: q.multiply(s, t))).alias("m"), q.dot(F.col("s"), F.col("a"), 3).alias("d"), "q")
    for r in made.collect():
        assert all(abs(x - y) < 1e-9 for x, y in zip(r.m, r.q)) and abs(r.d) < 1e-9


def test_zero_phase(spark):
    wave = [math.sin(2 * math.pi * 1.5 * k / 30) for k in range(600)]
    got = column(scans.zero_phase(values(spark, wave), "s", "k", "x", 7.0, 30.0), "smooth")
    assert max(abs(a - b) for a, b in zip(got[30:-30], wave[30:-30])) < 0.02
    buzz = column(scans.zero_phase(values(spark, [(-1.0) ** k for k in range(300)]), "s", "k", "x", 7.0, 30.0), "smooth")
    assert max(map(abs, buzz[30:-30])) < 0.05
    assert column(scans.zero_phase(values(spark, [1.0, 5.0]), "s", "k", "x", 7.0, 30.0), "smooth") == [1.0, 5.0]


def test_limit_rate_is_symmetric(spark):
    spike = [100.0 if k == 25 else 0.0 for k in range(51)]
    got = column(folds.limit_rate(values(spark, spike), "s", ["k"], "x", 10.0), "limited")
    assert all(abs(b - a) <= 10 + 1e-9 for a, b in zip(got, got[1:])) and all(abs(a - b) < 1e-9 for a, b in zip(got, got[::-1]))


def test_hampel_flags_only_the_spike(spark):
    xs = [0.0] * 20 + [1.0] * 20
    xs[10] = 5.0
    got = column(robust.hampel(values(spark, xs), "s", "x", F.col("ok"), 4, 3.5, 0.1), "outlier")
    assert [k for k, f in enumerate(got) if f] == [10]


def test_filling(spark):
    got = column(gaps.pchip_fill(values(spark, [0.0, 1.0, 2.0, None, None, None, 6.0, 7.0, 8.0]), "s", "x"))
    assert all(b >= a for a, b in zip(got, got[1:])) and max(got) <= 8.0
    edged = column(gaps.pchip_fill(values(spark, [None, None, 5.0, None, 7.0, 9.0, None, None]), "s", "x", edges=True))
    assert edged[:3] == [5.0] * 3 and edged[-2:] == [9.0] * 2 and 5 < edged[3] < 7
    assert column(gaps.pchip_fill(values(spark, [None, None]), "s", "x", edges=True)) == [None, None]
    assert column(gaps.hold_nearest(values(spark, [None, 1.0, None, None, 4.0]), "s", "x")) == [1.0, 1.0, 1.0, 4.0, 4.0]
    assert gaps.pchip_fill(values(spark, [1.0]).limit(0), "s", "x").count() == 0


def test_timeline_pushes_and_tells(spark):
    frames = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.01), (1, 2, 0.02), (1, 3, 0.5), (1, 4, 0.4)], "s int, i long, t double")
    got = timeline.to_slots(frames, "s", "i", "t", 1 / 30).orderBy("i").collect()
    assert [r.k for r in got] == [0, 1, 2, 15, 16] and [r.backward for r in got] == [False, False, False, False, True] and got[2].late


def test_viterbi_is_the_cheapest_path(spark):
    rng = random.Random(2)
    angles = [0.0, 2.0, 4.0]
    costs = [[rng.random() for _ in angles] for _ in range(6)]
    frame = spark.createDataFrame([(1, k, c) for k, c in enumerate(costs)], "s int, k long, c array<double>")
    got = column(folds.viterbi(frame, "s", ["k"], "c", angles, 1.5), "choice")

    def cost(path):
        total = sum(costs[k][p] for k, p in enumerate(path))
        for a, b in zip(path, path[1:]):
            d = angles[b] - angles[a]
            total += (math.atan2(math.sin(d), math.cos(d)) / 1.5) ** 2
        return total

    from itertools import product

    assert abs(cost(got) - min(cost(p) for p in product(range(3), repeat=6))) < 1e-9


def test_folds_keep_odd_rows(spark):
    rows = spark.createDataFrame([(None, 0, None, 0.0), (None, 1, 2.0, 1.0), (1, 0, float("nan"), 0.0), (1, 1, 3.0, 1.0), (1, 2, None, 1.0)], "s int, k long, x double, t double")
    got = {(r.s, r.k): r.smooth for r in folds.one_euro(rows, "s", ["k"], "x", "t").collect()}
    assert got == {(None, 0): 0.0, (None, 1): 2.0, (1, 0): 0.0, (1, 1): 3.0, (1, 2): 3.0}
    assert folds.one_euro(rows.limit(0), "s", ["k"], "x", "t").count() == 0


def test_rotation_averages(spark):
    half = math.sqrt(0.5)
    rows = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 1.0]), (1, [0.0, half, 0.0, half]), (1, [0.0, -half, 0.0, -half])], "g int, q array<double>")
    mean = rotations.average(rows, "g", "q").first().average
    assert abs(2 * math.atan2(mean[1], mean[3]) - math.pi / 3) < 0.2
    rng = random.Random(3)
    points = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(20)]
    turned = [[-y + 1, x + 2, z - 3] for x, y, z in points]
    pairs = spark.createDataFrame([(1, p, t) for p, t in zip(points, turned)], "g int, p array<double>, t array<double>")
    fit = rotations.fitted_rotation(pairs, "g", "p", "t").first().rotation
    assert all(abs(a - b) < 1e-9 for a, b in zip(fit, [0.0, 0.0, half, half]))


def test_phrases(spark):
    glosses = spark.createDataFrame([(0, "thankyou"), (1, "call"), (2, "callonphone"), (3, "icecream"), (4, "go")], "place int, gloss string")
    table = lookup.phrase_table(glosses)
    texts = spark.createDataFrame([(1, "Thank you, call on phone now! -- I go"), (2, "  "), (3, None), (4, "ice, cream call")], "id int, text string")
    got = [(r.id, r.text, r.gloss) for r in lookup.find_phrases(texts, ["id"], "text", table).orderBy("id", "place").collect()]
    assert got == [(1, "Thank you,", "thankyou"), (1, "call on phone", "callonphone"), (1, "now!", None), (1, "I", None), (1, "go", "go"), (4, "ice, cream", "icecream"), (4, "call", "call")]


def test_text_cells_and_classes(spark):
    row = spark.createDataFrame([('a"b,c', "l1\nl2", "plain", "index_1", "hand_l", "spine")], "a string, b string, c string, d string, e string, f string")
    got = row.select(*(csv_cell(F.col(c)).alias(c) for c in "abc"), *(bone_class(F.col(c)).alias(c) for c in "def"), normalise_word(F.lit("Don't!")).alias("g")).first()
    assert tuple(got) == ('"a""b,c"', '"l1\nl2"', "plain", "finger", "wrist", "trunk", "dont")


def test_review_file_and_records(spark, tmp_path):
    frame = spark.createDataFrame([("b", 1, "q1", "p", "approved", "me", 'two\nlines, "x"', "f"), ("a", 2, "q2", "p", "rejected", "me", "", "g")], ", ".join(f"{c} {'int' if c == 'rank' else 'string'}" for c in relations.REVIEW_COLUMNS))
    relations.write_review_file(frame, str(tmp_path / "csv"), ["sign"])
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert text == ",".join(relations.REVIEW_COLUMNS) + '\r\na,2,q2,p,rejected,me,,g\r\nb,1,q1,p,approved,me,"two\nlines, ""x""",f\r\n'
    stored = spark.createDataFrame([('{"go": {"decision": "approved", "sequenceId": "s1"}, "no": {"decision": "maybe", "sequenceId": "s"}, "x": {"decision": "rejected"}}',), ("not json",), (None,), ("[]",)], "json string")
    assert [tuple(r) for r in records.parse_reviews(stored).collect()] == [("go", "s1", "approved", "", "", "")]


def test_raw_clips(spark, tmp_path):
    import gzip
    import json

    clip = {"schema": "raw", "schemaVersion": 1, "clipId": "c", "layout": {"faceIndices": [7, 9]}, "frames": [
        {"i": 0, "pts": 0, "t": 0.0, "pose": [1, 2, 3, 0.5, 0.5], "poseWorld": None, "leftHand": [1, 2], "rightHand": [], "face": [1, 2, 3, 4, 5, 6]}, {"i": 1, "pts": 5, "t": 0.1}]}
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(json.dumps(clip).encode()))
    got = records.read_raw_clips(spark, str(tmp_path / "c.json.gz")).orderBy("i").collect()
    assert [tuple(p) for p in got[0].pose] == [(1.0, 2.0, 3.0)] and got[0].leftHand is None and got[0].rightHand == [] and got[0].face[9].x == 4.0
    assert got[1].pose is None and got[1].face is None


def test_rig_and_library_blocks(spark, tmp_path):
    import json
    import struct

    import numpy as np

    body = json.dumps({"nodes": [{"name": "root", "children": [1]}, {"name": "hand_l", "translation": [0, 1, 0]}], "skins": [{"joints": [1]}]}).encode()
    (tmp_path / "rig.glb").write_bytes(struct.pack("<4sIIII", b"glTF", 2, 20 + len(body), len(body), 0x4E4F534A) + body)
    rig = records.read_rig(spark, str(tmp_path / "rig.glb"))
    assert [(r.node, r.parent, r.is_joint) for r in rig.orderBy("idx").collect()] == [("root", None, False), ("hand_l", "root", True)]
    assert relations.closure(rig.select("node", "parent")).count() == 3
    data = np.arange(3 * 2 * 4, dtype="<i2")
    (tmp_path / "lib.bin").write_bytes(data.tobytes())
    layout = spark.createDataFrame([("raw", "one", 0, 1), ("raw", "two", 1, 2)], "variant string, word string, offset long, frames int")
    got = records.read_library_blocks(spark, str(tmp_path / "lib.bin"), layout, ["a", "b"]).where("word = 'two' and frame = 1 and bone = 'b'").first()
    assert list(got.q) == [20, 21, 22, 23]


@pytest.mark.parametrize("times", [["0", "1"]])
def test_latest_and_violations(spark, times):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, at int, v string")
    assert [r.k for r in relations.latest(log, "k", "at", F.col("v").isNull()).collect()] == ["b"]
    assert sorted(r.failed for r in relations.violations(log, has=F.col("v").isNotNull(), late=F.col("at") > 1).collect()) == ["has", "late", "late"]


def test_viterbi_query_chooses_among_48_angles(spark):
    from seriesloom.plans import catalogue
    from seriesloom.plans.inputs import rows

    sf = "/root/testdata/sf0.001"
    user = rows(spark, sf).groupBy("user_id").count().orderBy("count").first().user_id
    values = [r.value for r in rows(spark, sf).where(f"user_id = {user}").orderBy("i").collect()]
    angles = [-math.pi + 2 * math.pi * k / 48 for k in range(48)]
    move = [[(math.atan2(math.sin(b - a), math.cos(b - a)) / 0.8) ** 2 for b in angles] for a in angles]
    totals, back = [1 - math.cos(values[0] - a) for a in angles], []
    for v in values[1:]:
        back.append([min(range(48), key=lambda a: totals[a] + move[a][b]) for b in range(48)])
        totals = [totals[back[-1][b]] + move[back[-1][b]][b] + 1 - math.cos(v - angles[b]) for b in range(48)]
    path = [min(range(48), key=totals.__getitem__)]
    for pointers in reversed(back):
        path.insert(0, pointers[path[0]])
    got = catalogue.QUERIES["viterbi_path"](spark, sf).where(f"user_id = {user}").orderBy("i").collect()
    assert [r.choice for r in got] == path


def turn(angle):
    return [0.0, 0.0, math.sin(angle / 2), math.cos(angle / 2)]


def turns(frame, name):
    return [2 * math.atan2(q[2], q[3]) for q in (r[name] for r in frame.orderBy("k").collect())]


def test_rotation_filters_about_one_axis_are_the_scalar_ones(spark):
    rng = random.Random(8)
    angles = [0.2 + 0.6 * math.sin(k / 4) + rng.uniform(-0.2, 0.2) for k in range(40)]
    rows = [(1, k, k / 30, a, [x * (-1) ** (k // 7) for x in turn(a)]) for k, a in enumerate(angles)]
    frame = spark.createDataFrame(rows, "s int, k int, t double, a double, q array<double>")

    def near(got, want):
        wrapped = [math.atan2(math.sin(a - b), math.cos(a - b)) for a, b in zip(got, want, strict=True)]
        assert max(map(abs, wrapped)) < 1e-9

    near(turns(rotations.limit_rate(frame, "s", ["k"], "q", 0.1), "limited"), [r.limited for r in folds.limit_rate(frame, "s", ["k"], "a", 0.1).orderBy("k").collect()])
    near(turns(rotations.limited_steps(frame, "s", ["k"], "q", "t", 3.0), "limited"), [r.limited for r in folds.limited_steps(frame, "s", ["k"], "a", "t", 3.0).orderBy("k").collect()])
    plain = folds.one_euro(frame, "s", ["k"], "a", "t", 1.0, 0.0)
    near(turns(rotations.one_euro(frame, "s", ["k"], "q", "t", 1.0, 0.0), "smooth"), [r.smooth for r in plain.orderBy("k").collect()])


def test_rotations_low_pass(spark):
    angles = [0.3 + 0.5 * (k % 2) for k in range(30)]
    frame = spark.createDataFrame([(1, k, [x * (-1) ** (k // 7) for x in turn(a)]) for k, a in enumerate(angles)] + [(2, 0, [0.0, 0.0, 0.0, -1.0])], "s int, k int, q array<double>")
    got = rotations.zero_phase(frame, "s", "k", "q", 2.0, 30.0)
    assert all(abs(sum(x * x for x in r.smooth) - 1) < 1e-9 for r in got.collect())
    assert got.where("s = 2").first().smooth == [0.0, 0.0, 0.0, -1.0]
    middle = turns(got.where("s = 1"), "smooth")[10:20]
    assert all(abs(a - 0.55) < 0.02 for a in middle)


def test_fast_motion_is_explained_by_its_source(spark):
    clean = spark.createDataFrame([("L", k, [x, 0.0, z], [0.0, 0.0, 0.0], 0.5) for k, x, z in ((0, 0.0, 0.0), (1, 0.3, 0.4), (2, 0.3, 0.4), (4, 1.0, 0.0))], "side string, k int, wrist array<double>, hand array<double>, width double")
    events = spark.createDataFrame([("L", 1, 0.6), ("L", 2, 0.6), ("L", 4, 0.6)], "side string, k int, jump double")
    got = relations.fast_motion_check(events, clean, ["side"], "k", "jump", "wrist", "hand", "width").orderBy("k").collect()
    assert [(r.wrist_step, r.hand_step, r.plane_step, r.ratio, r.explained) for r in got] == [(0.25, 0.0, 0.15, 2.4, True), (0.0, 0.0, 0.0, 600.0, False), (None, None, None, None, None)]


def test_null_series_and_repeated_keys_are_kept(spark):
    from seriesloom.operators import gaps, lookup, robust, timeline

    slots = spark.createDataFrame([(None, 2, 1.0), (None, 5, 2.0), ("a", 0, 3.0), ("a", 9000, 4.0), ("b", None, 5.0)], "s string, k long, v double")
    grid = timeline.dense_grid(slots, "s", ["v"]).collect()
    assert sorted(r.k for r in grid if r.s is None) == list(range(6)) and sorted(r.k for r in grid if r.s == "a") == list(range(9001))
    assert {(r.s, r.k): r.v for r in grid if r.v is not None} == {(None, 2): 1.0, (None, 5): 2.0, ("a", 0): 3.0, ("a", 9000): 4.0}
    holes = gaps.gap_classes(timeline.dense_grid(slots, "s", ["v"]), "s", F.col("v").isNotNull()).collect()
    assert sorted((str(r.s), r.start, r.end, r.kind) for r in holes) == [("None", 0, 2, "edge"), ("None", 3, 5, "short"), ("a", 1, 9000, "long")]
    gated = robust.residual_gate(spark.createDataFrame([(None, 1.0), ("g", 1.0)], "g string, r double"), "g", "r")
    assert [r.accepted for r in gated.collect()] == [True, True]
    phrases = spark.createDataFrame([("one two", "PAIR", 2)], "phrase string, gloss string, words int")
    texts = spark.createDataFrame([(1, "go one"), (1, "one two three"), (None, "one"), (1, "go one"), (2, None), (2, " ")], "id long, text string")
    got = sorted((str(r.id), r.place, r.text, str(r.gloss)) for r in lookup.find_phrases(texts, ["id"], "text", phrases).collect())
    assert got == sorted([("1", 0, "go", "None"), ("1", 1, "one", "None")] * 2 + [("1", 0, "one two", "PAIR"), ("1", 2, "three", "None"), ("None", 0, "one", "None")])


def test_fits_leave_out_odd_vectors(spark):
    """NaN, null and infinite parts; groups with nothing else get null."""
    nan, inf = float("nan"), float("inf")
    q = [0.0, 0.0, math.sin(0.2), math.cos(0.2)]
    rows = [("a", q, [1.0, 0.0, 0.0]), ("a", [nan, 0.0, 0.0, 1.0], [nan, 0.0, 0.0]), ("a", None, None), ("a", [None, 0.0, 0.0, 1.0], [inf, 1.0, 1.0]), ("b", [nan] * 4, [nan] * 3), ("c", None, None), (None, q, [0.0, 0.0, -2.0])]
    frame = spark.createDataFrame(rows, "g string, q array<double>, v array<double>")
    means = {r.g: r.average for r in rotations.average(frame, "g", "q").collect()}
    assert means["a"] == pytest.approx(q) and means[None] == pytest.approx(q) and means["b"] is means["c"] is None
    axes = {r.g: r.axis for r in rotations.dominant_axis(frame, "g", "v").collect()}
    assert axes["a"] == pytest.approx([1.0, 0.0, 0.0]) and axes[None] == pytest.approx([0.0, 0.0, 1.0]) and axes["b"] is axes["c"] is None
    turned = [("a", [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ("a", [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]), ("a", [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]), ("a", [nan, 0.0, 0.0], [0.0] * 3), ("a", None, [1.0] * 3), ("b", [1.0, nan, 0.0], [1.0, 0.0, 0.0]), ("c", None, None)]
    fits = {r.g: r.rotation for r in rotations.fitted_rotation(spark.createDataFrame(turned, "g string, p array<double>, t array<double>"), "g", "p", "t").collect()}
    assert fits["a"] == pytest.approx([0.0, 0.0, math.sqrt(0.5), math.sqrt(0.5)]) and fits["b"] is fits["c"] is None
    assert rotations.average(frame.limit(0), "g", "q").count() == 0


def test_dominant_axis_of_a_plain_version(spark):
    """The line with the greatest sum of squared projections, among many directions."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(g, (rng.normal(size=3) * [3, 1, 0.5]).tolist()) for g in range(3) for _ in range(50)]
    got = {r.g: np.array(r.axis) for r in rotations.dominant_axis(spark.createDataFrame(rows, "g int, v array<double>"), "g", "v").collect()}
    tried = rng.normal(size=(20_000, 3))
    tried /= np.linalg.norm(tried, axis=1)[:, None]
    for g, axis in got.items():
        own = np.array([v for h, v in rows if h == g])
        best = ((own @ tried.T) ** 2).sum(axis=0).max()
        assert abs(np.linalg.norm(axis) - 1) < 1e-9 and ((own @ axis) ** 2).sum() >= best - 1e-9


def test_rotations_with_gaps_are_filtered(spark):
    """A null rotation stays null; its neighbours are filtered as if it weren't there."""
    turn = [[0.0, 0.0, math.sin(k / 80), math.cos(k / 80)] for k in range(60)]
    gaps_ = [None if k in (0, 17, 18) else [float("nan")] * 4 if k == 30 else [-x for x in v] if k > 40 else v for k, v in enumerate(turn)]
    frame = spark.createDataFrame([("a", k, v) for k, v in enumerate(gaps_)] + [("b", 0, None), ("b", 1, turn[5])], "s string, k int, q array<double>")
    got = {(r.s, r.k): r.smooth for r in rotations.zero_phase(frame, "s", "k", "q", 5.0, 30.0, block=16).collect()}
    without = spark.createDataFrame([("a", k, v) for k, v in enumerate(turn) if k not in (0, 17, 18, 30)], "s string, k int, q array<double>")
    want = {r.k: r.smooth for r in rotations.zero_phase(without, "s", "k", "q", 5.0, 30.0).collect()}
    for k in range(60):
        assert (got["a", k] is None) == (k in (0, 17, 18, 30))
        assert got["a", k] is None or got["a", k] == pytest.approx(want[k], abs=1e-9)
    assert got["b", 0] is None and got["b", 1] == turn[5]


def test_class_statistics_of_named_tracks(spark):
    rows = [("b", 1, 2.0, 1.0), ("b", 1, 5.0, 1.0), ("a", 1, 5.0, 2.0), ("c", 1, 1.0, 1.0), ("d", 2, None, None)]
    frame = spark.createDataFrame(rows, "track string, kind int, step double, acc double")
    got = {r.kind: (r.greatest_step, r.worst_track) for r in relations.class_statistics(frame, "track", "kind", "step", "acc", 1.0).collect()}
    assert got == {1: (5.0, "a"), 2: (None, None)}
