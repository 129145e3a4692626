"""Faults planted one by one, and chunks put together."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import folds, validation

FILES = "clip string, schema string, version int, fps double, frames int"
TRACKS = "clip string, bone string, path string, values array<double>"


def test_motion_faults(spark):
    good = ("a", "motion", 1, 30.0, 2)
    bad = [("b", "other", 1, 30.0, 1), ("c", "motion", 2, 30.0, 1), ("d", "motion", 1, float("nan"), 1), ("e", "motion", 1, 0.0, None), ("f", None, None, None, 0), ("g", "motion", 1, 30.0, 1)]
    tracks = [("a", "hip", "rotation", [0.0] * 8), ("a", "hip", "translation", [0.0] * 6), ("a", "arm", "rotation", [0.0] * 7), ("a", "leg", "translation", None), ("z", "hip", "rotation", [])]
    tracks += [(c, "hip", "rotation", [0.0] * 4) for c in "bcd"] + [("e", "hip", "rotation", []), ("f", "hip", "rotation", [])]
    got = {tuple(r) for r in validation.motion_faults(spark.createDataFrame([good, *bad], FILES), spark.createDataFrame(tracks, TRACKS), "motion", 1).collect()}
    want = {("a", "arm", "rotation", "length"), ("a", "leg", "translation", "length"), ("z", "hip", "rotation", "no file"), ("g", None, None, "no tracks"), ("e", "hip", "rotation", "length")}
    want |= {(c, None, None, f) for c, f in [("b", "schema"), ("c", "version"), ("d", "fps"), ("e", "fps"), ("e", "frames"), ("f", "schema"), ("f", "version"), ("f", "fps"), ("f", "frames")]}
    assert got == want


WORDS = "library string, place int, word string, offset long, frames int, hold_in int, stroke int, hold_out int"
DATA = "library string, fps double, bones int, variants int, frames long, values long"


def test_index_faults(spark):
    words = [("l", 0, "a", 0, 5, 1, 3, 1), ("l", 1, "b", 5, 4, 1, 2, 1), ("m", 0, "a", 0, 5, 1, 3, 2), ("m", 1, "a", 6, 1, 0, 1, 0), ("m", 2, "c", None, None, 1, 1, 1)]
    data = [("l", 30.0, 2, 3, 9, 9 * 2 * 3 * 4), ("m", -1.0, 0, 0, 7, 1), ("n", 30.0, 1, 1, 0, 0)]
    got = {tuple(r) for r in validation.index_faults(spark.createDataFrame(words, WORDS), spark.createDataFrame(data, DATA)).collect()}
    want = {("m", "a", "timing"), ("m", "a", "word"), ("m", "a", "offset"), ("m", "c", "offset"), ("m", "c", "timing")}
    want |= {("m", None, f) for f in ("fps", "bones", "variants", "frames", "values")} | {("n", None, "words")}
    assert got == want


def test_chunks_put_together(spark):
    rows = [(s, k, float((k * 37) % 11)) for s in ("a", "b", None) for k in range(100)]
    frame = spark.createDataFrame(rows, "s string, k int, x double").repartition(4)
    whole = {(r.s, r.k): r.average for r in folds.exponential_average(frame, "s", ["k"], "x", 0.7).collect()}
    told = validation.by_chunks(frame, "s", "k", 30, 30, lambda d, s: folds.exponential_average(d, s, ["k"], "x", 0.7))
    assert told.columns == ["s", "k", "x", "average"]
    got = {(r.s, r.k): r.average for r in told.collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-9 for k in whole)
    with pytest.raises(ValueError, match="halo"):
        validation.by_chunks(frame, "s", "k", 10, 11, lambda d, s: d)


def test_controlled_order(spark):
    bones = spark.createDataFrame([("hand",), ("hip",), ("hand",), ("wing",), (None,)], "b string")
    rig = spark.createDataFrame([("hip", 3), ("hand", 9), ("toe", 1)], "n string, i int")
    assert sorted(tuple(r) for r in validation.controlled_order(bones, rig, "b", "n", "i").collect()) == [("hand", 1), ("hip", 0)]
    assert validation.controlled_order(bones.where(F.col("b") == "wing"), rig, "b", "n", "i").count() == 0
