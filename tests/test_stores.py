"""Stores and readers: clean frames in buckets, lineage by digests, words out of binary blocks."""

from __future__ import annotations

import gzip
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.sources import blocks, clean_frames, lineage

HAND = "struct<state: string, palm_weight: double, rotation: array<double>, params: array<double>, landmarks: array<double>>"
FRAME = f"clip string, k long, t double, source int, hands struct<left: {HAND}, right: {HAND}>, body struct<valid: boolean, torso_yaw: double, wrist: map<string, array<double>>>, face struct<valid: boolean, rotation: array<double>, jaw_open: double>, raw array<double>"


def frame_rows():
    out = []
    for clip in ("a", "b", "c"):
        for k in range(20):
            hand = ("tracked", 0.123456, [0.0, 0.0, 3.0, 4.0], [-0.000015, 1e-6], None)
            out.append((clip, k, k / 30, None if k in (0, 7, 8) else k, (hand, None), (True, 0.100005, {"left": [0.1234567, None]}), (True, [0.0, 0.0, 0.0, 0.0] if k == 3 else [0.0, 2.0, 0.0, 0.0], float(k)), [0.123456789]))
    return out


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    frames = spark.createDataFrame(frame_rows(), FRAME).repartition(4)
    clean_frames.write_clean(frames, "clean_frames_test", raw=("raw",), buckets=4, path=str(tmp_path_factory.mktemp("clean") / "t"))
    yield clean_frames.read_clean(spark, "clean_frames_test")
    spark.sql("DROP TABLE clean_frames_test")


def test_rounding_of_all_nested_numbers(clean):
    row = clean.where("clip = 'a' and k = 1").first()
    assert row.t == 0.03333 and row.raw == [0.123456789]
    assert row.hands.left.palm_weight == 0.12346 and row.hands.left.params == [-0.00001, 0.0] and row.hands.left.landmarks is None and row.hands.right is None
    assert row.body.torso_yaw == math.floor(0.100005 * 1e5 + 0.5) / 1e5 and row.body.wrist == {"left": [0.12346, None]}
    assert clean.count() == 60


def test_windows_read_the_store_without_an_exchange(spark, clean):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    steps = clean.select("clip", "k", (F.col("t") - F.lag("t").over(W.partitionBy("clip").orderBy("k"))).alias("dt"))
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    assert "ReadSchema: struct<clip:string,k:bigint,t:double>" in plan
    assert steps.where("dt is null").count() == 3
    assert before == spark.conf.get("spark.sql.autoBroadcastJoinThreshold")


def test_source_pose_and_timeline(clean):
    pose = clean_frames.source_pose(clean)
    row = pose.where("clip = 'b' and k = 3").first()
    assert row.hands.left.rotation == pytest.approx([0, 0, 0.6, 0.8]) and row.hands.right is None and row.face.rotation is None and row.face.jaw_open == 3.0
    assert pose.where("k = 4").first().face.rotation == [0.0, 1.0, 0.0, 0.0]
    assert "landmarks" not in pose.select("hands")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    shown = {r.k: r.shown for r in clean_frames.playback_timeline(clean).where("clip = 'c'").collect()}
    assert [shown[k] for k in (0, 1, 6, 7, 8, 9)] == [1, 1, 6, 6, 6, 9]


def test_other_tables_are_refused(spark, tmp_path):
    spark.range(3).write.option("path", str(tmp_path / "o")).saveAsTable("other_frames_test")
    with pytest.raises(ValueError, match="not a table"):
        clean_frames.read_clean(spark, "other_frames_test")
    spark.sql("DROP TABLE other_frames_test")


# ---- lineage


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    plain = json.dumps({"rig": "r1", "words": ["a", "b"]}).encode()
    (folder / "plain.json").write_bytes(plain)
    (folder / "packed.json").write_bytes(gzip.compress(plain))
    (folder / "two.gz").write_bytes(gzip.compress(plain[:10]) + gzip.compress(plain[10:]))
    (folder / "broken.json").write_bytes(b"{nothing")
    (folder / "empty.gz").write_bytes(gzip.compress(b""))
    (folder / "nothing.json").write_bytes(b"")
    return folder, plain


def test_digests_of_packed_and_plain_bytes(spark, files):
    folder, plain = files
    got = {r.path.split("/")[-1]: r for r in lineage.read_with_digests(spark, str(folder), "rig string, words array<string>").collect()}
    want = hashlib.sha256(plain).hexdigest()
    assert {k for k, r in got.items() if r.sha256 == want} == {"plain.json", "packed.json", "two.gz"}
    assert got["packed.json"].stored_sha256 == hashlib.sha256((folder / "packed.json").read_bytes()).hexdigest() != want
    assert all(got[k].record.rig == "r1" and got[k].bytes == len(plain) for k in ("plain.json", "packed.json", "two.gz"))
    assert got["broken.json"].record is None or got["broken.json"].record.rig is None
    assert got["empty.gz"].bytes == 0 and got["empty.gz"].sha256 == hashlib.sha256(b"").hexdigest()
    assert "nothing.json" not in got
    with pytest.raises(ValueError, match="too early"):
        lineage.unpacked(gzip.compress(plain)[:-9])


def test_mismatches_name_their_side(spark, files):
    folder, plain = files
    digest = hashlib.sha256(plain).hexdigest()
    sources = lineage.read_with_digests(spark, str(folder)).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "sha256")
    good = spark.createDataFrame([("plain.json", digest, "run 1", "run 1"), ("packed.json", digest, "run 2", "run 2")], "file string, made_from string, run string, found_run string")
    both = lineage.enforced(lineage.matched(good, sources, "file", "video", "made_from"), {"rig": (F.col("made_from"), F.lit(digest)), "run": (F.col("run"), F.col("found_run"))}, "sound")
    assert [(r.lineage, r.sound) for r in both.collect()] == [(True, True)] * 2
    for bad, side in ((("plain.json", "0" * 64, "r", "r"), "video"), (("nowhere.json", digest, "r", "r"), "video"), (("plain.json", None, "r", "r"), "video"), (("plain.json", digest, "r", "s"), "run")):
        rows = lineage.matched(spark.createDataFrame([bad], good.schema), sources, "file", "video", "made_from")
        rows = lineage.enforced(rows, {"rig": (F.lit(digest), F.lit(digest)), "run": (F.col("run"), F.col("found_run"))}, "sound")
        with pytest.raises(Exception, match=f"lineage of {side}"):
            rows.collect()


def test_word_lists_must_agree(spark):
    frame = lambda *words: spark.createDataFrame([(w,) for w in words], "word string")
    assert lineage.same_keys(frame("a", "b", "b"), frame("b", "a"), "word").first().keys == 2
    with pytest.raises(Exception, match="only the first side has c"):
        lineage.same_keys(frame("a", "d", "c"), frame("a"), "word").collect()
    with pytest.raises(Exception, match="only the second side has z"):
        lineage.same_keys(frame("a"), frame("a", "z"), "word").collect()


# ---- words out of blocks


@pytest.fixture(scope="module")
def block(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("block")
    rng = np.random.default_rng(5)
    counts = {"tree": 3, "house": 600, "sea": 2, "sky": 1}
    data = rng.integers(-32767, 32768, (2, sum(counts.values()), 3, 4)).astype("<i2")
    data[0, 0, 0] = 0
    (folder / "data.bin").write_bytes(data.tobytes())
    words, at = [], 0
    for w, n in counts.items():
        words.append({"word": w, "frameOffset": at, "frameCount": n})
        at += n
    (folder / "index.json").write_text(json.dumps({"bones": ["hip", "arm", "hand"], "variants": ["raw", "smooth"], "totalFrames": at, "words": words[::-1]}))
    spark.conf.set(*blocks.PUSHDOWN)
    spark.dataSource.register(blocks.MotionBlocks)
    return folder, data, counts


def load(spark, folder, data="data.bin"):
    return spark.read.format("motion_blocks").option("index", str(folder / "index.json")).option("data", str(folder / data)).load()


def test_all_words(spark, block):
    folder, data, counts = block
    got = load(spark, folder).toPandas()
    assert len(got) == 2 * 606 * 3
    start = 0
    for w, n in counts.items():
        for v, variant in enumerate(("raw", "smooth")):
            own = got[(got.word == w) & (got.variant == variant)].sort_values(["frame", "bone"])
            want = data[v, start : start + n].astype(float)
            size = np.linalg.norm(want, axis=-1, keepdims=True)
            want = want / np.where(size > 0, size, 1)
            found = np.array(own.q.tolist()).reshape(n, 3, 4)
            assert np.abs(found - want[:, [1, 2, 0]]).max() < 1e-12
        start += n
    sizes = np.linalg.norm(np.array(got.q.tolist()), axis=1)
    assert ((np.abs(sizes - 1) < 1e-12) | (sizes == 0)).all() and (sizes == 0).sum() == 1


def test_a_filter_reads_the_words_bytes_only(spark, block):
    folder, data, counts = block
    # everything but the smooth tree is gone from this block: reading anything else ends the job
    whole = data.tobytes()
    first = 606 * 3 * 8
    (folder / "cut.bin").write_bytes(b"\0" * first + whole[first : first + 3 * 3 * 8])
    cut = load(spark, folder, "cut.bin")
    rows = cut.where("word = 'tree' and variant = 'smooth'").collect()
    assert len(rows) == 9 and np.abs(np.array([r.q for r in rows if r.bone == "arm" and r.frame == 2][0]) - data[1, 2, 1] / np.linalg.norm(data[1, 2, 1].astype(float))).max() < 1e-12
    with pytest.raises(Exception, match="ends within the word"):
        cut.where("word = 'house' and variant = 'smooth'").count()
    assert cut.where("word = 'nothing'").count() == 0
    assert cut.where("word in ('tree', 'nothing') and word = 'tree' and variant = 'smooth' and frame > 0").count() == 6
    reader = blocks.BlockReader({"index": str(folder / "index.json"), "data": str(folder / "data.bin")})
    assert [(p.variant, p.start, p.words) for p in reader.partitions()] == [(v, k * first, [("tree", 3), ("house", 600), ("sea", 2), ("sky", 1)]) for k, v in enumerate(("raw", "smooth"))]
