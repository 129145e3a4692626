"""The template of turned shapes, broken rules of skeletons, and figures taken while writing."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from seriesloom.operators import rollups, skeleton, templates


def turned(rng, shape):
    q = np.array([rng.gauss(0, 1) for _ in range(4)])
    w, x, y, z = q / np.linalg.norm(q)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return shape @ turn.T


def plain_template(shapes, iterations=4):
    """Rotations from singular values instead of quaternions, medians from sorted lists."""
    reference = shapes[0]
    for _ in range(iterations):
        out = []
        for s in shapes:
            u, _, vt = np.linalg.svd(s.T @ reference)
            flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
            out.append(s @ (u @ flip @ vt))
        reference = np.sort(np.array(out), axis=0)[len(out) // 2]
    return reference


@pytest.mark.parametrize("huge", [1_000_000, 20])
def test_template_against_plain(spark, huge):
    rng = random.Random(8)
    base = np.array([[rng.gauss(0, 1) for _ in range(3)] for _ in range(7)])
    shapes = [turned(rng, base + np.array([[rng.gauss(0, 0.05) for _ in range(3)] for _ in range(7)])) for _ in range(40)]
    shapes += [turned(rng, base * [1, 1, 5])]
    rows = [(k, s.tolist()) for k, s in enumerate(shapes)] + [(900, None), (901, [[1.0, 2.0, float("nan")]] * 7), (902, [[1.0, 2.0, 3.0]] * 6), (903, [[1.0, 2.0]] * 7), (904, []), (905, [None] * 7)]
    frame = spark.createDataFrame(rows, "k int, p array<array<double>>").repartition(4)
    got = templates.rotation_template(frame, "k", "p", huge_least=huge).orderBy("point").collect()
    assert np.abs(np.array([[r.x, r.y, r.z] for r in got]) - plain_template(shapes)).max() < 1e-9
    assert templates.rotation_template(frame.where("k >= 900 and k <> 902"), "k", "p").count() == 0


# ---- skeletons


def sound():
    """node -> [parent, x, y, z, length]; roles named like their nodes."""
    nodes = {"root": [None, 0, 0, 0, 0]}

    def add(node, parent, x, y, z):
        px, py, pz = nodes[parent][1:4]
        nodes[node] = [parent, x, y, z, math.dist((x, y, z), (px, py, pz))]

    for k, name in enumerate(skeleton.SPINE):
        add(name, "root" if k == 0 else skeleton.SPINE[k - 1], 0, 1 + 0.1 * k, 0)
    for name in skeleton.FACE:
        add(name, "head", 0.03 if "left" in name else -0.03 if "right" in name else 0, 1.55, 0.1)
    for side, s in (("left", 1), ("right", -1)):
        chain = [f"{side}_{a}" for a in skeleton.ARM]
        for k, name in enumerate(chain):
            add(name, "spine2" if k == 0 else chain[k - 1], s * (0.1 + 0.2 * k), 1.4, 0)
        for part in ("upper_arm", "forearm"):
            add(f"{side}_{part}_twist", f"{side}_{part}", s * 0.4, 1.4, 0)
        for i, f in enumerate(skeleton.FINGERS):
            for k in range(4):
                add(f"{side}_{f}{k}", f"{side}_hand" if k == 0 else f"{side}_{f}{k - 1}", s * (0.75 + 0.03 * k), 1.4, 0.01 * i)
    return nodes


def broken(spark, nodes, roles=None):
    roles = {n: n for n in nodes} if roles is None else roles
    table = spark.createDataFrame([(n, v[0], *(None if x is None else float(x) for x in v[1:])) for n, v in nodes.items()], "node string, parent string, x double, y double, z double, length double")
    named = spark.createDataFrame(list(roles.items()), "role string, node string")
    return {(r.rule, r.level, r.role) for r in skeleton.broken_rules(table, named).collect()}


def test_sound_skeleton_breaks_no_rule(spark):
    assert broken(spark, sound()) == set()


def test_each_rule_finds_its_fault(spark):
    roles = {n: n for n in sound()}
    for fault, want in (
        ("missing", ("required", "error", "left_hand")), ("unnamed", ("required", "error", "neck")), ("optional", ("optional", "warning", "jaw")), ("child", ("child", "error", "left_index2")),
        ("under", ("under", "error", "left_eye")), ("side", ("side", "error", "left_upper_arm")), ("mirror", ("mirror", "warning", "left_ring0")), ("short", ("segment", "error", "right_pinky3")),
        ("long", ("segment", "error", "right_thumb1")), ("facing", ("facing", "warning", "head")), ("null", ("segment", "error", "left_middle2")),
    ):
        nodes, named = sound(), dict(roles)
        if fault == "missing":
            named["left_hand"] = "no such node"
        elif fault == "unnamed":
            del named["neck"]
        elif fault == "optional":
            named["jaw"] = "no such node"
        elif fault == "child":
            nodes["left_index2"][0] = "left_index0"
        elif fault == "under":
            nodes["left_eye"][0] = "neck"
        elif fault == "side":
            for v in nodes.values():
                v[1] = -v[1]
        elif fault == "mirror":
            nodes["left_ring0"][2] += 0.05
        elif fault == "short":
            nodes["right_pinky3"][4] = 0.001
        elif fault == "long":
            nodes["right_thumb1"][4] = 0.11
        elif fault == "null":
            nodes["left_middle2"][4] = None
        else:
            named = {r: n for r, n in roles.items() if r not in skeleton.FACE}
        found = broken(spark, nodes, named)
        assert want in found and (found == {want} or fault in ("missing", "unnamed")), (fault, found)


def test_rules_cover_both_sides():
    rows = skeleton.rules()
    assert len(rows) == len(set(rows)) and sum(r[0] == "segment" for r in rows) == 30 and sum(r[0] == "mirror" for r in rows) == 8


# ---- figures


def test_figures_are_taken_while_writing(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, rng.random() < 0.3, rng.random(), rng.gauss(0, 1) if k % 7 else None) for k in range(500)]
    seen_by_tasks = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen_by_tasks.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "k int, clamped boolean, push double, flex double").repartition(3).mapInArrow(passed, "k int, clamped boolean, push double, flex double")
    own = {"clamped": "clamped", "push": "push", "flex": "flex"}
    figures = rollups.solver_figures({"left": own}, ["clamped"], {"push": 0.5}, ["push"], ["flex"])
    out, seen = rollups.observed(frame, "solver", **figures)
    out.write.parquet(str(tmp_path / "frames"))
    flex = [r[3] for r in rows if r[3] is not None]
    assert seen.get == {"left_clamped": sum(r[1] for r in rows), "left_push_over": sum(r[2] > 0.5 for r in rows), "left_push_most": max(r[2] for r in rows), "left_flex_least": min(flex), "left_flex_greatest": max(flex)}
    assert seen_by_tasks.value == 500
    again = spark.read.parquet(str(tmp_path / "frames")).agg(*(c.alias(n) for n, c in figures.items())).first().asDict()
    assert again == seen.get


def test_joint_influence(spark):
    rows = [(["a", "b", "a"], [0.5, 0.01, 0.2]), (["b", None], [0.9, 0.8]), (["c", "a"], [0.3]), (None, [1.0]), (["d"], None), ([], [])]
    got = rollups.joint_influence(spark.createDataFrame(rows, "j array<string>, w array<double>"), "j", "w").collect()
    assert {(r.joint, r.vertices, r.greatest) for r in got} == {("a", 2, 0.5), ("b", 1, 0.9), ("c", 1, 0.3)}
