"""Frames that tell a body's constants, and these constants (FLT-07, AGG-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selection import HUGE_LEAST, rank_quantiles

# When a palm faces the camera, a finger is straight, and a segment lies near the image plane.
FACING_LEAST, STRAIGHT_MOST, TILT_MOST, VISIBLE_LEAST, LENGTH_LEAST = 0.55, 0.44, 0.35, 0.5, 1e-6
#: The points of each digit, from its root to its tip.
CHAINS = {"thumb": (1, 2, 3, 4), "index": (5, 6, 7, 8), "middle": (9, 10, 11, 12), "ring": (13, 14, 15, 16), "pinky": (17, 18, 19, 20)}


def wholly_in_frame(points: Column) -> Column:
    """Whether every point of a hand lies in the image; a null or empty hand doesn't, nor one with a null point."""
    inside = F.forall(points, lambda p: F.coalesce((p["x"] >= 0) & (p["x"] <= 1) & (p["y"] >= 0) & (p["y"] <= 1), F.lit(False)))
    return F.coalesce(inside & (F.size(points) > 0), F.lit(False))


def faces_camera(normal: Column) -> Column:
    """Whether a palm whose unit normal is ``normal`` (x, y, z) faces the camera or turns its back to it."""
    return F.coalesce(F.abs(normal["z"]) > FACING_LEAST, F.lit(False))


def is_straight(flexion: Column, middle_joint: Column) -> Column:
    """Whether a finger is straight at its root and its middle joint (radians)."""
    return F.coalesce((F.abs(flexion) < STRAIGHT_MOST) & (F.abs(middle_joint) < STRAIGHT_MOST), F.lit(False))


def segment_samples(hands: DataFrame, points: str, keep: list[str]) -> DataFrame:
    """``digit, segment, share`` beside the columns in ``keep``: lengths of finger segments in palm lengths, of those near the image plane.

    A hand is 21 points; one whose palm has no length, and segments without any, are left out.
    """
    p = lambda k: F.get(points, F.lit(k))

    def apart(a: int, b: int) -> Column:
        return F.sqrt(sum(((p(a)[c] - p(b)[c]) * (p(a)[c] - p(b)[c]) for c in "xyz"), F.lit(0.0)))

    parts = [
        F.struct(F.lit(digit).alias("digit"), F.lit(s).alias("segment"), apart(chain[s], chain[s + 1]).alias("length"), F.abs(p(chain[s + 1])["z"] - p(chain[s])["z"]).alias("depth"))
        for digit, chain in CHAINS.items()
        for s in range(3)
    ]
    listed = hands.select(*keep, apart(9, 0).alias("_palm"), F.inline(F.array(*parts)))
    flat = (F.col("_palm") > LENGTH_LEAST) & (F.col("length") > LENGTH_LEAST) & (F.col("depth") / F.col("length") <= TILT_MOST)
    return listed.where(flat).select(*keep, "digit", "segment", (F.col("length") / F.col("_palm")).alias("share"))


def segment_lengths(samples: DataFrame, group: list[str], huge_least: int = HUGE_LEAST) -> DataFrame:
    """The upper median of each segment's lengths per group, by rank; a segment without samples has no row."""
    return rank_quantiles(samples, [*group, "digit", "segment"], "share", {"share": "floor(n / 2)"}, huge_least)


def shoulder_widths(samples: DataFrame, group: str, left: str, right: str, world_left: str, world_right: str, width: float, height: float, huge_least: int = HUGE_LEAST) -> DataFrame:
    """``shoulder_px, shoulder_m``: the upper medians of both widths per group over frames that show both shoulders.

    Points have ``x, y, z`` and those of the image ``visibility``, null counting as none. A group that never
    shows both has nulls: its body cannot be measured.
    """
    seen = (F.coalesce(F.col(left)["visibility"], F.lit(0.0)) >= VISIBLE_LEAST) & (F.coalesce(F.col(right)["visibility"], F.lit(0.0)) >= VISIBLE_LEAST)
    dx, dy = (F.col(left)["x"] - F.col(right)["x"]) * width, (F.col(left)["y"] - F.col(right)["y"]) * height
    metres = F.sqrt(sum(((F.col(world_left)[c] - F.col(world_right)[c]) * (F.col(world_left)[c] - F.col(world_right)[c]) for c in "xyz"), F.lit(0.0)))
    told = samples.select(F.col(group), F.when(seen, F.sqrt(dx * dx + dy * dy)).alias("px"), F.when(seen, metres).alias("m"))
    out = told.select(group).distinct()
    for column, name in (("px", "shoulder_px"), ("m", "shoulder_m")):
        medians = rank_quantiles(told, [group], column, {name: "floor(n / 2)"}, huge_least).withColumnRenamed(group, "_g")
        out = out.join(medians, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    return out
