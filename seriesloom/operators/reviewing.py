"""Scores by which frames are picked for review, and the picks (PRJ-14, SNK-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import carry

# Angles (degrees) and distances that make a frame eligible, and how far picks lie apart.
FIST, CURLED, POINT, KNUCKLE, OPEN, OPEN_KNUCKLE = 60.0, 55.0, 20.0, 30.0, 15.0, 25.0
PINCH_MOST, FACE_MOST, CROSS_LEAST, LAG, APART, LOOKED_AT = 0.3, 2.5, -0.05, 3, 45, 2_000


def _least(values: Column) -> Column:
    return F.array_min(values)


def _size(values: Column) -> Column:
    return F.array_max(F.transform(values, F.abs))


def finger_scores(frames: DataFrame, clip: str, k: str, bends: str, knuckles: str, tracked: str) -> DataFrame:
    """Adds ``fast, fist, pointing, open``: how much a frame is of each kind, null where it is not eligible.

    ``bends`` and ``knuckles`` are the angles (degrees) of index, middle, ring and pinky. ``fast`` is
    the greatest change of a bend over three frames, 0 for the first ones of a clip. A frame that
    isn't tracked, or whose angles are null, is of no kind.
    """
    w = W.partitionBy(clip).orderBy(k)
    b, m = F.col(bends), F.col(knuckles)
    on = F.coalesce(F.col(tracked), F.lit(False))
    moved = F.array_max(F.zip_with(b, F.lag(bends, LAG).over(w), lambda x, y: F.abs(x - y)))
    others = _least(F.slice(b, 2, 3))
    first, root = F.get(b, F.lit(0)), F.get(m, F.lit(0))
    return (
        frames.withColumn("_moved", moved)
        .withColumn("fast", F.when(on & b.isNotNull(), F.when(F.row_number().over(w) <= LAG, F.lit(0.0)).otherwise(F.col("_moved"))))
        .withColumn("fist", F.when(on & (_least(b) > FIST), F.least(_least(b), _least(m))))
        .withColumn("pointing", F.when(on & (first < POINT) & (root < KNUCKLE) & (others > CURLED), others - first - root))
        .withColumn("open", F.when(on & (_size(b) < OPEN) & (_size(m) < OPEN_KNUCKLE), -_size(b) - _size(m)))
        .drop("_moved")
    )


def contact_scores(frames: DataFrame, clip: str, k: str, right: str, left: str, right_tracked: str, left_tracked: str, centre: str, anchor: str, face_scale: str, wrist: str) -> DataFrame:
    """Adds ``pinch, at_face, crossed, wrist_speed``, null where a frame is not eligible.

    Hands are 21 points (``x, y``), ``centre``, ``anchor`` and ``wrist`` arrays of x and y in the body's
    units. ``pinch`` is the distance of thumb and index tips in palm lengths, negated; ``at_face`` the
    hand's distance from the face in its scale, negated; ``crossed`` how far the left hand's middle lies right of
    the right hand's; ``wrist_speed`` the step of the wrist, 0 for a clip's first frame.
    """
    p = lambda c, n: F.get(c, F.lit(n))

    def apart(a: Column, b: Column) -> Column:
        return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))

    def gap(a: Column, b: Column) -> Column:
        return F.sqrt((p(a, 0) - p(b, 0)) * (p(a, 0) - p(b, 0)) + (p(a, 1) - p(b, 1)) * (p(a, 1) - p(b, 1)))

    r, on, both = F.col(right), F.coalesce(F.col(right_tracked), F.lit(False)), F.coalesce(F.col(right_tracked) & F.col(left_tracked), F.lit(False))
    pinch = -apart(p(r, 4), p(r, 8)) / (apart(p(r, 9), p(r, 0)) + 1e-9)
    near = -gap(F.col(centre), F.col(anchor)) / F.col(face_scale)
    middle = lambda c: F.aggregate(c, F.lit(0.0), lambda t, q: t + q["x"]) / F.size(c)
    across = middle(r) - middle(F.col(left))
    w = W.partitionBy(clip).orderBy(k)
    step = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(gap(F.col(wrist), F.lag(wrist).over(w)))
    return (
        frames.withColumn("pinch", F.when(on & (pinch > -PINCH_MOST), pinch))
        .withColumn("at_face", F.when(on & (F.col(face_scale) > 0) & (near > -FACE_MOST), near))
        .withColumn("crossed", F.when(both & (across > CROSS_LEAST), across))
        .withColumn("wrist_speed", F.when(on, step))
    )


def labelled_picks(scores: DataFrame, clip: str, k: str, label_place: str, label: str, score: str, apart: int = APART, looked_at: int = LOOKED_AT) -> DataFrame:
    """``clip, label, k``: for each label in turn (by ``label_place``) its best frame that lies more than ``apart`` from all picks before.

    ``scores`` has a row for each eligible frame of a label; null and infinite scores are not
    eligible. Of equal scores the earlier frame counts; a label of which none of the first
    ``looked_at`` frames is far enough has no pick. The state is the places picked, so one per label.
    """
    good = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < F.lit(float("inf"))))
    w = W.partitionBy(clip, label_place).orderBy(F.desc(score), k)
    ranked = good.select(clip, k, label_place, label, F.row_number().over(w).alias("_rank")).where(F.col("_rank") <= looked_at)

    def step(state, place, at):
        done, picked = state
        if place == done or any(abs(at - p) <= apart for p in picked):
            return state, (False,)
        return (place, [*picked, at]), (True,)

    out = carry(ranked, clip, [label_place, "_rank"], [label_place, k], "_picked boolean", lambda: (None, []), step)
    return out.where("_picked").select(clip, label, k)
