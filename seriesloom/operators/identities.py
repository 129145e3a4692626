"""Which of two coupled detections is which, with memory of where each was last (WIN-32).

Two detectors look for one hand each; when hands cross or one is hidden, both may
find the same hand or each the other's. A frame's hands are held against both
sides' anchors (the body's wrists) and against where each side was last, which is
what earlier frames decided: a fold, not a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import carry

# Weight of the last place beside an anchor, and when two hands are one, are swapped, or one is the other's.
LAST_WEIGHT = 0.5
ONE_HAND_WRISTS, ONE_HAND_TIPS = 0.35, 0.5
SWAP_SHARE, SWAP_GAIN = 0.5, 1.2
RELABEL_SHARE, RELABEL_GAIN = 0.4, 1.5
LEAST_SIZE, LEAST_VISIBILITY, FRAME_MARGIN = 1e-4, 0.35, 0.05

OUTPUTS = "left_from string, right_from string, mark string, mark_side string"


def hand(points: Column, aspect: float = 1.0) -> Column:
    """What the step needs of a hand's 21 points (``x, y``): wrist x and y, palm size, x and y of the mean of three finger tips.

    Null for null points, for fewer than 17 of them, and where any of these numbers is not finite.
    """
    p = lambda k, c: F.get(points, F.lit(k))[c]
    dx, dy = (p(0, "x") - p(9, "x")) * aspect, p(0, "y") - p(9, "y")
    tip = lambda c: (p(8, c) + p(12, c) + p(16, c)) / 3
    parts = F.array(p(0, "x"), p(0, "y"), F.greatest(F.lit(LEAST_SIZE), F.sqrt(dx * dx + dy * dy)), tip("x"), tip("y"))
    return finite_or_null(parts)


def anchor(x: Column, y: Column, visibility: Column) -> Column:
    """A wrist of the body as (x, y); null where it is hardly visible or outside of the frame."""
    inside = (x > -FRAME_MARGIN) & (x < 1 + FRAME_MARGIN) & (y > -FRAME_MARGIN) & (y < 1 + FRAME_MARGIN)
    return F.when((visibility > LEAST_VISIBILITY) & inside, F.array(x.cast("double"), y.cast("double")))


def finite_or_null(values: Column) -> Column:
    good = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good, values)


def _apart(a, b, aspect: float) -> float:
    return math.hypot((a[0] - b[0]) * aspect, a[1] - b[1])


def _cost(found, place, last, aspect: float) -> float | None:
    """Mean distance of a hand from a side's anchor and last place, in palm sizes; None where the side has neither."""
    total = weight = 0.0
    for point, share in ((place, 1.0), (last, LAST_WEIGHT)):
        if point is not None:
            total += share * _apart(found, point, aspect) / found[2]
            weight += share
    return total / weight if weight else None


def identity_step(state, left, right, left_anchor, right_anchor, aspect: float = 1.0):
    """One frame: the state is where the left and the right hand were last; outputs are as in ``OUTPUTS``."""
    last = list(state) if state else [None, None]
    hands, places = [left, right], [left_anchor, right_anchor]
    source: list[str | None] = ["left" if left is not None else None, "right" if right is not None else None]
    mark = side = None

    def cost(k: int, to: int) -> float | None:
        return _cost(hands[k], places[to], last[to], aspect)

    if left is not None and right is not None:
        size = min(left[2], right[2])
        if _apart(left, right, aspect) / size < ONE_HAND_WRISTS and _apart(left[3:], right[3:], aspect) / size < ONE_HAND_TIPS:
            costs = [1.0 if c is None else c for c in (cost(0, 0), cost(1, 1))]
            gone = 1 if costs[0] <= costs[1] else 0
            hands[gone] = source[gone] = None
            mark, side = "drop", ("left", "right")[gone]
        else:
            own, crossed = (cost(0, 0), cost(1, 1)), (cost(0, 1), cost(1, 0))
            if None not in (*own, *crossed) and sum(crossed) < SWAP_SHARE * sum(own) and sum(own) - sum(crossed) > SWAP_GAIN:
                hands.reverse()
                source.reverse()
                mark = "swap"
    elif left is not None or right is not None:
        k = 0 if left is not None else 1
        own, crossed = cost(k, k), cost(k, 1 - k)
        if own is not None and crossed is not None and crossed < RELABEL_SHARE * own and own - crossed > RELABEL_GAIN:
            hands.reverse()
            source.reverse()
            mark, side = "relabel", ("left", "right")[1 - k]
    for k in range(2):
        if hands[k] is not None:
            last[k] = list(hands[k][:2])
    return tuple(last), (*source, mark, side)


def resolve(df: DataFrame, series: str, order: list[str], left: str, right: str, left_anchor: str, right_anchor: str, aspect: float = 1.0) -> DataFrame:
    """Adds ``left_from, right_from`` (which detection each side takes), ``mark`` (swap, drop, relabel) and ``mark_side`` to every frame.

    ``left`` and ``right`` are as ``hand`` makes them, anchors as ``anchor``. A side
    without a hand keeps its last place. Where both are one hand, the side that it
    suits less is dropped, the right one if it suits both alike. A frame without hands
    changes nothing; an empty table gives no rows. A series is one partition, in
    which frames are streamed.
    """
    return carry(df, series, order, [left, right, left_anchor, right_anchor], OUTPUTS, lambda: None, lambda s, *values: identity_step(s, *values, aspect=aspect))


def mark_counts(resolved: DataFrame, series: str) -> DataFrame:
    """``swaps, drops, relabels`` of each series."""
    return resolved.groupBy(series).agg(*(F.count_if(F.col("mark") == m).alias(f"{m}s") for m in ("swap", "drop", "relabel")))
