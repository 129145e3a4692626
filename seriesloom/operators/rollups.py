"""Figures taken in the pass that writes the rows, and influence of joints (AGG-20, AGG-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Observation]:
    """The frame, and where its figures are found once it has been written: no second scan.

    ``figures`` are aggregates. Each task keeps its part of them beside the rows that it hands on.
    """
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in figures.items())), seen


def solver_figures(sides: dict[str, dict[str, str]], flags: list[str], pushes: dict[str, float], peaks: list[str], ranges: list[str]) -> dict[str, Column]:
    """Aggregates of a solver's rows, by side: how often ``flags`` hold, how often ``pushes`` pass their bounds, the greatest
    of ``peaks`` (0 if there is none), least and greatest of ``ranges``.

    ``sides`` maps a side to the columns of its figures by name. Nulls count as not held, and are passed over.
    """
    out: dict[str, Column] = {}
    for side, columns in sides.items():
        for f in flags:
            out[f"{side}_{f}"] = F.count_if(F.col(columns[f]))
        for f, bound in pushes.items():
            out[f"{side}_{f}_over"] = F.count_if(F.col(columns[f]) > bound)
        for f in peaks:
            out[f"{side}_{f}_most"] = F.coalesce(F.max(columns[f]), F.lit(0.0))
        for f in ranges:
            out[f"{side}_{f}_least"], out[f"{side}_{f}_greatest"] = F.min(columns[f]), F.max(columns[f])
    return out


def joint_influence(vertices: DataFrame, joints: str, weights: str, least: float = 0.01) -> DataFrame:
    """``joint, vertices, greatest``: how many vertices each joint moves with a weight above ``least``, and its greatest weight.

    A vertex has an array of joints and one of weights; where they differ in length or one is
    null, what has no counterpart is passed over. A joint named twice by a vertex counts twice.
    """
    parts = vertices.select(F.inline(F.arrays_zip(F.col(joints).alias("joint"), F.col(weights).alias("weight"))))
    return parts.where(F.col("joint").isNotNull() & (F.col("weight") > least)).groupBy("joint").agg(F.count("*").alias("vertices"), F.max("weight").alias("greatest"))
