"""The middle shape of many that differ by a rotation (AGG-16)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import HUGE_LEAST, rank_quantiles

#: Points of a shape at most: the reference goes to every task and its new form through the driver.
MOST_POINTS = 10_000


def fit_rotations(shapes: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Shapes (n, points, 3) turned about the origin as near to the reference (points, 3) as can be, each by its own rotation (Horn)."""
    s = np.einsum("npi,pj->nij", shapes, reference)
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = (tuple(s[:, i, j] for j in range(3)) for i in range(3))
    # rows and columns in the order w, x, y, z
    upper = [xx + yy + zz, yz - zy, zx - xz, xy - yx, xx - yy - zz, xy + yx, zx + xz, yy - xx - zz, yz + zy, zz - xx - yy]
    matrix = np.zeros((len(shapes), 4, 4))
    for (i, j), part in zip(((i, j) for i in range(4) for j in range(i, 4)), upper):
        matrix[:, i, j] = matrix[:, j, i] = part
    w, x, y, z = np.linalg.eigh(matrix)[1][:, :, -1].T
    turn = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])
    return np.einsum("ijn,npj->npi", turn, shapes)


def rotation_template(shapes: DataFrame, order: str, points: str, iterations: int = 4, huge_least: int = HUGE_LEAST) -> DataFrame:
    """``point, x, y, z``: the upper median of every coordinate over all shapes, each turned onto the template before.

    ``points`` is an array of points (arrays of three) about their common origin. The first
    shape by ``order`` (of equal ones the least) is the first template. Each iteration
    is one scan: shapes are turned where they lie, and what leaves a task are coordinates
    by (point, axis), whose median is found by rank (see ``selection``). Through the driver
    go the template's points only, at most ``MOST_POINTS``.

    Shapes that are null, have a number that is null or not finite, or another number of points
    than the first are left out. Without any shape there is no row.
    """
    flat = F.flatten(F.col(points)).cast("array<double>")
    whole = F.forall(points, lambda p: p.isNotNull() & (F.size(p) == 3)) & F.forall(flat, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = shapes.where(whole & (F.size(points) > 0)).select(F.col(order).alias("_o"), flat.alias("_p"))
    spark = shapes.sparkSession
    first = good.orderBy(F.col("_o").asc_nulls_last(), "_p").select("_p").first()
    schema = "point int, x double, y double, z double"
    if first is None:
        return spark.createDataFrame([], schema)
    reference = np.array(first[0]).reshape(-1, 3)
    if len(reference) > MOST_POINTS:
        raise ValueError(f"a shape of more than {MOST_POINTS} points")
    good = good.where(F.size("_p") == reference.size).select("_p")
    many = good.count()
    for _ in range(iterations):

        def turned(batches: Iterator[pa.RecordBatch], reference=reference) -> Iterator[pa.RecordBatch]:
            step = max(1, 50_000 // reference.size)
            for batch in batches:
                for k in range(0, batch.num_rows, step):
                    part = batch.column(0).slice(k, step)
                    own = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1, 3)
                    out = fit_rotations(own, reference).reshape(len(own), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(out.shape[1], dtype=np.int32), len(out))), pa.array(out.ravel())], names=["place", "v"])

        coordinates = good.mapInArrow(turned, "place int, v double")
        middle = rank_quantiles(coordinates, ["place"], "v", {"middle": "floor(n / 2)"}, huge_least, most=many)
        reference = np.array([r.middle for r in sorted(middle.collect(), key=lambda r: r.place)]).reshape(-1, 3)
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(reference)], schema)
