"""Vectors and rotations as array columns: ``array<double>`` of 3, or of 4 in the order x, y, z, w (FN-03 to FN-07)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp

#: Quaternion components are stored in steps of 1 / QUANTA (fixed value).
QUANTA = 32767


def at(v: Column, k: int) -> Column:
    return F.get(v, F.lit(k))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; without it, nested array expressions grow with every level."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column, size: int = 4) -> Column:
    total = at(a, 0) * at(b, 0)
    for k in range(1, size):
        total = total + at(a, k) * at(b, k)
    return total


def scale(v: Column, s: Column, size: int = 4) -> Column:
    return F.array(*(at(v, k) * s for k in range(size)))


def norm(v: Column, size: int = 4) -> Column:
    return F.sqrt(dot(v, v, size))


def unit(v: Column, size: int = 4) -> Column:
    """The vector over its norm; null if the norm is 0."""
    n = norm(v, size)
    return F.when(n > 0, F.array(*(at(v, k) / n for k in range(size))))


def conjugate(q: Column) -> Column:
    return F.array(-at(q, 0), -at(q, 1), -at(q, 2), at(q, 3))


def multiply(a: Column, b: Column) -> Column:
    """The rotation b followed by the rotation a."""
    (ax, ay, az, aw), (bx, by, bz, bw) = ([at(q, k) for k in range(4)] for q in (a, b))
    return F.array(
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def angle_between(a: Column, b: Column) -> Column:
    """Radians in [0, pi] between two unit quaternions; q and -q are one rotation."""
    return F.lit(2.0) * F.acos(F.least(F.abs(dot(a, b)), F.lit(1.0)))


def align_to(q: Column, reference: Column) -> Column:
    """``q`` or ``-q``, whichever lies in the reference's hemisphere."""
    return F.when(dot(q, reference) < 0, scale(q, F.lit(-1.0))).otherwise(q)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc from a to b; a straight line, brought back to norm 1, where they nearly agree."""

    def mixed(b: Column, wa: Column, wb: Column) -> Column:
        return F.array(*(at(a, k) * wa + at(b, k) * wb for k in range(4)))

    def between(b: Column) -> Column:
        def on_arc(theta: Column) -> Column:
            s = F.sin(theta)
            straight = let(mixed(b, F.lit(1.0) - t, t), lambda v: unit(v))
            return F.when(s < 1e-9, straight).otherwise(mixed(b, F.sin((F.lit(1.0) - t) * theta) / s, F.sin(t * theta) / s))

        return let(F.acos(clamp(dot(a, b), -1.0, 1.0)), on_arc)

    return F.when(a.isNotNull() & b.isNotNull(), let(align_to(b, a), between))


def twist_angle(q: Column, axis: Column) -> Column:
    """Signed angle of q's turn about a unit axis; 0 where a half turn across the axis leaves it undefined."""
    along = dot(axis, q, 3)
    size = F.sqrt(along * along + at(q, 3) * at(q, 3))
    w = clamp(F.abs(at(q, 3)) / size, 0.0, 1.0)
    positive = F.when(at(q, 3) < 0, -along).otherwise(along) >= 0
    return F.when(size * size < 1e-12, F.lit(0.0)).otherwise(F.lit(2.0) * F.acos(w) * F.when(positive, 1.0).otherwise(-1.0))


def twist(q: Column, axis: Column) -> Column:
    """q's turn about the axis as a unit quaternion (no turn where it is undefined)."""
    none = F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))

    def turned(raw: Column) -> Column:
        signed = F.when(at(raw, 3) < 0, -norm(raw)).otherwise(norm(raw))
        return F.when(dot(raw, raw) < 1e-12, none).otherwise(let(signed, lambda n: F.transform(raw, lambda x: x / n)))

    return let(dot(axis, q, 3), lambda along: let(F.array(*(at(axis, k) * along for k in range(3)), at(q, 3)), turned))


def swing(q: Column, axis: Column) -> Column:
    """What is left of q when its twist about the axis is taken off: q = swing * twist."""
    return let(twist(q, axis), lambda t: multiply(q, conjugate(t)))


def quantise(v: Column) -> Column:
    """Components as 16-bit integers; halves round up."""
    return F.transform(v, lambda x: clamp(F.floor(x * QUANTA + 0.5), -QUANTA, QUANTA).cast("smallint"))


def restore(v: Column) -> Column:
    """Quantised components as a unit quaternion."""
    return unit(F.transform(v, lambda x: x.cast("double") / QUANTA))
