"""Points of a tracked body as columns: structs ``x, y, z`` (and ``visibility``) and arrays of them (PRJ-01 to PRJ-04, PRJ-06, PRJ-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quaternions import slerp
from .scalars import clamp

# Places of points in a body of 33, and the least numbers of points.
SHOULDERS, ELBOWS, WRISTS, OUTER_EYES, WORLD_EYES = {"left": 11, "right": 12}, {"left": 13, "right": 14}, {"left": 15, "right": 16}, {"left": 3, "right": 6}, {"left": 2, "right": 5}
BODY_POINTS, HAND_POINTS = 33, 21
OUT_OF_FRAME_WEIGHT = 0.4
#: The angles of a hand in the order in which they are stored.
HAND_PARAMS = {"thumb": ("azimuth", "elevation", "axial", "mcp", "ip")} | {f: ("abduction", "mcp", "pip", "dip") for f in ("index", "middle", "ring", "pinky")}


def at(points: Column, k: int) -> Column:
    return F.get(points, F.lit(k))


def xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def subset(points: Column, places: list[int]) -> Column:
    """The points at given places as a map; places beyond the end are null, a null array stays null."""
    return F.when(points.isNotNull(), F.map_from_arrays(F.lit(places), F.transform(F.lit(places), lambda k: F.get(points, k))))


def to_model(point: Column, width: float, height: float, z_scale: Column | float = 1.0) -> Column:
    """A point of the image (shares of its sides, y down, z away) in pixels: x right, y up, z towards the camera. Null stays null."""
    z = z_scale if isinstance(z_scale, Column) else F.lit(z_scale)
    return F.when(point.isNotNull(), xyz(point["x"] * width, -point["y"] * height, -point["z"] * width * z))


def from_model(point: Column, width: float, height: float, z_scale: Column | float = 1.0) -> Column:
    """The inverse of ``to_model``."""
    z = z_scale if isinstance(z_scale, Column) else F.lit(z_scale)
    return F.when(point.isNotNull(), xyz(point["x"] / width, -point["y"] / height, -point["z"] / (F.lit(width) * z)))


def flat_params(params: Column) -> Column:
    """A hand's angles, a struct per finger, as one array in the order of ``HAND_PARAMS``."""
    return F.when(params.isNotNull(), F.array(*(params[finger][angle] for finger, angles in HAND_PARAMS.items() for angle in angles)))


def nested_params(values: Column) -> Column:
    """The inverse of ``flat_params``; missing places are null."""
    out, k = [], 0
    for finger, angles in HAND_PARAMS.items():
        out.append(F.struct(*(F.get(values, F.lit(k + i)).alias(a) for i, a in enumerate(angles))).alias(finger))
        k += len(angles)
    return F.when(values.isNotNull(), F.struct(*out))


def _mean(points: Column, part) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda total, p: total + part(p)) / F.size(points)


def hand_centroid(points: Column, middle: Column, width: float, height: float, shoulder_px: Column, z_scale: Column | float) -> Column:
    """The mean of a hand's points from the middle of the shoulders (pixels), in shoulder widths; depth is the mean offset from the wrist.

    Null for a null or empty hand and without a middle; a point that is null makes it null.
    """
    z = z_scale if isinstance(z_scale, Column) else F.lit(z_scale)
    wrist = at(points, 0)["z"]
    x, y = _mean(points, lambda p: p["x"]) * width - middle["x"], -_mean(points, lambda p: p["y"]) * height - middle["y"]
    depth = _mean(points, lambda p: -(p["z"] - wrist)) * width * z
    return F.when((F.size(points) > 0) & middle.isNotNull(), xyz(x / shoulder_px, y / shoulder_px, depth / shoulder_px))


def body_sample(pose: Column, world: Column, hand_wrists: dict[str, Column], width: float, height: float, shoulder_px: Column, shoulder_m: Column) -> Column:
    """A frame's body in units of its shoulders: wrists and elbows, how sure they are, how high the shoulders stand, the torso's turn and lean.

    ``pose`` are 33 points of the image with ``visibility``, ``world`` the same in metres (y down, z
    away); a hand's own wrist stands for the body's where there is one, with confidence 1. A
    wrist out of frame counts 0.4 of its visibility. Null where either array is null or shorter.
    """
    image = lambda p: (p["x"] * width, -p["y"] * height)
    metres = lambda p: (p["x"], -p["y"], -p["z"])
    seen = lambda p: F.coalesce(p["visibility"], F.lit(0.0))
    ends = {s: image(at(pose, k)) for s, k in SHOULDERS.items()}
    far = {s: metres(at(world, k)) for s, k in SHOULDERS.items()}
    middle = tuple((a + b) / 2 for a, b in zip(ends["left"], ends["right"]))
    middle_m = tuple((a + b) / 2 for a, b in zip(far["left"], far["right"]))
    eyes = sum((image(at(pose, k))[1] for k in OUTER_EYES.values()), F.lit(0.0)) / 2
    sides = []
    for s in ("left", "right"):
        body_wrist, deep = at(pose, WRISTS[s]), at(world, WRISTS[s])
        own = hand_wrists[s]
        x, y = image(F.coalesce(own, F.struct(body_wrist["x"].alias("x"), body_wrist["y"].alias("y"))))
        inside = (body_wrist["x"] > 0) & (body_wrist["x"] < 1) & (body_wrist["y"] > 0) & (body_wrist["y"] < 1)
        sure = F.when(own.isNotNull(), F.lit(1.0)).otherwise(seen(body_wrist) * F.when(inside, F.lit(1.0)).otherwise(F.lit(OUT_OF_FRAME_WEIGHT)))
        elbow = metres(at(world, ELBOWS[s]))
        sides.append(
            F.struct(
                xyz((x - middle[0]) / shoulder_px, (y - middle[1]) / shoulder_px, (-deep["z"] - middle_m[2]) / shoulder_m).alias("wrist"),
                sure.alias("wrist_confidence"),
                F.when(own.isNotNull(), "hand").otherwise("pose").alias("wrist_source"),
                xyz(*((a - b) / shoulder_m for a, b in zip(elbow, middle_m))).alias("elbow"),
                seen(at(pose, ELBOWS[s])).alias("elbow_confidence"),
                xyz((ends[s][0] - middle[0]) / shoulder_px, (ends[s][1] - middle[1]) / shoulder_px, (far[s][2] - middle_m[2]) / shoulder_m).alias("shoulder"),
                ((ends[s][1] - eyes) / shoulder_px).alias("lift"),
            ).alias(s)
        )
    across = tuple(a - b for a, b in zip(far["left"], far["right"]))
    whole = F.struct(
        ((seen(at(pose, SHOULDERS["left"])) > 0.5) & (seen(at(pose, SHOULDERS["right"])) > 0.5)).alias("valid"),
        F.struct(middle[0].alias("x"), middle[1].alias("y")).alias("middle"),
        *sides,
        F.atan2(-across[2], across[0]).alias("torso_yaw"),
        F.atan2(ends["left"][1] - ends["right"][1], ends["left"][0] - ends["right"][0]).alias("torso_roll"),
    )
    return F.when((F.size(pose) >= BODY_POINTS) & (F.size(world) >= BODY_POINTS), whole)


def toward_rest(rotation: Column, rest: Column, strength: Column | float) -> Column:
    """``strength`` of the arc from rest to the rotation: 1 is the rotation itself, 0 rest. Null where either is null."""
    s = clamp(strength if isinstance(strength, Column) else F.lit(float(strength)), 0.0, 1.0)
    return F.when(s >= 1, F.when(rest.isNotNull(), rotation)).otherwise(slerp(rest, rotation, s))


def moved_toward_rest(place: Column, rest: Column, strength: Column | float) -> Column:
    """The same of a place (an array), along a straight line."""
    s = clamp(strength if isinstance(strength, Column) else F.lit(float(strength)), 0.0, 1.0)
    return F.zip_with(rest, place, lambda a, b: a + (b - a) * s)
