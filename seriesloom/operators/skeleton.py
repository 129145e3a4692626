"""Rules that a skeleton must keep, as a table, and the ones that it breaks (VAL-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import closure

# Names of the roles, the rules' distances (metres) and shares.
SIDES = ("left", "right")
FINGERS = ("thumb", "index", "middle", "ring", "pinky")
SPINE = ("hips", "spine0", "spine1", "spine2", "neck", "head")
ARM = ("clavicle", "upper_arm", "forearm", "hand")
FACE = ("jaw", *(f"{s}_{part}" for part in ("eyelid", "eyebrow", "mouth_corner", "eye") for s in SIDES))
MIRROR_MOST, SEGMENT_LEAST, SEGMENT_SHARE = 0.03, 0.002, 0.5


def rules() -> list[tuple[str, str, str | None]]:
    """(rule, role, other role): what is required or optional, whose child or descendant it is, what mirrors it, what bounds its length."""
    out: list[tuple[str, str, str | None]] = [("required", r, None) for r in ("root", *SPINE)]
    out += [("child", child, parent) for parent, child in zip(SPINE, SPINE[1:])]
    out += [(rule, f, other) for f in FACE for rule, other in (("optional", None), ("under", "head"))]
    for s in SIDES:
        chain = [f"{s}_{a}" for a in ARM]
        out += [("required", r, None) for r in chain] + [("child", chain[0], "spine2")]
        out += [("child", child, parent) for parent, child in zip(chain, chain[1:])]
        for part in ("upper_arm", "forearm"):
            out += [("optional", f"{s}_{part}_twist", None), ("child", f"{s}_{part}_twist", f"{s}_{part}")]
        for f in FINGERS:
            joints = [f"{s}_{f}{k}" for k in range(4)]
            out += [("required", r, None) for r in joints] + [("child", joints[0], f"{s}_hand")]
            out += [("child", child, parent) for parent, child in zip(joints, joints[1:])]
            out += [("segment", j, f"{s}_hand") for j in joints[1:]]
    out += [("mirror", f"left_{r}", f"right_{r}") for r in (*ARM[1:], *(f"{f}0" for f in FINGERS))]
    return out


def _apart(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def broken_rules(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """``rule, level, role, other, node, found``: a row for each rule that the skeleton breaks; none if it is sound.

    ``nodes`` has ``node, parent, x, y, z`` (where it rests) and ``length`` (to its parent), a row
    per node; ``roles`` has ``role, node``. Both are tables of one rig, some tens of rows, as
    is the table of ``rules`` that they are joined with.

    A required role without a node, a child that isn't its parent's own, and a face joint
    that isn't under the head are errors, as are a left side that isn't the character's
    left and a segment of a finger that is no longer than 2 mm or as long as half the
    forearm; an optional role whose node is missing, hands that don't mirror each other
    within 3 cm, and a face that doesn't tell where it looks are warnings. Rules on places
    (side, mirror, segment, facing) are looked at only where the tree is sound, as
    they need its joints. A role that isn't given counts as missing if it is required,
    and is passed over if not. A null length or place breaks the rule that needs it.
    """
    spark = nodes.sparkSession
    table = F.broadcast(spark.createDataFrame(rules(), "rule string, role string, other string"))
    named = roles.where(F.col("node").isNotNull()).select("role", "node")
    present = nodes.select("node").distinct().withColumn("there", F.lit(True))
    known = named.join(present, "node", "left").join(nodes, "node", "left").select("role", "node", "parent", "x", "y", "z", "length", F.coalesce("there", F.lit(False)).alias("there"))
    own = known.select(*(F.col(c).alias(f"a_{c}") for c in known.columns))
    far = known.select(*(F.col(c).alias(f"b_{c}") for c in known.columns))
    pairs = table.join(own, F.col("role") == F.col("a_role"), "left").join(far, F.col("other") == F.col("b_role"), "left")
    both = F.coalesce(F.col("a_there"), F.lit(False)) & F.coalesce(F.col("b_there"), F.lit(False))
    above = closure(nodes.select("node", "parent")).where("depth > 0").select(F.col("node").alias("_low"), F.col("ancestor").alias("_high")).withColumn("_under", F.lit(True))
    tree = pairs.join(above, (F.col("a_node") == F.col("_low")) & (F.col("b_node") == F.col("_high")), "left")
    broken = (
        F.when((F.col("rule") == "required") & ~F.coalesce("a_there", F.lit(False)), F.lit("missing"))
        .when((F.col("rule") == "optional") & ~F.coalesce("a_there", F.lit(True)), F.lit("missing"))
        .when((F.col("rule") == "child") & both & ~F.col("a_parent").eqNullSafe(F.col("b_node")), F.coalesce(F.concat(F.lit("child of "), F.col("a_parent")), F.lit("without a parent")))
        .when((F.col("rule") == "under") & both & F.col("_under").isNull(), F.lit("not under it"))
    )
    level = F.when(F.col("rule").isin("optional", "mirror", "facing"), "warning").otherwise("error")

    def told(rows: DataFrame, found: Column) -> DataFrame:
        return rows.withColumn("found", found).where("found is not null").select("rule", level.alias("level"), "role", "other", F.col("a_node").alias("node"), "found")

    in_tree = told(tree, broken)
    if not in_tree.where("level = 'error'").isEmpty():
        return in_tree

    # where the face looks: from the head to the middle of the eyes, or else to the jaw, on the ground plane
    at = {r: F.max(F.when((F.col("role") == r) & F.col("there"), F.struct("x", "y", "z"))).alias(r) for r in ("hips", "head", "jaw", "left_eye", "right_eye", "left_upper_arm", "right_upper_arm")}
    body = known.agg(*at.values())
    eyes = lambda c: (F.col(f"left_eye.{c}") + F.col(f"right_eye.{c}")) / 2
    seen = body.select("*", F.coalesce(eyes("x"), F.col("jaw.x")).alias("_px"), F.coalesce(eyes("z"), F.col("jaw.z")).alias("_pz"))
    fx, fz = F.col("_px") - F.col("head.x"), F.col("_pz") - F.col("head.z")
    size = F.sqrt(fx * fx + fz * fz)
    tells = F.coalesce(size > 1e-4, F.lit(False))
    # the character's left is up x facing
    facing = seen.select("hips", "left_upper_arm", "right_upper_arm", tells.alias("_tells"), F.when(tells, fz / size).otherwise(1.0).alias("_lx"), F.when(tells, -fx / size).otherwise(0.0).alias("_lz"))
    facing = F.broadcast(facing)
    across = (F.col("left_upper_arm.x") - F.col("right_upper_arm.x")) * F.col("_lx") + (F.col("left_upper_arm.z") - F.col("right_upper_arm.z")) * F.col("_lz")
    whole = facing.select(F.explode(F.array(F.struct(F.lit("side").alias("rule"), F.when(~F.coalesce(across > 0, F.lit(False)), F.lit("on the other side")).alias("found")), F.struct(F.lit("facing").alias("rule"), F.when(~F.col("_tells"), F.lit("unknown")).alias("found")))).alias("r"))
    whole = whole.select("r.*").where("found is not null").select("rule", level.alias("level"), F.when(F.col("rule") == "side", "left_upper_arm").otherwise("head").alias("role"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("node"), "found")

    placed = pairs.where(both & F.col("rule").isin("mirror", "segment")).join(facing)
    lateral = (F.col("a_x") - F.col("hips.x")) * F.col("_lx") + (F.col("a_z") - F.col("hips.z")) * F.col("_lz")
    mirrored = [F.col("a_x") - 2 * lateral * F.col("_lx"), F.col("a_y"), F.col("a_z") - 2 * lateral * F.col("_lz")]
    off = _apart(mirrored, [F.col("b_x"), F.col("b_y"), F.col("b_z")])
    fits = (F.col("a_length") > SEGMENT_LEAST) & (F.col("a_length") < SEGMENT_SHARE * F.col("b_length"))
    places = (
        F.when((F.col("rule") == "mirror") & ~F.coalesce(off <= MIRROR_MOST, F.lit(False)), F.coalesce(F.concat(F.format_number(off * 100, 1), F.lit(" cm")), F.lit("unknown")))
        .when((F.col("rule") == "segment") & ~F.coalesce(fits, F.lit(False)), F.coalesce(F.concat(F.format_number(F.col("a_length"), 4), F.lit(" m")), F.lit("unknown")))
    )
    return in_tree.unionByName(told(placed, places)).unionByName(whole)
