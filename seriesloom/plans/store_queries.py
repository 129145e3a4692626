"""Queries over identities, templates, blocks of filters and figures, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round_up_half
from ..operators import identities, rollups, rotations, templates
from .inputs import ROTATIONS, r6, rows, table
from .inputs import rotations as unit_rotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is any."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


# ---- identities: embeddings as frames of two hands, each label a clip


def _frames(spark, sf_dir):
    e = lambda k: F.element_at("embedding", k).cast("double")
    hand = lambda k: F.array(e(k), e(k + 1), 0.02 + F.abs(e(k + 2)), e(k + 3), e(k + 4))
    left, right = F.when(e(13) < 0.1, hand(1)), F.when(e(14) < 0.1, hand(6))
    # now and then both detectors find the right hand
    left = F.when((e(19) > 0.1) & right.isNotNull(), right).otherwise(left)
    return table(spark, sf_dir, "embeddings").select(
        "label", "vec_id", identities.finite_or_null(left).alias("l"), identities.finite_or_null(right).alias("r"),
        F.when(e(15) < 0.12, F.array(e(6), e(7) + e(16) / 20)).alias("la"), F.when(e(17) < 0.12, F.array(e(1), e(2) + e(18) / 20)).alias("ra"),
    )


def _identity_sql() -> str:
    """The fold as a recursive query: a row of each clip in each step."""
    apart = lambda ax, ay, bx, by: f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"

    def cost(hand: str, side: str) -> str:
        near = f"CASE WHEN o.{side}ax IS NULL THEN 0 ELSE {apart(f'o.{hand}x', f'o.{hand}y', f'o.{side}ax', f'o.{side}ay')} / o.{hand}s END"
        last = f"CASE WHEN s.{side}x IS NULL THEN 0 ELSE 0.5::DOUBLE * {apart(f'o.{hand}x', f'o.{hand}y', f's.{side}x', f's.{side}y')} / o.{hand}s END"
        weight = f"(CASE WHEN o.{side}ax IS NULL THEN 0 ELSE 1::DOUBLE END + CASE WHEN s.{side}x IS NULL THEN 0 ELSE 0.5::DOUBLE END)"
        return f"({near} + {last}) / nullif({weight}, 0)"

    tips = lambda h: (f"o.{h}tx", f"o.{h}ty")
    one = f"{apart('o.lx', 'o.ly', 'o.rx', 'o.ry')} / least(o.ls, o.rs) < 0.35::DOUBLE AND {apart(*tips('l'), *tips('r'))} / least(o.ls, o.rs) < 0.5::DOUBLE"
    return f"""
    WITH RECURSIVE e AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    h AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n,
        CASE WHEN e[13] < 0.1::DOUBLE THEN [e[1], e[2], 0.02::DOUBLE + abs(e[3]), e[4], e[5]] END AS own, CASE WHEN e[14] < 0.1::DOUBLE THEN [e[6], e[7], 0.02::DOUBLE + abs(e[8]), e[9], e[10]] END AS r, e FROM e),
    g AS (SELECT *, CASE WHEN e[19] > 0.1::DOUBLE AND r IS NOT NULL THEN r ELSE own END AS l FROM h),
    o AS MATERIALIZED (SELECT label, vec_id, n, l[1] AS lx, l[2] AS ly, l[3] AS ls, l[4] AS ltx, l[5] AS lty, r[1] AS rx, r[2] AS ry, r[3] AS rs, r[4] AS rtx, r[5] AS rty,
        CASE WHEN e[15] < 0.12::DOUBLE THEN e[6] END AS lax, CASE WHEN e[15] < 0.12::DOUBLE THEN e[7] + e[16] / 20 END AS lay,
        CASE WHEN e[17] < 0.12::DOUBLE THEN e[1] END AS rax, CASE WHEN e[17] < 0.12::DOUBLE THEN e[2] + e[18] / 20 END AS ray FROM g),
    s AS (
        SELECT label, 0::BIGINT AS n, NULL::BIGINT AS vec_id, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, NULL::DOUBLE AS rx, NULL::DOUBLE AS ry, NULL::VARCHAR AS left_from, NULL::VARCHAR AS right_from, NULL::VARCHAR AS mark, NULL::VARCHAR AS mark_side
        FROM (SELECT DISTINCT label FROM o)
        UNION ALL
        SELECT label, n, vec_id,
            CASE left_from WHEN 'left' THEN hlx WHEN 'right' THEN hrx ELSE plx END, CASE left_from WHEN 'left' THEN hly WHEN 'right' THEN hry ELSE ply END,
            CASE right_from WHEN 'left' THEN hlx WHEN 'right' THEN hrx ELSE prx END, CASE right_from WHEN 'left' THEN hly WHEN 'right' THEN hry ELSE pry END,
            left_from, right_from, mark, CASE WHEN mark = 'drop' THEN CASE WHEN left_from IS NULL THEN 'left' ELSE 'right' END WHEN mark = 'relabel' THEN CASE WHEN left_from IS NULL THEN 'right' ELSE 'left' END END
        FROM (SELECT *,
            CASE mark WHEN 'swap' THEN 'right' WHEN 'relabel' THEN CASE WHEN hlx IS NULL THEN 'right' END WHEN 'drop' THEN CASE WHEN coalesce(ll, 1) <= coalesce(rr, 1) THEN 'left' END ELSE CASE WHEN hlx IS NOT NULL THEN 'left' END END AS left_from,
            CASE mark WHEN 'swap' THEN 'left' WHEN 'relabel' THEN CASE WHEN hrx IS NULL THEN 'left' END WHEN 'drop' THEN CASE WHEN coalesce(ll, 1) > coalesce(rr, 1) THEN 'right' END ELSE CASE WHEN hrx IS NOT NULL THEN 'right' END END AS right_from
          FROM (SELECT *, CASE
                WHEN hlx IS NOT NULL AND hrx IS NOT NULL THEN CASE WHEN one THEN 'drop' WHEN lr + rl < 0.5::DOUBLE * (ll + rr) AND ll + rr - (lr + rl) > 1.2::DOUBLE THEN 'swap' END
                WHEN hlx IS NOT NULL THEN CASE WHEN lr < 0.4::DOUBLE * ll AND ll - lr > 1.5::DOUBLE THEN 'relabel' END
                WHEN hrx IS NOT NULL THEN CASE WHEN rl < 0.4::DOUBLE * rr AND rr - rl > 1.5::DOUBLE THEN 'relabel' END END AS mark
            FROM (SELECT o.label, o.n, o.vec_id, o.lx AS hlx, o.ly AS hly, o.rx AS hrx, o.ry AS hry, s.lx AS plx, s.ly AS ply, s.rx AS prx, s.ry AS pry, {one} AS one,
                    {cost('l', 'l')} AS ll, {cost('l', 'r')} AS lr, {cost('r', 'l')} AS rl, {cost('r', 'r')} AS rr
                  FROM s JOIN o ON o.label = s.label AND o.n = s.n + 1))))
    SELECT label, vec_id, left_from, right_from, mark, mark_side FROM s WHERE n > 0"""


@query(_identity_sql())
def identity_marks(spark, sf_dir):
    """Which detection is which hand, frame by frame, with memory (WIN-32)."""
    return identities.resolve(_frames(spark, sf_dir), "label", ["vec_id"], "l", "r", "la", "ra").select("label", "vec_id", "left_from", "right_from", "mark", "mark_side")


@query(_identity_sql().replace("SELECT label, vec_id, left_from, right_from, mark, mark_side FROM s WHERE n > 0", "SELECT label, count(*) FILTER (mark = 'swap') AS swaps, count(*) FILTER (mark = 'drop') AS drops, count(*) FILTER (mark = 'relabel') AS relabels FROM s WHERE n > 0 GROUP BY label"))
def identity_counts(spark, sf_dir):
    return identities.mark_counts(identities.resolve(_frames(spark, sf_dir), "label", ["vec_id"], "l", "r", "la", "ra"), "label")


@query()
def eased_ticks(spark, sf_dir):
    """Rotations of each label as targets, one every three seconds or so, eased at ticks of 100 ms and to rest between (STM-11)."""
    targets = unit_rotations(spark, sf_dir).select("label", (F.col("vec_id") * 331).alias("ms"), "q")
    last = targets.groupBy("label").agg(F.max("ms").alias("last"))
    ticks = last.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 2_000, F.lit(100).cast("long"))).alias("tick"))
    return rotations.eased(targets, ticks, "label", "ms", "q", rotations.Easing(period=100, tau=0.2)).select("label", "tick", F.transform("eased", lambda v: round_up_half(v, 6)).alias("eased"), "stale")


@query()
def rotation_template(spark, sf_dir):
    """Eight points of each embedding as a shape (AGG-16)."""
    point = lambda k: F.transform(F.slice("embedding", 3 * k + 1, 3), lambda x: x.cast("double"))
    shapes = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(point(k) for k in range(8))).alias("points"))
    made = templates.rotation_template(shapes, "vec_id", "points")
    return made.select("point", *(round_up_half(F.col(c), 6).alias(c) for c in "xyz"))


@query("""WITH v AS (SELECT unnest([vec_id % 7, vec_id % 11, vec_id % 13, label]) AS joint, unnest([abs(embedding[1]), abs(embedding[2]), abs(embedding[3]), abs(embedding[4])]) AS weight FROM embeddings)
    SELECT joint, count(*) AS vertices, max(weight)::DOUBLE AS greatest FROM v WHERE weight > 0.01::FLOAT GROUP BY joint""")
def joint_influence(spark, sf_dir):
    v = F.col("vec_id")
    vertices = table(spark, sf_dir, "embeddings").select(F.array(v % 7, v % 11, v % 13, F.col("label").cast("long")).alias("j"), F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x)).alias("w"))
    told = rollups.joint_influence(vertices, "j", "w", F.lit(0.01).cast("float"))
    return told.select("joint", "vertices", F.col("greatest").cast("double").alias("greatest"))


@query("""SELECT count(*) FILTER (event_type = 'error') AS left_clamped, count(*) FILTER (value > 50) AS left_push_over, max(value) AS left_push_most, min(value) AS left_value_least, max(value) AS left_value_greatest,
    count(*) FILTER (event_type = 'click') AS right_clamped, count(*) FILTER (value * 2 > 50) AS right_push_over, max(value * 2) AS right_push_most, min(value * 2) AS right_value_least, max(value * 2) AS right_value_greatest FROM events""")
def solver_rollup(spark, sf_dir):
    """A solver's figures by side, taken while the frames are written (AGG-20)."""
    frames = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("lc"), (F.col("event_type") == "click").alias("rc"), F.col("value").alias("l"), (F.col("value") * 2).alias("r"))
    sides = {"left": {"clamped": "lc", "push": "l", "value": "l"}, "right": {"clamped": "rc", "push": "r", "value": "r"}}
    out, seen = rollups.observed(frames, "solver", **rollups.solver_figures(sides, ["clamped"], {"push": 50.0}, ["push"], ["value"]))
    out.write.format("noop").mode("overwrite").save()
    figures = seen.get
    return spark.createDataFrame([tuple(figures.values())], ", ".join(f"{n} {'long' if isinstance(v, int) else 'double'}" for n, v in figures.items()))


#: Residuals of fits say what any right fit must reach: the twin finds the greatest eigenvalue by powers of the matrix.
_POWER = 60


def _moment_sql(size: int, source: str, names: list[str]) -> str:
    """The share of a group's squared length that lies along its greatest axis, by repeated multiplication."""
    m = {(i, j): f"m{min(i, j)}{max(i, j)}" for i in range(size) for j in range(size)}
    sums = ", ".join(f"sum({names[i]} * {names[j]}) AS m{i}{j}" for i in range(size) for j in range(i, size))
    cells = ", ".join(f"m{i}{j}" for i in range(size) for j in range(i, size))
    product = lambda i: " + ".join(f"{m[i, j]} * v{j}" for j in range(size))
    length = "sqrt(" + " + ".join(f"p{i} * p{i}" for i in range(size)) + ")"
    start = ", ".join(f"(1 + {i} * 0.37)::DOUBLE AS v{i}" for i in range(size))
    return f"""WITH RECURSIVE {source}, m AS (SELECT label, {sums} FROM src GROUP BY label),
        it AS (SELECT label, {cells}, {start}, 0 AS k FROM m
            UNION ALL SELECT label, {cells}, {", ".join(f"p{i} / {length}" for i in range(size))}, k + 1 FROM (SELECT *, {", ".join(f"{product(i)} AS p{i}" for i in range(size))} FROM it WHERE k < {_POWER * 40}))
        SELECT label, {r6("(" + " + ".join(f"v{i} * ({product(i)})" for i in range(size)) + ") / (" + " + ".join(f"m{i}{i}" for i in range(size)) + ")").replace("1e6", "1e5")} AS share FROM it WHERE k = {_POWER * 40}"""


def _share(df, fit, vector: str, size: int, name: str):
    """How much of a group's squared length lies along its fitted direction."""
    at = lambda c, k: F.get(c, F.lit(k))
    both = df.join(fit, "label")
    along = sum((at(vector, k) * at(name, k) for k in range(size)), F.lit(0.0))
    whole = sum((at(vector, k) * at(vector, k) for k in range(size)), F.lit(0.0))
    return both.groupBy("label").agg(round_up_half(F.sum(along * along) / F.sum(whole), 5).alias("share"))


@query(_moment_sql(4, f"{ROTATIONS}, src AS (SELECT label, x, y, z, w FROM rot)", ["x", "y", "z", "w"]))
def quat_average_share(spark, sf_dir):
    """How well the mean rotation of each label stands for its rotations (AGG-17)."""
    q = unit_rotations(spark, sf_dir).where("q is not null")
    return _share(q, rotations.average(q, "label", "q"), "q", 4, "average")


@query(_moment_sql(3, "src AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)", ["x", "y", "z"]))
def dominant_axis_share(spark, sf_dir):
    """How much of each label's spread lies along its dominant axis (AGG-18)."""
    v = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    return _share(v, rotations.dominant_axis(v, "label", "v"), "v", 3, "axis")


@query("SELECT user_id, count(*) AS frames, count(*) FILTER (value IS NOT NULL) AS filtered FROM events GROUP BY user_id")
def filtered_counts(spark, sf_dir):
    """Rotations made of each user's events, filtered both ways: every value stays a rotation of norm 1 (WIN-11)."""
    angle = F.col("value") / 40
    turned = rows(spark, sf_dir).select("user_id", "i", F.when(F.col("value").isNotNull(), F.array(F.lit(0.0), F.lit(0.0), F.sin(angle), F.cos(angle))).alias("q"))
    smooth = rotations.zero_phase(turned, "user_id", "i", "q", 0.1, 1.0)
    good = F.abs(F.aggregate("smooth", F.lit(0.0), lambda a, x: a + x * x) - 1) < 1e-9
    return smooth.groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(good).alias("filtered"))
