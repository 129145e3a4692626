"""Queries over points of bodies and hands (embeddings seen as such), each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import landmarks
from ..functions.scalars import round_up_half
from ..operators import calibration, folds, relations, reviewing, rotations, validation
from . import series_queries
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


def _e(k: int):
    return F.element_at("embedding", k).cast("double")


def _points(many: int, visibility: bool = False):
    """Points of consecutive components about the middle of the image; they go round at the end of the vector."""
    out = []
    for k in range(many):
        x, y, z, v = (_e((4 * k + c) % 64 + 1) for c in range(4))
        parts = [(0.5 + x).alias("x"), (0.5 + y).alias("y"), z.alias("z")] + ([F.abs(v * 5).alias("visibility")] if visibility else [])
        out.append(F.struct(*parts))
    return F.array(*out)


def _sql_point(k: int, c: int) -> str:
    value = f"embedding[{(4 * k + c) % 64 + 1}]::DOUBLE"
    return f"(0.5::DOUBLE + {value})" if c < 2 else f"abs({value} * 5)" if c == 3 else value


@query(f"""SELECT vec_id, {r6(f"{_sql_point(0, 0)} * 640")} AS x, {r6(f"-{_sql_point(0, 1)} * 480")} AS y, {r6(f"-{_sql_point(0, 2)} * 640 * 0.7::DOUBLE")} AS z, {r6(_sql_point(0, 0))} AS back_x, {r6(_sql_point(0, 1))} AS back_y, {r6(_sql_point(0, 2))} AS back_z,
    {r6(_sql_point(3, 0))} AS third, NULL::DOUBLE AS beyond FROM embeddings""")
def model_space(spark, sf_dir):
    """A point to model space and back, and two of a chosen subset (PRJ-01, PRJ-02)."""
    model = landmarks.to_model(F.col("p")[0], 640.0, 480.0, 0.7)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _points(5).alias("p")).select("vec_id", model.alias("m"), landmarks.subset(F.col("p"), [3, 9]).alias("s"))
    back = landmarks.from_model(F.col("m"), 640.0, 480.0, 0.7)
    told = rows.select("vec_id", "m", "s", back.alias("b"))
    return told.select("vec_id", *(round_up_half(F.col(f"m.{c}"), 6).alias(c) for c in "xyz"), *(round_up_half(F.col(f"b.{c}"), 6).alias(f"back_{c}") for c in "xyz"), round_up_half(F.col("s")[3]["x"], 6).alias("third"), round_up_half(F.col("s")[9]["x"], 6).alias("beyond"))


def _body_sql() -> str:
    image = lambda k: (f"({_sql_point(k, 0)} * 640)", f"(-{_sql_point(k, 1)} * 480)")
    # the world's points are the image's in other units
    metres = lambda k: (f"({_sql_point(k, 0)} * 2)", f"(-{_sql_point(k, 1)} * 2)", f"(-{_sql_point(k, 2)})")
    l, r, lw, rw = image(11), image(12), metres(11), metres(12)
    mid = tuple(f"(({a} + {b}) / 2)" for a, b in zip(l, r))
    midm = tuple(f"(({a} + {b}) / 2)" for a, b in zip(lw, rw))
    eye = f"(({image(3)[1]} + {image(6)[1]}) / 2)"
    out = [f"vec_id, {_sql_point(11, 3)} > 0.5::DOUBLE AND {_sql_point(12, 3)} > 0.5::DOUBLE AS valid", f"{r6(f'atan2(-({lw[2]} - {rw[2]}), {lw[0]} - {rw[0]})')} AS torso_yaw", f"{r6(f'atan2({l[1]} - {r[1]}, {l[0]} - {r[0]})')} AS torso_roll"]
    for s, wrist, elbow, shoulder in (("left", 15, 13, l), ("right", 16, 14, r)):
        own = "vec_id % 3 = 0" if s == "left" else "false"
        x = f"CASE WHEN {own} THEN 0.25::DOUBLE * 640 ELSE {image(wrist)[0]} END"
        inside = f"{_sql_point(wrist, 0)} > 0 AND {_sql_point(wrist, 0)} < 1 AND {_sql_point(wrist, 1)} > 0 AND {_sql_point(wrist, 1)} < 1"
        sure = f"CASE WHEN {own} THEN 1 ELSE {_sql_point(wrist, 3)} * CASE WHEN {inside} THEN 1 ELSE 0.4::DOUBLE END END"
        out += [f"{r6(f'({x} - {mid[0]}) / 130')} AS {s}_wrist_x", f"{r6(f'({metres(wrist)[2]} - {midm[2]}) / 0.4::DOUBLE')} AS {s}_wrist_z", f"{r6(sure)} AS {s}_sure", f"{r6(f'({metres(elbow)[1]} - {midm[1]}) / 0.4::DOUBLE')} AS {s}_elbow_y", f"{r6(f'({shoulder[1]} - {eye}) / 130')} AS {s}_lift"]
    return f"SELECT {', '.join(out)} FROM embeddings"


@query(_body_sql())
def body_features(spark, sf_dir):
    """Body-relative features of a frame (PRJ-03); every third one has a hand of its own at the left wrist."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _points(33, True).alias("p"))
    world = F.transform("p", lambda q: F.struct((q["x"] * 2).alias("x"), (q["y"] * 2).alias("y"), q["z"].alias("z")))
    hand = F.when(F.col("vec_id") % 3 == 0, F.struct(F.lit(0.25).alias("x"), F.lit(0.75).alias("y")))
    none = F.lit(None).cast("struct<x: double, y: double>")
    told = rows.withColumn("w", world).select("vec_id", landmarks.body_sample(F.col("p"), F.col("w"), {"left": hand, "right": none}, 640.0, 480.0, F.lit(130.0), F.lit(0.4)).alias("b"))
    six = lambda c, name: round_up_half(F.col(c), 6).alias(name)
    sides = [six(f"b.{s}.{path}", f"{s}_{name}") for s in ("left", "right") for path, name in (("wrist.x", "wrist_x"), ("wrist.z", "wrist_z"), ("wrist_confidence", "sure"), ("elbow.y", "elbow_y"), ("lift", "lift"))]
    return told.select("vec_id", F.col("b.valid").alias("valid"), six("b.torso_yaw", "torso_yaw"), six("b.torso_roll", "torso_roll"), *sides)


_HAND = range(21)


@query(f"""SELECT vec_id, {r6("((" + " + ".join(_sql_point(k, 0) for k in _HAND) + ") / 21 * 640 - 320) / 130")} AS x, {r6("(-(" + " + ".join(_sql_point(k, 1) for k in _HAND) + ") / 21 * 480 + 240) / 130")} AS y,
    {r6("(" + " + ".join(f"-({_sql_point(k, 2)} - {_sql_point(0, 2)})" for k in _HAND) + ") / 21 * 640 * 0.7::DOUBLE / 130")} AS z FROM embeddings""")
def hand_centroids(spark, sf_dir):
    """A hand's middle in shoulder widths (PRJ-06)."""
    middle = F.struct(F.lit(320.0).alias("x"), F.lit(-240.0).alias("y"))
    told = table(spark, sf_dir, "embeddings").select("vec_id", landmarks.hand_centroid(_points(21), middle, 640.0, 480.0, F.lit(130.0), 0.7).alias("c"))
    return told.select("vec_id", *(round_up_half(F.col(f"c.{a}"), 6).alias(a) for a in "xyz"))


@query("SELECT vec_id, list_transform(embedding[1:21], lambda x: x::DOUBLE) AS flat, embedding[5]::DOUBLE AS thumb_ip, embedding[8]::DOUBLE AS index_pip, embedding[21]::DOUBLE AS pinky_dip FROM embeddings")
def hand_params(spark, sf_dir):
    """Angles of a hand from an array to structs and back (PRJ-04)."""
    nested = landmarks.nested_params(F.transform(F.slice("embedding", 1, 21), lambda x: x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", nested.alias("h"))
    return rows.select("vec_id", landmarks.flat_params(F.col("h")).alias("flat"), F.col("h.thumb.ip").alias("thumb_ip"), F.col("h.index.pip").alias("index_pip"), F.col("h.pinky.dip").alias("pinky_dip"))


@query(f"""WITH {ROTATIONS}, t AS (SELECT label, vec_id, 2 * acos(least(1, abs(w))) AS angle, CASE WHEN w < 0 THEN -w ELSE w END AS c FROM rot)
    SELECT label, vec_id, {r6("angle * 0.3::DOUBLE")} AS turned, {r6("cos(angle * 0.15::DOUBLE)")} AS w FROM t""")
def toward_rest(spark, sf_dir):
    """Rotations at three tenths of the way from rest: three tenths of their angle (PRJ-15)."""
    rest = F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))
    q = landmarks.toward_rest(F.col("q"), rest, 0.3)
    rows = unit_rotations(spark, sf_dir).where("q is not null").select("label", "vec_id", q.alias("q"))
    w = F.abs(F.get("q", F.lit(3)))
    return rows.select("label", "vec_id", round_up_half(2 * F.acos(F.least(F.lit(1.0), w)), 6).alias("turned"), round_up_half(w, 6).alias("w"))


def _segments_sql() -> str:
    apart = lambda a, b: f"sqrt(({_sql_point(a, 0)} - {_sql_point(b, 0)})**2 + ({_sql_point(a, 1)} - {_sql_point(b, 1)})**2 + ({_sql_point(a, 2)} - {_sql_point(b, 2)})**2)"
    each = [f"SELECT label, {apart(9, 0)} AS palm, '{d}' AS digit, {s} AS segment, {apart(c[s], c[s + 1])} AS length, abs({_sql_point(c[s + 1], 2)} - {_sql_point(c[s], 2)}) AS depth FROM embeddings" for d, c in calibration.CHAINS.items() for s in range(3)]
    return f"""WITH s AS ({" UNION ALL ".join(each)}), f AS (SELECT label, digit, segment, list_sort(list(length / palm)) AS v FROM s WHERE palm > 1e-6 AND length > 1e-6 AND depth / length <= 0.35::DOUBLE GROUP BY ALL)
        SELECT label, digit, segment, {r6("v[len(v) // 2 + 1]")} AS share FROM f"""


@query(_segments_sql())
def segment_lengths(spark, sf_dir):
    """Finger segments of each label's hands in palm lengths, of those near the image plane (FLT-07, AGG-14)."""
    hands = table(spark, sf_dir, "embeddings").select("label", _points(21).alias("p"))
    told = calibration.segment_lengths(calibration.segment_samples(hands, "p", ["label"]), ["label"])
    return told.select("label", "digit", "segment", round_up_half(F.col("share"), 6).alias("share"))


@query(f"""WITH s AS (SELECT label, CASE WHEN {_sql_point(11, 3)} >= 0.5::DOUBLE AND {_sql_point(12, 3)} >= 0.5::DOUBLE THEN sqrt((({_sql_point(11, 0)} - {_sql_point(12, 0)}) * 640)**2 + (({_sql_point(11, 1)} - {_sql_point(12, 1)}) * 480)**2) END AS px,
        CASE WHEN {_sql_point(11, 3)} >= 0.5::DOUBLE AND {_sql_point(12, 3)} >= 0.5::DOUBLE THEN sqrt(({_sql_point(11, 0)} - {_sql_point(12, 0)})**2 + ({_sql_point(11, 1)} - {_sql_point(12, 1)})**2 + ({_sql_point(11, 2)} - {_sql_point(12, 2)})**2) END AS m FROM embeddings),
    g AS (SELECT label, list_sort(list(px) FILTER (px IS NOT NULL)) AS p, list_sort(list(m) FILTER (m IS NOT NULL)) AS m FROM s GROUP BY label)
    SELECT label, {r6("p[len(p) // 2 + 1]")} AS shoulder_px, {r6("m[len(m) // 2 + 1]")} AS shoulder_m FROM g""")
def shoulder_normaliser(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", _points(13, True).alias("p")).select("label", F.col("p")[11].alias("l"), F.col("p")[12].alias("r"))
    told = calibration.shoulder_widths(rows, "label", "l", "r", "l", "r", 640.0, 480.0)
    return told.select("label", *(round_up_half(F.col(c), 6).alias(c) for c in ("shoulder_px", "shoulder_m")))


def _scored(spark, sf_dir):
    bends, knuckles = (F.transform(F.slice("embedding", a, 4), lambda x: F.abs(x.cast("double")) * 400 - 10) for a in (1, 5))
    hand = lambda k: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(F.element_at("embedding", (i + k) % 64 + 1).cast("double").alias("x"), F.element_at("embedding", (i * 2 + k) % 64 + 1).cast("double").alias("y")))
    rows = table(spark, sf_dir, "embeddings").select(
        "label", "vec_id", bends.alias("b"), knuckles.alias("m"), (_e(9) > -0.1).alias("on"), (_e(10) > -0.1).alias("left_on"),
        hand(0).alias("r"), hand(30).alias("l"), F.array(_e(11), _e(12)).alias("centre"), F.array(_e(13), _e(14)).alias("anchor"), (_e(15) + 0.1).alias("scale"), F.array(_e(16), _e(17)).alias("wrist"),
    )
    told = reviewing.finger_scores(rows, "label", "vec_id", "b", "m", "on")
    return reviewing.contact_scores(told, "label", "vec_id", "r", "l", "on", "left_on", "centre", "anchor", "scale", "wrist")


SCORES = ("fast", "fist", "pointing", "open", "pinch", "at_face", "crossed", "wrist_speed")


def _scores_sql() -> str:
    e = lambda k: f"e[{k}]"
    b = [f"(abs({e(k)}) * 400 - 10)" for k in range(1, 5)]
    m = [f"(abs({e(k)}) * 400 - 10)" for k in range(5, 9)]
    fast = "greatest(" + ", ".join(f"abs({x} - lag({x}, 3) OVER w)" for x in b) + ")"
    least, others = f"least({', '.join(b)})", f"least({', '.join(b[1:])})"
    size = lambda v: "greatest(" + ", ".join(f"abs({x})" for x in v) + ")"
    x, y = lambda i, k: e((i + k) % 64 + 1), lambda i, k: e((2 * i + k) % 64 + 1)
    apart = lambda i, j: f"sqrt(({x(i, 0)} - {x(j, 0)})**2 + ({y(i, 0)} - {y(j, 0)})**2)"
    middle = lambda k: "((" + " + ".join(x(i, k) for i in range(21)) + ") / 21)"
    rows = {
        "fast": f"CASE WHEN row_number() OVER w <= 3 THEN 0 ELSE {fast} END",
        "fist": f"CASE WHEN {least} > 60 THEN least({least}, {', '.join(m)}) END",
        "pointing": f"CASE WHEN {b[0]} < 20 AND {m[0]} < 30 AND {others} > 55 THEN {others} - {b[0]} - {m[0]} END",
        "open": f"CASE WHEN {size(b)} < 15 AND {size(m)} < 25 THEN -{size(b)} - {size(m)} END",
        "pinch": f"CASE WHEN -{apart(4, 8)} / ({apart(9, 0)} + 1e-9::DOUBLE) > -0.3::DOUBLE THEN -{apart(4, 8)} / ({apart(9, 0)} + 1e-9::DOUBLE) END",
        "at_face": f"CASE WHEN {e(15)} + 0.1::DOUBLE > 0 AND -sqrt(({e(11)} - {e(13)})**2 + ({e(12)} - {e(14)})**2) / ({e(15)} + 0.1::DOUBLE) > -2.5::DOUBLE THEN -sqrt(({e(11)} - {e(13)})**2 + ({e(12)} - {e(14)})**2) / ({e(15)} + 0.1::DOUBLE) END",
        "crossed": f"CASE WHEN {e(10)} > -0.1::DOUBLE AND {middle(0)} - {middle(30)} > -0.05::DOUBLE THEN {middle(0)} - {middle(30)} END",
        "wrist_speed": f"CASE WHEN row_number() OVER w = 1 THEN 0 ELSE sqrt(({e(16)} - lag({e(16)}) OVER w)**2 + ({e(17)} - lag({e(17)}) OVER w)**2) END",
    }
    return "WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT label, vec_id, " + ", ".join(f"{r6(f'CASE WHEN {e(9)} > -0.1::DOUBLE THEN {sql} END')} AS {name}" for name, sql in rows.items()) + " FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id)"


@query(_scores_sql())
def review_scores(spark, sf_dir):
    """How much each frame is of each kind that a review looks for (PRJ-14)."""
    return _scored(spark, sf_dir).select("label", "vec_id", *(round_up_half(F.col(c), 6).alias(c) for c in SCORES))


@query()
def review_picks(spark, sf_dir):
    """The frame of each kind that stands for it, in turn and apart from each other (SNK-14)."""
    listed = _scored(spark, sf_dir).select("label", "vec_id", F.inline(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("kind"), F.col(c).alias("score")) for k, c in enumerate(SCORES)))))
    return reviewing.labelled_picks(listed, "label", "vec_id", "place", "kind", "score", apart=20)


@query(f"""WITH f AS (SELECT label, vec_id, sqrt((embedding[1]::DOUBLE - lag(embedding[1]) OVER w)**2 + (embedding[2]::DOUBLE - lag(embedding[2]) OVER w)**2 + (embedding[3]::DOUBLE - lag(embedding[3]) OVER w)**2) AS wj,
        sqrt((embedding[4]::DOUBLE - lag(embedding[4]) OVER w)**2 + (embedding[5]::DOUBLE - lag(embedding[5]) OVER w)**2 + (embedding[6]::DOUBLE - lag(embedding[6]) OVER w)**2) AS hj, vec_id - lag(vec_id) OVER w = 10 AS follows, abs(embedding[7]::DOUBLE) AS jump FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    r AS (SELECT label, vec_id, jump, CASE WHEN wj IS NOT NULL THEN floor(jump / greatest(wj, hj, 0.001::DOUBLE) * 100 + 0.5::DOUBLE) / 100 END AS ratio, wj, hj FROM (SELECT label, vec_id, jump, CASE WHEN follows THEN wj END AS wj, CASE WHEN follows THEN hj END AS hj FROM f))
    SELECT label, vec_id, ratio, ratio <= 0.5::DOUBLE AS explained FROM r WHERE jump > 0.1::DOUBLE""")
def fast_motion(spark, sf_dir):
    """Fast events against the source's own step (JN-06, FIT-11); a vector follows the one before of its label if their ids are ten apart."""
    vectors = table(spark, sf_dir, "embeddings")
    point = lambda k: F.transform(F.slice("embedding", k, 3), lambda x: x.cast("double"))
    clean = vectors.select("label", "vec_id", point(1).alias("wrist"), point(4).alias("hand"), F.lit(1.0).alias("metres"))
    events = vectors.select("label", "vec_id", F.abs(_e(7)).alias("jump")).where("jump > 0.1")
    told = relations.fast_motion_check(events, clean, ["label"], "vec_id", "jump", "wrist", "hand", "metres", most=0.5, apart=10)
    return told.select("label", "vec_id", "ratio", "explained")


@query("SELECT user_id, count(*) AS frames, count(*) AS alike FROM events GROUP BY user_id")
def limited_turns(spark, sf_dir):
    """Turns about one axis limited both ways (WIN-13): alike to their angles limited as numbers, which ``rate_limit`` holds against SQL.

    The angles are within a quarter turn of 0 whatever the value, so that no step between
    two of them is a half turn or more, which a rotation would take the other way round.
    Rows without a number are alike in having no angle.
    """
    told = rows(spark, sf_dir).withColumn("angle", F.when(~F.isnan("value"), F.atan(F.col("value") / 100)))
    q = F.array(F.lit(0.0), F.lit(0.0), F.sin(F.col("angle") / 2), F.cos(F.col("angle") / 2))
    turned = told.withColumn("q", F.when(F.col("angle").isNotNull(), q))
    numbers = folds.limit_rate(turned, "user_id", ["i"], "angle", 0.05, "plain")
    both = rotations.limit_rate(numbers, "user_id", ["i"], "q", 0.05)
    limited = 2 * F.atan2(F.get("limited", F.lit(2)), F.get("limited", F.lit(3)))
    return both.groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.coalesce(F.abs(limited - F.col("plain")) < 5e-6, F.col("limited").isNull() & F.col("plain").isNull())).alias("alike"))


@query("SELECT * FROM (WITH w AS (SELECT p_brand AS library, p_partkey AS place, p_name AS word, p_size AS frames, (sum(p_size) OVER b - p_size)::BIGINT + CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS start, p_size // 3 AS a, p_size // 3 AS c, p_size - 2 * (p_size // 3) + CASE WHEN p_partkey % 70 = 0 THEN 1 ELSE 0 END AS s FROM part WINDOW b AS (PARTITION BY p_brand ORDER BY p_partkey, p_name)),"
       " n AS (SELECT *, row_number() OVER (PARTITION BY library, word ORDER BY place) AS nth, coalesce(sum(frames) OVER (PARTITION BY library ORDER BY place, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)"
       " SELECT library, word, 'word' AS fault FROM n WHERE nth > 1 UNION ALL SELECT library, word, 'offset' FROM n WHERE start <> before UNION ALL SELECT library, word, 'timing' FROM n WHERE frames < 2 OR a + s + c <> frames"
       " UNION ALL SELECT library, NULL, 'values' FROM w GROUP BY library HAVING count(*) % 3 = 0)")  # fmt: skip
def index_faults(spark, sf_dir):
    """Parts as words of libraries by brand, with faults planted by rule (VAL-01, VAL-03)."""
    size = F.col("p_size")
    b = Window.partitionBy("p_brand").orderBy("p_partkey", "p_name")
    words = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("library"), F.col("p_partkey").alias("place"), F.col("p_name").alias("word"), size.alias("frames"),
        (F.sum(size).over(b) - size + F.when(F.col("p_partkey") % 50 == 0, 1).otherwise(0)).alias("offset"),
        F.floor(size / 3).alias("hold_in"), F.floor(size / 3).alias("hold_out"), (size - 2 * F.floor(size / 3) + F.when(F.col("p_partkey") % 70 == 0, 1).otherwise(0)).alias("stroke"),
    )
    whole = words.groupBy("library").agg(F.sum("frames").alias("frames"), F.count("*").alias("_n"))
    data = whole.select("library", F.lit(30.0).alias("fps"), F.lit(47).alias("bones"), F.lit(2).alias("variants"), "frames", (F.col("frames") * 2 * 47 * 4 + F.when(F.col("_n") % 3 == 0, 1).otherwise(0)).alias("values"))
    return validation.index_faults(words, data)


@query("SELECT n_name AS bone, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def controlled_order(spark, sf_dir):
    """Nations that have customers, in the order of their keys, as bones in the order of a rig (TOP-07)."""
    nations = table(spark, sf_dir, "nation")
    used = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return validation.controlled_order(used, nations, "n_name", "n_name", "n_nationkey")


@query(series_queries.ORACLE_SQL["ema"].replace(r6("y"), "(floor(y * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE)"))
def chunked_average(spark, sf_dir):
    """An average that forgets within 120 rows, by chunks of 150 with that halo: the same as over whole series (SRC-17, SET-04)."""
    told = validation.by_chunks(rows(spark, sf_dir), "user_id", "i", 150, 120, lambda d, s: folds.exponential_average(d, s, ["i"], "value", 0.18))
    return told.select("user_id", "i", round_up_half(F.col("average"), 4).alias("average"))
