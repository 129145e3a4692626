"""Queries over rotations and the relational library, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quaternions as q
from ..functions import text as words
from ..functions.scalars import round_up_half
from ..functions.selection import linear_quantiles
from ..operators import folds, lookup, relations, rotations
from . import inputs
from .inputs import ROTATIONS, r6, table
from .series_queries import six

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


# ---- rotations


def _parts(column: str = "q"):
    return [round_up_half(q.at(F.col(column), k), 6).alias(c) for k, c in enumerate("xyzw")]


_DOT = "x*lag(x) OVER v + y*lag(y) OVER v + z*lag(z) OVER v + w*lag(w) OVER v"
_V = "WINDOW v AS (PARTITION BY label ORDER BY vec_id)"


@query(f"""WITH {ROTATIONS}, f AS (SELECT *, CASE WHEN {_DOT} < 0 THEN 1 ELSE 0 END AS f FROM rot {_V}),
    s AS (SELECT *, CASE WHEN sum(f) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) % 2 = 1 THEN -1 ELSE 1 END AS s FROM f)
    SELECT label, vec_id, {r6("s*x")} AS x, {r6("s*y")} AS y, {r6("s*z")} AS z, {r6("s*w")} AS w FROM s""")
def quat_hemisphere_align(spark, sf_dir):
    return rotations.align(inputs.rotations(spark, sf_dir), "label", "vec_id", "q").select("label", "vec_id", *_parts())


@query(f"WITH {ROTATIONS} SELECT label, vec_id, {r6(f'2 * acos(least(abs({_DOT}), 1.0::DOUBLE))')} AS step FROM rot {_V}")
def quat_angle_steps(spark, sf_dir):
    return rotations.angle_steps(inputs.rotations(spark, sf_dir), "label", "vec_id", "q").select("label", "vec_id", six("step"))


@query(f"""WITH {ROTATIONS}, d AS (SELECT label, abs(sqrt(x*x + y*y + z*z + w*w) - 1) AS e, {_DOT} < 0 AS flip FROM rot {_V})
    SELECT label, count(*) AS "rows", 0::BIGINT AS not_finite, {r6("max(e)")} AS norm_error, count(*) FILTER (flip) AS flips FROM d GROUP BY label""")
def quat_norm_check(spark, sf_dir):
    told = rotations.numeric_checks(inputs.rotations(spark, sf_dir), "label", "vec_id", "q")
    return told.select("label", "rows", "not_finite", six("norm_error"), "flips")


@query(f"""WITH {ROTATIONS}, i AS (SELECT label, vec_id, [floor(x * 32767 + 0.5::DOUBLE), floor(y * 32767 + 0.5::DOUBLE), floor(z * 32767 + 0.5::DOUBLE), floor(w * 32767 + 0.5::DOUBLE)] AS i FROM rot),
    n AS (SELECT *, sqrt((i[1]/32767)**2 + (i[2]/32767)**2 + (i[3]/32767)**2 + (i[4]/32767)**2) AS n FROM i)
    SELECT vec_id, i[1]::BIGINT AS ix, i[2]::BIGINT AS iy, i[3]::BIGINT AS iz, i[4]::BIGINT AS iw, {r6("i[1]/32767/n")} AS x, {r6("i[4]/32767/n")} AS w FROM n""")
def int16_quantise(spark, sf_dir):
    packed = inputs.rotations(spark, sf_dir).withColumn("i", q.quantise(F.col("q")))
    packed = packed.withColumn("r", q.restore(F.col("i")))
    return packed.select("vec_id", *(q.at(F.col("i"), k).cast("long").alias(f"i{c}") for k, c in enumerate("xyzw")), *(p for p in _parts("r")[:1]), _parts("r")[3])


@query(f"""WITH {ROTATIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM rot), p AS (SELECT a.*, b.x AS bx, b.y AS by_, b.z AS bz, b.w AS bw FROM k a JOIN k b ON a.label = b.label AND b.k = a.k + 1),
    d AS (SELECT *, CASE WHEN x*bx + y*by_ + z*bz + w*bw < 0 THEN -1 ELSE 1 END AS s, abs(x*bx + y*by_ + z*bz + w*bw) AS d FROM p),
    t AS (SELECT *, acos(least(d, 1.0::DOUBLE)) AS o FROM d), f AS (SELECT *, sin(0.75::DOUBLE * o) / sin(o) AS wa, s * sin(0.25::DOUBLE * o) / sin(o) AS wb FROM t)
    SELECT label, k, {r6("x*wa + bx*wb")} AS x, {r6("y*wa + by_*wb")} AS y, {r6("z*wa + bz*wb")} AS z, {r6("w*wa + bw*wb")} AS w FROM f""")
def quat_slerp_sample(spark, sf_dir):
    """Every track a quarter of a frame after each of its frames but the last."""
    frames = inputs.rotations(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long") - 1)
    last = frames.groupBy("label").agg(F.max("k").alias("m"))
    points = frames.join(last, "label").where("k < m").select("label", F.col("k").alias("frame"), (F.col("k") + 0.25).alias("at"))
    told = rotations.sample_rotation(points, frames.select("label", "k", "q"), "label", "at", "q", 1.0)
    return told.select("label", F.col("frame").alias("k"), *_parts())


@query(f"""WITH {ROTATIONS}, t AS (SELECT *, sqrt(y*y + w*w) AS n FROM rot)
    SELECT vec_id, {r6("CASE WHEN n*n < 1e-12 THEN 0 ELSE 2 * acos(least(abs(w) / n, 1.0::DOUBLE)) * CASE WHEN (CASE WHEN w < 0 THEN -y ELSE y END) >= 0 THEN 1 ELSE -1 END END")} AS twist,
           {r6("abs(CASE WHEN n*n < 1e-12 THEN w ELSE (w*abs(w) + y*(CASE WHEN w < 0 THEN -y ELSE y END)) / n END)")} AS swing_w FROM t""")
def swing_twist(spark, sf_dir):
    axis = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    told = inputs.rotations(spark, sf_dir).withColumn("swing", q.swing(F.col("q"), axis))
    return told.select("vec_id", round_up_half(q.twist_angle(F.col("q"), axis), 6).alias("twist"), round_up_half(F.abs(q.at(F.col("swing"), 3)), 6).alias("swing_w"))


@query(f"""WITH {ROTATIONS}, a AS (SELECT label, vec_id, atan2(y, x) AS a FROM rot), d AS (SELECT *, a - lag(a) OVER (PARTITION BY label ORDER BY vec_id) AS d FROM a)
    SELECT label, vec_id, {r6("sum(coalesce(atan2(sin(d), cos(d)), a)) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)")} AS angle FROM d""")
def angle_unwrap(spark, sf_dir):
    angles = inputs.rotations(spark, sf_dir).select("label", "vec_id", F.atan2(q.at(F.col("q"), 1), q.at(F.col("q"), 0)).alias("angle"))
    return rotations.unwrap(angles, "label", "vec_id", "angle").select("label", "vec_id", six("angle"))


@query()
def quat_average(spark, sf_dir):
    """The mean rotation of each label (an eigenvector: no SQL twin)."""
    return rotations.average(inputs.rotations(spark, sf_dir), "label", "q").select("label", *_parts("average"))


@query()
def dominant_axis(spark, sf_dir):
    return rotations.dominant_axis(inputs.rotations(spark, sf_dir), "label", "q").select("label", *(round_up_half(q.at(F.col("axis"), k), 6).alias(c) for k, c in enumerate("xyz")))


@query()
def fitted_rotation(spark, sf_dir):
    """The rotation between consecutive triples of each embedding, per label."""
    pairs = table(spark, sf_dir, "embeddings").select("label", *(F.transform(F.slice("embedding", a, 3), lambda x: x.cast("double")).alias(c) for a, c in ((1, "p"), (4, "q"))))
    return rotations.fitted_rotation(pairs, "label", "p", "q").select("label", *_parts("rotation"))


@query()
def lone_turns(spark, sf_dir):
    """Rotations that neither neighbour shares, judged in order (each decision changes later ones: no SQL twin)."""
    told = inputs.rotations(spark, sf_dir).withColumn("valid", F.col("vec_id") % 11 != 0)
    return folds.clear_lone_turns(told, "label", ["vec_id"], "q", "valid", far=1.2, near=1.1).select("label", "vec_id", "kept")


@query(f"""WITH g AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), s AS (SELECT unnest(generate_series(10, 70)) / 20.0::DOUBLE AS z_scale),
    l AS (SELECT label, z_scale, sqrt(x*x + y*y + (z*z_scale)*(z*z_scale)) AS n FROM g, s), c AS (SELECT label, z_scale, stddev_pop(n) / avg(n) AS cost FROM l GROUP BY label, z_scale)
    SELECT label, arg_min(z_scale, (floor(cost * 1e9::DOUBLE), z_scale)) AS z, {r6("min(cost)")} AS cost FROM c GROUP BY label""")
def grid_search_argmin(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("label", *(F.get("embedding", F.lit(k)).cast("double").alias(f"p{k}") for k in range(3)))
    x, y, z = (F.col(f"p{k}") for k in range(3))
    told = relations.grid_argmin(points, "label", [k / 20 for k in range(10, 71)], lambda s: F.sqrt(x * x + y * y + (z * s) * (z * s)), lambda c: F.stddev_pop(c) / F.avg(c))
    return told.select("label", "z", six("cost"))


# ---- the library


@query("SELECT DISTINCT l_partkey AS track FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def unknown_tracks_anti(spark, sf_dir):
    rig = table(spark, sf_dir, "part").where("p_size <= 25")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("track")).distinct().join(rig, F.col("track") == F.col("p_partkey"), "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def reviewed_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def keyset_symmetric_diff(spark, sf_dir):
    return relations.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1998-01-01'")
def except_codes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return relations.new_codes(orders.where("o_orderdate >= date'1998-01-01'").select("o_custkey"), orders.where("o_orderdate < date'1998-01-01'").select("o_custkey"))


@query("SELECT d.doc_id, d.version, l.quality FROM (SELECT doc_id, n_chars % 3 AS version FROM documents) d JOIN (SELECT doc_id, quality + toxic AS version, quality FROM labels) l ON l.doc_id = d.doc_id AND l.version = d.version")
def review_join_stale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 3).alias("version"))
    reviews = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).cast("long").alias("version"), "quality")
    return relations.current_reviews(docs, reviews, "doc_id", "version").select("doc_id", "version", "quality")


_CELL = """CASE WHEN regexp_matches(coalesce({c}::VARCHAR, ''), '[",\\n\\r]') THEN '"' || replace({c}::VARCHAR, '"', '""') || '"' ELSE coalesce({c}::VARCHAR, '') END"""


@query(f"""SELECT d.doc_id, {" || ',' || ".join(_CELL.format(c=c) for c in ("d.doc_id", "d.lang", "l.quality", "d.text"))} AS line FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def review_csv_lines(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return relations.csv_lines(joined, ["doc_id", "lang", "quality", "text"]).select("doc_id", "line")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders))
    SELECT o_custkey, o_orderkey FROM l WHERE n = 1 AND o_orderstatus <> 'P'""")
def review_upsert(spark, sf_dir):
    """The last decision of each word in an append-only log; deletions (status P) end a word."""
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return relations.latest(log, "o_custkey", "o_orderdate", F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey")


_TAKES = """takes AS (SELECT o_custkey AS word, o_orderkey AS take, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank,
    CASE WHEN o_totalprice > 400000 THEN 'approved' WHEN o_totalprice < 50000 THEN 'rejected' ELSE 'unreviewed' END AS status, o_orderstatus = 'F' AS recognised FROM orders)"""


def _takes(spark, sf_dir):
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = F.when(F.col("o_totalprice") > 400000, "approved").when(F.col("o_totalprice") < 50000, "rejected").otherwise("unreviewed")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("word"), F.col("o_orderkey").alias("take"), F.row_number().over(order).cast("long").alias("rank"), status.alias("status"), (F.col("o_orderstatus") == "F").alias("recognised"))


@query(f"WITH {_TAKES}, r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY (status = 'approved') DESC, recognised DESC, rank, take) AS n FROM takes WHERE status <> 'rejected') SELECT word, take, rank, status FROM r WHERE n = 1")
def take_choice(spark, sf_dir):
    return relations.choose_take(_takes(spark, sf_dir), "word", "rank", "status", "recognised", "take").select("word", "take", "rank", "status")


@query(f"""WITH {_TAKES} SELECT count(*) AS takes, count(DISTINCT word) AS words, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
    count(*) FILTER (NOT recognised) AS misread, count(*) FILTER (rank = 1 AND status = 'rejected') AS first_rejected FROM takes""")
def library_counts(spark, sf_dir):
    return _takes(spark, sf_dir).agg(
        F.count("*").alias("takes"), F.countDistinct("word").alias("words"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(~F.col("recognised")).alias("misread"), F.count_if((F.col("rank") == 1) & (F.col("status") == "rejected")).alias("first_rejected"),
    )


@query(r"""SELECT regexp_replace(event_type || ' over ' || value::BIGINT || '.5e-3 deg in ' || props, '\d+(\.\d+)?(e-?\d+)?', '#', 'g') AS message, count(*) AS times FROM events GROUP BY 1""")
def failure_tally(spark, sf_dir):
    message = F.concat(F.col("event_type"), F.lit(" over "), F.bround("value").cast("long").cast("string"), F.lit(".5e-3 deg in "), F.col("props"))
    return relations.tally(table(spark, sf_dir, "events"), message)


@query("""SELECT event_type, count(*) AS hits, max(value) AS greatest, list_sort(list(event_id))[1:12] AS first_places FROM events WHERE value > 30 GROUP BY event_type""")
def counter_first12(spark, sf_dir):
    return relations.counter(table(spark, sf_dir, "events"), "event_type", F.col("value") > 30, "value", "event_id")


@query("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, event_id FROM l WHERE event_type = b""")
def repeated_frames(spark, sf_dir):
    return relations.repeated_rows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("""SELECT event_type, quantile_cont(value, 0.1::DOUBLE) AS p10, quantile_cont(value, 0.5::DOUBLE) AS p50, quantile_cont(value, 0.95::DOUBLE) AS p95, min(value) AS least, max(value) AS greatest FROM events GROUP BY event_type""".replace("quantile_cont(value, 0.1::DOUBLE)", r6("quantile_cont(value, 0.1::DOUBLE)")).replace("quantile_cont(value, 0.5::DOUBLE)", r6("quantile_cont(value, 0.5::DOUBLE)")).replace("quantile_cont(value, 0.95::DOUBLE)", r6("quantile_cont(value, 0.95::DOUBLE)")))
def baseline_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    told = linear_quantiles(events, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    ends = events.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
    return told.join(ends, "event_type").select("event_type", *(round_up_half(F.col(n), 6).alias(n) for n in ("p10", "p50", "p95")), "least", "greatest")


@query("SELECT n_name, row_number() OVER (ORDER BY lower(n_name)) AS place FROM nation")
def locale_sort_rank(spark, sf_dir):
    ranked = table(spark, sf_dir, "nation").withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.expr("n_name collate UNICODE_CI_AI"))).cast("long"))
    return ranked.select("n_name", "place")


@query("""WITH o AS (SELECT n_regionkey, n_name, lead(n_name) OVER w AS n, lag(n_name) OVER w AS p, first_value(n_name) OVER g AS f, last_value(n_name) OVER g AS l FROM nation
    WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name), g AS (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT n_regionkey, n_name, coalesce(n, f) AS next_key, coalesce(p, l) AS previous_key FROM o""")
def next_previous(spark, sf_dir):
    return relations.neighbours_in_order(table(spark, sf_dir, "nation"), ["n_name"], "n_name", "n_regionkey").select("n_regionkey", "n_name", "next_key", "previous_key")


@query("""WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    up AS (SELECT node, node AS ancestor, 0 AS depth FROM nodes UNION ALL SELECT up.node, n.parent, depth + 1 FROM up JOIN nodes n ON n.node = up.ancestor WHERE n.parent IS NOT NULL) SELECT node, ancestor, depth FROM up""")
def rig_closure(spark, sf_dir):
    def part(name, prefix, key, above=None, up=None):
        parent = F.concat(F.lit(above), F.col(up).cast("string")) if above else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"), parent.alias("parent"))

    return relations.closure(part("region", "r", "r_regionkey").union(part("nation", "n", "n_nationkey", "r", "n_regionkey")).union(part("supplier", "s", "s_suppkey", "n", "s_nationkey")))


_GLOSSES = ("it", "we", "haveto", "hesheit", "weus", "minemy", "un", "de", "the", "la", "que")

_NORM = "regexp_replace(lower({w}), '[^a-z0-9]', '', 'g')"
_PHRASES_SQL = " UNION ALL ".join(
    [f"SELECT 0 AS kind, {k} AS place, 0 AS j, '{g}' AS gloss, '{g}' AS phrase" for k, g in enumerate(_GLOSSES)]
    + [f"SELECT 1, {k}, {j}, '{g}', '{p}'" for k, g in enumerate(_GLOSSES) for j, p in enumerate(lookup.PHRASES.get(g, []))]
)


@query(f"""WITH RECURSIVE all_p AS ({_PHRASES_SQL}), phrases AS (SELECT phrase, gloss FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY kind, place, j) AS n FROM all_p) WHERE n = 1),
    raw AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS raw FROM conversations WHERE text IS NOT NULL),
    w AS MATERIALIZED (SELECT conv_id, turn, unnest(raw) AS raw, generate_subscripts(raw, 1) - 1 AS place FROM raw),
    n AS MATERIALIZED (SELECT *, {_NORM.format(w="raw")} AS a, coalesce(' ' || {_NORM.format(w="lead(raw) OVER v")}, '') AS b, lead(raw) OVER v AS rb, coalesce(' ' || {_NORM.format(w="lead(raw, 2) OVER v")}, '') AS c, lead(raw, 2) OVER v AS rc FROM w WINDOW v AS (PARTITION BY conv_id, turn ORDER BY place)),
    m AS MATERIALIZED (SELECT n.*, p1.gloss AS g1, CASE WHEN rb IS NOT NULL THEN p2.gloss END AS g2, CASE WHEN rc IS NOT NULL THEN p3.gloss END AS g3 FROM n LEFT JOIN phrases p1 ON p1.phrase = a LEFT JOIN phrases p2 ON p2.phrase = a || b LEFT JOIN phrases p3 ON p3.phrase = a || b || c),
    best AS MATERIALIZED (SELECT conv_id, turn, place, CASE WHEN a = '' THEN 1 WHEN g3 IS NOT NULL THEN 3 WHEN g2 IS NOT NULL THEN 2 ELSE 1 END AS size, a = '' AS skip,
        CASE WHEN g3 IS NOT NULL THEN raw || ' ' || rb || ' ' || rc WHEN g2 IS NOT NULL THEN raw || ' ' || rb ELSE raw END AS text, coalesce(g3, g2, g1) AS gloss FROM m),
    walk AS (SELECT * FROM best WHERE place = 0 UNION ALL SELECT b.* FROM walk k JOIN best b ON b.conv_id = k.conv_id AND b.turn = k.turn AND b.place = k.place + k.size)
    SELECT conv_id, turn, place, text, gloss FROM walk WHERE NOT skip""")
def phrase_lookup(spark, sf_dir):
    glosses = spark.createDataFrame(list(enumerate(_GLOSSES)), "place int, gloss string")
    found = lookup.find_phrases(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", lookup.phrase_table(glosses))
    return found.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "text", "gloss")


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[\\s/]', '', 'g') AS search_key, list_extract(string_split(p_type, ' '), -1) AS base,
    CASE WHEN regexp_matches(p_brand, '^Brand#1') THEN 'one' ELSE 'other' END AS kind,
    list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, CASE WHEN p_size % 7 = 0 THEN 'seventh' END], lambda x: x IS NOT NULL) AS reasons,
    repeat('A', p_size % 3) || repeat('T', p_size % 5) || repeat('A', p_size % 2) AS states FROM part""")
def labels_and_reasons(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        words.search_key(F.col("p_name")).alias("search_key"),
        words.basename(F.replace(F.col("p_type"), F.lit(" "), F.lit("/"))).alias("base"),
        F.when(F.col("p_brand").rlike("^Brand#1"), "one").otherwise("other").alias("kind"),
        words.reasons(large=size > 40, dear=F.col("p_retailprice") > 1000, seventh=size % 7 == 0).alias("reasons"),
        words.phase_states(size % 3, size % 5, size % 2, F.lit(True)).alias("states"),
    )


@query("""SELECT o_orderkey, 'priced' AS failed FROM orders WHERE NOT coalesce(o_totalprice > 1000, false) UNION ALL SELECT o_orderkey, 'known' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def row_violations(spark, sf_dir):
    return relations.violations(table(spark, sf_dir, "orders"), priced=F.col("o_totalprice") > 1000, known=F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "failed")


@query("""SELECT event_type, CASE event_type WHEN 'view' THEN 'T' WHEN 'click' THEN 'I' WHEN 'error' THEN 'A' END AS code, count(*) AS n FROM events GROUP BY ALL""")
def state_counts(spark, sf_dir):
    state = F.col("event_type")
    named = F.when(state == "view", "tracked").when(state == "click", "interpolated").when(state == "error", "absent")
    return table(spark, sf_dir, "events").groupBy("event_type", words.state_code(named).alias("code")).agg(F.count("*").alias("n"))
