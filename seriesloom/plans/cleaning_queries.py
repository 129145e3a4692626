"""Queries over the steps around cleaning, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as words
from ..functions.quaternions import unit
from ..functions.scalars import round_up_half
from ..operators import cleaning, gaps, lookup, timeline
from . import inputs, series_queries
from .inputs import GRID, ROTATIONS, ROWS, r6, rows, table
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


@query(f"""WITH p AS (SELECT vec_id, unnest([[embedding[1], embedding[2]], [embedding[3], embedding[4]], [embedding[5], embedding[6]]]) AS p FROM embeddings)
    SELECT vec_id, {r6("count(*) FILTER (p[1] < -0.05::DOUBLE OR p[1] > 1.05::DOUBLE OR p[2] < -0.05::DOUBLE OR p[2] > 1.05::DOUBLE) / 3.0::DOUBLE")} AS share FROM p GROUP BY vec_id""")
def out_of_frame_share(spark, sf_dir):
    """Three points of each embedding against the unit square."""
    point = lambda k: F.transform(F.slice("embedding", k, 2), lambda x: x.cast("double"))
    share = cleaning.outside_share(F.array(point(1), point(3), point(5)), 0.05)
    return table(spark, sf_dir, "embeddings").select("vec_id", round_up_half(share, 6).alias("share"))


@query("""SELECT l_returnflag, CASE WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.06 THEN 'tax' WHEN l_quantity < 10 THEN 'quantity' END AS reason, count(*) AS lines FROM lineitem GROUP BY ALL""")
def acceptance_cascade(spark, sf_dir):
    reason = cleaning.first_failure(discount=F.col("l_discount") > 0.08, tax=F.col("l_tax") > 0.06, quantity=F.col("l_quantity") < 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", reason.alias("reason")).agg(F.count("*").alias("lines"))


@query(f"WITH {ROWS} SELECT user_id, i, value FROM rows_ WHERE i % 6 = 0")
def systematic_sample(spark, sf_dir):
    """Every sixth row of a series: the sampling is the feature."""
    return cleaning.every_nth(rows(spark, sf_dir), "user_id", ["i"], 6).select("user_id", "i", "value")


@query(f"""WITH {ROWS}, p AS (SELECT *, event_type <> 'error' AS p, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM rows_)
    SELECT user_id, i, last_value(CASE WHEN p AND b % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS held FROM p""")
def stride_hold(spark, sf_dir):
    return cleaning.sample_and_hold(rows(spark, sf_dir), "user_id", "i", "value", F.col("event_type") != "error", 3).select("user_id", "i", "held")


@query(f"""WITH {ROWS}, n AS (SELECT user_id, max(i) AS last FROM rows_ GROUP BY user_id),
    j AS (SELECT r.user_id, r.i, greatest(0, r.i - 7) AS low, least(last, r.i + 6) AS high FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY i)) >= 60 AS jump FROM rows_) r JOIN n USING (user_id) WHERE jump),
    e AS (SELECT r.user_id, r.i, max(j.i) AS k FROM rows_ r JOIN j ON j.user_id = r.user_id AND r.i BETWEEN j.low AND j.high GROUP BY r.user_id, r.i),
    w AS (SELECT e.user_id, e.i, low, high, 0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * (e.i - low) / (high - low)::DOUBLE) AS w FROM e JOIN j ON j.user_id = e.user_id AND j.i = e.k)
    SELECT r.user_id, r.i, {r6("a.value * (1 - w) + b.value * w")} AS bridged FROM rows_ r LEFT JOIN w ON w.user_id = r.user_id AND w.i = r.i
    LEFT JOIN rows_ a ON a.user_id = w.user_id AND a.i = low LEFT JOIN rows_ b ON b.user_id = w.user_id AND b.i = high""")
def cosine_bridges(spark, sf_dir):
    return cleaning.bridges(rows(spark, sf_dir), "user_id", "i", "value", 60.0).select("user_id", "i", six("bridged"))


_MASK = series_queries.ORACLE_SQL["butterworth_filtfilt"].replace(
    "event_type, value,", "event_type, CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value,", 1
).replace(r6("y"), "y").replace(r6("value"), "value")


@query(f"""WITH {ROWS}, m AS ({_MASK}), w AS (SELECT user_id, i, greatest(least(smooth, 1.0::DOUBLE), 0.0::DOUBLE) AS w FROM m)
    SELECT user_id, i, {r6("value * w + (i % 10) * (1 - w)")} AS faded FROM rows_ JOIN w USING (user_id, i)""")
def source_cross_fade(spark, sf_dir):
    both = rows(spark, sf_dir).withColumn("other", (F.col("i") % 10).cast("double"))
    return cleaning.cross_fade(both, "user_id", "i", "value", "other", F.col("event_type") != "error", 0.1, 1.0).select("user_id", "i", six("faded"))


@query()
def hypothesis_path(spark, sf_dir):
    """Two rotations of each embedding as hypotheses, or neither (a path: held against a plain version, no SQL twin)."""
    part = lambda k: unit(F.transform(F.slice("embedding", k, 4), lambda x: x.cast("double")))
    cost = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    told = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.array(part(1), part(5)).alias("turns"), F.array(cost(8), cost(9)).alias("costs"))
    told = timeline.number_rows(told.where("turns[0] is not null and turns[1] is not null"), "label", ["vec_id"])
    return cleaning.choose_hypotheses(told, "label", "i", "turns", "costs", 0.6, 0.1, 4.0).select("label", "vec_id", "choice")


@query()
def anchored_offsets(spark, sf_dir):
    """Offsets of -60 to 60 by 2 that bring each user's values near 20 at least cost (a path: held against enumeration, no SQL twin)."""
    offsets = [float(2 * j) for j in range(-30, 31)]
    told = rows(spark, sf_dir).withColumn("costs", F.transform(F.lit(offsets), lambda o: F.abs(F.col("value") + o - 20) + F.abs(o) * 0.05))
    return cleaning.anchored_path(told, "user_id", ["i"], "costs", F.col("value") > 150, offsets, 0.01).select("user_id", "i", "offset")


_SLERP = f"""WITH {ROTATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, vec_id % 4 <> 1 AS valid FROM rot),
    a AS (SELECT *, last_value(CASE WHEN valid THEN k END IGNORE NULLS) OVER (PARTITION BY label ORDER BY k ROWS UNBOUNDED PRECEDING) AS ka,
        first_value(CASE WHEN valid THEN k END IGNORE NULLS) OVER (PARTITION BY label ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM r),
    p AS (SELECT a.label, a.vec_id, a.k, coalesce(ka, kb) AS ka, coalesce(kb, ka) AS kb FROM a WHERE ka IS NOT NULL OR kb IS NOT NULL),
    d AS (SELECT p.*, u.x, u.y, u.z, u.w, v.x AS bx, v.y AS by_, v.z AS bz, v.w AS bw, u.x*v.x + u.y*v.y + u.z*v.z + u.w*v.w AS c, coalesce((p.k - p.ka) / nullif(p.kb - p.ka, 0)::DOUBLE, 0) AS t FROM p JOIN r u ON u.label = p.label AND u.k = p.ka JOIN r v ON v.label = p.label AND v.k = p.kb),
    o AS (SELECT *, acos(least(abs(c), 1.0::DOUBLE)) AS o, CASE WHEN c < 0 THEN -1 ELSE 1 END AS s FROM d),
    f AS (SELECT *, CASE WHEN ka = kb THEN 1.0::DOUBLE ELSE sin((1 - t) * o) / sin(o) END AS wa, CASE WHEN ka = kb THEN 0.0::DOUBLE ELSE s * sin(t * o) / sin(o) END AS wb FROM o)"""


@query(_SLERP + f""" SELECT label, vec_id, {r6("x*wa + bx*wb")} AS x, {r6("y*wa + by_*wb")} AS y, {r6("z*wa + bz*wb")} AS z, {r6("w*wa + bw*wb")} AS w FROM f""")
def quat_slerp_fill(spark, sf_dir):
    turns = timeline.number_rows(inputs.rotations(spark, sf_dir).where("q is not null"), "label", ["vec_id"], "k")
    turns = turns.withColumn("q", F.when(F.col("vec_id") % 4 != 1, F.col("q")))
    filled = gaps.slerp_fill(turns, "label", "q").where("q is not null")
    return filled.select("label", "vec_id", *(round_up_half(F.get("q", F.lit(k)), 6).alias(c) for k, c in enumerate("xyzw")))


@query(f"""WITH {GRID}, s AS (SELECT user_id, k // 24 AS day, event_type, event_id, value FROM grid WHERE event_id IS NOT NULL)
    SELECT user_id, day, arg_min(event_id, (event_id, value)) FILTER (event_type = 'view') AS seen, arg_min(event_id, (event_id, value)) FILTER (event_type = 'click') AS clicked, arg_min(event_id, (event_id, value)) FILTER (event_type = 'error') AS failed
    FROM s WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id, day""")
def aligned_streams(spark, sf_dir):
    days = inputs.slots(spark, sf_dir).select("user_id", F.floor(F.col("k") / 24).cast("long").alias("day"), "event_type", "event_id", "value")
    streams = {name: days.where(F.col("event_type") == kind).select("user_id", "day", "event_id", "value") for name, kind in (("seen", "view"), ("clicked", "click"), ("failed", "error"))}
    told = cleaning.aligned(streams, "user_id", "day")
    return told.select("user_id", "day", *(F.col(f"{n}.event_id").alias(n) for n in streams))


@query(f"""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderdate < DATE '1995-01-01') AS a, count(*) FILTER (o_orderdate >= DATE '1995-01-01') AS b,
      max(o_totalprice) FILTER (o_orderdate < DATE '1995-01-01') AS pa, max(o_totalprice) FILTER (o_orderdate >= DATE '1995-01-01') AS pb FROM orders GROUP BY o_custkey)
    SELECT o_custkey, nullif(a, 0) AS orders_before, nullif(b, 0) AS orders_after, nullif(b, 0) - nullif(a, 0) AS orders_change, pa AS dearest_before, pb AS dearest_after, {r6("pb - pa")} AS dearest_change FROM o WHERE a + b > 0""")
def before_after_report(spark, sf_dir):
    def part(when: str):
        return table(spark, sf_dir, "orders").where(when).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("dearest"))

    told = cleaning.before_after(part("o_orderdate < date'1995-01-01'"), part("o_orderdate >= date'1995-01-01'"), "o_custkey", ["orders", "dearest"])
    return told.withColumn("dearest_change", round_up_half(F.col("dearest_change"), 6))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.03 THEN l_extendedprice END, p_retailprice) AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey""")
def rest_pose(spark, sf_dir):
    """Missing values from a dimension's rest values."""
    rest = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") > 0.03, F.col("l_extendedprice")).alias("price"))
    return cleaning.or_rest(lines, "l_partkey", "price", rest, "p_retailprice").select("l_orderkey", "l_linenumber", "price")


@query(f"""WITH l AS (SELECT p_type, list_sort(list(p_retailprice)) AS v FROM part WHERE p_retailprice IS NOT NULL GROUP BY p_type)
    SELECT p_type, len(v)::BIGINT AS samples, {r6("CASE WHEN len(v) >= 20 THEN list_aggregate(v, 'median') END")} AS median_mid, CASE WHEN len(v) >= 20 THEN v[len(v)//2 + 1] END AS median_upper FROM l""")
def guarded_medians(spark, sf_dir):
    return cleaning.guarded_medians(table(spark, sf_dir, "part"), "p_type", "p_retailprice").select("p_type", "samples", six("median_mid"), "median_upper")


@query(f"""WITH l AS (SELECT user_id, count(value) AS n, avg(value) AS mean, max(value) AS greatest, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id)
    SELECT user_id, n, {r6("mean")} AS mean, greatest, v[floor(0.95::DOUBLE * (n - 1))::BIGINT + 1] AS high FROM l""")
def timing_summary(spark, sf_dir):
    return cleaning.timing_summary(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", "n", six("mean"), "greatest", "high")


@query("SELECT user_id, arg_min(event_id, (abs(value - 20), event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY user_id")
def nearest_entry(spark, sf_dir):
    entries = table(spark, sf_dir, "events").withColumn("place", F.col("event_id"))
    return cleaning.nearest_entry(entries, "user_id", "value", 20.0, "place", "event_id")


@query("SELECT lang, greatest(1, floor(coalesce(sum(n_chars), 0) / 30.0::DOUBLE / 60 + 0.5::DOUBLE))::BIGINT AS minutes FROM documents GROUP BY lang")
def playback_minutes(spark, sf_dir):
    return cleaning.playback_minutes(table(spark, sf_dir, "documents"), "lang", "n_chars", 30.0)


@query("""WITH n AS (SELECT l_orderkey, l_linenumber - 1 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (p <> i) = 0 AS contiguous, min(CASE WHEN p <> i THEN i END) AS first_wrong FROM n GROUP BY l_orderkey""")
def contiguous_places(spark, sf_dir):
    return cleaning.contiguous(table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_linenumber") - 1), "l_orderkey", "p")


_LABELS = "CASE o_custkey % 5 WHEN 0 THEN 'hesheit' WHEN 1 THEN 'thankyou' WHEN 2 THEN 'TV' WHEN 3 THEN 'shhh' ELSE 'go' END"


@query(f"""WITH w AS (SELECT {_LABELS} AS gloss, CASE WHEN o_orderkey % 2 = 0 THEN 'both' ELSE 'right' END AS hands, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS ok, o_totalprice > 300000 AS attention, o_orderkey % 3 = 0 AS done, o_orderkey FROM orders),
    l AS (SELECT *, CASE gloss WHEN 'hesheit' THEN 'he / she / it' WHEN 'thankyou' THEN 'thank you' WHEN 'shhh' THEN 'shh' ELSE gloss END AS label FROM w)
    SELECT label, count(*) AS n_all, count(*) FILTER (hands = 'both') AS n_two, count(*) FILTER (attention) AS n_attention, count(*) FILTER (NOT ok) AS n_misread, count(*) FILTER (NOT done) AS n_unreviewed, count(*) FILTER (done) AS n_reviewed,
        count(*) FILTER (contains(lower(gloss), 'hes') OR contains(regexp_replace(lower(label), '[\\s/]', '', 'g'), 'hes')) AS n_found,
        count(*) FILTER (o_orderkey % 7 < 2) AS n_tolerated FROM l GROUP BY label""")
def word_filter_counts(spark, sf_dir):
    """How many words each filter of the list shows, by label, and how many findings are tolerated."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    turn = F.col("o_custkey") % 5
    gloss = F.when(turn == 0, "hesheit").when(turn == 1, "thankyou").when(turn == 2, "TV").when(turn == 3, "shhh").otherwise("go")
    finding = F.when(key % 7 == 0, "hand resets to rest pose while tracked").when(key % 7 == 1, "12 one-frame finger spikes in 3 s").otherwise("the hand resets to rest pose while tracked")
    told = table(spark, sf_dir, "orders").withColumn("gloss", gloss).withColumn("label", lookup.gloss_label(F.col("gloss")))
    tests = words.word_filters(F.when(key % 2 == 0, "both").otherwise("right"), F.when(status != "P", status == "F"), F.col("o_totalprice") > 300000, key % 3 == 0)
    tests |= {"found": words.found_in("He s", F.col("gloss"), F.col("label")), "tolerated": words.tolerated(finding)}
    return told.groupBy("label").agg(*(F.count_if(t).alias(f"n_{n}") for n, t in tests.items()))
