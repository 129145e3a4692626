"""Queries over event series, each with its DuckDB twin."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import array_floor, array_median, array_median_lower, array_median_upper
from ..functions.scalars import clamp, round_half_even, round_up_half, smoothstep, soft_clamp
from ..functions.selection import linear_quantiles, rank_quantiles
from ..operators import folds, gaps, relations, robust, scans, timeline
from .inputs import GRID, HOUR, ROWS, SLOTS, grid, r6, rows, slots, table

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


def six(name: str, alias: str | None = None):
    return round_up_half(F.col(name), 6).alias(alias or name)


@query(f"WITH {SLOTS} SELECT user_id, event_id, i, k, abs(t - k * 3600.0::DOUBLE) >= 3600.0::DOUBLE AS late, false AS backward FROM slots")
def timeline_resample(spark, sf_dir):
    return slots(spark, sf_dir).select("user_id", "event_id", "i", "k", "late", "backward")


@query(f"""WITH {ROWS}, d AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS d FROM rows_),
    m AS (SELECT *, median(d) OVER (PARTITION BY user_id) AS n FROM d)
    SELECT user_id, count(*) AS frames, {r6("(count(*) - 1) / nullif(max(t) - min(t), 0) * 1000")} AS rate_per_1000_s, {r6("min(d)")} AS least_step, {r6("max(d)")} AS greatest_step,
           count(*) FILTER (d = 0) AS repeated_times, coalesce(max(d) - min(d) > 0.002::DOUBLE, false) AS variable_rate, count(*) FILTER (d > n * 1.5::DOUBLE) AS gaps
    FROM m GROUP BY user_id""")
def timing_report(spark, sf_dir):
    told = timeline.timing_report(rows(spark, sf_dir), "user_id", ["i"], "t")
    return told.select("user_id", "frames", round_up_half(F.col("average_rate") * 1000, 6).alias("rate_per_1000_s"), six("least_step"), six("greatest_step"), "repeated_times", "variable_rate", "gaps")


_RUNS = f"""WITH {GRID}, f AS (SELECT *, CASE WHEN valid IS DISTINCT FROM lag(valid) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM grid WINDOW w AS (PARTITION BY user_id ORDER BY k)),
    g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM f),
    runs AS (SELECT user_id, valid AS state, min(k) AS start, max(k) + 1 AS "end" FROM g GROUP BY user_id, island, valid)"""


@query(_RUNS + ' SELECT user_id, start, "end" FROM runs WHERE NOT state')
def missing_runs(spark, sf_dir):
    return gaps.runs(grid(spark, sf_dir), "user_id", F.col("valid")).where("not state").select("user_id", "start", "end")


@query(f"""WITH {ROWS}, f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM rows_ WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, event_type AS state, min(i) AS start, max(i) + 1 AS "end" FROM g WHERE event_type <> 'view' GROUP BY user_id, island, event_type""")
def state_intervals(spark, sf_dir):
    return gaps.runs(rows(spark, sf_dir), "user_id", F.col("event_type"), "i").where("state <> 'view'").select("user_id", "state", "start", "end")


@query(_RUNS + """, n AS (SELECT user_id, max(k) + 1 AS n FROM grid GROUP BY user_id)
    SELECT user_id, start, "end", "end" - start AS length, CASE WHEN start = 0 OR "end" = n THEN 'edge' WHEN "end" - start <= 8 THEN 'short' ELSE 'long' END AS kind
    FROM runs JOIN n USING (user_id) WHERE NOT state""")
def gap_classes(spark, sf_dir):
    return gaps.gap_classes(grid(spark, sf_dir), "user_id", F.col("valid"))


@query(_RUNS + """ SELECT user_id, sum("end" - start)::BIGINT AS frames, coalesce(sum("end" - start) FILTER (state), 0)::BIGINT AS detected,
    round_even(coalesce(sum("end" - start) FILTER (state), 0) / sum("end" - start)::DOUBLE, 4) AS ratio, count(*) FILTER (NOT state) AS missing_runs,
    coalesce(max("end" - start) FILTER (NOT state), 0)::BIGINT AS longest_missing FROM runs GROUP BY user_id""")
def detection_stats(spark, sf_dir):
    return gaps.detection_stats(grid(spark, sf_dir), "user_id", F.col("valid"))


@query(f"""WITH {ROWS}, n AS (SELECT *, list(value) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM rows_),
    m AS (SELECT *, list_aggregate(near, 'median') AS m FROM n), d AS (SELECT *, 1.4826::DOUBLE * list_aggregate(list_transform(near, lambda v: abs(v - m)), 'median') AS s FROM m)
    SELECT user_id, event_id, coalesce(event_type <> 'error' AND len(near) >= 4 AND abs(value - m) > greatest(3.5::DOUBLE * s, 0.1::DOUBLE), false) AS outlier FROM d""")
def hampel_flags(spark, sf_dir):
    return robust.hampel(rows(spark, sf_dir), "user_id", "value", F.col("event_type") != "error", 4, 3.5, 0.1, "i").select("user_id", "event_id", "outlier")


_VALUES = f"""WITH {GRID}, v AS (SELECT user_id, k, CASE WHEN valid THEN value END AS x FROM grid),
    knots AS (SELECT user_id, k, x, lag(k) OVER w AS kp, lag(x) OVER w AS xp, lead(k) OVER w AS kn, lead(x) OVER w AS xn FROM v WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY k)),
    sec AS (SELECT *, (k - kp)::DOUBLE AS h0, (kn - k)::DOUBLE AS h1, (x - xp) / (k - kp) AS s0, (xn - x) / (kn - k) AS s1 FROM knots),
    sl AS (SELECT user_id, k, x, CASE WHEN kp IS NULL THEN s1 WHEN kn IS NULL THEN s0 WHEN s0 * s1 <= 0 THEN 0.0::DOUBLE
           ELSE ((h1 * 2 + h0) + (h1 + h0 * 2)) / ((h1 * 2 + h0) / s0 + (h1 + h0 * 2) / s1) END AS m FROM sec),
    around AS (SELECT v.user_id, v.k, v.x, last_value(sl.k IGNORE NULLS) OVER up AS ka, last_value(sl.x IGNORE NULLS) OVER up AS xa, last_value(sl.m IGNORE NULLS) OVER up AS ma,
           first_value(sl.k IGNORE NULLS) OVER down AS kb, first_value(sl.x IGNORE NULLS) OVER down AS xb, first_value(sl.m IGNORE NULLS) OVER down AS mb
           FROM v LEFT JOIN sl ON sl.user_id = v.user_id AND sl.k = v.k
           WINDOW up AS (PARTITION BY v.user_id ORDER BY v.k ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY v.user_id ORDER BY v.k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    t AS (SELECT *, t1 * t1 AS t2, t1 * t1 * t1 AS t3 FROM (SELECT *, (kb - ka)::DOUBLE AS h, (k - ka) / nullif(kb - ka, 0)::DOUBLE AS t1 FROM around)),
    filled AS MATERIALIZED (SELECT user_id, k, x, coalesce(x, (t3*2 - t2*3 + 1) * xa + (t3 - t2*2 + t1) * h * ma + (t2*3 - t3*2) * xb + (t3 - t2) * h * mb, xa, xb) AS y FROM t)"""


def _valid_grid(spark, sf_dir):
    return grid(spark, sf_dir).select("user_id", "k", F.when(F.col("valid"), F.col("value")).alias("value"))


@query(_VALUES + f" SELECT user_id, k, {r6('y')} AS value FROM filled")
def pchip_fill(spark, sf_dir):
    return gaps.pchip_fill(_valid_grid(spark, sf_dir), "user_id", "value", edges=True).select("user_id", "k", six("value"))


@query(f"""WITH {GRID}, v AS (SELECT user_id, k, CASE WHEN valid THEN value END AS x FROM grid),
    a AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS b, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM v)
    SELECT user_id, k, coalesce(x, CASE WHEN b IS NULL THEN f WHEN f IS NULL THEN b END) AS value FROM a""")
def hold_edges(spark, sf_dir):
    return gaps.hold_edges(_valid_grid(spark, sf_dir), "user_id", "value").select("user_id", "k", "value")


_AROUND = f"""WITH {GRID}, v AS (SELECT user_id, k, CASE WHEN valid THEN value END AS x, CASE WHEN valid THEN k END AS kv FROM grid),
    a AS (SELECT *, last_value(kv IGNORE NULLS) OVER up AS kb, last_value(x IGNORE NULLS) OVER up AS xb, first_value(kv IGNORE NULLS) OVER down AS ka, first_value(x IGNORE NULLS) OVER down AS xa FROM v
          WINDOW up AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(_AROUND + " SELECT user_id, k, CASE WHEN kb IS NULL OR ka - k < k - kb THEN xa ELSE xb END AS value FROM a")
def hold_nearest(spark, sf_dir):
    return gaps.hold_nearest(_valid_grid(spark, sf_dir), "user_id", "value").select("user_id", "k", "value")


@query(_AROUND + " SELECT user_id, k, xb AS value FROM a")
def carry_forward(spark, sf_dir):
    return gaps.carry_forward(_valid_grid(spark, sf_dir), "user_id", "value")


@query(f"""WITH {GRID}, a AS (SELECT *, last_value(event_id IGNORE NULLS) OVER up AS eb, last_value(t IGNORE NULLS) OVER up AS tb, first_value(event_id IGNORE NULLS) OVER down AS ea, first_value(t IGNORE NULLS) OVER down AS ta FROM grid
          WINDOW up AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, k, CASE WHEN eb IS NULL OR abs(ta - k * 3600.0::DOUBLE) < abs(tb - k * 3600.0::DOUBLE) THEN ea ELSE eb END AS shows FROM a""")
def nearest_source(spark, sf_dir):
    return timeline.nearest_source(grid(spark, sf_dir), "user_id", "event_id", "t", HOUR).select("user_id", "k", "shows")


@query(f"""WITH {GRID}, e AS (SELECT user_id, k, CASE WHEN valid THEN k END AS kv, valid FROM grid),
    a AS (SELECT *, last_value(kv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS ka, first_value(kv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM e),
    u AS (SELECT *, greatest(least((k - ka - 4) / 6.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS u, greatest(least((kb - k) / 3.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS s FROM a),
    w AS (SELECT *, CASE WHEN ka IS NULL THEN 0.0::DOUBLE ELSE 1 - u*u*(3 - 2*u) END AS wa, CASE WHEN kb IS NULL THEN 0.0::DOUBLE ELSE 1 - s*s*(3 - 2*s) END AS wb FROM u)
    SELECT user_id, k, {r6("CASE WHEN NOT valid THEN wa END")} AS w_before, {r6("CASE WHEN NOT valid THEN wb END")} AS w_after, {r6("CASE WHEN NOT valid THEN greatest(0.0::DOUBLE, 1 - wa - wb) END")} AS w_rest,
           CASE WHEN valid THEN 'tracked' WHEN least(1.0::DOUBLE, wa + wb) >= 0.999::DOUBLE THEN 'held' WHEN wa + wb > 0 THEN 'fallback' ELSE 'absent' END AS state FROM w""")
def long_gap_weights(spark, sf_dir):
    told = gaps.long_gap_weights(grid(spark, sf_dir), "user_id", F.col("valid"), hold=4, blend=6, reacquire=3)
    rest = F.when(~F.col("valid"), F.col("w_rest"))
    return told.select("user_id", "k", six("w_before"), six("w_after"), round_up_half(rest, 6).alias("w_rest"), "state")


@query(f"""WITH {ROWS}, f AS (SELECT *, value > 50 AS f FROM rows_), g AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY i), false) AS was FROM f)
    SELECT user_id, i, CASE WHEN f THEN 'enter' ELSE 'leave' END AS event FROM g WHERE f <> was""")
def transition_events(spark, sf_dir):
    return gaps.transitions(rows(spark, sf_dir), "user_id", F.col("value") > 50, "i").select("user_id", "i", "event")


@query(f"""WITH {ROWS}, p AS (SELECT a.user_id, a.i, a.value, b.value AS near FROM rows_ a CROSS JOIN generate_series(-3, 3) AS o(d)
      JOIN (SELECT user_id, max(i) AS last FROM rows_ GROUP BY user_id) n ON n.user_id = a.user_id
      JOIN rows_ b ON b.user_id = a.user_id AND b.i = greatest(0, least(n.last, a.i + o.d)))
    SELECT user_id, i, {r6("sum(near) / 7")} AS smooth FROM p GROUP BY user_id, i""")
def centered_moving_avg(spark, sf_dir):
    return gaps.centred_average(rows(spark, sf_dir), "user_id", "value", 7, "i").select("user_id", "i", six("smooth"))


@query(f"""WITH {ROWS}, s AS (SELECT *, abs(value - lag(value) OVER w) AS step FROM rows_ WINDOW w AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, i, {r6("step")} AS step, {r6("step / 0.5::DOUBLE")} AS velocity, {r6("abs(step - lag(step) OVER (PARTITION BY user_id ORDER BY i)) / 0.25::DOUBLE")} AS acceleration FROM s""")
def step_velocity_accel(spark, sf_dir):
    return timeline.steps(rows(spark, sf_dir), "user_id", "i", "value", 0.5).select("user_id", "i", six("step"), six("velocity"), six("acceleration"))


@query(f"""WITH {ROWS}, n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM rows_ WINDOW w AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, i FROM n WHERE abs(value - p) > 20 AND abs(value - q) > 20 AND abs(q - p) < 10""")
def spike_flags(spark, sf_dir):
    return robust.spikes(rows(spark, sf_dir), "user_id", "value", 20.0, "i").where("spike").select("user_id", "i")


@query(f"""WITH e AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    d AS (SELECT *, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS jump,
          sqrt((lead(x) OVER w - lag(x) OVER w)**2 + (lead(y) OVER w - lag(y) OVER w)**2 + (lead(z) OVER w - lag(z) OVER w)**2) AS skip FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    n AS (SELECT *, coalesce(lag(jump) OVER w, 0) AS b, coalesce(lead(jump) OVER w, 0) AS a FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT label, vec_id, {r6("jump")} AS jump, CASE WHEN jump > 0.25::DOUBLE THEN CASE WHEN jump > greatest(b, a) * 1.5::DOUBLE OR coalesce(a > 0.25::DOUBLE AND skip < least(jump, a) * 0.5::DOUBLE, false) OR jump > 0.5::DOUBLE THEN 'teleport' ELSE 'fast' END END AS kind FROM n""")
def teleport_class(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("label", "vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))
    return robust.classify_jumps(points, "label", ["x", "y", "z"], 0.25, 0.5, 1.5, "vec_id").select("label", "vec_id", six("jump"), "kind")


@query(f"""WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
    SELECT event_type, {r6("(SELECT quantile_cont(e.value, 0.9::DOUBLE) FROM events e WHERE e.event_type = l.event_type)")} AS q_linear, {r6("list_aggregate(v, 'median')")} AS median_mid,
    v[len(v)//2 + 1] AS median_upper, v[(len(v) - 1)//2 + 1] AS median_lower, v[floor(0.9::DOUBLE * (len(v) - 1))::BIGINT + 1] AS q_floor FROM l""")
def percentile_conventions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ranks = rank_quantiles(events, ["event_type"], "value", {"_a": "floor((n - 1) / 2)", "median_upper": "floor(n / 2)", "q_floor": "floor(0.9D * (n - 1))"})
    linear = linear_quantiles(events, ["event_type"], "value", {"q_linear": 0.9})
    both = ranks.join(linear, "event_type").withColumn("median_mid", (F.col("_a") + F.col("median_upper")) / 2)
    return both.select("event_type", six("q_linear"), six("median_mid"), "median_upper", F.col("_a").alias("median_lower"), "q_floor")


@query(f"""WITH {ROWS} SELECT user_id, i, {r6("quantile_cont(value, 0.9::DOUBLE) OVER (PARTITION BY user_id ORDER BY i ROWS 9 PRECEDING)")} AS rolling FROM rows_""")
def rolling_quantiles(spark, sf_dir):
    return robust.rolling_quantile(rows(spark, sf_dir), "user_id", "value", 10, 0.9, order="i").select("user_id", "i", six("rolling"))


@query(f"""WITH {ROWS}, n AS (SELECT *, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)) AS near FROM rows_),
    m AS (SELECT *, near[len(near)//2 + 1] AS m FROM n), d AS (SELECT *, 1.4826::DOUBLE * list_sort(list_transform(near, lambda v: abs(v - m)))[len(near)//2 + 1] AS s FROM m)
    SELECT user_id, i, CASE WHEN len(near) >= 3 AND abs(value - m) > greatest(3.0::DOUBLE * s, 0.5::DOUBLE) THEN m ELSE value END AS gated FROM d""")
def median_gate(spark, sf_dir):
    return robust.median_gate(rows(spark, sf_dir), "user_id", "value", 9, 3.0, 0.5, "i").select("user_id", "i", "gated")


@query(f"""WITH {ROWS}, l AS (SELECT user_id, 1.5::DOUBLE * quantile_cont(value, 0.9::DOUBLE) AS l FROM rows_ GROUP BY user_id) SELECT user_id, count(*) AS accepted FROM rows_ JOIN l USING (user_id) WHERE value <= l GROUP BY user_id""")
def residual_gate(spark, sf_dir):
    return robust.residual_gate(rows(spark, sf_dir), "user_id", "value", 0.9).where("accepted").groupBy("user_id").agg(F.count("*").alias("accepted"))


def _fold_sql(first: str, following: str, outputs: str, columns: str) -> str:
    """A recursion over row numbers, all series at once."""
    return f"WITH RECURSIVE {ROWS}, walk AS (SELECT user_id, i, t, {first} FROM rows_ WHERE i = 0 UNION ALL SELECT s.user_id, s.i, s.t, {following} FROM walk r JOIN rows_ s ON s.user_id = r.user_id AND s.i = r.i + 1) SELECT user_id, i, {outputs} FROM walk {columns}"


@query(_fold_sql("value AS y", "r.y + 0.18::DOUBLE * (s.value - r.y)", f"{r6('y')} AS average", ""))
def ema(spark, sf_dir):
    return folds.exponential_average(rows(spark, sf_dir), "user_id", ["i"], "value", 0.18).select("user_id", "i", six("average"))


_DT = "greatest(CASE WHEN s.t - r.t > 0 THEN s.t - r.t ELSE 1 / 30.0::DOUBLE END, 1 / 240.0::DOUBLE)"


def _weight(cutoff: str) -> str:
    return f"(1 / (1 + 1 / (2 * pi() * ({cutoff})) / {_DT}))"


_SLOPE = f"(r.d + {_weight('0.001::DOUBLE')} * ((s.value - r.y) / {_DT} - r.d))"


@query(_fold_sql("value AS y, 0.0::DOUBLE AS d", f"r.y + {_weight(f'0.00001::DOUBLE + 0.01::DOUBLE * abs({_SLOPE})')} * (s.value - r.y), {_SLOPE}", f"{r6('y')} AS smooth", ""))
def one_euro_batch(spark, sf_dir):
    return folds.one_euro(rows(spark, sf_dir), "user_id", ["i"], "value", "t", 0.00001, 0.01, 0.001).select("user_id", "i", six("smooth"))


@query(_fold_sql("value AS y", "r.y + greatest(-0.001::DOUBLE * greatest(s.t - r.t, 1 / 240.0::DOUBLE), least(0.001::DOUBLE * greatest(s.t - r.t, 1 / 240.0::DOUBLE), s.value - r.y))", f"{r6('y')} AS limited", ""))
def limit_step(spark, sf_dir):
    return folds.limited_steps(rows(spark, sf_dir), "user_id", ["i"], "value", "t", 0.001).select("user_id", "i", six("limited"))


@query(f"""WITH RECURSIVE {ROWS}, fw AS (SELECT user_id, i, value AS y FROM rows_ WHERE i = 0 UNION ALL SELECT s.user_id, s.i, r.y + greatest(-10.0::DOUBLE, least(10.0::DOUBLE, s.value - r.y)) FROM fw r JOIN rows_ s ON s.user_id = r.user_id AND s.i = r.i + 1),
    ends AS (SELECT user_id, max(i) AS i FROM rows_ GROUP BY user_id),
    bw AS (SELECT user_id, i, value AS y FROM rows_ JOIN ends USING (user_id, i) UNION ALL SELECT s.user_id, s.i, r.y + greatest(-10.0::DOUBLE, least(10.0::DOUBLE, s.value - r.y)) FROM bw r JOIN rows_ s ON s.user_id = r.user_id AND s.i = r.i - 1)
    SELECT user_id, i, {r6("(fw.y + bw.y) * 0.5::DOUBLE")} AS limited FROM fw JOIN bw USING (user_id, i)""")
def rate_limit(spark, sf_dir):
    return folds.limit_rate(rows(spark, sf_dir), "user_id", ["i"], "value", 10.0).select("user_id", "i", six("limited"))


_B, _A = scans.butterworth(0.1, 1.0)
_GAIN = sum(_B) / (1 + sum(_A))
_Z2 = _B[2] - _A[1] * _GAIN
_Z1 = _B[1] - _A[0] * _GAIN + _Z2


def _pass_sql(name: str, source: str) -> str:
    b0, b1, b2, a1, a2 = (f"({v!r}::DOUBLE)" for v in (*_B, *_A))
    y = f"({b0} * s.x + r.z1)"
    y0 = f"({b0} * x + {_Z1!r}::DOUBLE * x)"
    return f"""{name} AS (SELECT user_id, p, {y0} AS y, {b1} * x - {a1} * {y0} + {_Z2!r}::DOUBLE * x AS z1, {b2} * x - {a2} * {y0} AS z2 FROM {source} WHERE p = 0
        UNION ALL SELECT s.user_id, s.p, {y}, {b1} * s.x - {a1} * {y} + r.z2, {b2} * s.x - {a2} * {y} FROM {name} r JOIN {source} s ON s.user_id = r.user_id AND s.p = r.p + 1)"""


@query(f"""WITH RECURSIVE {ROWS}, n AS (SELECT user_id, count(*) AS n, arg_min(value, i) AS a, arg_max(value, i) AS z FROM rows_ GROUP BY user_id),
    ext AS (SELECT user_id, i + least(18, n - 1) AS p, value AS x FROM rows_ JOIN n USING (user_id) WHERE n > 2
        UNION ALL SELECT user_id, least(18, n - 1) - i, 2 * a - value FROM rows_ JOIN n USING (user_id) WHERE n > 2 AND i BETWEEN 1 AND least(18, n - 1)
        UNION ALL SELECT user_id, least(18, n - 1) + n - 1 + (n - 1 - i), 2 * z - value FROM rows_ JOIN n USING (user_id) WHERE n > 2 AND n - 1 - i BETWEEN 1 AND least(18, n - 1)),
    src AS MATERIALIZED (SELECT * FROM ext), {_pass_sql("fw", "src")},
    rev AS MATERIALIZED (SELECT user_id, max(p) OVER (PARTITION BY user_id) - p AS p, y AS x FROM fw), {_pass_sql("bw", "rev")},
    core AS (SELECT bw.user_id, n + 2 * least(18, n - 1) - 1 - p - least(18, n - 1) AS i, y FROM bw JOIN n USING (user_id))
    SELECT user_id, i, {r6("y")} AS smooth FROM core JOIN n USING (user_id) WHERE i BETWEEN 0 AND n - 1 UNION ALL SELECT user_id, i, {r6("value")} FROM rows_ JOIN n USING (user_id) WHERE n < 3""")
def butterworth_filtfilt(spark, sf_dir):
    return scans.zero_phase(rows(spark, sf_dir), "user_id", "i", "value", 0.1, 1.0).select("user_id", "i", six("smooth"))


@query()
def viterbi_path(spark, sf_dir):
    """Cheapest of 48 angles per row: the cost of an angle is its distance from one read off the value."""
    angles = [-math.pi + 2 * math.pi * k / 48 for k in range(48)]
    costs = F.transform(F.lit(angles), lambda a: 1 - F.cos(F.col("value") - a))
    return folds.viterbi(rows(spark, sf_dir).withColumn("costs", costs), "user_id", ["i"], "costs", angles, 0.8).select("user_id", "i", "choice")


@query(f"""WITH {ROWS}, o AS (SELECT user_id, list([i] ORDER BY value DESC, i) AS ks FROM rows_ GROUP BY user_id),
    p AS (SELECT user_id, list_reduce(ks, lambda acc, x: CASE WHEN len(acc) < 5 AND len(list_filter(acc, lambda q: abs(q - x[1]) <= 5)) = 0 THEN list_concat(acc, x) ELSE acc END) AS picks FROM o)
    SELECT user_id, unnest(picks) AS i, generate_subscripts(picks, 1)::INTEGER AS pick FROM p""")
def greedy_nms(spark, sf_dir):
    return folds.greedy_picks(rows(spark, sf_dir), "user_id", "value", "i", apart=5, most=5).select("user_id", "i", "pick")


@query(_VALUES.replace("CASE WHEN valid THEN value END AS x FROM grid", "CASE WHEN h.outlier THEN NULL ELSE g.value END AS x FROM grid g LEFT JOIN hampel h ON h.event_id = g.event_id").replace(
    "v AS (SELECT user_id, k,",
    """near AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM rows_), med AS (SELECT *, list_aggregate(near, 'median') AS m FROM near),
    hampel AS (SELECT event_id, len(near) >= 4 AND abs(value - m) > greatest(3.5::DOUBLE * 1.4826::DOUBLE * list_aggregate(list_transform(near, lambda v: abs(v - m)), 'median'), 0.1::DOUBLE) AS outlier FROM med),
    v AS (SELECT g.user_id, g.k,""") + f""", st AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY user_id ORDER BY k)) AS step FROM filled),
    ac AS (SELECT *, abs(step - lag(step) OVER (PARTITION BY user_id ORDER BY k)) AS acc, user_id % 5 AS class FROM st),
    tr AS (SELECT class, user_id, max(step) AS top, list_sort(list(step) FILTER (step IS NOT NULL)) AS ss, list_sort(list(acc) FILTER (acc IS NOT NULL)) AS aa FROM ac GROUP BY class, user_id)
    SELECT class, {r6("max(top)")} AS greatest_step, arg_max(user_id, (top, -user_id)) AS worst_track, {r6("max(ss[floor(0.999::DOUBLE * (len(ss) - 1))::BIGINT + 1])")} AS high_step,
           {r6("max(top) / 3600.0::DOUBLE")} AS greatest_velocity, {r6("max(aa[floor(0.999::DOUBLE * (len(aa) - 1))::BIGINT + 1])")} AS high_acceleration FROM tr GROUP BY class""")
def class_temporal_stats(spark, sf_dir):
    """Slots, outlier gate, monotone filling, steps, and the statistics per class: the flagship query."""
    placed = robust.hampel(slots(spark, sf_dir), "user_id", "value", F.lit(True), 4, 3.5, 0.1, "i")
    clean = placed.withColumn("value", F.when(~F.col("outlier"), F.col("value")))
    full = timeline.dense_grid(clean, "user_id", ["value"])
    filled = gaps.pchip_fill(full, "user_id", "value", edges=True)
    moved = timeline.steps(filled, "user_id", "k", "value", 1.0).withColumn("class", F.col("user_id") % 5)
    told = relations.class_statistics(moved, "user_id", "class", "step", "acceleration", HOUR)
    return told.select("class", six("greatest_step"), "worst_track", six("high_step"), six("greatest_velocity"), six("high_acceleration"))


@query(f"""WITH {GRID}, q AS (SELECT user_id, t + 900.0::DOUBLE AS moment, event_id FROM slots), n AS (SELECT user_id, max(k) AS "last" FROM grid GROUP BY user_id),
    v AS (SELECT user_id, k, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS x FROM grid),
    p AS (SELECT q.*, "last", greatest(least(moment / 3600.0::DOUBLE, "last"::DOUBLE), 0.0::DOUBLE) AS e FROM q JOIN n USING (user_id))
    SELECT p.user_id, event_id, {r6("a.x + (b.x - a.x) * (e - floor(e))")} AS value FROM p JOIN v a ON a.user_id = p.user_id AND a.k = floor(e)::BIGINT JOIN v b ON b.user_id = p.user_id AND b.k = least(floor(e)::BIGINT + 1, "last")""")
def asof_floor_interp(spark, sf_dir):
    asked = slots(spark, sf_dir).select("user_id", "event_id", (F.col("t") + 900.0).alias("at"))
    samples = gaps.carry_forward(grid(spark, sf_dir).select("user_id", "k", "value"), "user_id", "value")
    return timeline.sample_at(asked, samples, "user_id", "at", "value", HOUR).select("user_id", "event_id", six("value"))


@query("""SELECT o_custkey, o_orderkey, (sum(o_orderkey % 7 + 1) OVER w - (o_orderkey % 7 + 1))::BIGINT AS start, (sum(o_orderkey % 7 + 1) OVER w)::BIGINT AS "end"
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def sequence_offsets(spark, sf_dir):
    items = table(spark, sf_dir, "orders").withColumn("length", F.col("o_orderkey") % 7 + 1)
    return timeline.sequence_offsets(items, "o_custkey", ["o_orderdate", "o_orderkey"], "length").select("o_custkey", "o_orderkey", "start", "end")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, (sum(o_orderkey % 7 + 1) OVER w - (o_orderkey % 7 + 1))::BIGINT AS start FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT DISTINCT o_custkey, o_orderkey % 50 AS frame FROM orders)
    SELECT p.o_custkey, p.frame, s.o_orderkey AS segment FROM p ASOF JOIN s ON s.o_custkey = p.o_custkey AND p.frame >= s.start""")
def segment_at(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 50).alias("frame")).distinct()
    segments = sequence_offsets(spark, sf_dir).select("o_custkey", "start", F.col("o_orderkey").alias("segment"))
    return timeline.segment_at(points, segments, "o_custkey", "frame")


@query(f"WITH {SLOTS}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, floor(t / 86400.0::DOUBLE) ORDER BY i) AS n FROM rows_) SELECT user_id, event_id, floor(t / 86400.0::DOUBLE)::BIGINT AS day FROM f WHERE n = 1")
def keep_first_per_slot(spark, sf_dir):
    days = rows(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400.0).cast("long"))
    return timeline.keep_first(days, ["user_id", "day"], ["i"]).select("user_id", "event_id", "day")


@query(f"""WITH {ROWS}, c AS (SELECT user_id, i, i // 20 AS chunk, false AS warm FROM rows_ UNION ALL SELECT user_id, i, i // 20 + 1, true FROM rows_ WHERE i % 20 >= 15) SELECT user_id, i, chunk, warm FROM c""")
def chunks_with_halo(spark, sf_dir):
    return timeline.chunks_with_halo(rows(spark, sf_dir), "i", 20, 5).select("user_id", "i", "chunk", "warm")


@query(f"""WITH {ROWS} SELECT user_id, i, coalesce(event_id > max(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS in_order FROM rows_ WHERE false
    UNION ALL SELECT user_id, i, coalesce(source > last_value(source IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) FROM (SELECT *, CASE WHEN event_type <> 'error' THEN event_id % 100 END AS source FROM rows_)""")
def source_order(spark, sf_dir):
    told = rows(spark, sf_dir).withColumn("source", F.when(F.col("event_type") != "error", F.col("event_id") % 100))
    return timeline.source_order(told, "user_id", "i", "source").select("user_id", "i", "in_order")


@query(f"""SELECT event_id, {r6("greatest(least(value, 30.0::DOUBLE), 5.0::DOUBLE)")} AS clamped,
    {r6("(SELECT u*u*(3 - 2*u) FROM (SELECT greatest(least((value - 5) / 25.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS u))")} AS eased,
    {r6("CASE WHEN value > 20 THEN 20 + 10 * ((exp(2 * (value - 20) / 10) - 1) / (exp(2 * (value - 20) / 10) + 1)) WHEN value < 15 THEN 15 - 10 * ((exp(2 * (15 - value) / 10) - 1) / (exp(2 * (15 - value) / 10) + 1)) ELSE value END")} AS soft,
    floor(-value * 10 + 0.5::DOUBLE) / 10 AS half_up, round_even(value, 1) AS half_even FROM events""")
def scalar_functions(spark, sf_dir):
    x = F.col("value")
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        round_up_half(clamp(x, 5.0, 30.0), 6).alias("clamped"),
        round_up_half(smoothstep(5.0, 30.0, x), 6).alias("eased"),
        round_up_half(soft_clamp(x, 5.0, 30.0, 10.0), 6).alias("soft"),
        round_up_half(-x, 1).alias("half_up"),
        round_half_even(x, 1).alias("half_even"),
    )


@query("""WITH w AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) AS v FROM events)
    SELECT event_id, list_aggregate(v, 'median') AS mid, v[len(v)//2 + 1] AS upper, v[(len(v) - 1)//2 + 1] AS lower, v[floor(0.75::DOUBLE * (len(v) - 1))::BIGINT + 1] AS q75 FROM w""")
def array_quantiles(spark, sf_dir):
    """The array conventions over the 31 events around each event of a user; ``group_quantiles`` takes whole groups by rank."""
    near = F.collect_list("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-15, 15))
    v = F.col("v")
    told = table(spark, sf_dir, "events").select("event_id", near.alias("v"))
    return told.select("event_id", array_median(v).alias("mid"), array_median_upper(v).alias("upper"), array_median_lower(v).alias("lower"), array_floor(v, 0.75).alias("q75"))


@query("""WITH w AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)
    SELECT user_id, list_aggregate(v, 'median') AS mid, v[len(v)//2 + 1] AS upper, v[(len(v) - 1)//2 + 1] AS lower, v[floor(0.75::DOUBLE * (len(v) - 1))::BIGINT + 1] AS q75 FROM w""")
def group_quantiles(spark, sf_dir):
    """The quantiles of ``array_quantiles`` over all events of each user, by rank: no user's events are collected."""
    places = {"upper": "floor(n / 2)", "lower": "floor((n - 1) / 2)", "q75": "floor(0.75D * (n - 1))"}
    ranks = rank_quantiles(table(spark, sf_dir, "events"), ["user_id"], "value", places)
    return ranks.select("user_id", ((F.col("upper") + F.col("lower")) / 2).alias("mid"), "upper", "lower", "q75")
