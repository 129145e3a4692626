"""Order statistics of groups of any size by distributed selection (AGG-09, AGG-15).

A group that holds more rows than a task should is not sorted: bounds from a
mergeable sketch cut its values into ranges, one aggregate counts the ranges, the
counts tell which range holds a wanted rank, and only the rows of that range are
read again and ranked. Whatever the sketch's error, the ranks are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A group is huge if it holds more than one in so many of all rows, so there are at most so many of them.
HUGE_SHARE = 1_000
#: Groups of fewer rows are never huge.
HUGE_LEAST = 1_000_000
#: Ranges that a huge group's values are cut into.
RANGES = 256


def rank_quantiles(df: DataFrame, group: list[str], value: str, places: dict[str, str], huge_least: int = HUGE_LEAST, most: int | None = None) -> DataFrame:
    """Order statistics per group without collecting a group, and without sorting a huge one.

    ``places`` maps an output name to an SQL expression of the 0-based place in terms of
    ``n``, the group's number of values. Groups of up to ``huge_least`` rows (or a
    thousandth of all) are ranked by a window; the others, at most ``HUGE_SHARE``, by
    selection. Null values are left out, NaN counts as the greatest, a null group is a
    group. Groups without values are left out; a place outside of [0, n) gives null.
    ``most`` is a bound of the groups' sizes, where one is known: below ``huge_least`` it
    spares the count that tells huge groups.
    """
    named = df.where(F.col(value).isNotNull()).select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col(value).alias("_v"))
    keys = [f"_g{k}" for k in range(len(group))]
    if most is not None and most <= huge_least:
        return _by_window(named, keys, places).select(*(F.col(k).alias(g) for k, g in zip(keys, group)), *places)
    counts = named.groupBy(*keys).agg(F.count("*").alias("n"))
    # what comes to the driver is at most HUGE_SHARE + 1 numbers
    largest = [r.n for r in counts.orderBy(F.desc("n")).select("n").limit(HUGE_SHARE + 1).collect()]
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(huge_least, total // HUGE_SHARE)
    if not largest or largest[0] <= bound:
        out = _by_window(named, keys, places)
    else:
        huge = F.broadcast(counts.where(F.col("n") > bound))
        same = _same(keys)
        few = named.alias("a").join(huge.alias("b"), same("a", "b"), "left_anti")
        many = named.alias("a").join(huge.alias("b"), same("a", "b"), "left_semi")
        out = _by_selection(many, huge, keys, places)
        if largest[-1] <= bound or len(largest) > HUGE_SHARE:
            out = out.unionByName(_by_window(few, keys, places))
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), *places)


def _same(keys: list[str]):
    """Equality of groups, null ones among them."""

    def on(a: str, b: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    return on


def _by_window(named: DataFrame, keys: list[str], places: dict[str, str]) -> DataFrame:
    ranked = named.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_v")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == F.expr(place), F.col("_v"))).alias(name) for name, place in places.items()))


def _by_selection(rows: DataFrame, sizes: DataFrame, keys: list[str], places: dict[str, str]) -> DataFrame:
    """``rows`` of huge groups only; ``sizes`` has their numbers of rows."""
    same = _same(keys)
    cuts = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 4 * RANGES))).alias("_cuts"))
    # range 2i + 1 holds the values equal to cut i, range 2i those before it: a value that many rows share is a range of its own
    placed = rows.alias("a").join(F.broadcast(cuts).alias("b"), same("a", "b")).select("a.*", "b._cuts")
    below, equal = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.array_contains("_cuts", F.col("_v"))
    placed = placed.select(*keys, "_v", (below * 2 + equal.cast("int")).alias("_range"))
    w = W.partitionBy(*keys).orderBy("_range")
    ranges = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_many")).withColumn("_before", F.sum("_many").over(w) - F.col("_many"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.expr(place).cast("long").alias("place")) for name, place in places.items()))
    asked = sizes.select(*keys, F.inline(wanted))
    found = ranges.alias("a").join(asked.alias("b"), same("a", "b") & (F.col("_before") <= F.col("place")) & (F.col("place") < F.col("_before") + F.col("_many")))
    found = found.select(*(F.col(f"a.{k}").alias(k) for k in keys), "_range", "name", (F.col("place") - F.col("_before")).alias("_rank"))
    # a wanted range holds some hundredth of its group at most, unless one value fills it; then any of its rows will do
    hit = found.select(*keys, "_range").distinct()
    near = placed.alias("a").join(F.broadcast(hit).alias("b"), same("a", "b") & (F.col("a._range") == F.col("b._range")), "left_semi")
    whole = near.where(F.col("_range") % 2 == 1).groupBy(*keys, "_range").agg(F.max("_v").alias("_v")).withColumn("_rank", F.lit(None).cast("long"))
    inner = near.where(F.col("_range") % 2 == 0)
    inner = inner.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_range").orderBy("_v")).cast("long") - 1).select(*keys, "_range", "_v", "_rank")
    values = whole.unionByName(inner)
    at = values.alias("a").join(F.broadcast(found).alias("b"), same("a", "b") & (F.col("a._range") == F.col("b._range")) & (F.col("a._rank").isNull() | (F.col("a._rank") == F.col("b._rank"))))
    picked = at.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in places))
    # groups of which every place lies outside still have a row
    return sizes.select(*keys).alias("a").join(picked.alias("b"), same("a", "b"), "left").select("a.*", *(F.col(f"b.{name}") for name in places))


def linear_quantiles(df: DataFrame, group: list[str], value: str, ps: dict[str, float], huge_least: int = HUGE_LEAST) -> DataFrame:
    """Quantiles interpolated at (n - 1) p between the two ranks around it, per group; values that are not finite are left out."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < F.lit(float("inf"))))
    names = list(ps)
    places = {f"_low{k}": f"floor({ps[n]!r}D * (n - 1))" for k, n in enumerate(names)} | {f"_high{k}": f"ceil({ps[n]!r}D * (n - 1))" for k, n in enumerate(names)}
    ranks = rank_quantiles(good, group, value, places, huge_least)
    counts = good.groupBy(*(F.col(g).alias(f"_c{k}") for k, g in enumerate(group))).agg(F.count("*").alias("n"))
    on = F.lit(True)
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_c{k}"))
    both = ranks.join(counts, on)

    def between(k: int, p: float) -> Column:
        share = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        low, high = F.col(f"_low{k}").cast("double"), F.col(f"_high{k}").cast("double")
        return low + (high - low) * share

    return both.select(*group, *(between(k, ps[n]).alias(n) for k, n in enumerate(names)))
