"""The relational library around the series: reviews, takes, sets, tallies, trees (JN-02 to JN-06, AGG-03, AGG-05, AGG-07, AGG-12, AGG-19, SET-01, SET-02, SET-05, TOP-02, TOP-04, TOP-06, VAL-01, VAL-03, SNK-10, SNK-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import round_up_half
from ..functions.text import csv_cell, mask_numbers

# The columns of a review file.
REVIEW_COLUMNS = ("sign", "rank", "sequence_id", "participant_id", "decision", "reviewer", "notes", "clip_file")


def current_reviews(words: DataFrame, reviews: DataFrame, word: str, version: str) -> DataFrame:
    """Reviews of the words' present versions; a review of another version is stale and goes."""
    return words.join(reviews, [word, version])


def latest(log: DataFrame, key: str, stamp: str, deleted: Column | None = None) -> DataFrame:
    """The last row of each key of an append-only log; keys whose last row is a deletion go."""
    order = [F.desc(stamp), *(F.desc(c) for c in log.columns if c not in (key, stamp))]
    last = log.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return last if deleted is None else last.where(~F.coalesce(deleted, F.lit(False)))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: the row's cells, quoted where they must be, joined by commas."""
    return df.withColumn("line", F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns)))


def write_review_file(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder with one CSV file of a header and CRLF line ends; line ends within notes stay as they are.

    The review file is small (one row per reviewed word), so it is one ordered task.
    """
    header = df.sparkSession.createDataFrame([(0, ",".join(REVIEW_COLUMNS))], "part int, line string")
    body = csv_lines(df, list(REVIEW_COLUMNS)).select(F.lit(1).alias("part"), "line", *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)))
    head = header.select("part", "line", *(F.lit(None).cast(body.schema[f"_o{k}"].dataType).alias(f"_o{k}") for k in range(len(order))))
    rows = head.union(body).coalesce(1).sortWithinPartitions("part", *(f"_o{k}" for k in range(len(order))))
    rows.select("line").write.option("lineSep", "\r\n").text(path)


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with that ``side``: no row if both hold the same keys."""
    one, other = left.select(key).distinct(), right.select(key).distinct()
    first = one.join(other, key, "left_anti").withColumn("side", F.lit("left"))
    return first.unionByName(other.join(one, key, "left_anti").withColumn("side", F.lit("right")))


def new_codes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Distinct rows of ``now`` that ``before`` does not have."""
    return now.subtract(before)


def choose_take(takes: DataFrame, word: str, rank: str, status: str, recognised: str, take: str) -> DataFrame:
    """One take per word: an approved one, else a recognised one, else any; the best rank among these. Rejected ones are out."""
    order = [F.desc(F.col(status).eqNullSafe("approved")), F.desc(F.coalesce(F.col(recognised), F.lit(False))), F.col(rank), F.col(take)]
    left = takes.where(~F.col(status).eqNullSafe("rejected"))
    return left.withColumn("_n", F.row_number().over(W.partitionBy(word).orderBy(*order))).where("_n = 1").drop("_n")


def counter(df: DataFrame, group: str, hit: Column, magnitude: str, place: str, first: int = 12) -> DataFrame:
    """Per group the hits, their greatest magnitude and the first ``first`` places.

    Only that many rows per group reach the list, so a group's size does not matter.
    """
    hits = df.where(hit)
    w = W.partitionBy(group).orderBy(place)
    early = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first).groupBy(group).agg(F.array_sort(F.collect_list(place)).alias("first_places"))
    return hits.groupBy(group).agg(F.count("*").alias("hits"), F.max(magnitude).alias("greatest")).join(early, group)


def tally(df: DataFrame, message: Column) -> DataFrame:
    """How often each message occurs, numbers aside."""
    return df.groupBy(mask_numbers(message).alias("message")).agg(F.count("*").alias("times"))


def repeated_rows(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Rows that repeat the value of the row before."""
    w = W.partitionBy(series).orderBy(*order)
    return df.withColumn("_b", F.lag(value).over(w)).where(F.col(value) == F.col("_b")).drop("_b")


def class_statistics(df: DataFrame, track: str, kind: str, step: str, acceleration: str, period: float, p: float = 0.999) -> DataFrame:
    """Per class: the greatest step and its track, the greatest of the tracks' p-quantiles, the greatest velocity and acceleration quantile.

    Two levels: order statistics per track by ranks over one exchange, then the maximum per class.
    Of tracks with the same greatest step, the first by name is told; a class without steps has none.
    """
    whole = W.partitionBy(kind, track)
    ranked = df.select(kind, track, F.col(step).alias("_s"), F.col(acceleration).alias("_a"))
    for c in ("_s", "_a"):
        ranked = ranked.withColumn(f"{c}r", F.row_number().over(whole.orderBy(F.col(c).asc_nulls_last())) - 1).withColumn(f"{c}n", F.count(c).over(whole))

    def at_rank(c: str):
        return F.max(F.when(F.col(f"{c}r") == F.floor(F.lit(p) * (F.col(f"{c}n") - 1)), F.col(c)))

    tracks = ranked.groupBy(kind, track).agg(F.max("_s").alias("top"), at_rank("_s").alias("high_step"), at_rank("_a").alias("high_acceleration"))
    # the least of (falling step, name): names may be numbers or texts
    worst = F.min(F.when(F.col("top").isNotNull(), F.struct((-F.col("top")).alias("_n"), F.col(track).alias("_t"))))
    return tracks.groupBy(kind).agg(
        F.max("top").alias("greatest_step"),
        worst["_t"].alias("worst_track"),
        F.max("high_step").alias("high_step"),
        (F.max("top") / period).alias("greatest_velocity"),
        F.max("high_acceleration").alias("high_acceleration"),
    )


def grid_argmin(df: DataFrame, group: str, grid: list[float], cost, aggregate) -> DataFrame:
    """The grid value of least cost per group, the first among equals: ``cost(z)`` per row, ``aggregate(column)`` per group.

    The grid is a literal array and costs are summed on the map side, so a row is never shuffled per grid value.
    """
    w = W.partitionBy(group).orderBy("cost", "z")
    curve = df.withColumn("z", F.explode(F.lit(grid))).withColumn("_c", cost(F.col("z"))).groupBy(group, "z").agg(aggregate(F.col("_c")).alias("cost"))
    return curve.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def closure(nodes: DataFrame) -> DataFrame:
    """``node, ancestor, depth`` of a small tree table ``node, parent`` (a root's parent is null); depth 0 is the node itself.

    ``nodes`` has one row per joint of a rig.
    """
    spark = nodes.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE up(node, ancestor, depth) AS (
            SELECT node, node, 0 FROM {nodes}
            UNION ALL
            SELECT up.node, n.parent, up.depth + 1 FROM up JOIN {nodes} n ON n.node = up.ancestor WHERE n.parent IS NOT NULL
        )
        SELECT * FROM up
        """,
        nodes=nodes,
    )


def neighbours_in_order(df: DataFrame, order: list[str], key: str, group: str | None = None) -> DataFrame:
    """``next_key`` and ``previous_key`` in a display order, going round at both ends."""
    w = W.partitionBy(*([group] if group else [F.lit(0)])).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = df.withColumn("next_key", F.coalesce(F.lead(key).over(w), F.first(key).over(whole)))
    return out.withColumn("previous_key", F.coalesce(F.lag(key).over(w), F.last(key).over(whole)))


def violations(df: DataFrame, **tests: Column) -> DataFrame:
    """A row for each test a row fails: ``failed`` is its name; a null test counts as failed."""
    names = F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    return df.withColumn("failed", F.explode(names))


def fast_motion_check(events: DataFrame, clean: DataFrame, series: list[str], frame: str, jump: str, wrist: str, hand: str, width: str, most: float = 2.5, apart: int = 1) -> DataFrame:
    """Fast events with the source's own step over the same frame, and whether it explains them.

    ``clean`` has a row per ``series`` and frame with the points ``wrist`` and ``hand``
    (3 numbers each) and the metres ``width`` of their unit. An event is explained if its
    ``jump`` in metres is at most ``most`` times the greater step. Without the frame or
    the one before it (``apart`` less) the steps and ``explained`` are null. Frames are whole
    numbers: fractions would make neighbours miss each other by their last digits.
    """
    w = W.partitionBy(*series).orderBy(frame)
    follows = F.lag(frame).over(w) == F.col(frame) - apart

    def step(point: str, size: int) -> Column:
        before = F.lag(point).over(w)
        squares = sum(((F.get(point, F.lit(k)) - F.get(before, F.lit(k))) * (F.get(point, F.lit(k)) - F.get(before, F.lit(k))) for k in range(size)), F.lit(0.0))
        return F.when(follows, F.sqrt(squares) * F.col(width))

    moved = clean.select(*series, frame, step(wrist, 3).alias("_w"), step(hand, 3).alias("_h"), F.greatest(step(wrist, 2), step(hand, 2)).alias("_p"))
    joined = events.join(moved, [*series, frame], "left")
    source = F.when(F.col("_w").isNotNull() & F.col("_h").isNotNull(), F.greatest("_w", "_h", F.lit(1e-3)))
    told = joined.withColumn("ratio", round_up_half(F.col(jump) / source, 2)).withColumn("explained", F.col("ratio") <= most)
    return told.select(*events.columns, round_up_half(F.col("_w"), 4).alias("wrist_step"), round_up_half(F.col("_h"), 4).alias("hand_step"), round_up_half(F.col("_p"), 4).alias("plane_step"), "ratio", "explained")
