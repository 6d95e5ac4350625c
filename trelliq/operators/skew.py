"""Problem 5: exact figures per key when a few keys hold most rows.

Method: value-frequency compression. Rows are grouped by key *and* value first, which spreads a hot key over all tasks
and leaves one weighted row for each distinct value; counts, distinct counts, modes and percentiles then come from the
weighted values. Percentiles go through ranges of equally many values, so that no task orders all values of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values are cut into the square of so many ranges.
COARSE = 32


def weighted_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): how often each value occurs with each key; null keys are left out, a null value is one."""
    return rows.select(F.col(key).alias("key"), F.col(value).alias("value")).filter("key IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("weight"))


def key_figures(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_rows, n_values, mode, mode_rows) of every non-null key.

    n_values counts distinct non-null values; mode is the most frequent non-null value, the smallest on a tie, null for
    a key without values. All of it comes from one aggregation of the weighted values, combined before it is shuffled, so
    a hot key sends one row a task. Extra columns are ignored, whatever their names; an empty table gives an empty frame.
    """
    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))))
    figures = weighted_values(rows, key, value).groupBy("key").agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_values"), top.alias("top"))
    return figures.select("key", "n_rows", "n_values", F.col("top.v").alias("mode"), F.coalesce(-F.col("top.w"), F.lit(0)).alias("mode_rows"))


def heavy_keys(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, n_rows) of the keys that hold ``share`` or more of all rows with a non-null key: at most 1 / share rows."""
    counts = weighted_values(rows, key, value).groupBy("key").agg(F.sum("weight").alias("n_rows"))
    whole = counts.agg(F.sum("n_rows").alias("__all"))
    return counts.crossJoin(F.broadcast(whole)).filter(F.col("n_rows") >= F.lit(share) * F.col("__all")).select("key", "n_rows")


def value_ranges(w: DataFrame, value: str, coarse: int = COARSE) -> DataFrame:
    """``w`` with ``bucket``, a number that never falls as the value grows: its place among ``coarse`` squared quantiles.

    The edges come from a sketch of all weighted values, so a bucket holds about as many of them as any other however
    the values lie (an outlier stretches no range); only the balance of tasks depends on them, no result does. They are
    found in two steps of ``coarse`` comparisons.
    """
    n = coarse * coarse
    edges = w.agg(F.percentile_approx(value, F.array(*(F.lit(i / n) for i in range(n))), 20 * n).alias("__edges"))
    firsts = F.array(*(F.get("__edges", F.lit(i * coarse)) for i in range(coarse)))
    edges = F.broadcast(edges.select("__edges", firsts.alias("__firsts")))  # one row of about n numbers
    at = F.greatest(F.size(F.filter("__firsts", lambda e: e <= F.col(value))) - 1, F.lit(0))
    placed = w.crossJoin(edges).withColumn("__at", at)
    inside = F.size(F.filter(F.slice("__edges", F.col("__at") * coarse + 1, F.lit(coarse)), lambda e: e <= F.col(value)))
    return placed.withColumn("bucket", F.col("__at") * coarse + inside).drop("__edges", "__firsts", "__at")


def key_percentiles(rows: DataFrame, key: str, value: str, shares: list[float], coarse: int = COARSE) -> DataFrame:
    """(key, share, percentile): exact percentiles with linear interpolation of the non-null numbers of each key.

    The two neighbours of each wanted rank are looked up: counts of the value ranges of ``value_ranges`` tell the range of
    a rank, and only within that range are weighted values put in order. Keys without numbers are left out; extra
    columns are ignored, whatever their names; an empty table gives an empty frame.
    """
    w = weighted_values(rows, key, value).filter("value IS NOT NULL").withColumn("value", F.col("value").cast("double"))
    w = value_ranges(w, "value", coarse)
    below = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = w.groupBy("key", "bucket").agg(F.sum("weight").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(below), F.lit(0)))
    wanted = ranges.groupBy("key").agg(F.sum("n").alias("all")).select("key", "all", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    rank = F.col("share") * (F.col("all") - 1)
    wanted = wanted.select("key", "share", (rank - F.floor(rank)).alias("part"), F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))).alias("rank"), F.floor(rank).alias("low"))
    found = wanted.join(ranges, "key").filter("rank >= start AND rank < start + n").select("key", "share", "part", "rank", "low", "bucket", "start")
    needed = found.select("key", "bucket").distinct()
    inside = Window.partitionBy("key", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = w.join(needed, ["key", "bucket"], "left_semi").withColumn("upto", F.sum("weight").over(inside))
    hit = found.join(placed, ["key", "bucket"]).filter("rank - start < upto AND rank - start >= upto - weight")
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    return hit.groupBy("key", "share").agg((low + (high - low) * F.max("part")).alias("percentile"))
