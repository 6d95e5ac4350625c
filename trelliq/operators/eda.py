"""Length statistics, histograms and value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trelliq.functions import text as t


def length_stats(rows: DataFrame, text: str) -> DataFrame:
    """(n, shortest, longest, mean, median) of the trimmed lengths of non-null texts."""
    size = F.length(t.trimmed(F.col(text)))
    return rows.filter(F.col(text).isNotNull()).select(size.alias("l")).agg(
        F.count("*").alias("n"), F.min("l").alias("shortest"), F.max("l").alias("longest"), F.round(F.avg("l"), 9).alias("mean"), F.median(F.col("l").cast("double")).alias("median")
    )


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, low, n): equal bins from the smallest to the largest value, the last closed; empty bins are left out."""
    values = rows.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0))
    counted = values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return counted.select("bin", F.round(F.col("lo") + F.col("bin") * width, 9).alias("low"), "n")


def by_style(rows: DataFrame) -> DataFrame:
    """(style, n, median_length, mean_overlap) by the exact first token."""
    q, p = F.col("query"), F.col("pos")
    own = rows.filter("query IS NOT NULL").select(t.query_type(q).alias("style"), F.length(q).cast("double").alias("l"), t.containment_overlap(q, p).alias("o"))
    return own.groupBy("style").agg(F.count("*").alias("n"), F.median("l").alias("median_length"), F.round(F.avg("o"), 9).alias("mean_overlap"))


def overlap_stats(rows: DataFrame) -> DataFrame:
    """(n, mean, median, zero_rate) of the Jaccard overlap of query and positive."""
    own = rows.filter("query IS NOT NULL AND pos IS NOT NULL").select(t.jaccard_overlap(F.col("query"), F.col("pos")).alias("o"))
    return own.agg(F.count("*").alias("n"), F.round(F.avg("o"), 9).alias("mean"), F.round(F.median("o"), 9).alias("median"), F.round(F.avg((F.col("o") == 0).cast("int")), 9).alias("zero_rate"))
