"""The ledger of a cleaning run: what each stage removed and left, and tables drawn from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq int, stage string, unit string, remaining bigint"


def ledger(spark: SparkSession, counts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(seq, stage, unit, removed, remaining) in the order given; each frame is one (stage, unit)'s remaining rows."""
    rows = None
    for seq, (stage, unit, df) in enumerate(counts):
        one = df.agg(F.count("*").alias("remaining")).select(F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), F.lit(unit).alias("unit"), "remaining")
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], "seq int, stage string, unit string, removed bigint, remaining bigint")
    before = F.lag("remaining").over(Window.partitionBy("unit").orderBy("seq"))
    return rows.select("seq", "stage", "unit", F.coalesce(before - F.col("remaining"), F.lit(0).cast("bigint")).alias("removed"), "remaining")


def tracks(entries: DataFrame) -> DataFrame:
    """(seq, stage, unit, remaining, retention) for every stage and unit: the last entry of a stage, else carried forward."""
    stages = entries.groupBy("stage").agg(F.min("seq").alias("at"))
    last = entries.groupBy("stage", "unit").agg(F.max_by("remaining", "seq").alias("remaining"))
    grid = stages.crossJoin(F.broadcast(entries.select("unit").distinct()))  # a ledger has a few stages and units
    w = Window.partitionBy("unit").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(last, ["stage", "unit"], "left").withColumn("left", F.last("remaining", True).over(w))
    first = F.first("remaining", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.select(F.col("at").alias("seq"), "stage", "unit", F.col("left").alias("remaining"), F.round(F.try_divide("left", first), 9).alias("retention"))
