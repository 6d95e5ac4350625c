"""Defects of triplet rows and their repair (rows of query_id, query, pos_id, pos, neg_id, loaded_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trelliq.functions.text import blank


def loaded_first() -> list:
    """The order of rows with one query_id, nulls first: the one loaded first counts."""
    return ["loaded_at", "pos_id", F.md5(F.array_join("neg_id", ","))]


def flagged(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """``rows`` with a boolean for each defect that a row shows by itself."""
    known = corpus.select(F.col("id").alias("pos_id"), F.lit(True).alias("known_pos")).distinct()
    return (
        rows.join(known, "pos_id", "left")
        .withColumn("null_query", blank(F.col("query")))
        .withColumn("null_pos", blank(F.col("pos")))
        .withColumn("orphan_pos", F.col("known_pos").isNull())
        .withColumn("no_negatives", F.coalesce(F.size("neg_id") <= 0, F.lit(True)))
        .withColumn("self_negative", F.coalesce(F.array_contains("neg_id", F.col("pos_id")), F.lit(False)))
        .drop("known_pos")
    )


ROW_DEFECTS = ["null_query", "null_pos", "orphan_pos", "no_negatives", "self_negative"]
DEFECTS = [*ROW_DEFECTS, "duplicate_query_id"]


def defect_summary(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(defect, n, rate)."""
    sums = flagged(rows, corpus).agg(F.count("*").alias("rows"), *(F.sum(F.col(d).cast("bigint")).alias(d) for d in ROW_DEFECTS))
    repeats = rows.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicate_query_id"))
    stacked = ", ".join(f"'{d}', {d}" for d in DEFECTS)
    both = sums.crossJoin(F.broadcast(repeats)).selectExpr("rows", f"stack({len(DEFECTS)}, {stacked}) AS (defect, n)")
    return both.select("defect", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("n", "rows").alias("rate"))


def drop_defects(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """The first row of each query_id, unless it has a missing text or an orphan positive; negatives are repaired later.

    The filter stands right behind the rank, so each task keeps one row of a query_id before anything is shuffled. What texts and lists
    say is found before, so that they are shuffled only where the caller selects them.
    """
    *order, lists = loaded_first()
    shown = rows.withColumns({"__lists": lists, "__blank": blank(F.col("query")) | blank(F.col("pos"))})
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "__lists"))
    first = shown.withColumn("__nth", nth).filter("__nth = 1").filter("NOT __blank").drop("__nth", "__lists", "__blank")
    return first.join(corpus.select(F.col("id").alias("pos_id")), "pos_id", "left_semi")


def edges(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each non-null listed negative, with its place."""
    return rows.select(*keep, F.posexplode("neg_id").alias("place", "neg_id")).filter("neg_id IS NOT NULL")


def orphan_negatives(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Distinct listed negatives that the corpus lacks."""
    return edges(rows).select("neg_id").distinct().join(corpus.select(F.col("id").alias("neg_id")), "neg_id", "left_anti")


def first_places(listed: DataFrame, *key: str) -> DataFrame:
    """``listed`` without later places of one key."""
    return listed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("place"))).filter("nth = 1").drop("nth")


def clean_edges(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, pos_id, place, neg_id): negatives in order, without the positive, unknown ids and repeats."""
    listed = edges(rows, "query_id", "pos_id").filter("neg_id <> pos_id")
    known = corpus.select(F.col("id").alias("neg_id")).distinct()
    return first_places(listed.join(known, "neg_id", "left_semi"), "query_id", "neg_id").select("query_id", "pos_id", "place", "neg_id")


def in_order(values: str, *by: str) -> Column:
    """The values of a group as the JSON text of a list, in the order of ``by``."""
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*by, values))), lambda x: x[values]))
