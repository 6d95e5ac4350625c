"""Reuse, screening, budgets and mining of negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.operators.filters import seeded
from trelliq.operators.skew import weighted_values


def reuse(listed: DataFrame) -> DataFrame:
    """(neg_id, n_edges, n_queries): how often a negative is listed, and by how many queries; hot ids are pre-grouped."""
    w = weighted_values(listed, "neg_id", "query_id")
    return w.groupBy(F.col("key").alias("neg_id")).agg(F.sum("weight").alias("n_edges"), F.count("value").alias("n_queries"))


def high_reuse_pairs(listed: DataFrame, least: int = 20) -> DataFrame:
    """Distinct (query_id, neg_id) whose negative is listed ``least`` times or more."""
    often = reuse(listed).filter(F.col("n_edges") >= least).select("neg_id")
    return listed.select("query_id", "neg_id").distinct().join(often, "neg_id", "left_semi").select("query_id", "neg_id")


def without_pairs(listed: DataFrame, flagged: DataFrame) -> DataFrame:
    return listed.join(flagged.select("query_id", "neg_id"), ["query_id", "neg_id"], "left_anti")


def prune_stats(scored: DataFrame, threshold: float) -> DataFrame:
    """(n_pairs, n_flagged, rate, n_queries, n_affected, n_left_empty, mean_after) of dropping pairs at or above a score."""
    flag = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    q = scored.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(flag).alias("f"))
    return q.agg(
        F.sum("n").alias("n_pairs"), F.sum("f").alias("n_flagged"), F.round(F.try_divide(F.sum("f"), F.sum("n")), 9).alias("rate"), F.count("*").alias("n_queries"),
        F.count_if(F.col("f") > 0).alias("n_affected"), F.count_if(F.col("f") == F.col("n")).alias("n_left_empty"), F.round(F.avg(F.col("n") - F.col("f")), 9).alias("mean_after"),
    )


def capped(listed: DataFrame, most: int = 8, seed: int = 590) -> DataFrame:
    """Up to ``most`` negatives of each query in seeded order; ``place`` keeps the list's order."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(seeded(seed, "query_id", "neg_id")))
    return listed.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def first_negatives(listed: DataFrame, n: int) -> DataFrame:
    """The first ``n`` negatives of each query, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return listed.withColumn("rank", rank).filter(F.col("rank") <= n)


def training_columns(listed: DataFrame, n: int) -> DataFrame:
    """(query_id, pos_id, negative_1 .. negative_n) of queries with ``n`` negatives or more."""
    ranked = first_negatives(listed, n)
    columns = [F.max(F.when(F.col("rank") == i, F.col("neg_id"))).alias(f"negative_{i}") for i in range(1, n + 1)]
    return ranked.groupBy("query_id", "pos_id").agg(F.count("*").alias("n"), *columns).filter(F.col("n") == n).drop("n")


def sanitized(listed: DataFrame, passages: DataFrame, split: str = "train") -> DataFrame:
    """Edges of queries of ``split`` (a column of ``listed``) whose negative lies in the same partition."""
    inside = passages.filter(F.col("split") == split).select(F.col("id").alias("neg_id"))
    return listed.filter(F.col("split") == split).join(inside, "neg_id", "left_semi")


def strip_counts(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """(query_id, before, self, out, kept) of the lists of ``rows`` (query_id, pos_id, neg_id): elements in all, those equal to the
    positive, those outside ``inside`` (id), and distinct ones left. Queries without a list have zeros."""
    known = inside.select(F.col("id").alias("neg_id"), F.lit(True).alias("known")).distinct()
    own = rows.select("query_id", "pos_id", F.explode("neg_id").alias("neg_id")).filter("neg_id IS NOT NULL").join(known, "neg_id", "left")
    itself = F.coalesce(F.col("neg_id") == F.col("pos_id"), F.lit(False))
    # Repeats of a list's element count in the first three, as the list has them.
    by = own.groupBy("query_id", "neg_id").agg(F.count("*").alias("n"), F.max(itself).alias("itself"), F.max(F.col("known").isNotNull()).alias("known"))
    counts = by.groupBy("query_id").agg(
        F.sum("n").alias("before"), F.sum(F.when(F.col("itself"), F.col("n")).otherwise(0)).alias("self"),
        F.sum(F.when(~F.col("itself") & ~F.col("known"), F.col("n")).otherwise(0)).alias("out"), F.count_if(~F.col("itself") & F.col("known")).alias("kept"),
    )
    return rows.select("query_id").distinct().join(counts, "query_id", "left").fillna(0, ["before", "self", "out", "kept"])


def hardest_first(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar of each query's listed negatives (query_id, place, neg_id, similarity), ties by place, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "place"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def mining_counters(stripped: DataFrame, chosen: DataFrame, rejected: DataFrame, n: int) -> DataFrame:
    """One row of the counters of a mining run: ``stripped`` as of ``strip_counts``, ``chosen`` (query_id, mined boolean) with one
    row for each negative in the end, ``rejected`` (query_id, n) candidates at or above the cap."""
    ends = chosen.groupBy("query_id").agg(F.count("*").alias("after"), F.count_if("mined").alias("mined"))
    q = stripped.join(ends, "query_id", "left").join(rejected.withColumnRenamed("n", "rejected"), "query_id", "left").fillna(0, ["after", "mined", "rejected"])
    needing = F.col("kept") < n
    return q.agg(
        F.count("*").alias("n_queries"), F.coalesce(F.sum("before"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("out"), F.lit(0)).alias("n_out"), F.coalesce(F.sum("self"), F.lit(0)).alias("n_self"),
        F.coalesce(F.sum("mined"), F.lit(0)).alias("n_mined"), F.count_if(needing).alias("n_needing"), F.count_if(F.col("after") < n).alias("n_short"),
        F.coalesce(F.sum(F.when(needing, F.col("rejected")).otherwise(0)), F.lit(0)).alias("n_rejected"), F.round(F.avg("after"), 3).alias("mean_after"),
    )


def mined(have: DataFrame, candidates: DataFrame, n: int, cap: float) -> DataFrame:
    """(query_id, id, similarity, rank): candidates below ``cap`` that a query lacks, best first, until it has ``n``.

    ``have`` has (query_id, id) for each negative kept, ``candidates`` (query_id, id, similarity).
    """
    counts = have.groupBy("query_id").agg(F.count("*").alias("have"))
    free = candidates.filter(F.col("similarity") < cap).join(have.select("query_id", "id"), ["query_id", "id"], "left_anti").join(counts, "query_id", "left")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return free.withColumn("rank", rank).filter(F.col("rank") <= F.lit(n) - F.coalesce("have", F.lit(0))).select("query_id", "id", "similarity", "rank")


def with_reuse(listed: DataFrame) -> DataFrame:
    """``listed`` with neg_reuse_count, the number of queries that list the negative."""
    return listed.join(reuse(listed).select("neg_id", F.col("n_queries").alias("neg_reuse_count")), "neg_id")


def training_stats(rows: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """(n_rows, n_dropped): queries of ``rows`` with ``n`` negatives or more, and those without."""
    counts = listed.groupBy("query_id").agg(F.count("*").alias("k"))
    enough = F.coalesce(F.col("k") >= n, F.lit(False))
    return rows.select("query_id").distinct().join(counts, "query_id", "left").agg(F.count_if(enough).alias("n_rows"), F.count_if(~enough).alias("n_dropped"))
