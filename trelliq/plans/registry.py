"""All queries outside the text subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trelliq.operators.skew import heavy_keys, key_figures, key_percentiles
from trelliq.plans import artifacts, cleaning, evaluation, mining
from trelliq.sources.tables import table


def listed_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "merged").select("query_id", F.explode("neg_id").alias("neg_id")).filter("neg_id IS NOT NULL")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(listed_negatives(spark, folder), "neg_id", "query_id", 0.025).select(F.col("key").alias("neg_id"))


def p5_figures(spark: SparkSession, folder: str) -> DataFrame:
    figures = key_figures(listed_negatives(spark, folder), "neg_id", "query_id")
    return figures.select(F.col("key").alias("neg_id"), "n_rows", F.col("n_values").alias("n_queries"), F.col("mode").alias("top_query"), F.col("mode_rows").alias("top_query_rows"))


def p5_score_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    found = key_percentiles(table(spark, folder, "negative_scores"), "neg_id", "neg_similarity", [0.05, 0.5, 0.95])
    return found.select(F.col("key").alias("neg_id"), "share", F.round("percentile", 9).alias("similarity"))


QUERIES = cleaning.QUERIES | mining.QUERIES | evaluation.QUERIES | artifacts.QUERIES | {f.__name__: f for f in (p5_found, p5_figures, p5_score_percentiles)}

SQL = cleaning.SQL | mining.SQL | evaluation.SQL | artifacts.SQL | {
    "p5_found": """
        WITH e AS (SELECT unnest(neg_id) AS neg_id FROM merged)
        SELECT neg_id FROM e WHERE neg_id IS NOT NULL GROUP BY 1
        HAVING count(*) >= 0.025 * (SELECT count(*) FROM e WHERE neg_id IS NOT NULL)""",
    "p5_figures": """
        WITH e AS (SELECT query_id, unnest(neg_id) AS neg_id FROM merged),
        w AS (SELECT neg_id, query_id, count(*) AS c FROM e WHERE neg_id IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT neg_id, query_id, c, row_number() OVER (PARTITION BY neg_id ORDER BY c DESC, query_id) AS r
              FROM w WHERE query_id IS NOT NULL)
        SELECT w.neg_id, CAST(sum(w.c) AS BIGINT) AS n_rows, count(w.query_id) AS n_queries,
               max(t.query_id) AS top_query, coalesce(max(t.c), 0) AS top_query_rows
        FROM w LEFT JOIN t ON t.neg_id = w.neg_id AND t.r = 1 GROUP BY 1""",
    "p5_score_percentiles": """
        SELECT neg_id, s.share, round(quantile_cont(neg_similarity, [0.05, 0.5, 0.95])[s.i], 9) AS similarity
        FROM negative_scores, (VALUES (1, CAST(0.05 AS DOUBLE)), (2, CAST(0.5 AS DOUBLE)), (3, CAST(0.95 AS DOUBLE))) AS s(i, share)
        WHERE neg_id IS NOT NULL AND neg_similarity IS NOT NULL GROUP BY neg_id, s.i, s.share""",
}
