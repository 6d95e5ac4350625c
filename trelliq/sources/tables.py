"""Readers of the tables, with their schemas stated: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trelliq.session import ship

CORPUS = "id string, text string"
MERGED = "query string, query_id string, pos string, pos_id string, neg array<string>, neg_id array<string>, loaded_at timestamp_ntz"
NEGATIVE_SCORES = "query_id string, query string, neg_id string, neg_reuse_count bigint, neg_similarity double, scored_at timestamp_ntz"
SPLIT_ROWS = "query_id string, split string, source string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, facility string, loaded_at timestamp_ntz"
MIX_TARGETS = "source string, target_share double, max_passes int"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"

SCHEMAS = {
    "corpus": CORPUS,
    "merged": MERGED,
    "negative_scores": NEGATIVE_SCORES,
    "split_rows": SPLIT_ROWS,
    "documents": DOCUMENTS,
    "mix_targets": MIX_TARGETS,
    "embeddings": EMBEDDINGS,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; a column that the file lacks is null."""
    ship(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
