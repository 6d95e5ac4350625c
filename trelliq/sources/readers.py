"""Readers with stated schemas, and the guards of what was read."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trelliq.config import DatasetIntegrityError
from trelliq.functions.text import matching_form, trimmed
from trelliq.operators.filters import NO_ENTITY
from trelliq.operators.vocab import parsed_records, read_records, vocabulary

SPLIT_RECORD = "query_id string, query string, split string, pos_id string, pos string, neg_id array<string>, neg array<string>"
CLEANED_RECORD = "query_id string, query string, pos_id string, pos string, alt_pos_ids array<string>, neg_ids array<string>, negs array<string>, neg_ids_uncapped array<string>"
CORPUS_RECORD = "id string, text string, split string, token_count int"
LABELS = "query_id string, query string, predicted string, label string"
QRELS = "`query-id` string, `corpus-id` string, score int"


def parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a broken line fails the read instead of turning into nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def labels_csv(spark: SparkSession, path: str, schema: str = LABELS) -> DataFrame:
    """Hand labels with a header; labels stay text, so a blank cell cannot turn 1 into 1.0."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(term): distinct lines of more than three characters in matching form, without mentions that name nothing."""
    line = trimmed(F.col("value"))
    terms = spark.read.text(path).filter(F.length(line) > 3).select(matching_form(line).alias("term"))
    return terms.filter((F.col("term") != "") & ~F.col("term").isin(NO_ENTITY)).distinct()


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(term, tree_numbers, n_words) of a descriptor file."""
    return vocabulary(parsed_records(read_records(spark, path)))


def checked_count(df: DataFrame, label: str, expected: int | None, strict: bool = True) -> DataFrame:
    """``df``, after its row count was compared: an error when strict, else a warning. Nothing is expected of None."""
    if expected is not None and (found := df.count()) != expected:
        said = f"{label}: {found} rows, expected {expected}"
        if strict:
            raise DatasetIntegrityError(said)
        warnings.warn(said, stacklevel=2)
    return df


def graded(qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qrels, histogram): renamed to (query_id, id, grade), and (grade, n, known) with grades 0 to 2 known."""
    own = qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("id"), F.col("score").alias("grade"))
    return own, own.groupBy("grade").agg(F.count("*").alias("n")).withColumn("known", F.coalesce(F.col("grade").isin(0, 1, 2), F.lit(False)))


def vector_width(vectors: DataFrame, expected: int, column: str = "embedding") -> DataFrame:
    """``vectors``, after every vector was found to have the expected width."""
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low is not None and (low, high) != (expected, expected):
        raise DatasetIntegrityError(f"vectors of {low} to {high} numbers, expected {expected}")
    return vectors


def retrieval_folder(spark: SparkSession, folder: str, expected_passages: int | None = None, expected_queries: int | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a retrieval benchmark: corpus/ and queries/ as JSON lines (id, text), qrels/ as tab-separated
    (query-id, corpus-id, score) with a header. Passages and judged queries are counted against what is expected; grades
    beyond 0 to 2 warn."""
    corpus, queries = (jsonl(spark, f"{folder}/{name}", "id string, text string") for name in ("corpus", "queries"))
    qrels, histogram = graded(spark.read.schema(QRELS).option("header", True).option("sep", "\t").csv(f"{folder}/qrels"))
    checked_count(corpus, "corpus", expected_passages, strict)
    checked_count(qrels.select("query_id").distinct(), "judged queries", expected_queries, strict)
    if odd := [r["grade"] for r in histogram.filter("NOT known").limit(5).collect()]:
        warnings.warn(f"grades beyond 0 to 2: {odd}", stacklevel=2)
    return corpus, queries, qrels
