"""The records that a run exports: queries and passages with their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trelliq.functions.text import n_tokens


def texts(corpus: DataFrame, id_name: str, text_name: str) -> DataFrame:
    return corpus.select(F.col("id").alias(id_name), F.col("text").alias(text_name)).dropDuplicates([id_name])


def with_lists(queries: DataFrame, listed: DataFrame, corpus: DataFrame, order: str, ids: str = "neg_ids", negs: str = "negs") -> DataFrame:
    """``queries`` (query_id, pos_id) with pos, and the negatives of ``listed`` (query_id, neg_id) as two lists in one order: ids and
    texts. Queries without any have empty lists; texts that the corpus lacks are null."""
    named = listed.select("query_id", order, "neg_id").join(texts(corpus, "neg_id", "neg"), "neg_id", "left")
    lists = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, "neg_id", "neg"))).alias("__l"))
    joined = queries.join(texts(corpus, "pos_id", "pos"), "pos_id", "left").join(lists, "query_id", "left")
    empty = F.array().cast("array<string>")
    return joined.withColumns({ids: F.coalesce(F.transform("__l", lambda x: x["neg_id"]), empty), negs: F.coalesce(F.transform("__l", lambda x: x["neg"]), empty)}).drop("__l")


def passages(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, split, token_count) of every passage; ``labels`` has (id, split)."""
    return corpus.join(labels.dropDuplicates(["id"]), "id").select("id", "text", "split", n_tokens(F.col("text")).alias("token_count"))
