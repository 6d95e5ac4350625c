"""Duplicate passages and queries by normalized text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.functions.text import matching_form, query_form
from trelliq.operators.integrity import clean_edges, first_places
from trelliq.session import written


def canonical_passages(corpus: DataFrame) -> DataFrame:
    """(id, canonical_id): the smallest id with the same normalized text; a null text stands for itself.

    Normalized once and grouped by digest, so that long texts are not shuffled and a text copied very often is one row
    before anything is joined.
    """
    forms = written(corpus.select("id", F.sha2(matching_form(F.col("text")), 256).alias("form")), "forms")
    named = forms.filter("form IS NOT NULL")
    groups = named.groupBy("form").agg(F.min("id").alias("canonical_id"))
    return named.join(groups, "form").select("id", "canonical_id").unionByName(forms.filter("form IS NULL").select("id", F.col("id").alias("canonical_id")))


def passage_duplicates(corpus: DataFrame) -> DataFrame:
    """(n_ids, n_texts, n_merged, largest_group)."""
    sizes = canonical_passages(corpus).groupBy("canonical_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_texts"), (F.sum("n") - F.count("*")).alias("n_merged"), F.max("n").alias("largest_group"))


def remapped_edges(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, pos_id, place, neg_id) with canonical ids, collapsed and self negatives stripped again."""
    names = canonical_passages(corpus)
    e = clean_edges(rows, corpus)
    e = e.join(names.select(F.col("id").alias("neg_id"), F.col("canonical_id").alias("neg")), "neg_id").drop("neg_id").withColumnRenamed("neg", "neg_id")
    e = e.join(names.select(F.col("id").alias("pos_id"), F.col("canonical_id").alias("pos")), "pos_id").drop("pos_id").withColumnRenamed("pos", "pos_id")
    return first_places(e.filter("neg_id <> pos_id"), "query_id", "neg_id")


def query_duplicates(rows: DataFrame) -> DataFrame:
    """(n_queries, n_groups, n_repeated, largest_group, n_many_positives) over normalized queries."""
    g = rows.groupBy(matching_form(F.col("query")).alias("form")).agg(F.count("*").alias("n"), F.countDistinct("pos_id").alias("positives"))
    many = F.col("n") > 1
    return g.agg(F.sum("n").alias("n_queries"), F.count("*").alias("n_groups"), F.count_if(many).alias("n_repeated"), F.max("n").alias("largest_group"), F.count_if(many & (F.col("positives") > 1)).alias("n_many_positives"))


def consolidated(rows: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, negatives) with one query for each normalized text.

    queries(form, query_id, query, pos_id, alt_pos_ids); negatives(query_id, rank, neg_id): the union of the lists in the
    order of (query_id, place), first occurrence kept, all positives left out. ``listed`` has (query_id, place, neg_id).
    """
    forms = rows.select("query_id", "query", "pos_id", matching_form(F.col("query")).alias("form"))
    groups = forms.groupBy("form").agg(F.min("query_id").alias("rep"), F.min_by("query", "query_id").alias("query"), F.array_sort(F.collect_set("pos_id")).alias("alt_pos_ids"))
    named = forms.select("form", "query_id").join(groups.select("form", "rep"), "form")
    union = listed.select("query_id", "place", "neg_id").join(named, "query_id")
    first = union.groupBy("rep", "neg_id").agg(F.min(F.struct("query_id", "place")).alias("at"))
    positives = groups.select("rep", F.explode("alt_pos_ids").alias("neg_id"))
    kept = first.join(positives, ["rep", "neg_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("at"))
    queries = groups.select("form", F.col("rep").alias("query_id"), "query", F.get("alt_pos_ids", F.lit(0)).alias("pos_id"), "alt_pos_ids")
    return queries, kept.select(F.col("rep").alias("query_id"), rank.alias("rank"), "neg_id")


def exact_groups(assigned: DataFrame) -> DataFrame:
    """(form, n, n_splits, example, straddles, splits, query_ids) of queries with the same form; the last two are JSON lists in
    order, and the ids of a group are part of its row. ``assigned`` has (query_id, query, split)."""
    g = assigned.groupBy(query_form(F.col("query")).alias("form"))
    ids, splits = F.to_json(F.array_sort(F.collect_list("query_id"))), F.to_json(F.array_sort(F.collect_set("split")))
    found = g.agg(F.count("*").alias("n"), F.countDistinct("split").alias("n_splits"), F.min_by("query", "query_id").alias("example"), splits.alias("splits"), ids.alias("query_ids"))
    return found.filter("n > 1").withColumn("straddles", F.col("n_splits") > 1)


#: Which split keeps a query that stands in several.
PRECEDENCE = {"test": 2, "val": 1, "train": 0}


def precedence(split: str = "split"):
    out = F.lit(None).cast("int")
    for name, value in PRECEDENCE.items():
        out = F.when(F.col(split) == name, value).otherwise(out)
    return out


def straddlers(assigned: DataFrame) -> DataFrame:
    """(query_id, split) to drop: copies outside the highest split in which their query stands."""
    forms = assigned.select("query_id", "split", query_form(F.col("query")).alias("form"), precedence().alias("rank"))
    best = forms.groupBy("form").agg(F.max("rank").alias("best"))
    return forms.join(best, "form").filter("rank < best").select("query_id", "split")
