"""Similarity of pairs and search in embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trelliq.functions.vectors import dot
from trelliq.operators.skew import key_percentiles
from trelliq.session import ship, store, written

#: Queries of a search are compared with rows in blocks of at most so many, rows in lots of so many or so many bytes.
BLOCK, LOT_ROWS, CHUNK_BYTES = 1024, 8192, 64 << 20


def vector_of(id_col: Column, n: int | Column) -> Column:
    """Place in an embedding table of ``n`` rows that stands in for encoding the text of an id."""
    return F.conv(F.substring(F.md5(id_col), 1, 8), 16, 10).cast("bigint") % n


def pair_similarity(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``similarity``, the inner product of the vectors of two ids; ``vectors`` has (vec_id, embedding)."""
    n = F.broadcast(vectors.agg(F.count("*").alias("__n")))
    table = vectors.select("vec_id", "embedding")
    left, right = (table.select(F.col("vec_id").alias(f"__{s}"), F.col("embedding").alias(f"__v{s}")) for s in "ab")
    placed = pairs.crossJoin(n).withColumn("__a", vector_of(F.col(a), F.col("__n"))).withColumn("__b", vector_of(F.col(b), F.col("__n")))
    scored = placed.join(left, "__a").join(right, "__b").withColumn("similarity", dot(F.col("__va"), F.col("__vb")))
    return scored.drop("__n", "__a", "__b", "__va", "__vb")


def distribution(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(statistic, value): n, mean, population deviation, extremes and exact percentiles of the non-null values."""
    v = rows.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    basic = v.agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    basic = basic.selectExpr("stack(5, 'n', n, 'mean', mean, 'std', std, 'min', min, 'max', max) AS (statistic, value)")
    at = key_percentiles(v.withColumn("k", F.lit(1)), "k", "v", shares)
    names = F.concat(F.lit("p"), F.format_string("%.1f", F.col("share") * 100))
    return basic.unionByName(at.select(names.alias("statistic"), F.col("percentile").alias("value"))).select("statistic", F.round("value", 6).alias("value"))


def embedded(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vec_id, split, embedding) of (id, split), as ``top_matches`` reads it; ``vectors`` has (vec_id, embedding)."""
    n = F.broadcast(vectors.agg(F.count("*").alias("__n")))
    own = vectors.select(F.col("vec_id").alias("__at"), "embedding")
    placed = ids.crossJoin(n).withColumn("__at", vector_of(F.col("id"), F.col("__n")))
    return placed.join(own, "__at").select(F.col("id").alias("vec_id"), "split", "embedding")


def gathered(batches: Iterator[pd.DataFrame], most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, splits, matrix) of rows in lots of bounded size."""
    held, size = [], 0
    for pdf in batches:
        if len(pdf):
            matrix = np.stack(pdf["embedding"].to_numpy())
            held.append((pdf["vec_id"].to_numpy(), pdf["split"].to_numpy(), matrix))
            size += matrix.nbytes
            if size >= most:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def compared(queries: DataFrame, base: DataFrame, schema: str, work: Callable, apart: bool = False, without: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``work(query ids, row ids, scores)`` of every block of queries against every lot of rows, with the given schema.

    Both have (vec_id, split, embedding). Queries are a table in the shared folder that each task reads block by block, so
    neither the driver nor a task ever holds all of them, and the rows are scanned once and not shuffled. Scores of
    pairs that are left out (a query's own row, or the pairs of ``without`` instead; with ``apart`` rows of its own split)
    are minus infinity.
    """
    spark = base.sparkSession
    ship(spark)
    if without is None:
        asked = queries.select("vec_id", "split", "embedding", F.array("vec_id").alias("hidden"))
    else:
        # A query's own list, as long as the row that names it.
        lists = without.groupBy(F.col("query_id").alias("vec_id")).agg(F.collect_list("id").alias("hidden"))
        asked = queries.select("vec_id", "split", "embedding").join(lists, "vec_id", "left")
    asked = written(asked, "queries")
    folder = asked._trelliq_table

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, path = store(folder)
        names = sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))
        for ids, splits, matrix in gathered(batches):
            for name in names:
                with files.open_input_file(name) as f:
                    for part in pq.ParquetFile(f).iter_batches(block):
                        pdf = part.to_pandas()
                        own = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                        out = pdf["hidden"].explode().dropna()
                        for at in range(0, len(ids), LOT_ROWS):
                            some = ids[at : at + LOT_ROWS]
                            scores = np.round(own @ matrix[at : at + LOT_ROWS].astype(np.float64).T, 9)
                            pairs = pd.DataFrame({"row": out.index.to_numpy(), "id": out.to_numpy()}).merge(pd.DataFrame({"id": some, "column": np.arange(len(some))}), on="id") if len(out) else None
                            if pairs is not None:
                                scores[pairs["row"].to_numpy(), pairs["column"].to_numpy()] = -np.inf
                            if apart:
                                scores[pdf["split"].to_numpy()[:, None] == splits[at : at + LOT_ROWS][None, :]] = -np.inf
                            yield work(pdf["vec_id"].to_numpy(), some, scores)

    return base.select("vec_id", "split", "embedding").mapInPandas(scan, schema)


def top_matches(queries: DataFrame, base: DataFrame, k: int, apart: bool = False, block: int = BLOCK, below: float | None = None, without: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity): the ``k`` rows of ``base`` nearest to each query, itself left out, ties by id.

    Both have (vec_id, split, embedding); ``apart`` leaves out rows of the query's own split, ``below`` rows of that
    similarity or more, ``without`` (query_id, id) these pairs instead of the query itself. All of them are left out
    before rows are ranked, so they take no place among the ``k``. Each lot of rows keeps k rows a query (see
    ``compared``), and these alone are shuffled.
    """
    kinds = [x.schema["vec_id"].dataType.simpleString() for x in (queries, base)]

    def nearest(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        if below is not None:
            scores[scores >= below] = -np.inf
        # Only rows that reach a query's k-th score are sorted, ties by id.
        at = max(0, scores.shape[1] - k)
        least = np.partition(scores, at, axis=1)[:, at]
        row, column = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        order = np.lexsort((ids[column], -scores[row, column], row))
        row, column = row[order], column[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[nth < k], column[nth < k]
        return pd.DataFrame({"query_id": asked[row], "id": ids[column], "similarity": scores[row, column]})

    found = compared(queries, base, f"query_id {kinds[0]}, id {kinds[1]}, similarity double", nearest, apart, without, block)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")


def count_at_least(queries: DataFrame, base: DataFrame, least: float, without: DataFrame | None = None) -> DataFrame:
    """(query_id, n) of the queries with rows of similarity ``least`` or more, pairs of ``without`` left out: only counts leave
    a task."""

    def count(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        n = (scores >= least).sum(axis=1)
        return pd.DataFrame({"query_id": asked[n > 0], "n": n[n > 0]})

    found = compared(queries, base, f"query_id {queries.schema['vec_id'].dataType.simpleString()}, n bigint", count, without=without)
    return found.groupBy("query_id").agg(F.sum("n").alias("n"))


def unordered(pairs: DataFrame) -> DataFrame:
    """One row for each unordered pair, the most similar, then the smallest query."""
    key = [F.least("query_id", "id"), F.greatest("query_id", "id")]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("similarity"), "query_id"))
    return pairs.withColumn("nth", nth).filter("nth = 1").drop("nth")
