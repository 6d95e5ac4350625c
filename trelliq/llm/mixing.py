"""Problem 7: a mixture of sources with target shares of all tokens, small sources repeated a capped number of times.

Method: systematic sampling. Within a source the documents are put in order, each adds the same expected number of
copies to a running sum that starts at one random offset, and a document is emitted once for each integer that its step
of the sum crosses. The order is by size, so every stretch of sizes is drawn evenly and a source's tokens miss their
target by about one document. The running sum is exact and distributed: counts by (source, size), then by hash bucket
of a size, then a rank within one bucket, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.llm.tokens import TOKENIZERS, token_counts
from trelliq.session import written

HASH_BUCKETS = 4096


def mixture_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_passes, n_docs, size, wanted, expected) of each target that has tokens.

    ``sizes`` has (source, n_docs, size). Shares are taken in proportion among the targets that have documents. Without
    ``total_tokens`` the mixture is the largest in which every such source meets its share within its cap; with it, a
    source that cannot reach its share stops at its cap. Several rows of one source add their shares and keep the lowest
    cap; rows with a null source, or without a positive share and cap, are left out.
    """
    wanted = (
        targets.filter("source IS NOT NULL AND target_share > 0 AND max_passes > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_passes").alias("max_passes"))
        .join(sizes.filter("size > 0"), "source")
    )
    reach = F.col("max_passes") * F.col("size") / F.col("target_share")
    whole = wanted.agg(F.sum("target_share").alias("__shares"), F.min(reach).alias("__reach"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("__reach") * F.col("__shares")
    wanted = wanted.crossJoin(F.broadcast(whole)).withColumn("wanted", F.col("target_share") / F.col("__shares") * total)
    expected = F.least(F.col("max_passes").cast("double"), F.col("wanted") / F.col("size"))
    return wanted.withColumn("expected", expected).drop("__shares", "__reach")


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_tokens: int | None = None, seed: int = 42, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture(source, doc_id, copy_no, n_tokens): one row for each use of a document. report(source, target_share,
    max_passes, n_docs, available_tokens, n_rows, n_tokens, actual_share, passes): one row for each source with a
    target, unreached ones with zeros. Documents with a null source or with no token are never used. Repeated rows count
    as documents of their own. Empty tables give an empty mixture. Extra columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).filter("source IS NOT NULL")
    counted = written(token_counts(own, "text", ["doc_id", "source"], tokenizers), "tokens").filter("n_tokens > 0")
    sizes = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("size"))
    plan = written(mixture_plan(sizes, targets, total_tokens), "plan")

    h = F.xxhash64(F.lit(seed), "doc_id")
    keyed = counted.join(F.broadcast(plan.select("source", "expected")), "source").withColumn("h", h).withColumn("part", F.pmod("h", F.lit(HASH_BUCKETS)))
    ranks = ranked(keyed, "source", "n_tokens", ["h", "doc_id"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.floor(offset + F.col("expected") * (F.col("rank") + 1)) - F.floor(offset + F.col("expected") * F.col("rank"))
    used = ranks.withColumn("copies", copies.cast("int")).filter("copies > 0")
    mixture = used.select("source", "doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens")

    reached = used.groupBy("source").agg(F.sum("copies").alias("n_rows"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    all_targets = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_passes").alias("max_passes"))
    report = all_targets.join(plan.select("source", "n_docs", F.col("size").alias("available_tokens")), "source", "left").join(reached, "source", "left")
    report = report.fillna(0, ["n_docs", "available_tokens", "n_rows", "n_tokens"])
    whole = report.agg(F.sum("n_tokens").alias("__all"))
    report = report.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_passes", "n_docs", "available_tokens", "n_rows", "n_tokens",
        F.coalesce(F.try_divide("n_tokens", "__all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.try_divide("n_tokens", "available_tokens"), F.lit(0.0)).alias("passes"),
    )
    return mixture, report


def ranked(rows: DataFrame, group: str, size: str, within: list[str]) -> DataFrame:
    """``rows`` (which have a bucket ``part``) with ``rank``, their place from 0 by (size, part, within) in their group."""
    by_part = rows.groupBy(group, size, "part").agg(F.count("*").alias("n"))
    before_part = Window.partitionBy(group, size).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.withColumn("part_start", F.coalesce(F.sum("n").over(before_part), F.lit(0))).drop("n")
    before_size = Window.partitionBy(group).orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.groupBy(group, size).agg(F.sum("n").alias("n")).withColumn("size_start", F.coalesce(F.sum("n").over(before_size), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(group, size, "part").orderBy(*within))
    return (
        rows.withColumn("place", place)
        .join(parts, [group, size, "part"])
        .join(starts, [group, size])
        .withColumn("rank", F.col("size_start") + F.col("part_start") + F.col("place") - 1)
        .drop("size_start", "part_start", "place")
    )
