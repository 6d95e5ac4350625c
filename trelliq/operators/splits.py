"""Seeded partitions of passages, inherited query splits, and their audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.functions.text import query_form
from trelliq.operators.filters import seeded

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


class LeakageError(ValueError):
    """A split holds what another must not have seen."""


def partitioned(passages: DataFrame, shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """(id, split): a seeded permutation of the distinct ids cut at the rounded shares, the last split taking the rest.

    The permutation is the order of a hash; its 4096 leading values are counted first, so no task ranks all ids.
    """
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    ids = passages.select("id").filter("id IS NOT NULL").distinct().withColumn("h", seeded(seed, "id")).withColumn("part", F.substring("h", 1, 3))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h", "id")) + F.col("start")
    placed = ids.join(F.broadcast(starts.select("part", "start", "all")), "part").withColumn("rank", rank)
    *first, last = shares
    bound, split = F.lit(0), None
    for s in first:
        bound = bound + F.bround(F.col("all") * F.lit(shares[s]), 0).cast("bigint")
        split = F.when(F.col("rank") <= bound, s) if split is None else split.when(F.col("rank") <= bound, s)
    return placed.select("id", split.otherwise(last).alias("split"))


def inherited(rows: DataFrame, partition: DataFrame) -> DataFrame:
    """``rows`` with the split of their positive; null where the partition lacks it (see ``checked``)."""
    return rows.join(partition.select(F.col("id").alias("pos_id"), "split"), "pos_id", "left")


def checked(rows: DataFrame) -> DataFrame:
    """``rows``, or a LeakageError naming up to five whose positive has no split."""
    lost = [r["query_id"] for r in rows.filter("split IS NULL").select("query_id").limit(5).collect()]
    if lost:
        raise LeakageError(f"positives without a split, as of queries {lost}")
    return rows


def split_summary(assigned: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(split, n_queries, n_positives, n_negatives, share, target) for every split of ``shares``."""
    spark = assigned.sparkSession
    targets = spark.createDataFrame(list(shares.items()), "split string, target double")
    found = assigned.groupBy("split").agg(F.count("*").alias("n_queries"), F.countDistinct("pos_id").alias("n_positives"), F.sum(F.greatest(F.size("neg_id"), F.lit(0))).alias("n_negatives"))
    joined = targets.join(found, "split", "left").fillna(0, ["n_queries", "n_positives", "n_negatives"])
    whole = F.broadcast(found.filter("split IS NOT NULL").agg(F.sum("n_queries").alias("__all")))
    return joined.crossJoin(whole).withColumn("share", F.round(F.try_divide("n_queries", "__all"), 9)).drop("__all")


def passage_labels(corpus: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(id, split): the split in which a passage is a positive, else 'shared' if it is any negative, else 'unused'."""
    own = positives.select(F.col("pos_id").alias("id"), "split").groupBy("id").agg(F.min("split").alias("split"))
    used = negatives.select(F.col("neg_id").alias("id"), F.lit("shared").alias("shared")).distinct()
    return corpus.select("id").join(own, "id", "left").join(used, "id", "left").select("id", F.coalesce("split", "shared", F.lit("unused")).alias("split"))


def count_of(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def leakage_audit(assigned: DataFrame, partition: DataFrame, *extra: DataFrame) -> DataFrame:
    """(check, violations) of queries (query_id, query, pos_id, neg_id, split) against the passages' partition, and of the
    caller's own checks (``extra``, frames of the same columns)."""
    pos = assigned.select("query_id", "split", "pos_id")
    train = assigned.filter("split = 'train'")
    negs = train.select("pos_id", F.explode("neg_id").alias("neg_id")).filter("neg_id IS NOT NULL")
    train_negs = negs.select(F.col("neg_id").alias("id")).distinct()
    seen = train_negs.union(train.select("pos_id").filter("pos_id IS NOT NULL")).distinct()
    sides = partition.groupBy("id").agg(F.sort_array(F.collect_set("split")).alias("s"))
    forms = assigned.groupBy(query_form(F.col("query")).alias("form")).agg(F.countDistinct("split").alias("n"))

    def both(a: str, b: str) -> DataFrame:
        return sides.filter(F.array_contains("s", a) & F.array_contains("s", b))

    home = pos.join(partition.select(F.col("id").alias("pos_id"), F.col("split").alias("home")), "pos_id", "left")
    checks = [count_of(f"partition_overlap_{a}_{b}", both(a, b)) for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
    checks += [count_of(f"{s}_pos_outside_own_partition", home.filter((F.col("split") == s) & ~F.equal_null("home", "split"))) for s in SHARES]
    checks += [count_of(f"{s}_passages_seen_in_train", partition.filter(F.col("split") == s).join(seen, "id", "left_semi")) for s in ("test", "val")]

    def positives(s: str) -> DataFrame:
        return pos.filter(F.col("split") == s).select(F.col("pos_id").alias("id")).distinct()

    checks.append(count_of("test_pos_ids_in_train_any_role", positives("test").join(seen, "id", "left_semi")))
    checks += [count_of(f"{s}_pos_ids_as_train_negatives", positives(s).join(train_negs, "id", "left_semi")) for s in ("val", "test")]
    checks.append(count_of("train_negatives_equal_to_own_positive", train.filter(F.array_contains("neg_id", F.col("pos_id")))))
    checks.append(count_of("exact_duplicate_queries_across_splits", forms.filter("n > 1")))
    checks.append(count_of("duplicate_query_ids_across_splits", assigned.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1")))
    return reduce(DataFrame.unionByName, [*checks, *extra])


def enforce(audit: DataFrame) -> DataFrame:
    """The audit, or a LeakageError if any check found something."""
    bad = {r["check"]: r["violations"] for r in audit.collect() if r["violations"]}
    if bad:
        raise LeakageError(", ".join(f"{k}={v}" for k, v in sorted(bad.items())))
    return audit


def straddling(assigned: DataFrame) -> DataFrame:
    """(check, violations): positives and normalized queries that stand in more than one split."""
    by_pos = assigned.groupBy("pos_id").agg(F.countDistinct("split").alias("n")).filter("n > 1 AND pos_id IS NOT NULL")
    by_form = assigned.groupBy(query_form(F.col("query")).alias("form")).agg(F.countDistinct("split").alias("n")).filter("n > 1 AND form IS NOT NULL")
    return count_of("shared_positives", by_pos).unionByName(count_of("shared_queries", by_form))


def deviation(assigned: DataFrame, largest: DataFrame, shares: dict[str, float] = SHARES, least: float = 0.01) -> DataFrame:
    """(max_deviation, tolerance, within) of the shares of ``assigned`` (split), which may miss their targets by ``least`` or by the
    largest component (``largest``: one row of largest_share), as components are never cut."""
    targets = assigned.sparkSession.createDataFrame(list(shares.items()), "split string, target double")
    found = assigned.groupBy("split").agg(F.count("*").alias("n"))
    whole = F.broadcast(found.agg(F.sum("n").alias("all")))
    away = F.abs(F.coalesce("n", F.lit(0)) / F.col("all") - F.col("target"))
    worst = targets.join(found, "split", "left").crossJoin(whole).agg(F.max(away).alias("d"))
    joined = worst.crossJoin(F.broadcast(largest)).withColumn("tolerance", F.greatest(F.lit(least), F.col("largest_share")))
    return joined.select(F.round("d", 9).alias("max_deviation"), "tolerance", (F.col("d") <= F.col("tolerance")).alias("within"))


def totality(corpus: DataFrame, partition: DataFrame) -> DataFrame:
    """(n_passages, n_placed, n_twice): distinct passages, placed ones, and those placed more than once."""
    twice = partition.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n_twice"))
    return corpus.agg(F.countDistinct("id").alias("n_passages")).crossJoin(F.broadcast(partition.agg(F.count("*").alias("n_placed")))).crossJoin(F.broadcast(twice))


def survivors(rows: DataFrame, floor: int) -> DataFrame:
    """(survivors, floor, breached): how many rows a run's filters left, against the least it may leave."""
    return rows.agg(F.count("*").alias("survivors")).select("survivors", F.lit(floor).alias("floor"), (F.col("survivors") < floor).alias("breached"))


def positives_outside(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(split, n_outside): queries (query_id, pos_id, split) whose positive is not in the index (id, split) of their split."""
    home = rows.join(index.select(F.col("id").alias("pos_id"), F.col("split").alias("home")), "pos_id", "left")
    return home.groupBy("split").agg(F.count_if(~F.equal_null("home", "split")).alias("n_outside"))


def inside_index(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows``, or a LeakageError if a positive is not in ``index`` (id): no metric could count it."""
    lost = rows.select(F.col("pos_id").alias("id")).join(index.select("id"), "id", "left_anti").count()
    if lost:
        raise LeakageError(f"{lost} queries have a positive outside the index")
    return rows
