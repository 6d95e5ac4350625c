"""Retrieval metrics over ranked runs, BM25, and a paired bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.operators.lexical import bm25_runs


def ranked(run: DataFrame, depth: int) -> DataFrame:
    """``run`` (query_id, id, score) with ``rank``, ties by id, down to ``depth``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return run.withColumn("rank", rank).filter(F.col("rank") <= depth)


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall, precision, mrr, hit) at ``k`` with linear gains; ``qrels`` has (query_id, id, grade).

    Every query with a positive grade has a row; one without results scores 0.
    """
    top = ranked(run, k).join(qrels, ["query_id", "id"])
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    found = top.filter("grade > 0").groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.count("*").alias("hits"), F.min("rank").alias("first"))
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = qrels.filter("grade > 0").withColumn("rank", ideal_rank)
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("best"), F.count("*").alias("relevant"))
    joined = ideal.join(found, "query_id", "left")
    zero = F.lit(0.0)
    return joined.select(
        "query_id", F.coalesce(F.col("dcg") / F.col("best"), zero).alias("ndcg"), F.coalesce(F.col("hits") / F.col("relevant"), zero).alias("recall"),
        F.coalesce(F.col("hits") / F.lit(float(k)), zero).alias("precision"), F.coalesce(1 / F.col("first"), zero).alias("mrr"), F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("hit"),
    )


def cutoffs(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10), ranks: int = 10) -> DataFrame:
    """(metric, k, value): accuracy, precision and recall at each of ``ks``, ndcg and mrr at ``ranks``, averaged over the graded queries.

    A query may have any number of relevant ids; one without results scores 0."""
    relevant = qrels.filter("grade > 0").select("query_id", "id")
    hits = ranked(run, max(ks)).join(relevant, ["query_id", "id"]).groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    q = relevant.groupBy("query_id").agg(F.count("*").alias("n")).join(hits, "query_id", "left").fillna(0)
    columns = [x for k in ks for x in ((f"'accuracy', {k}", F.avg((F.col(f"h{k}") > 0).cast("double"))), (f"'precision', {k}", F.avg(F.col(f"h{k}") / k)), (f"'recall', {k}", F.avg(F.col(f"h{k}") / F.col("n"))))]
    one = q.agg(*(c.alias(f"c{i}") for i, (_, c) in enumerate(columns)))
    stacked = one.selectExpr(f"stack({len(columns)}, " + ", ".join(f"{name}, c{i}" for i, (name, _) in enumerate(columns)) + ") AS (metric, k, value)")
    best = per_query(run, qrels, ranks).agg(F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr")).selectExpr(f"stack(2, 'ndcg', {ranks}, ndcg, 'mrr', {ranks}, mrr) AS (metric, k, value)")
    return stacked.unionByName(best).select("metric", "k", F.round("value", 9).alias("value"))


def metric_key(values: dict, name: str = "") -> str:
    """The key of nDCG@10 in a dict of metrics, the cosine one first; evaluators have named it differently."""
    for wanted in (("ndcg@10", "cosine"), ("ndcg@10",)):
        for key in values:
            if all(w in key.lower() for w in wanted):
                return key
    raise KeyError(f"no nDCG@10 among the metrics of {name}: {sorted(values)}")


def claims(rows: DataFrame) -> DataFrame:
    """(answer_id, at, claim) of the sentences of (answer_id, text) that have a word."""
    parts = F.filter(F.split("text", r"[.!?]+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return rows.select("answer_id", F.posexplode(F.transform(parts, lambda x: F.trim(x))).alias("at", "claim"))


def chunked(rows: DataFrame, size: int = 40, step: int = 20) -> DataFrame:
    """(answer_id, chunk, text) of runs of ``size`` words of (answer_id, text), one each ``step`` words; shorter texts are one."""
    words = rows.select("answer_id", F.split(F.trim("text"), " +").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + step, F.lit(1)), F.lit(step))
    return words.select("answer_id", "w", F.posexplode(starts).alias("chunk", "start")).select("answer_id", "chunk", F.array_join(F.slice("w", F.col("start"), F.lit(size)), " ").alias("text"))


def averages(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 9).alias(c) for c in ("ndcg", "recall", "precision", "mrr", "hit")))


def bm25(queries: DataFrame, passages: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best passages of each query; query words count once."""
    return bm25_runs(queries, passages, k, [(k1, b)]).drop("setting")


def paired_bootstrap(a: DataFrame, b: DataFrame, metric: str, resamples: int = 10000, seed: int = 42) -> DataFrame:
    """(mean_difference, low, high, p): 95 % interval of the mean difference over resampled queries.

    Each query's weight in a resample is a Poisson(1) draw from a hash of (seed, resample, query), so resampling is one
    aggregation in any order, on any number of tasks; the rows that leave it are one a resample.
    """
    d = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").select("query_id", (F.col("x") - F.col("y")).alias("d"))
    u = F.pmod(F.xxhash64(F.lit(seed), "r", "query_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # Cumulative Poisson(1) probabilities.
    weight = sum((F.when(u >= p, 1).otherwise(0) for p in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676)), F.lit(0))
    draws = d.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).groupBy("r").agg(F.try_divide(F.sum(weight * F.col("d")), F.sum(weight)).alias("m"))
    ends = draws.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("m") <= 0).cast("double")).alias("below"))
    mean = F.broadcast(d.agg(F.avg("d").alias("mean_difference")))
    return ends.crossJoin(mean).select("mean_difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (2 * F.least("below", 1 - F.col("below"))).alias("p"))


def config_matrix(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(config, tier, n_queries, ndcg, recall, precision, mrr, hit) of all runs of (config, tier, query_id, id, score).

    One pass scores every configuration: the run's name becomes part of the query's. ``qrels`` has (tier, query_id, id,
    grade); a configuration is scored on all graded queries of its tier.
    """
    name = F.to_json(F.struct("config", "tier", "query_id"))
    tagged = runs.select(name.alias("query_id"), "id", "score")
    known = runs.select("config", "tier").distinct().join(qrels, "tier").select(name.alias("query_id"), "id", "grade")
    scores = per_query(tagged, known, k)
    parts = scores.select("*", F.get_json_object("query_id", "$.config").alias("config"), F.get_json_object("query_id", "$.tier").alias("tier"))
    return parts.groupBy("config", "tier").agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 9).alias(c) for c in ("ndcg", "recall", "precision", "mrr", "hit")))


def faithfulness(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(answer_id, n_claims, n_supported, share, weakest) of (answer_id, claim, chunk, entailment).

    A claim is supported when its best chunk reaches the threshold; a null score supports nothing.
    """
    best = claims.groupBy("answer_id", "claim").agg(F.max("entailment").alias("best"))
    ok = F.coalesce(F.col("best") >= threshold, F.lit(False))
    return best.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count_if(ok).alias("n_supported"), F.avg(ok.cast("double")).alias("share"), F.min(F.coalesce("best", F.lit(0.0))).alias("weakest"))


def kappa(pairs: DataFrame) -> DataFrame:
    """(n, agreement, kappa) of two raters' labels (a, b); kappa is 1 where chance alone would always agree."""
    c = pairs.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    whole = F.broadcast(c.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")))
    left, right = c.groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("na")), c.groupBy(F.col("b").alias("x")).agg(F.sum("n").alias("nb"))
    chance = F.broadcast(left.join(right, "x").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both")))
    r = whole.crossJoin(chance).select(F.coalesce("all", F.lit(0)).alias("n"), F.try_divide("same", "all").alias("agreement"), F.try_divide("both", F.col("all") * F.col("all")).alias("e"))
    return r.select("n", "agreement", F.when(F.col("e") == 1, 1.0).otherwise(F.try_divide(F.col("agreement") - F.col("e"), 1 - F.col("e"))).alias("kappa"))
