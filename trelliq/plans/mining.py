"""Queries of the mining half: reuse, similarity, negatives, splits, audits, ledger, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trelliq.config import PARTITIONS
from trelliq.functions import text as t
from trelliq.operators import graph, integrity, ledger as book, metrics, negatives, records, similarity, splits
from trelliq.operators.filters import degenerate_passages, seeded, with_content
from trelliq.plans import sql as s
from trelliq.plans.cleaning import SAMPLE_LABELS, assigned, cleaned, hand_label_scores, kept, scores_sql
from trelliq.session import written
from trelliq.sources.tables import table

SHARES = [0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.995, 0.999]
NEAR_SHARES = [0.5, 0.9, 0.95, 0.99, 0.995, 0.999]
#: The recorded score at and above which a negative counts as false (which also caps mining), negatives of a query.
FALSE_NEGATIVE, BUDGET = 0.71, 8
SEARCH_STEP = 50


def scored_pairs(spark, folder) -> DataFrame:
    """(query_id, neg_id, similarity): each scored pair once."""
    rows = table(spark, folder, "negative_scores").filter("neg_id IS NOT NULL")
    return rows.groupBy("query_id", "neg_id").agg(F.max("neg_similarity").alias("similarity"))


def vectors(spark, folder) -> DataFrame:
    """Embeddings with a split by seeded hash, for searches."""
    h = F.conv(F.substring(seeded(42, "vec_id"), 1, 8), 16, 10).cast("bigint") % 10
    split = F.when(h < 8, "train").when(h < 9, "val").otherwise("test")
    return table(spark, folder, "embeddings").select("vec_id", "embedding", split.alias("split"))


def asked(spark, folder) -> DataFrame:
    """The stated query set of a search: rows whose id is divisible by 50."""
    return vectors(spark, folder).filter(F.col("vec_id") % SEARCH_STEP == 0)


def partition(spark, folder) -> DataFrame:
    return splits.partitioned(table(spark, folder, "corpus"))


def negative_reuse_edges(spark, folder):
    return negatives.reuse(integrity.edges(table(spark, folder, "merged"), "query_id")).select("neg_id", "n_edges")


def negative_reuse_queries(spark, folder):
    return negatives.reuse(integrity.edges(table(spark, folder, "merged"), "query_id")).select("neg_id", "n_queries")


def reuse_topn(spark, folder):
    """Report of the 15 most reused negatives with their text."""
    top = negatives.reuse(cleaned(spark, folder)).orderBy(F.desc("n_queries"), "neg_id").limit(15).select("neg_id", "n_queries")
    return table(spark, folder, "corpus").join(F.broadcast(top), F.col("id") == F.col("neg_id")).select("neg_id", "n_queries", "text")


def high_reuse_candidates(spark, folder):
    return negatives.high_reuse_pairs(cleaned(spark, folder))


def edge_similarity(spark, folder) -> DataFrame:
    return similarity.pair_similarity(cleaned(spark, folder), table(spark, folder, "embeddings"), "query_id", "neg_id")


def pair_similarity(spark, folder):
    return edge_similarity(spark, folder).select("query_id", "neg_id", F.round("similarity", 6).alias("similarity"))


def similarity_percentiles(spark, folder):
    return similarity.distribution(scored_pairs(spark, folder), "similarity", SHARES)


def cutoff(spark, folder, candidates: DataFrame) -> DataFrame:
    """One row: the fifth percentile of positive similarity over queries with a much reused negative."""
    asked_for = candidates.select("query_id").distinct()
    positives = kept(spark, folder).select("query_id", "pos_id").join(asked_for, "query_id", "left_semi")
    scored = similarity.pair_similarity(positives, table(spark, folder, "embeddings"), "query_id", "pos_id")
    found = similarity.key_percentiles(scored.withColumn("k", F.lit(1)), "k", "similarity", [0.05])
    return found.select(F.round("percentile", 6).alias("threshold"))


def fn_threshold(spark, folder):
    return cutoff(spark, folder, written(negatives.high_reuse_pairs(cleaned(spark, folder)), "candidates"))


def drop_false_negatives(spark, folder):
    """Edges without the much reused pairs at or above the calibrated cutoff; edges and candidates are made once."""
    edges = written(cleaned(spark, folder), "edges")
    candidates = written(negatives.high_reuse_pairs(edges), "candidates")
    scored = similarity.pair_similarity(candidates, table(spark, folder, "embeddings"), "query_id", "neg_id")
    flagged = scored.crossJoin(F.broadcast(cutoff(spark, folder, candidates))).filter(F.round("similarity", 6) >= F.col("threshold"))
    return negatives.without_pairs(edges, flagged).select("query_id", "place", "neg_id")


def fn_stats(spark, folder):
    return negatives.prune_stats(scored_pairs(spark, folder), FALSE_NEGATIVE)


def top_bottom_pairs(spark, folder):
    """Report of the five most and three least similar pairs."""
    p = scored_pairs(spark, folder).filter("similarity IS NOT NULL")
    top = p.orderBy(F.desc("similarity"), "query_id", "neg_id").limit(5).withColumn("end", F.lit("top"))
    return top.unionByName(p.orderBy("similarity", "query_id", "neg_id").limit(3).withColumn("end", F.lit("bottom")))


def cap_negatives(spark, folder):
    c = negatives.capped(cleaned(spark, folder), BUDGET)
    return c.groupBy("query_id").agg(F.count("*").alias("n"), integrity.in_order("neg_id", "place").alias("neg_ids"))


def training_triplets(spark, folder):
    return negatives.first_negatives(cleaned(spark, folder), 4).select("query_id", "pos_id", "rank", "neg_id")


def training_columns(spark, folder):
    return negatives.training_columns(cleaned(spark, folder), 4)


def cross_split_neighbors(spark, folder):
    return similarity.unordered(similarity.top_matches(asked(spark, folder), vectors(spark, folder), 1, apart=True)).withColumn("similarity", F.round("similarity", 6))


def near_dup_stats(spark, folder):
    """Distribution over the stated query set (``asked``) and the best match of each of its rows, not over the table."""
    return similarity.distribution(cross_split_neighbors(spark, folder), "similarity", NEAR_SHARES)


def near_dup_top30(spark, folder):
    """Report of the 30 most similar pairs across splits, of the stated query set."""
    return cross_split_neighbors(spark, folder).orderBy(F.desc("similarity"), "query_id", "id").limit(30)


def training(spark, folder) -> tuple[DataFrame, DataFrame]:
    """(queries, passages) of the training partition: kept queries with an inherited split, with their lists, and (id, split)."""
    part = written(partition(spark, folder), "partition")
    rows = splits.inherited(kept(spark, folder).select("query_id", "query", "pos_id", "neg_id"), part).filter("split = 'train'")
    return rows, part.filter("split = 'train'")


def stated(rows: DataFrame) -> DataFrame:
    """The stated query set of searches by text id: rows whose hashed id is divisible by 50."""
    return rows.filter(similarity.vector_of(F.col("query_id"), SEARCH_STEP) == 0)


def embedded(spark, folder, ids: DataFrame) -> DataFrame:
    return similarity.embedded(ids, table(spark, folder, "embeddings"))


def topk_passages(spark, folder):
    """Ten nearest training passages of each training query of the stated set, its own positive left out."""
    rows, inside = training(spark, folder)
    asked = stated(rows)
    own = asked.select("query_id", F.col("pos_id").alias("id"))
    near = similarity.top_matches(embedded(spark, folder, asked.select(F.col("query_id").alias("id"), "split")), embedded(spark, folder, inside), 10, without=own)
    return near.withColumn("similarity", F.round("similarity", 6))


def mining_run(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stripped, chosen, rejected) of mining for the training queries of the stated set (see ``negatives.mining_counters``)."""
    rows, inside = training(spark, folder)
    asked = written(stated(rows), "asked")
    vectors = table(spark, folder, "embeddings")
    stripped = negatives.strip_counts(asked, inside)
    listed = integrity.first_places(integrity.edges(asked, "query_id", "pos_id").filter("neg_id <> pos_id").join(inside.select(F.col("id").alias("neg_id")), "neg_id", "left_semi"), "query_id", "neg_id")
    have = written(negatives.hardest_first(similarity.pair_similarity(listed, vectors, "query_id", "neg_id"), BUDGET), "have")
    counts = have.groupBy("query_id").agg(F.count("*").alias("k"))
    needing = written(asked.join(counts, "query_id", "left").filter(F.coalesce("k", F.lit(0)) < BUDGET), "needing")
    taken = written(have.select("query_id", F.col("neg_id").alias("id")).join(needing.select("query_id"), "query_id", "left_semi").unionByName(needing.select("query_id", F.col("pos_id").alias("id"))).distinct(), "taken")
    queries = written(embedded(spark, folder, needing.select(F.col("query_id").alias("id"), "split")), "vectors")
    base = written(embedded(spark, folder, inside), "inside")
    # The cap and the exclusions hold before rows are ranked, so a large group of near copies takes no candidate's place.
    near = similarity.top_matches(queries, base, BUDGET, below=FALSE_NEGATIVE, without=taken)
    more = negatives.mined(have.select("query_id", F.col("neg_id").alias("id")), near, BUDGET, FALSE_NEGATIVE)
    listed_first = have.select("query_id", F.col("neg_id").alias("id"), "similarity", "rank", F.lit(False).alias("mined"))
    held = F.coalesce("k", F.lit(0))
    mined = more.join(counts, "query_id", "left").select("query_id", "id", "similarity", (F.col("rank") + held).cast("int").alias("rank"), F.lit(True).alias("mined"))
    return stripped, listed_first.unionByName(mined), similarity.count_at_least(queries, base, FALSE_NEGATIVE, taken)


def mine_negatives(spark, folder):
    """Lists of eight for the training queries of the stated set: their own negatives in the training partition, hardest first,
    then the nearest training passages below the false-negative threshold that they lack, never their positive."""
    return mining_run(spark, folder)[1].withColumn("similarity", F.round("similarity", 6))


def mining_stats(spark, folder):
    """The counters of that run; queries without a list count too."""
    return negatives.mining_counters(*mining_run(spark, folder), BUDGET)


def split_deviation(spark, folder):
    """(max_deviation, tolerance, within): the largest deviation from the targets against one percent or the largest component."""
    labels = written(components(spark, folder), "components")
    split = labels.join(graph.greedy_packing(labels, splits.SHARES), "component")
    return splits.deviation(split, graph.component_stats(labels).select("largest_share"))


def component_gate(spark, folder):
    return graph.component_gate(components(spark, folder))


def partition_totals(spark, folder):
    """(n_passages, n_placed, n_twice): whether every passage has just one partition."""
    return splits.totality(table(spark, folder, "corpus"), partition(spark, folder))


def survivor_gate(spark, folder):
    """(survivors, floor, breached): queries left after both filters against the floor of the settings."""
    return splits.survivors(with_content(kept(spark, folder).select("query_id", "pos")), PARTITIONS.splits.least_survivors)


def positives_outside(spark, folder):
    """(split, n_outside): assigned queries whose positive is not in the index of their split."""
    return splits.positives_outside(assigned(spark, folder).select("query_id", "pos_id", "split"), partition(spark, folder))


def reuse_top5(spark, folder):
    """Report of the five negatives that are listed most often."""
    return negatives.reuse(integrity.edges(table(spark, folder, "merged"), "query_id")).orderBy(F.desc("n_edges"), "neg_id").limit(5).select("neg_id", "n_edges")


def reuse_top8_text(spark, folder):
    """Report of the eight negatives that most queries list, with the first 80 characters of their text."""
    top = negatives.reuse(integrity.edges(table(spark, folder, "merged"), "query_id")).orderBy(F.desc("n_queries"), "neg_id").limit(8).select("neg_id", "n_queries")
    return table(spark, folder, "corpus").join(F.broadcast(top), F.col("id") == F.col("neg_id")).select("neg_id", "n_queries", F.substring("text", 1, 80).alias("text"))


def training_stats(spark, folder):
    return negatives.training_stats(kept(spark, folder), cleaned(spark, folder), 4)


def split_records(spark, folder):
    """The exported records of assigned queries: texts in place of ids, lists as JSON text."""
    rows = assigned(spark, folder).select("query_id", t.trimmed(F.col("query")).alias("query"), "split", "pos_id", "neg_id")
    corpus = table(spark, folder, "corpus")
    listed = integrity.clean_edges(rows, corpus)
    lists = negatives.capped(listed, BUDGET)
    out = records.with_lists(rows.drop("neg_id"), lists, corpus, "place")
    uncapped = listed.groupBy("query_id").agg(integrity.in_order("neg_id", "place").alias("neg_ids_uncapped"))
    return out.select("query_id", "query", "split", "pos_id", "pos", F.to_json("neg_ids").alias("neg_ids"), F.to_json("negs").alias("negs")).join(uncapped, "query_id", "left").withColumn("neg_ids_uncapped", F.coalesce("neg_ids_uncapped", F.lit("[]")))


def corpus_records(spark, folder):
    """The exported passages: with the split in which they are a positive, or shared or unused, and their tokens."""
    return records.passages(table(spark, folder, "corpus"), passage_labels(spark, folder))


def hardest(spark, folder) -> DataFrame:
    """Up to four scored negatives of each query, the most similar kept."""
    p = scored_pairs(spark, folder).filter("similarity IS NOT NULL").select("query_id", F.col("neg_id").alias("id"), F.col("similarity").alias("score"))
    return metrics.ranked(p, 4)


def sanitize_negatives(spark, folder):
    part = written(partition(spark, folder), "partition")
    rows = splits.inherited(cleaned(spark, folder), part)
    return negatives.sanitized(rows, part).select("query_id", "pos_id", "place", "neg_id")


def hardest_negatives(spark, folder):
    return hardest(spark, folder).select("query_id", F.col("id").alias("neg_id"), F.col("score").alias("similarity"), "rank")


def partition_corpus(spark, folder):
    return partition(spark, folder)


def inherited(spark, folder) -> DataFrame:
    """Kept queries with the split of their positive, written once: the check reads it and so does the query."""
    rows = splits.inherited(kept(spark, folder).select("query_id", "query", "pos_id", "neg_id"), partition(spark, folder))
    return splits.checked(written(rows, "inherited"))


def assign_splits(spark, folder):
    return inherited(spark, folder).select("query_id", "pos_id", "split")


def split_summary(spark, folder):
    return splits.split_summary(inherited(spark, folder))


def components(spark, folder):
    return graph.query_components(table(spark, folder, "merged"))


def component_stats(spark, folder):
    return graph.component_stats(components(spark, folder))


def greedy_splits(spark, folder):
    labels = components(spark, folder)
    return labels.join(graph.greedy_packing(labels, splits.SHARES), "component").select("query_id", "component", "split")


def labels_of(corpus: DataFrame, positives: DataFrame, rows: DataFrame) -> DataFrame:
    """Labels by the split of ``positives`` (pos_id, split) and the lists of ``rows`` (pos_id, neg_id).

    Repeats in a list and ids that the corpus lacks need no cleaning: listed ids count once and are looked up from the corpus."""
    return splits.passage_labels(corpus, positives, integrity.edges(rows, "pos_id").filter("neg_id <> pos_id"))


def passage_labels(spark, folder):
    # The kept rows are made once: the table with their splits has their lists too.
    rows = inherited(spark, folder)
    return labels_of(table(spark, folder, "corpus"), rows.select("pos_id", "split"), rows)


def leakage_audit(spark, folder):
    # Each of the fourteen checks reads these: made once.
    rows = written(assigned(spark, folder).select("query_id", "query", "pos_id", "neg_id", "split"), "assigned")
    residual = residual_near_dups(spark, folder).filter("check = 'residual'").select(F.lit("near_duplicate_queries_across_splits").alias("check"), "violations")
    return splits.leakage_audit(rows, written(partition(spark, folder), "partition"), residual)


def leakage_asserts(spark, folder):
    return splits.straddling(assigned(spark, folder))


def residual_near_dups(spark, folder):
    """Near pairs across splits whose ends both survive: neither end is in the lowest split that the pair touches.

    Counts cover the stated query set (``asked``) and the best match of each of its rows, as in the SQL, not the table."""
    v = vectors(spark, folder).select("vec_id", "split")
    pairs = cross_split_neighbors(spark, folder).filter("similarity >= 0.2")
    rank = "CASE split WHEN 'test' THEN 2 WHEN 'val' THEN 1 ELSE 0 END"
    a, b = v.selectExpr("vec_id AS query_id", f"{rank} AS ra"), v.selectExpr("vec_id AS id", f"{rank} AS rb")
    ends = pairs.join(a, "query_id").join(b, "id")
    dropped = ends.select(F.when(F.col("ra") < F.col("rb"), F.col("query_id")).otherwise(F.col("id")).alias("x")).distinct()
    alive = pairs.join(dropped.withColumnRenamed("x", "query_id"), "query_id", "left_anti").join(dropped.withColumnRenamed("x", "id"), "id", "left_anti")
    return splits.count_of("near_pairs", pairs).unionByName(splits.count_of("dropped", dropped)).unionByName(splits.count_of("residual", alive))


def warning_gates(spark, folder):
    """(gate, value, threshold, breached) of the five rates that a run should not leave.

    The precision is that of the notebook rule against the sample's label file; a missing value breaches nothing."""
    k = written(kept(spark, folder).select("query_id", "query", "pos", "pos_id", "loaded_at", "neg_id"), "kept")
    rule = t.has(F.col("query"), t.REFERRING) & t.has(F.col("query"), t.UNDERSPECIFIED) & ~t.has(F.col("query"), t.SEED_ENTITY)
    flag = k.agg(F.avg(rule.cast("double")).alias("value")).select(F.lit("anaphoric_rate").alias("gate"), "value", F.lit(0.15).alias("threshold"))
    fn = fn_stats(spark, folder).select(F.lit("false_negative_rate").alias("gate"), F.col("rate").alias("value"), F.lit(0.4).alias("threshold"))
    style = assigned(spark, folder).groupBy("split").agg(F.avg(t.is_question(F.col("query")).cast("double")).alias("x")).agg((F.max("x") - F.min("x")).alias("value")).select(F.lit("style_spread").alias("gate"), "value", F.lit(0.05).alias("threshold"))
    precision = hand_label_scores(spark, folder).filter("variant = 'undefined'").select(F.lit("filter_precision").alias("gate"), F.col("precision").alias("value"), F.lit(0.8).alias("threshold"))
    overlap = t.jaccard_overlap(F.coalesce("query", F.lit("")), F.coalesce("pos", F.lit("")))
    before, after = (rows.agg(F.avg(overlap).alias(n)) for rows, n in ((table(spark, folder, "merged"), "a"), (k, "b")))
    drift = before.crossJoin(F.broadcast(after)).select(F.lit("overlap_drift").alias("gate"), F.abs(F.col("a") - F.col("b")).alias("value"), F.lit(0.02).alias("threshold"))
    gates = flag.unionByName(fn).unionByName(style).unionByName(precision).unionByName(drift)
    worse = F.when(F.col("gate") == "filter_precision", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return gates.select("gate", F.round("value", 9).alias("value"), "threshold", F.coalesce(worse, F.lit(False)).alias("breached"))


def stages(spark, folder) -> DataFrame:
    """The ledger of the cleaning steps, with both units at every stage."""
    merged = table(spark, folder, "merged")
    k, c = written(kept(spark, folder).select("query_id", "query", "pos"), "kept"), written(cleaned(spark, folder), "edges")
    content = with_content(k).select("query_id")
    rule = t.has(F.col("query"), t.REFERRING) & t.has(F.col("query"), t.UNDERSPECIFIED) & ~t.has(F.col("query"), t.SEED_ENTITY)
    named = with_content(k).filter(~rule).select("query_id")
    pruned = c.join(scored_pairs(spark, folder).filter(F.col("similarity") >= FALSE_NEGATIVE), ["query_id", "neg_id"], "left_anti").join(named, "query_id", "left_semi")
    pruned = written(pruned, "pruned")
    capped = negatives.capped(pruned, BUDGET)
    steps = [
        ("00_raw", merged, integrity.edges(merged)), ("01_structural", k, c), ("02_degenerate", content, c.join(content, "query_id", "left_semi")),
        ("03_anaphoric", named, c.join(named, "query_id", "left_semi")), ("04_false_negative", pruned.select("query_id").distinct(), pruned), ("05_cap", capped.select("query_id").distinct(), capped),
    ]
    return book.ledger(spark, [(stage, unit, df) for stage, q, e in steps for unit, df in (("queries", q), ("pairs", e))])


def ledger(spark, folder):
    return stages(spark, folder)


def ledger_tracks(spark, folder):
    return book.tracks(stages(spark, folder).filter("NOT (stage = '02_degenerate' AND unit = 'pairs')"))


def before_after(spark, folder):
    """(measure, before, after) of the raw and the kept rows."""
    merged, k = table(spark, folder, "merged"), kept(spark, folder)

    def figures(rows: DataFrame) -> DataFrame:
        overlap = t.jaccard_overlap(F.coalesce("query", F.lit("")), F.coalesce("pos", F.lit("")))
        one = rows.agg(F.count("*").cast("double").alias("rows"), F.countDistinct("query_id").cast("double").alias("queries"), F.avg(F.greatest(F.size("neg_id"), F.lit(0))).alias("negatives"), F.avg(overlap).alias("overlap"))
        return one.selectExpr("stack(4, 'rows', rows, 'queries', queries, 'mean_negatives', negatives, 'mean_overlap', overlap) AS (measure, value)")

    return figures(merged).withColumnRenamed("value", "before").join(figures(k).withColumnRenamed("value", "after"), "measure").select("measure", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))


def run_and_grades(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates of each kept query (its scored negatives and its positive by overlap) and their grades."""
    positives = kept(spark, folder).select("query_id", F.col("pos_id").alias("id"), (t.containment_overlap(F.col("query"), F.col("pos")) + 0.4).alias("score"))
    pairs = scored_pairs(spark, folder).filter("similarity IS NOT NULL").select("query_id", F.col("neg_id").alias("id"), F.col("similarity").alias("score"))
    pairs = pairs.join(positives.select("query_id"), "query_id", "left_semi").join(positives.select("query_id", "id"), ["query_id", "id"], "left_anti")
    grades = positives.select("query_id", "id", F.lit(2).alias("grade")).unionByName(pairs.filter("score >= 0.6").select("query_id", "id", F.lit(1).alias("grade")))
    return positives.unionByName(pairs).withColumn("score", F.round("score", 6)), grades


def ndcg_recall_mrr(spark, folder):
    run, grades = run_and_grades(spark, folder)
    return metrics.averages(metrics.per_query(run, grades.filter("grade = 2").withColumn("grade", F.lit(1))))


def graded_ndcg(spark, folder):
    run, grades = run_and_grades(spark, folder)
    return metrics.per_query(run, grades).select("query_id", F.round("ndcg", 9).alias("ndcg"), F.round("recall", 9).alias("recall"))


def bm25_topk(spark, folder):
    """Ten best passages for the stated query set: kept queries whose hashed id is divisible by 50."""
    queries = stated(kept(spark, folder).select("query_id", "query"))
    return metrics.bm25(queries, table(spark, folder, "corpus"), 10)


def paired_bootstrap(spark, folder):
    run, grades = run_and_grades(spark, folder)
    by_id = run.withColumn("score", F.xxhash64("id").cast("double"))
    return metrics.paired_bootstrap(metrics.per_query(run, grades), metrics.per_query(by_id, grades), "ndcg")


QUERIES = {
    f.__name__: f
    for f in (
        negative_reuse_edges, negative_reuse_queries, reuse_topn, high_reuse_candidates, pair_similarity, similarity_percentiles, fn_threshold, drop_false_negatives, fn_stats,
        top_bottom_pairs, cap_negatives, training_triplets, training_columns, cross_split_neighbors, near_dup_stats, topk_passages, mine_negatives, sanitize_negatives, mining_stats,
        hardest_negatives, partition_corpus, assign_splits, split_summary, components, component_stats, greedy_splits, passage_labels, leakage_audit, leakage_asserts, residual_near_dups,
        warning_gates, ledger, ledger_tracks, before_after, ndcg_recall_mrr, graded_ndcg, bm25_topk, paired_bootstrap, near_dup_top30, split_deviation, component_gate,
        partition_totals, survivor_gate, positives_outside, reuse_top5, reuse_top8_text, training_stats, split_records, corpus_records,
    )
}

RAW = "raw AS (SELECT query_id, neg_id FROM (SELECT query_id, unnest(neg_id) AS neg_id FROM merged) WHERE neg_id IS NOT NULL)"
PAIRS = "pairs AS (SELECT query_id, neg_id, max(neg_similarity) AS similarity FROM negative_scores WHERE neg_id IS NOT NULL GROUP BY 1, 2)"
OFTEN = "often AS (SELECT neg_id FROM clean GROUP BY 1 HAVING count(*) >= 20), cand AS (SELECT DISTINCT query_id, neg_id FROM clean WHERE neg_id IN (SELECT neg_id FROM often))"
COUNT = "vn AS (SELECT count(*) AS n FROM embeddings)"


def at(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % (SELECT n FROM vn)"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def scored(rows: str, a: str, b: str) -> str:
    return f"(SELECT r.*, {dot('x.embedding', 'y.embedding')} AS sim FROM {rows} r JOIN embeddings x ON x.vec_id = {at('r.' + a)} JOIN embeddings y ON y.vec_id = {at('r.' + b)})"


def spread(values: str, column: str, shares: list[float]) -> str:
    parts = [f"SELECT '{n}' AS statistic, round({e}, 6) AS value FROM {values}" for n, e in (("n", f"count({column})::DOUBLE"), ("mean", f"avg({column})"), ("std", f"stddev_pop({column})"), ("min", f"min({column})"), ("max", f"max({column})"))]
    parts += [f"SELECT 'p{share * 100:.1f}', round(quantile_cont({column}::DOUBLE, {share}::DOUBLE), 6) FROM {values}" for share in shares]
    return " UNION ALL ".join(parts)


CUTOFF = f"""{s.CLEAN}, {OFTEN}, {COUNT}, pp AS (SELECT query_id, pos_id FROM kept WHERE query_id IN (SELECT query_id FROM cand)),
    cut AS (SELECT round(quantile_cont(sim, 0.05::DOUBLE), 6) AS threshold FROM {scored("pp", "query_id", "pos_id")})"""
VECTORS = """vecs AS (SELECT vec_id, embedding, CASE WHEN h < 8 THEN 'train' WHEN h < 9 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, CAST('0x' || substr(md5('42:' || vec_id), 1, 8) AS BIGINT) % 10 AS h FROM embeddings)), ask AS (SELECT * FROM vecs WHERE vec_id % 50 = 0)"""


def nearest(k: int, more: str = "") -> str:
    return f"""{VECTORS}, cross_rows AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({dot("a.embedding", "b.embedding")}, 9) AS similarity FROM ask a JOIN vecs b ON a.vec_id <> b.vec_id {more}),
    near AS (SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS nth FROM cross_rows) WHERE nth <= {k})"""


CROSS = f"""{nearest(1, "AND a.split <> b.split")}, uno AS (SELECT query_id, id, round(similarity, 6) AS similarity FROM
    (SELECT *, row_number() OVER (PARTITION BY least(query_id, id), greatest(query_id, id) ORDER BY similarity DESC, query_id) AS nth FROM near) WHERE nth = 1)"""
ASSIGNED = f"{s.CLEAN}, assigned AS (SELECT k.*, r.split FROM kept k JOIN (SELECT DISTINCT query_id, split FROM split_rows WHERE split IS NOT NULL) r USING (query_id))"
INHERITED = f"{s.CLEAN}, {s.PARTITION}, inh AS (SELECT k.*, p.split FROM kept k LEFT JOIN part p ON p.id = k.pos_id)"
N_RULE = f"({s.has('query', t.REFERRING)} AND {s.has('query', t.UNDERSPECIFIED)} AND NOT {s.has('query', t.SEED_ENTITY)})"
IS_QUESTION = f"({s.has('query', t.QUESTION_START)} OR ends_with({s.trimmed('query')}, '?'))"
COMPONENTS = """RECURSIVE qp AS (SELECT DISTINCT query_id, pos_id FROM merged WHERE query_id IS NOT NULL),
    hub AS (SELECT pos_id, min(query_id) AS h FROM qp WHERE pos_id IS NOT NULL GROUP BY 1),
    star AS (SELECT DISTINCT query_id AS a, h AS b FROM qp JOIN hub USING (pos_id) WHERE query_id <> h), both_ways AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
    reach(a, b) AS (SELECT query_id, query_id FROM qp UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
    comp AS (SELECT a AS query_id, min(b) AS component FROM reach GROUP BY 1)"""
MINING = f"""{INHERITED}, {COUNT}, tp AS (SELECT id FROM part WHERE split = 'train'), ask AS (SELECT * FROM inh WHERE split = 'train' AND CAST('0x' || substr(md5(query_id), 1, 8) AS BIGINT) % 50 = 0),
    every AS (SELECT a.query_id, a.pos_id, p.id, round({dot("x.embedding", "y.embedding")}, 9) AS sim FROM ask a CROSS JOIN tp p JOIN embeddings x ON x.vec_id = {at("a.query_id")} JOIN embeddings y ON y.vec_id = {at("p.id")})"""
MINED = f"""{MINING}, li AS (SELECT query_id, neg_id, min(place) AS place FROM (SELECT query_id, pos_id, unnest(neg_id) AS neg_id, generate_subscripts(neg_id, 1) - 1 AS place FROM ask) WHERE neg_id <> pos_id AND neg_id IN (SELECT id FROM tp) GROUP BY 1, 2),
    own AS (SELECT query_id, neg_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, place) AS rank FROM {scored("li", "query_id", "neg_id")}),
    hv AS (SELECT query_id, count(*) AS k FROM own WHERE rank <= 8 GROUP BY 1),
    free AS (SELECT v.query_id, v.id, v.sim, row_number() OVER (PARTITION BY v.query_id ORDER BY v.sim DESC, v.id) AS rank FROM every v WHERE v.sim < 0.71 AND v.id <> v.pos_id
        AND NOT EXISTS (SELECT 1 FROM own h WHERE h.query_id = v.query_id AND h.neg_id = v.id AND h.rank <= 8)),
    chosen AS (SELECT query_id, neg_id AS id, sim AS similarity, CAST(rank AS INT) AS rank, false AS mined FROM own WHERE rank <= 8
        UNION ALL SELECT f.query_id, f.id, f.sim, CAST(f.rank + coalesce(k, 0) AS INT), true FROM free f LEFT JOIN hv USING (query_id) WHERE f.rank <= 8 - coalesce(k, 0))"""
GREEDY = f"""{COMPONENTS}, whole AS (SELECT CAST(count(*) AS DOUBLE) AS a FROM comp), targets(split, share) AS (VALUES ('train', 0.8::DOUBLE), ('val', 0.1::DOUBLE), ('test', 0.1::DOUBLE)),
    line AS (SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS i FROM (SELECT component, count(*) AS n FROM comp GROUP BY 1)),
    walk(i, component, n, split, x, y, z) AS (SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
        SELECT l.i, l.component, l.n, CASE p WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END, x + CASE p WHEN 0 THEN l.n ELSE 0 END, y + CASE p WHEN 1 THEN l.n ELSE 0 END, z + CASE p WHEN 2 THEN l.n ELSE 0 END
        FROM (SELECT *, CASE WHEN 0.8::DOUBLE * a - x >= 0.1::DOUBLE * a - y AND 0.8::DOUBLE * a - x >= 0.1::DOUBLE * a - z THEN 0 WHEN 0.1::DOUBLE * a - y >= 0.1::DOUBLE * a - z THEN 1 ELSE 2 END AS p FROM walk, whole) w JOIN line l ON l.i = w.i + 1)"""
LEDGER = f"""{s.CLEAN}, {PAIRS}, deg AS (SELECT query_id, query FROM kept WHERE {s.n_words("pos")} >= 8), ana AS (SELECT query_id FROM deg WHERE NOT {N_RULE}),
    fn AS (SELECT c.* FROM clean c JOIN ana USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.query_id = c.query_id AND p.neg_id = c.neg_id AND p.similarity >= 0.71)),
    cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('590:' || query_id || ':' || neg_id)) AS nth FROM fn) WHERE nth <= 8),
    led(seq, stage, unit, remaining) AS (
        SELECT 0, '00_raw', 'queries', (SELECT count(*) FROM merged) UNION ALL SELECT 1, '00_raw', 'pairs', (SELECT count(*) FROM (SELECT unnest(neg_id) AS x FROM merged) WHERE x IS NOT NULL)
        UNION ALL SELECT 2, '01_structural', 'queries', (SELECT count(*) FROM kept) UNION ALL SELECT 3, '01_structural', 'pairs', (SELECT count(*) FROM clean)
        UNION ALL SELECT 4, '02_degenerate', 'queries', (SELECT count(*) FROM deg) UNION ALL SELECT 5, '02_degenerate', 'pairs', (SELECT count(*) FROM clean JOIN deg USING (query_id))
        UNION ALL SELECT 6, '03_anaphoric', 'queries', (SELECT count(*) FROM ana) UNION ALL SELECT 7, '03_anaphoric', 'pairs', (SELECT count(*) FROM clean JOIN ana USING (query_id))
        UNION ALL SELECT 8, '04_false_negative', 'queries', (SELECT count(DISTINCT query_id) FROM fn) UNION ALL SELECT 9, '04_false_negative', 'pairs', (SELECT count(*) FROM fn)
        UNION ALL SELECT 10, '05_cap', 'queries', (SELECT count(DISTINCT query_id) FROM cap) UNION ALL SELECT 11, '05_cap', 'pairs', (SELECT count(*) FROM cap))"""
RUN = f"""{s.CLEAN}, {PAIRS}, posi AS (SELECT query_id, pos_id AS id, {s.containment("query", "pos")} + 0.4 AS score FROM kept),
    negs AS (SELECT p.query_id, p.neg_id AS id, p.similarity AS score FROM pairs p WHERE p.similarity IS NOT NULL AND p.query_id IN (SELECT query_id FROM posi)
        AND NOT EXISTS (SELECT 1 FROM posi x WHERE x.query_id = p.query_id AND x.id = p.neg_id)),
    run AS (SELECT query_id, id, round(score, 6) AS score FROM (SELECT * FROM posi UNION ALL SELECT * FROM negs)),
    ranks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM run) WHERE rank <= 10)"""


def per_query(grades: str) -> str:
    return f"""{RUN}, qrels AS ({grades}), found AS (SELECT r.query_id, sum(q.grade / log2(r.rank + 1)) AS dcg, count(*) AS hits, min(r.rank) AS first FROM ranks r JOIN qrels q USING (query_id, id) GROUP BY 1),
    ideal AS (SELECT query_id, sum(CASE WHEN k <= 10 THEN grade / log2(k + 1) ELSE 0 END) AS best, count(*) AS relevant
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS k FROM qrels) GROUP BY 1),
    scores AS (SELECT i.query_id, coalesce(dcg / best, 0) AS ndcg, coalesce(hits / relevant, 0) AS recall, coalesce(hits / 10, 0) AS precision, coalesce(1 / first, 0) AS mrr,
        CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM ideal i LEFT JOIN found USING (query_id))"""


RESIDUAL = f"""{CROSS}, rk AS (SELECT vec_id, CASE split WHEN 'test' THEN 2 WHEN 'val' THEN 1 ELSE 0 END AS r FROM vecs), p AS (SELECT * FROM uno WHERE similarity >= 0.2),
    d AS (SELECT DISTINCT CASE WHEN a.r < b.r THEN p.query_id ELSE p.id END AS x FROM p JOIN rk a ON a.vec_id = p.query_id JOIN rk b ON b.vec_id = p.id)"""


def audit_sql() -> str:
    a = lambda name, q: f"SELECT '{name}' AS \"check\", (SELECT count(*) FROM {q}) AS violations"
    seen = "(SELECT neg_id AS id FROM tneg UNION SELECT pos_id FROM assigned WHERE split = 'train' AND pos_id IS NOT NULL)"
    parts = [a(f"partition_overlap_{x}_{y}", f"(SELECT id FROM part WHERE split = '{x}' INTERSECT SELECT id FROM part WHERE split = '{y}')") for x, y in (("train", "val"), ("train", "test"), ("val", "test"))]
    parts += [a(f"{x}_pos_outside_own_partition", f"assigned q LEFT JOIN part p ON p.id = q.pos_id WHERE q.split = '{x}' AND p.split IS DISTINCT FROM '{x}'") for x in splits.SHARES]
    parts += [a(f"{x}_passages_seen_in_train", f"part WHERE split = '{x}' AND id IN {seen}") for x in ("test", "val")]
    parts.append(a("test_pos_ids_in_train_any_role", f"(SELECT DISTINCT pos_id FROM assigned WHERE split = 'test' AND pos_id IN {seen})"))
    parts += [a(f"{x}_pos_ids_as_train_negatives", f"(SELECT DISTINCT pos_id FROM assigned WHERE split = '{x}' AND pos_id IN (SELECT neg_id FROM tneg))") for x in ("val", "test")]
    parts.append(a("train_negatives_equal_to_own_positive", "assigned WHERE split = 'train' AND list_contains(neg_id, pos_id)"))
    parts.append(a("exact_duplicate_queries_across_splits", f"(SELECT {s.query_form('query')} AS f FROM assigned GROUP BY 1 HAVING count(DISTINCT split) > 1)"))
    parts.append(a("duplicate_query_ids_across_splits", "(SELECT query_id FROM assigned GROUP BY 1 HAVING count(*) > 1)"))
    parts.append("SELECT 'near_duplicate_queries_across_splits', (SELECT count(*) FROM p WHERE query_id NOT IN (SELECT x FROM d) AND id NOT IN (SELECT x FROM d))")
    return f"WITH {ASSIGNED}, {s.PARTITION}, {RESIDUAL}, tneg AS (SELECT DISTINCT n AS neg_id FROM (SELECT unnest(neg_id) AS n FROM assigned WHERE split = 'train') WHERE n IS NOT NULL) " + " UNION ALL ".join(parts)


OVERLAP = s.jaccard("coalesce(query, '')", "coalesce(pos, '')")
LABELS_ONLY = SAMPLE_LABELS[len(s.KEPT) + 2 :].strip()
FIGURES = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, round((SELECT {e} FROM merged), 9) AS before, round((SELECT {e} FROM kept), 9) AS after"
    for m, e in (("rows", "count(*)::DOUBLE"), ("queries", "count(DISTINCT query_id)::DOUBLE"), ("mean_negatives", "avg(coalesce(len(neg_id), 0))"), ("mean_overlap", f"avg({s.jaccard('coalesce(query, ' + chr(39) * 2 + ')', 'coalesce(pos, ' + chr(39) * 2 + ')')})"))
)

SQL = {
    "negative_reuse_edges": f"WITH {RAW} SELECT neg_id, count(*) AS n_edges FROM raw GROUP BY 1",
    "negative_reuse_queries": f"WITH {RAW} SELECT neg_id, count(DISTINCT query_id) AS n_queries FROM raw GROUP BY 1",
    "reuse_topn": f"""WITH {s.CLEAN}, top AS (SELECT neg_id, count(DISTINCT query_id) AS n_queries FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
        SELECT neg_id, n_queries, text FROM top JOIN corpus ON id = neg_id""",
    "high_reuse_candidates": f"WITH {s.CLEAN}, {OFTEN} SELECT query_id, neg_id FROM cand",
    "pair_similarity": f"WITH {s.CLEAN}, {COUNT} SELECT query_id, neg_id, round(sim, 6) AS similarity FROM {scored('clean', 'query_id', 'neg_id')}",
    "similarity_percentiles": f"WITH {PAIRS} {spread('pairs', 'similarity', SHARES)}",
    "fn_threshold": f"WITH {CUTOFF} SELECT threshold FROM cut",
    "drop_false_negatives": f"""WITH {CUTOFF}, bad AS (SELECT query_id, neg_id FROM {scored("cand", "query_id", "neg_id")}, cut WHERE round(sim, 6) >= threshold)
        SELECT query_id, place, neg_id FROM clean c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.query_id = c.query_id AND b.neg_id = c.neg_id)""",
    "fn_stats": f"""WITH {PAIRS}, q AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE similarity >= 0.71) AS f FROM pairs GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(f) AS BIGINT) AS n_flagged, round(sum(f) / sum(n), 9) AS rate, count(*) AS n_queries, count(*) FILTER (WHERE f > 0) AS n_affected,
        count(*) FILTER (WHERE f = n) AS n_left_empty, round(avg(n - f), 9) AS mean_after FROM q""",
    "top_bottom_pairs": f"""WITH {PAIRS}, p AS (SELECT * FROM pairs WHERE similarity IS NOT NULL) SELECT * FROM (SELECT *, 'top' AS "end" FROM p ORDER BY similarity DESC, query_id, neg_id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT *, 'bottom' FROM p ORDER BY similarity, query_id, neg_id LIMIT 3)""",
    "cap_negatives": f"""WITH {s.CLEAN}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('590:' || query_id || ':' || neg_id)) AS nth FROM clean)
        SELECT query_id, count(*) AS n, to_json(list(neg_id ORDER BY place))::VARCHAR AS neg_ids FROM c WHERE nth <= 8 GROUP BY 1""",
    "training_triplets": f"WITH {s.CLEAN} SELECT * FROM (SELECT query_id, pos_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, neg_id FROM clean) WHERE rank <= 4",
    "training_columns": f"""WITH {s.CLEAN}, r AS (SELECT query_id, pos_id, list(neg_id ORDER BY place) AS l FROM clean GROUP BY 1, 2)
        SELECT query_id, pos_id, l[1] AS negative_1, l[2] AS negative_2, l[3] AS negative_3, l[4] AS negative_4 FROM r WHERE len(l) >= 4""",
    "cross_split_neighbors": f"WITH {CROSS} SELECT * FROM uno",
    "near_dup_stats": f"WITH {CROSS} {spread('uno', 'similarity', NEAR_SHARES)}",
    "near_dup_top30": f"WITH {CROSS} SELECT * FROM uno ORDER BY similarity DESC, query_id, id LIMIT 30",
    "topk_passages": f"WITH {MINING}, near AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS nth FROM every WHERE id <> pos_id) SELECT query_id, id, round(sim, 6) AS similarity FROM near WHERE nth <= 10",
    "mine_negatives": f"WITH {MINED} SELECT query_id, id, round(similarity, 6) AS similarity, rank, mined FROM chosen",
    "mining_stats": f"""WITH {MINED}, b AS (SELECT query_id, pos_id, unnest(neg_id) AS n FROM ask), c AS (SELECT query_id, count(n) AS before, count(*) FILTER (WHERE n = pos_id) AS self,
            count(*) FILTER (WHERE n IS NOT NULL AND n IS DISTINCT FROM pos_id AND n NOT IN (SELECT id FROM tp)) AS o FROM b WHERE n IS NOT NULL GROUP BY 1),
        e AS (SELECT query_id, count(*) AS after, count(*) FILTER (WHERE mined) AS m FROM chosen GROUP BY 1), k AS (SELECT query_id, count(*) AS kept FROM own GROUP BY 1),
        r AS (SELECT query_id, count(*) AS n FROM every v WHERE sim >= 0.71 AND id <> pos_id AND NOT EXISTS (SELECT 1 FROM own h WHERE h.query_id = v.query_id AND h.neg_id = v.id AND h.rank <= 8) GROUP BY 1),
        q AS (SELECT a.query_id, coalesce(before, 0) AS before, coalesce(self, 0) AS self, coalesce(o, 0) AS o, coalesce(kept, 0) AS kept, coalesce(after, 0) AS after, coalesce(m, 0) AS m, coalesce(r.n, 0) AS rej
            FROM ask a LEFT JOIN c USING (query_id) LEFT JOIN k USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN r USING (query_id))
        SELECT count(*) AS n_queries, CAST(coalesce(sum(before), 0) AS BIGINT) AS n_before, CAST(coalesce(sum(o), 0) AS BIGINT) AS n_out, CAST(coalesce(sum(self), 0) AS BIGINT) AS n_self, CAST(coalesce(sum(m), 0) AS BIGINT) AS n_mined,
            count(*) FILTER (WHERE kept < 8) AS n_needing, count(*) FILTER (WHERE after < 8) AS n_short, CAST(coalesce(sum(rej) FILTER (WHERE kept < 8), 0) AS BIGINT) AS n_rejected, round(avg(after), 3) AS mean_after FROM q""",
    "split_deviation": f"""WITH {GREEDY}, z AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), g AS (SELECT t.split, t.share AS target, coalesce(sum(n), 0) / (SELECT sum(n) FROM z) AS share FROM targets t LEFT JOIN (SELECT n, split FROM walk WHERE i > 0) w USING (split) GROUP BY 1, 2)
        SELECT round(max(abs(share - target)), 9) AS max_deviation, greatest(0.01::DOUBLE, (SELECT round(max(n) / sum(n), 9) FROM z)) AS tolerance, max(abs(share - target)) <= greatest(0.01::DOUBLE, (SELECT round(max(n) / sum(n), 9) FROM z)) AS within FROM g""",
    "component_gate": f"WITH {COMPONENTS}, z AS (SELECT count(*) AS n FROM comp GROUP BY component), x AS (SELECT round(max(n) / sum(n), 9) AS largest_share FROM z) SELECT largest_share, largest_share > 0.1 AS unreachable, largest_share > 0.5 AS fatal FROM x",
    "partition_totals": f"WITH {s.PARTITION} SELECT (SELECT count(DISTINCT id) FROM corpus) AS n_passages, (SELECT count(*) FROM part) AS n_placed, (SELECT count(*) FROM (SELECT id FROM part GROUP BY id HAVING count(*) > 1)) AS n_twice",
    "survivor_gate": f"WITH {s.KEPT} SELECT count(*) AS survivors, 8000 AS floor, count(*) < 8000 AS breached FROM kept WHERE {s.n_words('pos')} >= 8",
    "positives_outside": f"WITH {ASSIGNED}, {s.PARTITION} SELECT q.split, count(*) FILTER (WHERE p.split IS DISTINCT FROM q.split) AS n_outside FROM assigned q LEFT JOIN part p ON p.id = q.pos_id GROUP BY 1",
    "reuse_top5": f"WITH {RAW} SELECT neg_id, count(*) AS n_edges FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "reuse_top8_text": f"WITH {RAW}, top AS (SELECT neg_id, count(DISTINCT query_id) AS n_queries FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) SELECT neg_id, n_queries, substr(text, 1, 80) AS text FROM top JOIN corpus ON id = neg_id",
    "training_stats": f"WITH {s.CLEAN}, c AS (SELECT query_id, count(*) AS k FROM clean GROUP BY 1) SELECT count(*) FILTER (WHERE coalesce(k, 0) >= 4) AS n_rows, count(*) FILTER (WHERE coalesce(k, 0) < 4) AS n_dropped FROM kept LEFT JOIN c USING (query_id)",
    "split_records": f"""WITH {ASSIGNED}, cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('590:' || query_id || ':' || neg_id)) AS nth FROM clean) WHERE nth <= 8),
        l AS (SELECT query_id, to_json(list(neg_id ORDER BY place))::VARCHAR AS neg_ids, to_json(list(c.text ORDER BY place))::VARCHAR AS negs FROM cap JOIN corpus c ON c.id = neg_id GROUP BY 1), u AS (SELECT query_id, to_json(list(neg_id ORDER BY place))::VARCHAR AS neg_ids_uncapped FROM clean GROUP BY 1)
        SELECT query_id, {s.trimmed("query")} AS query, a.split, a.pos_id, c.text AS pos, coalesce(neg_ids, '[]') AS neg_ids, coalesce(negs, '[]') AS negs, coalesce(neg_ids_uncapped, '[]') AS neg_ids_uncapped
        FROM assigned a JOIN corpus c ON c.id = a.pos_id LEFT JOIN l USING (query_id) LEFT JOIN u USING (query_id)""",
    "corpus_records": f"""WITH {INHERITED}, o AS (SELECT pos_id AS id, min(split) AS split FROM inh GROUP BY 1), u AS (SELECT DISTINCT neg_id AS id FROM clean)
        SELECT c.id, c.text, coalesce(o.split, CASE WHEN u.id IS NOT NULL THEN 'shared' END, 'unused') AS split, {s.n_tokens("c.text")} AS token_count FROM corpus c LEFT JOIN o ON o.id = c.id LEFT JOIN u ON u.id = c.id""",
    "greedy_splits": f"WITH {GREEDY} SELECT query_id, comp.component, split FROM comp JOIN (SELECT component, split FROM walk WHERE i > 0) USING (component)",
    "sanitize_negatives": f"""WITH {INHERITED} SELECT c.query_id, c.pos_id, c.place, c.neg_id FROM clean c JOIN part p ON p.id = c.pos_id JOIN part n ON n.id = c.neg_id
        WHERE p.split = 'train' AND n.split = 'train'""",
    "hardest_negatives": f"""WITH {PAIRS} SELECT * FROM (SELECT query_id, neg_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neg_id) AS rank FROM pairs WHERE similarity IS NOT NULL) WHERE rank <= 4""",
    "partition_corpus": f"WITH {s.PARTITION} SELECT id, split FROM part",
    "assign_splits": f"WITH {INHERITED} SELECT query_id, pos_id, split FROM inh",
    "split_summary": f"""WITH {INHERITED}, g AS (SELECT split, count(*) AS n_queries, count(DISTINCT pos_id) AS n_positives, CAST(sum(coalesce(len(neg_id), 0)) AS BIGINT) AS n_negatives FROM inh GROUP BY 1)
        SELECT t.split, t.target, coalesce(n_queries, 0) AS n_queries, coalesce(n_positives, 0) AS n_positives, coalesce(n_negatives, 0) AS n_negatives,
        round(coalesce(n_queries, 0) / (SELECT sum(n_queries) FROM g), 9) AS share FROM (VALUES ('train', 0.8::DOUBLE), ('val', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) t(split, target) LEFT JOIN g ON g.split = t.split""",
    "components": f"WITH {COMPONENTS} SELECT query_id, component FROM comp",
    "component_stats": f"""WITH {COMPONENTS}, z AS (SELECT count(*) AS n FROM comp GROUP BY component) SELECT count(*) AS n_components, round(avg(n), 9) AS mean_size, median(n::DOUBLE) AS median_size, max(n) AS max_size,
        count(*) FILTER (WHERE n = 1) AS n_singletons, round(max(n) / sum(n), 9) AS largest_share FROM z""",
    "passage_labels": f"""WITH {INHERITED}, o AS (SELECT pos_id AS id, min(split) AS split FROM inh GROUP BY 1), u AS (SELECT DISTINCT neg_id AS id FROM clean)
        SELECT c.id, coalesce(o.split, CASE WHEN u.id IS NOT NULL THEN 'shared' END, 'unused') AS split FROM corpus c LEFT JOIN o ON o.id = c.id LEFT JOIN u ON u.id = c.id""",
    "leakage_audit": audit_sql(),
    "leakage_asserts": f"""WITH {ASSIGNED} SELECT 'shared_positives' AS "check", (SELECT count(*) FROM (SELECT pos_id FROM assigned WHERE pos_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS violations
        UNION ALL SELECT 'shared_queries', (SELECT count(*) FROM (SELECT {s.query_form("query")} AS f FROM assigned GROUP BY 1 HAVING count(DISTINCT split) > 1))""",
    "residual_near_dups": f"""WITH {RESIDUAL}
        SELECT 'near_pairs' AS "check", (SELECT count(*) FROM p) AS violations UNION ALL SELECT 'dropped', (SELECT count(*) FROM d)
        UNION ALL SELECT 'residual', (SELECT count(*) FROM p WHERE query_id NOT IN (SELECT x FROM d) AND id NOT IN (SELECT x FROM d))""",
    "warning_gates": f"""WITH {ASSIGNED}, {PAIRS}, st AS (SELECT avg({IS_QUESTION}::INT) AS x FROM assigned GROUP BY split),
        {LABELS_ONLY}, o AS (SELECT (SELECT avg({OVERLAP}) FROM merged) - (SELECT avg({OVERLAP}) FROM kept) AS d),
        g(gate, value, threshold) AS (SELECT 'anaphoric_rate', (SELECT avg({N_RULE}::INT) FROM kept), 0.15::DOUBLE
            UNION ALL SELECT 'false_negative_rate', (SELECT round(count(*) FILTER (WHERE similarity >= 0.71) / count(*), 9) FROM pairs), 0.4 UNION ALL SELECT 'style_spread', (SELECT max(x) - min(x) FROM st), 0.05
            UNION ALL SELECT 'filter_precision', (SELECT round_even(tp / nullif(tp + fp, 0), 4) FROM c), 0.8 UNION ALL SELECT 'overlap_drift', (SELECT abs(d) FROM o), 0.02)
        SELECT gate, round(value, 9) AS value, threshold, coalesce(CASE WHEN gate = 'filter_precision' THEN value < threshold ELSE value > threshold END, false) AS breached FROM g""",
    "ledger": f"WITH {LEDGER} SELECT seq, stage, unit, coalesce(lag(remaining) OVER (PARTITION BY unit ORDER BY seq) - remaining, 0) AS removed, remaining FROM led",
    "ledger_tracks": f"""WITH {LEDGER}, part_led AS (SELECT * FROM led WHERE NOT (stage = '02_degenerate' AND unit = 'pairs')), st AS (SELECT stage, min(seq) AS seq FROM part_led GROUP BY 1),
        grid AS (SELECT st.seq, st.stage, u.unit, l.remaining AS own FROM st CROSS JOIN (SELECT DISTINCT unit FROM part_led) u LEFT JOIN part_led l ON l.stage = st.stage AND l.unit = u.unit),
        f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY unit ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS remaining,
            first_value(own) OVER (PARTITION BY unit ORDER BY seq) AS base FROM grid)
        SELECT seq, stage, unit, remaining, round(remaining / base, 9) AS retention FROM f""",
    "before_after": f"WITH {s.KEPT} {FIGURES}",
    "ndcg_recall_mrr": f"""WITH {per_query("SELECT query_id, id, 1 AS grade FROM posi")}
        SELECT count(*) AS n_queries, round(avg(ndcg), 9) AS ndcg, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(mrr), 9) AS mrr, round(avg(hit), 9) AS hit FROM scores""",
    "graded_ndcg": f"WITH {per_query('SELECT query_id, id, 2 AS grade FROM posi UNION ALL SELECT query_id, id, 1 FROM negs WHERE score >= 0.6')} SELECT query_id, round(ndcg, 9) AS ndcg, round(recall, 9) AS recall FROM scores",
    "bm25_topk": f"""WITH {s.KEPT}, tok AS (SELECT id, regexp_extract_all(lower(text), '{t.LETTER}+') AS w FROM corpus WHERE text IS NOT NULL), tf AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(w) AS w FROM tok) GROUP BY 1, 2),
        dl AS (SELECT id, len(w) AS dl FROM tok WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
        ask AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '{t.LETTER}+'))) AS w FROM kept WHERE CAST('0x' || substr(md5(query_id), 1, 8) AS BIGINT) % 50 = 0),
        sc AS (SELECT query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
            FROM ask JOIN tf USING (w) JOIN df USING (w) JOIN dl ON dl.id = tf.id, st GROUP BY 1, 2)
        SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10""",
}
