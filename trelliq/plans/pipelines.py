"""The two cleaning runs from end to end, as tables, reports and a manifest in a folder."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trelliq.config import COMPONENTS, PARTITIONS, DatasetIntegrityError, Settings, run_name
from trelliq.functions import text as t
from trelliq.operators import dedup, filters, graph, integrity, ledger, negatives, records, similarity, splits
from trelliq.paths import Places
from trelliq.plans.cleaning import parsed
from trelliq.operators.vocab import found_terms, vocabulary
from trelliq.session import written
from trelliq.sources import readers, writers
from trelliq.sources.tables import table


def with_lists(queries: DataFrame, listed: DataFrame, order: str, how: str = "inner", name: str = "neg_ids") -> DataFrame:
    """``queries`` with their negatives in order; with ``how`` 'left' those without any keep an empty list."""
    lists = listed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "neg_id"))), lambda x: x["neg_id"]).alias(name))
    return queries.join(lists, "query_id", how).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def survivor_check(rows: DataFrame, settings: Settings, strict: bool) -> DataFrame:
    """The survivor gate of a run: an error when strict, else a warning."""
    gate = splits.survivors(rows, settings.splits.least_survivors)
    found = gate.first()
    if found["breached"]:
        said = f"{found['survivors']} queries left, fewer than {found['floor']}"
        if strict:
            raise DatasetIntegrityError(said)
        warnings.warn(said, stacklevel=3)
    return gate


def run_components(spark: SparkSession, corpus: DataFrame, merged: DataFrame, vectors: DataFrame, out: str, settings: Settings = COMPONENTS, gazetteer: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Structural repair, passage and query dedup, content, anaphora, calibrated screening, cap, splits by component.

    ``gazetteer`` (term; ``readers.gazetteer`` reads one) names entities; without it the seed words do, and the report says
    which. With ``strict`` fewer survivors than the settings ask for are an error, else a warning; a component over half
    of the queries always is an error. Writes the records of each split with their texts, the passages with the split in
    which they are a positive (or shared, or unused), the ledger, a report and a manifest."""
    f, s = settings.filters, settings.splits
    shares = dict(zip(("train", "val", "test"), s.shares))
    kept = written(integrity.drop_defects(merged, corpus).select("query_id", "query", "pos_id", "pos", "neg_id", "loaded_at"), "kept")
    remapped = written(dedup.remapped_edges(kept, corpus), "remapped")
    names = dedup.canonical_passages(corpus)
    canonical = kept.join(names.withColumnRenamed("id", "pos_id"), "pos_id").drop("pos_id").withColumnRenamed("canonical_id", "pos_id")
    queries, listed = dedup.consolidated(canonical, remapped)
    queries, listed = written(queries, "queries"), written(listed, "listed")
    content = filters.degenerate_cascade(queries, corpus, f.least_tokens).select("query_id", "pos_id")
    content = written(queries.drop("pos_id").join(content, "query_id"), "content")
    entities, source = filters.entity_flags(content, filters.gazetteer_hits(content, gazetteer) if gazetteer is not None else None)
    rule = t.has(F.col("query"), t.REFERRING) & t.has(F.col("query"), t.UNDERSPECIFIED) & ~F.col("has_entity")
    flagged = written(content.join(entities, "query_id").withColumn("is_anaphoric", F.coalesce(rule, F.lit(False))).drop("has_entity"), "flagged")
    named = written(flagged.filter("NOT is_anaphoric").drop("is_anaphoric"), "named")
    listed = listed.join(named.select("query_id"), "query_id", "left_semi").withColumnRenamed("rank", "place")
    candidates = negatives.high_reuse_pairs(listed, f.high_reuse)
    positives = named.select("query_id", "pos_id").join(candidates.select("query_id").distinct(), "query_id", "left_semi")
    cut = similarity.key_percentiles(similarity.pair_similarity(positives, vectors, "query_id", "pos_id").withColumn("k", F.lit(1)), "k", "similarity", [f.false_negative_percentile])
    scored = similarity.pair_similarity(candidates, vectors, "query_id", "neg_id").crossJoin(F.broadcast(cut.select("percentile")))
    pruned = written(negatives.without_pairs(listed, scored.filter("similarity >= percentile")), "pruned")
    capped = written(negatives.capped(pruned, s.budget, settings.seed), "capped")
    ready = written(with_lists(with_lists(named, capped, "place"), pruned, "place", name="neg_ids_uncapped"), "ready")
    labels = written(graph.query_components(ready.select("query_id", F.explode("alt_pos_ids").alias("pos_id"))), "labels")
    split = written(graph.checked_components(labels).join(graph.greedy_packing(labels, shares), "component").select("query_id", "split"), "split")
    rows = ready.join(split, "query_id").select("query_id", t.trimmed(F.col("query")).alias("query"), "split", "pos_id", "alt_pos_ids", "neg_ids_uncapped")
    lists = capped.join(split.select("query_id"), "query_id", "left_semi")
    final = written(records.with_lists(rows, lists, corpus, "place").select("query_id", "query", "split", "pos_id", "pos", "alt_pos_ids", "neg_ids", "negs", "neg_ids_uncapped"), "final")
    used = final.select(F.explode("neg_ids_uncapped").alias("neg_id"))
    passages = records.passages(corpus, splits.passage_labels(corpus, final.select(F.explode("alt_pos_ids").alias("pos_id"), "split"), used))
    steps = [("00_raw", merged, integrity.edges(merged)), ("01_structural", kept, remapped), ("02_consolidated", queries, listed), ("03_named", named, listed),
             ("04_false_negative", pruned.select("query_id").distinct(), pruned), ("05_cap", ready, ready.select(F.explode("neg_ids")))]
    book = ledger.ledger(spark, [(stage, unit, df) for stage, q, e in steps for unit, df in (("queries", q), ("pairs", e))])
    extra = {"components": graph.component_stats(labels), "deviation": splits.deviation(final, graph.component_stats(labels).select("largest_share"), shares), "entity_source": source,
             "false_negative_threshold": cut.select("percentile"), "survivors": survivor_check(final, settings, strict)}
    sample = filters.stratified_sample(flagged.select("query_id", "is_anaphoric"), "is_anaphoric", f.sample_size // 2, settings.seed)
    return finish(final, passages, book, out, settings, extra, sample.join(flagged.select("query_id", "query"), "query_id"))


def near_queries(rows: DataFrame, vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, dropped): the best match of each query (query_id, split) in another split, one row a pair, flagged from ``threshold``
    on; and the query_ids of the flagged ends in the lower split, which the other end's split must not see."""
    own = written(similarity.embedded(rows.select(F.col("query_id").alias("id"), "split"), vectors), "query_vectors")
    pairs = similarity.unordered(similarity.top_matches(own, own, 1, apart=True)).withColumn("flagged", F.col("similarity") >= threshold)
    home = rows.select("query_id", dedup.precedence().alias("rank"))
    ends = pairs.filter("flagged").join(home.withColumnRenamed("rank", "a"), "query_id").join(home.select(F.col("query_id").alias("id"), F.col("rank").alias("b")), "id")
    return written(pairs, "near"), ends.select(F.when(F.col("a") < F.col("b"), F.col("query_id")).otherwise(F.col("id")).alias("query_id")).distinct()


def top_up(train: DataFrame, have: DataFrame, inside: DataFrame, vectors: DataFrame, budget: int, cap: float) -> DataFrame:
    """(query_id, neg_id, rank): passages of ``inside`` (id, split) below ``cap`` for the queries of ``train`` (query_id,
    pos_id, split) with fewer than ``budget`` negatives in ``have`` (query_id, neg_id), the most similar first.

    A query's positive and its own negatives are no candidates, so it ends short only where such passages run out.
    """
    counts = have.groupBy("query_id").agg(F.count("*").alias("n"))
    short = written(train.join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < budget), "short")
    kept = have.select("query_id", F.col("neg_id").alias("id")).join(short.select("query_id"), "query_id", "left_semi")
    taken = written(kept.unionByName(short.select("query_id", F.col("pos_id").alias("id"))).distinct(), "taken")
    asked = written(similarity.embedded(short.select(F.col("query_id").alias("id"), "split"), vectors), "asked")
    near = similarity.top_matches(asked, written(similarity.embedded(inside, vectors), "inside"), budget, below=cap, without=taken)
    return negatives.mined(kept, near, budget, cap).select("query_id", F.col("id").alias("neg_id"), "rank")


def run_partitions(spark: SparkSession, corpus: DataFrame, merged: DataFrame, vectors: DataFrame, out: str, settings: Settings = PARTITIONS, terms: DataFrame | None = None, labels: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Anaphora by vocabulary, content, fixed screening, random partitions with inherited splits, exact and near copies of
    queries kept in the highest split only, and training negatives of the training partition, mined up to the budget below
    the false-negative threshold. The audit includes near copies that are left; any finding is an error.

    ``labels`` (``readers.labels_csv``) are hand labels of an earlier sample, scored in the report. With ``strict`` fewer
    survivors than the settings ask for are an error, else a warning. Writes the records of each split with their texts,
    the passages with their partition, the pairs of near queries, a sample for annotators, the ledger, a report and a manifest.

    Validation and test queries all stay, with their own lists; ``neg_ids`` has up to ``budget`` of a list, the hardest,
    and ``neg_ids_uncapped`` the whole of it. ``terms`` is the vocabulary (``readers.vocabulary_file``), which any real
    corpus needs: without it the example records of the tests stand in, with a warning and a note in the report, and
    queries that name anything else count as anaphoric.
    """
    if terms is None:
        warnings.warn("run_partitions without a vocabulary: the example records stand in", stacklevel=2)
    f, s = settings.filters, settings.splits
    shares = dict(zip(("train", "val", "test"), s.shares))
    kept = written(integrity.drop_defects(merged, corpus).select("query_id", "query", "pos_id", "pos", "neg_id", "loaded_at"), "kept")
    counts = found_terms(kept, vocabulary(parsed(spark)) if terms is None else terms).groupBy("query_id").agg(F.count("*").alias("n_terms"))
    flags = written(filters.anaphoric_by_vocabulary(kept, counts), "flags")
    named = written(filters.with_content(kept.join(flags.filter("NOT is_anaphoric").select("query_id"), "query_id", "left_semi"), f.least_words), "named")
    partition = written(splits.partitioned(corpus, shares, settings.seed), "partition")
    assigned = splits.checked(written(splits.inherited(named, partition), "inherited"))
    assigned = written(assigned.join(dedup.straddlers(assigned).select("query_id"), "query_id", "left_anti"), "assigned")
    near = None
    if s.near_duplicate_threshold is not None:
        near, dropped = near_queries(assigned, vectors, s.near_duplicate_threshold)
        assigned = written(assigned.join(dropped, "query_id", "left_anti"), "assigned")
    listed = integrity.clean_edges(assigned, corpus).join(assigned.select("query_id", "split"), "query_id")
    inside = partition.filter("split = 'train'").select("id", "split")
    screened = written(similarity.pair_similarity(listed, vectors, "query_id", "neg_id").filter(F.col("similarity") < F.lit(f.false_negative_threshold)), "screened")
    # Only training must not see other partitions; evaluation rows keep their own lists.
    own = screened.filter("split <> 'train'").unionByName(screened.filter("split = 'train'").join(inside.select(F.col("id").alias("neg_id")), "neg_id", "left_semi"))
    best = F.row_number().over(similarity.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "place"))
    ranked = written(own.withColumn("rank", best), "ranked")
    hardest = ranked.filter(F.col("rank") <= s.budget).select("query_id", "neg_id", "rank")
    train = assigned.filter("split = 'train'").select("query_id", "pos_id", "split")
    more = written(top_up(train, hardest, inside, vectors, s.budget, min(s.mining_cap, f.false_negative_threshold)), "mined")
    chosen = written(hardest.unionByName(more.withColumn("rank", F.col("rank") + s.budget)), "chosen")
    rows = with_lists(assigned.select("query_id", t.trimmed(F.col("query")).alias("query"), "split", "pos_id"), ranked, "place", "left", "neg_ids_uncapped").withColumn("alt_pos_ids", F.array("pos_id"))
    final = written(records.with_lists(rows, chosen, corpus, "rank").select("query_id", "query", "split", "pos_id", "pos", "alt_pos_ids", "neg_ids", "negs", "neg_ids_uncapped"), "final")
    steps = [("00_raw", merged, integrity.edges(merged)), ("01_structural", kept, integrity.clean_edges(kept, corpus)), ("02_named", named, integrity.clean_edges(named, corpus)),
             ("03_assigned", assigned, listed), ("04_false_negative", assigned, screened), ("05_own_partition", assigned, ranked), ("06_hardest", assigned, hardest), ("07_mined", final, chosen)]
    book = ledger.ledger(spark, [(stage, unit, df) for stage, q, e in steps for unit, df in (("queries", q), ("pairs", e))])
    alive = final.select("query_id")
    residual = [] if near is None else [splits.count_of("near_duplicate_queries_across_splits", near.filter("flagged").join(alive, "query_id", "left_semi").join(alive.withColumnRenamed("query_id", "id"), "id", "left_semi"))]
    audit = splits.enforce(splits.leakage_audit(final.withColumnRenamed("neg_ids", "neg_id"), partition, *residual))
    ends = chosen.join(train.select("query_id"), "query_id", "left_semi").join(more.select("query_id", "neg_id", F.lit(True).alias("mined")), ["query_id", "neg_id"], "left").select("query_id", F.coalesce("mined", F.lit(False)).alias("mined"))
    stripped = negatives.strip_counts(assigned.filter("split = 'train'").select("query_id", "pos_id", "neg_id"), inside)
    extra = {"audit": audit, "vocabulary": "example records" if terms is None else "given", "mining": negatives.mining_counters(stripped, ends, spark.createDataFrame([], "query_id string, n bigint"), s.budget),
             "anaphoric": filters.anaphoric_summary(flags), "survivors": survivor_check(final, settings, strict), "hand_labels": None if labels is None else filters.label_scores(labels)}
    if near is not None:
        extra["near_queries"] = similarity.distribution(near, "similarity", [0.5, 0.9, 0.95, 0.99, 0.995, 0.999])
        writers.parquet(near, Places(out).near_pairs)
    sample = filters.refilled_sample(flags, "is_anaphoric", f.sample_size, settings.seed)
    return finish(final, records.passages(corpus, partition), book, out, settings, extra, sample.join(kept.select("query_id", "query"), "query_id"))


def finish(final: DataFrame, passages: DataFrame, book: DataFrame, out: str, settings: Settings, extra: dict, sample: DataFrame) -> DataFrame:
    """Write splits and passages as JSON lines, the sample and the ledger as CSV, a report and a manifest; the final rows come back.

    The sample has an empty label column, for annotators to fill; its strata are hidden by the order of the ids."""
    places = Places(out)
    for split in ("train", "val", "test"):
        writers.jsonl(final.filter(F.col("split") == split), places.split(split))
    writers.jsonl(passages, places.corpus, "id")
    writers.csv(book.orderBy("seq"), places.ledger)
    writers.csv(sample.select("query_id", "query", F.col("is_anaphoric").cast("string").alias("predicted"), F.lit("").alias("label")).orderBy("query_id"), places.sample)
    writers.report({"run": run_name(settings), "settings": settings, "splits": final.groupBy("split").count(), "passages": passages.groupBy("split").count()} | extra, places.report)
    outputs = [*(places.split(x) for x in ("train", "val", "test")), places.corpus, places.ledger, places.report]
    writers.manifest(places.manifest, settings.name, settings.seed, settings, [], outputs)
    return final


def freeze(spark: SparkSession, folder: str, names: dict[str, int | None], out: str, settings: Settings = COMPONENTS, strict: bool = True) -> dict:
    """Count the tables of a folder against what is expected (None: anything), write their manifest and make them read-only."""
    paths = [f"{folder}/{name}.parquet" for name in names]
    for name, expected in names.items():
        readers.checked_count(table(spark, folder, name), name, expected, strict)
    made = writers.manifest(Places(out).manifest, "freeze", settings.seed, settings, paths, [])
    for path in paths:
        writers.set_readonly(path)
    return made
