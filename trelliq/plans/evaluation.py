"""Queries of the evaluation half: retrieval metrics by index, sweeps, hard negatives of a retriever, answers and labels."""

from __future__ import annotations

import json
from itertools import product
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trelliq.functions import text as t
from trelliq.operators import filters, lexical, metrics, splits
from trelliq.plans import mining as m
from trelliq.plans import sql as s
from trelliq.plans.cleaning import assigned, kept
from trelliq.session import written
from trelliq.sources.tables import table

#: The grid of the training sweep, and the specification of the other run's.
GRID = {"learning_rate": [1e-5, 2e-5], "epochs": [1, 2, 3], "n_hard_negatives": [4, 8]}
SPECS = "lr=1e-5,epochs=1;lr=2e-5,epochs=1;lr=2e-5,epochs=2"
BM25_GRID = {"k1": [0.9, 1.2], "b": [0.4, 0.75]}


def asked(spark, folder, rows: DataFrame | None = None, part: DataFrame | None = None) -> DataFrame:
    """The stated query set with the partition of its positive; ``rows`` and ``part`` are the kept rows and the partition where they are made already."""
    rows = kept(spark, folder).select("query_id", "query", "pos_id", "pos") if rows is None else rows
    return written(splits.inherited(m.stated(rows), m.partition(spark, folder) if part is None else part), "asked")


def kept_once(spark, folder) -> DataFrame:
    """The kept rows without their texts, a table; for what reads all of them more than once."""
    return written(kept(spark, folder).select("query_id", "query", "pos_id", "neg_id"), "kept")


def index(spark, folder, split: str | None, labels: DataFrame | None = None) -> DataFrame:
    """Passages of the whole corpus, or of one split and the shared ones."""
    corpus = table(spark, folder, "corpus")
    if split is None:
        return corpus
    labels = m.passage_labels(spark, folder) if labels is None else labels
    return corpus.join(labels.filter(F.col("split").isin(split, "shared")).select("id"), "id", "left_semi")


def relevant(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("pos_id").alias("id"), F.lit(1).alias("grade"))


def run_over(queries: DataFrame, passages: DataFrame, depth: int = 10, **more: float) -> DataFrame:
    return metrics.bm25(queries.select("query_id", "query"), passages, depth, **more)


def ir_eval(spark, folder):
    """All metrics of a lexical retriever over the whole corpus, one positive a query."""
    # No split is asked for, so the corpus is not partitioned.
    queries = written(m.stated(kept(spark, folder).select("query_id", "query", "pos_id")), "asked")
    return metrics.cutoffs(run_over(queries, table(spark, folder, "corpus")), relevant(queries))


def all_positives(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, grade): every positive of the queries with the same form among the kept ``rows``."""
    forms = rows.select(t.matching_form(F.col("query")).alias("form"), F.col("pos_id").alias("id")).distinct()
    return queries.select("query_id", t.matching_form(F.col("query")).alias("form")).join(forms, "form").select("query_id", "id", F.lit(1).alias("grade"))


def ir_eval_own_index(spark, folder):
    """Metrics of training queries of the stated set over the training and shared passages, with all positives of a query's form."""
    rows, part = kept_once(spark, folder), written(m.partition(spark, folder), "partition")
    queries = asked(spark, folder, rows.drop("neg_id"), part).filter("split = 'train'")
    labels = m.labels_of(table(spark, folder, "corpus"), splits.inherited(rows.select("pos_id"), part), rows)
    passages = written(index(spark, folder, "train", labels), "index")
    splits.inside_index(queries.select("query_id", "pos_id"), passages)
    return metrics.cutoffs(run_over(queries, passages), all_positives(rows, queries), (5, 10))


def index_gap(spark, folder):
    """(own_index, full_index, gap): nDCG@10 of the same queries over their split's index and over the whole corpus."""
    queries = asked(spark, folder).filter("split = 'train'")
    own, full = (metrics.per_query(run_over(queries, p), relevant(queries)).agg(F.avg("ndcg").alias(n)) for n, p in (("own", index(spark, folder, "train")), ("full", table(spark, folder, "corpus"))))
    return own.crossJoin(F.broadcast(full)).select(F.round("own", 9).alias("own_index"), F.round("full", 9).alias("full_index"), F.round(F.col("own") - F.col("full"), 9).alias("gap"))


def hard_negatives(spark, folder):
    """(query_id, rank, id): the first eight of the 50 training passages that the retriever finds, without positives."""
    rows, part = kept_once(spark, folder), written(m.partition(spark, folder), "partition")
    queries = asked(spark, folder, rows.drop("neg_id"), part).filter("split = 'train'")
    inside = part.filter("split = 'train'").select("id")
    run = run_over(queries, table(spark, folder, "corpus").join(inside, "id", "left_semi"), 50)
    free = run.join(all_positives(rows, queries).select("query_id", "id"), ["query_id", "id"], "left_anti")
    return metrics.ranked(free.select("query_id", "id", "score"), 8).select("query_id", "rank", "id")


def config_matrix(spark, folder):
    """Metrics of two configurations of the retriever on two tiers: the whole corpus, and passages of six words or more."""
    queries = asked(spark, folder)
    corpus = table(spark, folder, "corpus")
    tiers = {"full": corpus, "content": corpus.filter(t.n_tokens(F.col("text")) >= 6)}
    configs = {"plain": (1.2, 0.75), "flat": (0.9, 0.0)}
    out = None
    for tier, p in tiers.items():
        # Both configurations share one reading of a tier.
        run = lexical.bm25_runs(queries.select("query_id", "query"), p, 10, list(configs.values()))
        run = run.select(F.element_at(F.array(*map(F.lit, configs)), F.col("setting") + 1).alias("config"), F.lit(tier).alias("tier"), "query_id", "id", "score")
        out = run if out is None else out.unionByName(run)
    qrels = relevant(queries)
    return metrics.config_matrix(out, qrels.select(F.lit("full").alias("tier"), "*").unionByName(qrels.select(F.lit("content").alias("tier"), "*")))


def run_id(point: dict) -> str:
    return "_".join(f"{k}{v:g}" for k, v in point.items())


def points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def sweep_grid(spark, folder):
    """All combinations of the training sweep's settings."""
    rows = [(run_id(p), *p.values()) for p in points(GRID)]
    return spark.createDataFrame(rows, "run_id string, learning_rate double, epochs int, n_hard_negatives int")


def sweep_specs(spark, folder):
    """(run_name, lr, epochs) of a sweep written as text."""
    one = spark.createDataFrame([(SPECS,)], "spec string").select(F.posexplode(F.split("spec", ";")).alias("i", "spec"))
    pairs = F.str_to_map("spec", F.lit(","), F.lit("="))
    lr, epochs = pairs["lr"].cast("double"), pairs["epochs"].cast("int")
    return one.select(F.concat(F.lit("run"), F.col("i") + 1).alias("run_name"), lr.alias("lr"), epochs.alias("epochs"))


def sweep(grid: dict[str, list], score, folder: str | None = None) -> list[dict]:
    """A row (run_id, settings, ndcg, gain) for each point, the best first, ties by run_id; ``score(point)`` is its nDCG@10.

    With a folder a point that has its metrics file there is not run again. ``gain`` is over the last point of the grid.
    """
    rows = []
    for point in points(grid):
        file = Path(folder, run_id(point), "metrics.json") if folder else None
        if file and file.exists():
            ndcg = json.loads(file.read_text())["ndcg@10"]
        else:
            ndcg = score(point)
            if file:
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(json.dumps({"ndcg@10": ndcg} | point))
        rows.append({"run_id": run_id(point)} | point | {"ndcg": ndcg})
    return [r | {"gain": round(r["ndcg"] - rows[-1]["ndcg"], 4)} for r in sorted(rows, key=lambda r: (-r["ndcg"], r["run_id"]))]


def sweep_results(spark, folder):
    """(rank, run_id, k1, b, ndcg, is_best): the retriever's settings by nDCG@10, the best first."""
    queries = asked(spark, folder)
    grid, qrels = points(BM25_GRID), relevant(queries)
    # All settings share one reading of the corpus.
    run = lexical.bm25_runs(queries.select("query_id", "query"), table(spark, folder, "corpus"), 10, [(p["k1"], p["b"]) for p in grid])
    out = None
    for i, p in enumerate(grid):
        one = metrics.per_query(run.filter(F.col("setting") == i).drop("setting"), qrels).agg(F.round(F.avg("ndcg"), 9).alias("ndcg"))
        one = one.select(F.lit(run_id(p)).alias("run_id"), F.lit(p["k1"]).alias("k1"), F.lit(p["b"]).alias("b"), "ndcg")
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(metrics.Window.orderBy(F.desc("ndcg"), "run_id"))  # one row a setting
    return out.withColumn("rank", rank).withColumn("is_best", F.col("rank") == 1)


def answer_subset(spark, folder):
    """The fixed subset of test queries for which answers are written: the first 50 in seeded order."""
    rows = assigned(spark, folder).filter("split = 'test'").select("query_id", F.lit(True).alias("test"))
    return filters.stratified_sample(rows, "test", 50).select("query_id")


def faithfulness_scores(spark, folder):
    """Support of each sentence of a positive by chunks of the passage that the retriever ranks first, for the stated set.

    Lexical containment stands in for a model's entailment score."""
    queries = asked(spark, folder)
    best = metrics.ranked(run_over(queries, table(spark, folder, "corpus"), 1), 1).select(F.col("query_id").alias("answer_id"), "id")
    chunks = metrics.chunked(best.join(table(spark, folder, "corpus"), "id").select("answer_id", "text"))
    said = metrics.claims(queries.select(F.col("query_id").alias("answer_id"), F.col("pos").alias("text")))
    pairs = said.join(chunks, "answer_id").select("answer_id", F.col("at").cast("string").alias("claim"), "chunk", t.containment_overlap(F.col("claim"), F.col("text")).alias("entailment"))
    return metrics.faithfulness(pairs).withColumns({c: F.round(c, 9) for c in ("share", "weakest")})


def rule_kappa(spark, folder):
    """Agreement of the two anaphora rules that need no vocabulary."""
    f = filters.anaphoric_flags(kept(spark, folder)).select(F.col("eda").cast("string").alias("a"), F.col("notebook").cast("string").alias("b"))
    return metrics.kappa(f).withColumns({c: F.round(c, 9) for c in ("agreement", "kappa")})


QUERIES = {f.__name__: f for f in (ir_eval, ir_eval_own_index, index_gap, hard_negatives, config_matrix, sweep_grid, sweep_specs, sweep_results, answer_subset, faithfulness_scores, rule_kappa)}

LABELS = f"""{m.INHERITED}, own_split AS (SELECT pos_id AS id, min(split) AS split FROM inh GROUP BY 1), used AS (SELECT DISTINCT neg_id AS id FROM clean),
    labels AS (SELECT c.id, coalesce(o.split, CASE WHEN u.id IS NOT NULL THEN 'shared' END, 'unused') AS label FROM corpus c LEFT JOIN own_split o ON o.id = c.id LEFT JOIN used u ON u.id = c.id),
    ask AS (SELECT * FROM inh WHERE CAST('0x' || substr(md5(query_id), 1, 8) AS BIGINT) % 50 = 0), ask_train AS (SELECT * FROM ask WHERE split = 'train')"""
WHOLE = "SELECT id, text FROM corpus"
OWN = "SELECT id, text FROM corpus JOIN labels USING (id) WHERE label IN ('train', 'shared')"
IN_TRAIN = "SELECT c.id, text FROM corpus c JOIN part p ON p.id = c.id WHERE p.split = 'train'"
CONTENT = f"SELECT id, text FROM corpus WHERE {s.n_tokens('text')} >= 6"
ONE = "SELECT query_id, pos_id AS id FROM {}"
FORMS = f"SELECT DISTINCT a.query_id, k.pos_id AS id FROM ask_train a JOIN kept k ON {s.matching_form('a.query')} = {s.matching_form('k.query')}"


def bm25_sql(name: str, rows: str, ask: str, depth: int, k1: float = 1.2, b: float = 0.75) -> str:
    """``name``(query_id, id, score, rank) of the passages ``rows`` for the queries of ``ask``."""
    return f"""{name}_tok AS (SELECT id, regexp_extract_all(lower(text), '{t.LETTER}+') AS w FROM ({rows}) WHERE text IS NOT NULL), {name}_tf AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(w) AS w FROM {name}_tok) GROUP BY 1, 2),
    {name}_dl AS (SELECT id, len(w) AS dl FROM {name}_tok WHERE len(w) > 0), {name}_st AS (SELECT count(*) AS n, avg(dl) AS a FROM {name}_dl), {name}_df AS (SELECT w, count(*) AS df FROM {name}_tf GROUP BY 1),
    {name}_q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '{t.LETTER}+'))) AS w FROM {ask}),
    {name}_sc AS (SELECT query_id, f.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / a))), 6) AS score
        FROM {name}_q JOIN {name}_tf f USING (w) JOIN {name}_df USING (w) JOIN {name}_dl d ON d.id = f.id, {name}_st GROUP BY 1, 2),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_sc) WHERE rank <= {depth})"""


def scores_sql(name: str, run: str, grades: str) -> str:
    """``name``(query_id, n, ranks): the number of relevant ids of each query and the ranks at which they were found."""
    return f"""{name} AS (SELECT g.query_id, count(*) AS n, list(r.rank ORDER BY r.rank) FILTER (WHERE r.rank IS NOT NULL) AS ranks FROM ({grades}) g LEFT JOIN {run} r ON r.query_id = g.query_id AND r.id = g.id GROUP BY 1)"""


NDCG = "coalesce(list_sum(list_transform(ranks, lambda x: 1 / log2(x + 1))), 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1)))"


def cutoffs_sql(name: str, ks: tuple[int, ...]) -> str:
    hits = lambda k: f"coalesce(len(list_filter(ranks, lambda x: x <= {k})), 0)"
    parts = [f"SELECT '{metric}' AS metric, {k} AS k, round(avg({e}), 9) AS value FROM {name}" for k in ks for metric, e in (("accuracy", f"({hits(k)} > 0)::INT"), ("precision", f"{hits(k)} / {k}"), ("recall", f"{hits(k)} / n"))]
    parts += [f"SELECT 'ndcg', 10, round(avg({NDCG}), 9) FROM {name}", f"SELECT 'mrr', 10, round(avg(coalesce(1 / ranks[1], 0)), 9) FROM {name}"]
    return " UNION ALL ".join(parts)


def matrix_sql() -> str:
    runs, parts = [], []
    for tier, rows in (("full", WHOLE), ("content", CONTENT)):
        for config, k1, b in (("plain", 1.2, 0.75), ("flat", 0.9, 0.0)):
            name = f"{config}_{tier}"
            runs += [bm25_sql(name, rows, "ask", 10, k1, b), scores_sql(f"{name}_s", name, ONE.format("ask"))]
            parts.append(f"""SELECT '{config}' AS config, '{tier}' AS tier, count(*) AS n_queries, round(avg({NDCG}), 9) AS ndcg, round(avg(coalesce(len(ranks), 0) / n), 9) AS recall, round(avg(coalesce(len(ranks), 0) / 10), 9) AS precision,
                round(avg(coalesce(1 / ranks[1], 0)), 9) AS mrr, round(avg((coalesce(ranks[1], 0) = 1)::INT), 9) AS hit FROM {name}_s""")
    return f"WITH {LABELS}, {', '.join(runs)} {' UNION ALL '.join(parts)}"


def sweep_sql() -> str:
    runs, parts = [], []
    for i, p in enumerate(points(BM25_GRID)):
        runs += [bm25_sql(f"r{i}", WHOLE, "ask", 10, **p), scores_sql(f"s{i}", f"r{i}", ONE.format("ask"))]
        parts.append(f"SELECT '{run_id(p)}' AS run_id, {p['k1']}::DOUBLE AS k1, {p['b']}::DOUBLE AS b, round(avg({NDCG}), 9) AS ndcg FROM s{i}")
    return f"WITH {LABELS}, {', '.join(runs)}, o AS ({' UNION ALL '.join(parts)}), n AS (SELECT *, row_number() OVER (ORDER BY ndcg DESC, run_id) AS rank FROM o) SELECT *, rank = 1 AS is_best FROM n"


SQL = {
    "ir_eval": f"WITH {LABELS}, {bm25_sql('run', WHOLE, 'ask', 10)}, {scores_sql('sc', 'run', ONE.format('ask'))} {cutoffs_sql('sc', (1, 5, 10))}",
    "ir_eval_own_index": f"WITH {LABELS}, {bm25_sql('run', OWN, 'ask_train', 10)}, {scores_sql('sc', 'run', FORMS)} {cutoffs_sql('sc', (5, 10))}",
    "index_gap": f"""WITH {LABELS}, {bm25_sql("o", OWN, "ask_train", 10)}, {scores_sql("os", "o", ONE.format("ask_train"))}, {bm25_sql("f", WHOLE, "ask_train", 10)}, {scores_sql("fs", "f", ONE.format("ask_train"))},
        x AS (SELECT (SELECT avg({NDCG}) FROM os) AS a, (SELECT avg({NDCG}) FROM fs) AS b) SELECT round(a, 9) AS own_index, round(b, 9) AS full_index, round(a - b, 9) AS gap FROM x""",
    "hard_negatives": f"""WITH {LABELS}, {bm25_sql("run", IN_TRAIN, "ask_train", 50)}, pf AS ({FORMS}), free AS (SELECT * FROM run r WHERE NOT EXISTS (SELECT 1 FROM pf WHERE pf.query_id = r.query_id AND pf.id = r.id)),
        o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM free) SELECT query_id, nth AS rank, id FROM o WHERE nth <= 8""",
    "config_matrix": matrix_sql(),
    "sweep_grid": "SELECT run_id, learning_rate, epochs, n_hard_negatives FROM (VALUES " + ", ".join(f"('{run_id(p)}', {p['learning_rate']}::DOUBLE, {p['epochs']}, {p['n_hard_negatives']})" for p in points(GRID)) + ") g(run_id, learning_rate, epochs, n_hard_negatives)",
    "sweep_specs": f"""WITH x AS (SELECT unnest(string_split('{SPECS}', ';')) AS spec, generate_subscripts(string_split('{SPECS}', ';'), 1) AS i)
        SELECT 'run' || i AS run_name, CAST(regexp_extract(spec, 'lr=([^,]+)', 1) AS DOUBLE) AS lr, CAST(regexp_extract(spec, 'epochs=([^,]+)', 1) AS INT) AS epochs FROM x""",
    "sweep_results": sweep_sql(),
    "answer_subset": f"WITH {m.ASSIGNED}, o AS (SELECT query_id, row_number() OVER (ORDER BY md5('42:' || query_id), query_id) AS nth FROM assigned WHERE split = 'test') SELECT query_id FROM o WHERE nth <= 50",
    "faithfulness_scores": f"""WITH {LABELS}, {bm25_sql("run", WHOLE, "ask", 1)}, e AS (SELECT query_id, string_split_regex(trim(text, ' '), ' +') AS w FROM run JOIN corpus c ON c.id = run.id),
        ch AS (SELECT query_id, array_to_string(w[x : x + 39], ' ') AS chunk FROM (SELECT query_id, w, unnest(range(1, greatest(len(w) - 40 + 20, 1) + 1, 20)) AS x FROM e)),
        cl AS (SELECT query_id, unnest(c) AS claim, generate_subscripts(c, 1) AS place FROM (SELECT query_id, list_filter(regexp_split_to_array(pos, '[.!?]+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS c FROM ask)),
        b AS (SELECT query_id, place, max({s.containment("claim", "chunk")}) AS best FROM cl JOIN ch USING (query_id) GROUP BY 1, 2)
        SELECT query_id AS answer_id, count(*) AS n_claims, count(*) FILTER (WHERE best >= 0.5) AS n_supported, round(avg((best >= 0.5)::INT), 9) AS share, round(min(best), 9) AS weakest FROM b GROUP BY 1""",
    "rule_kappa": f"""WITH {s.KEPT}, f AS (SELECT {s.has("query", t.PATIENT_REFERENCE)} AND {s.has("query", t.GENERIC_OUTCOME)} AND NOT {s.has("query", t.SEED_ENTITY)} AS a, {m.N_RULE} AS b FROM kept),
        x AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) / count(*) AS o, (count(*) FILTER (WHERE a) * count(*) FILTER (WHERE b) + count(*) FILTER (WHERE NOT a) * count(*) FILTER (WHERE NOT b)) / (count(*) * count(*)) AS e FROM f)
        SELECT n, round(o, 9) AS agreement, round(CASE WHEN e = 1 THEN 1.0::DOUBLE ELSE (o - e) / (1 - e) END, 9) AS kappa FROM x""",
}
