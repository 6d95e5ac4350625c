import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trelliq.operators import dedup, filters, graph, integrity, ledger, metrics, negatives, similarity, splits, vocab
from trelliq.plans.cleaning import RECORDS

MERGED = "query_id string, query string, pos_id string, pos string, neg_id array<string>, loaded_at timestamp_ntz"


def toy(spark, rows, extra=True):
    """Rows of (query_id, query, pos_id, pos, neg_id)."""
    df = spark.createDataFrame([(*r, None) for r in rows], MERGED)
    return df.withColumn("known_pos", F.lit(1)).withColumn("nth", F.lit("x")) if extra else df


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([("p1", "One, text here"), ("p2", "one text  HERE"), ("p3", "another"), ("p4", None), ("p5", "")], "id string, text string")


def test_integrity(spark, corpus):
    rows = [("q1", "a", "p1", "x", ["p3", None, "p1", "p3", "zz", "p2"]), ("q1", "a", "p2", "x", ["p3"]), ("q2", "  ", "p1", "x", []), ("q3", "a", "p1", None, None),
            ("q4", "a", "zz", "x", ["p1"]), ("q5", "a", None, "x", ["p1"]), ("q6", "a", "p4", "x", None)]
    m = toy(spark, rows, extra=False)
    found = {r["defect"]: r["n"] for r in integrity.defect_summary(m, corpus).collect()}
    assert found == {"null_query": 1, "null_pos": 1, "orphan_pos": 2, "no_negatives": 3, "self_negative": 1, "duplicate_query_id": 1}
    kept = integrity.drop_defects(m, corpus)
    assert sorted(r["query_id"] for r in kept.collect()) == ["q1", "q6"]
    edges = integrity.clean_edges(kept, corpus).collect()
    assert [(r["place"], r["neg_id"]) for r in sorted(edges)] == [(0, "p3"), (5, "p2")]
    assert [r["neg_id"] for r in integrity.orphan_negatives(m, corpus).collect()] == ["zz"]
    empty = toy(spark, [], extra=False)
    assert integrity.drop_defects(empty, corpus).count() == 0 and {r["n"] for r in integrity.defect_summary(empty, corpus).collect()} == {0}


def test_passage_and_query_dedup(spark, corpus):
    assert dict(map(tuple, dedup.canonical_passages(corpus).collect())) == {"p1": "p1", "p2": "p1", "p3": "p3", "p4": "p4", "p5": "p5"}
    rows = [("q2", "Same!", "p3", "x", ["p1", "p5"]), ("q1", "same", "p1", "x", ["p5", "p3", "p4"]), ("q3", "other", "p1", "x", ["p3"])]
    m = toy(spark, rows, extra=False)
    queries, negs = dedup.consolidated(m, integrity.edges(m, "query_id"))
    by = {r["query_id"]: r for r in queries.collect()}
    assert by["q1"]["alt_pos_ids"] == ["p1", "p3"] and by["q1"]["query"] == "same" and set(by) == {"q1", "q3"}
    assert sorted((r["query_id"], r["rank"], r["neg_id"]) for r in negs.collect()) == [("q1", 1, "p5"), ("q1", 2, "p4"), ("q3", 1, "p3")]


def test_precedence_keeps_the_test_copy(spark):
    a = spark.createDataFrame([("a", "Same query", "train"), ("b", "same  query!", "test"), ("c", "same query", "val"), ("d", "own", "train")], "query_id string, query string, split string")
    assert sorted(r["query_id"] for r in dedup.straddlers(a).collect()) == ["a", "c"]
    (g,) = dedup.exact_groups(a).collect()
    assert (g["n"], g["n_splits"], g["straddles"]) == (3, 3, True)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    rows = [(f"c{n:02}", f"k{n + d}") for n in range(40) for d in (0, 1)] + [(f"s{n:02}", "hub") for n in range(60)] + [(f"r{r.randrange(50)}", f"z{r.randrange(50)}") for _ in range(50)] + [("alone", None)]
    df = spark.createDataFrame(rows, "query_id string, pos_id string").repartition(3)
    labels = dict(map(tuple, graph.query_components(df).collect()))
    parent = {q: q for q, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for q, p in rows:
        if p is not None:
            a, b = root(q), root(first.setdefault(p, q))
            parent[max(a, b)] = min(a, b)
    assert labels == {q: root(q) for q in parent}


def greedy(sizes, shares):
    """The plain recurrence over (size, name), one component at a time."""
    count, target = dict.fromkeys(shares, 0), {s: share * sum(n for n, _ in sizes) for s, share in shares.items()}
    out = {}
    for n, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        best = max(target, key=lambda s: target[s] - count[s])
        count[best] += n
        out[name] = best
    return out


@pytest.mark.parametrize("seed", range(300))
def test_turns_are_those_of_the_plain_recurrence(seed):
    r = random.Random(seed)
    sizes = [(k, r.choice((1, 2, 5, 100, 3000))) for k in sorted({r.choice((1, 1, 2, 3, 5, 40, r.randrange(1, 2000))) for _ in range(r.randrange(1, 7))}, reverse=True)]
    shares = r.choice((splits.SHARES, {"a": 0.5, "b": 0.5}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"x": 1.0}, {"a": 0.25, "b": 0.25, "c": 0.25, "d": 0.25}))
    runs = graph.turns(sizes, shares, sum(n * c for n, c in sizes))
    found = [p[i % len(p)] for _, a, b, p in runs for i in range(b - a)]
    assert found == list(greedy([(n, f"{n}-{i:05}") for n, c in sizes for i in range(c)], shares).values())
    assert len(runs) <= 6 * len(sizes)


@pytest.mark.parametrize("n", [200, 6000])
def test_greedy_packing_row_by_row(spark, n):
    r = random.Random(n)
    sizes = [(r.choice((1, 1, 1, 2, 3, 5, 40)), f"c{r.randrange(10**6)}x{i}") for i in range(n)]
    rows = [(f"{c}q{i}", c) for k, c in sizes for i in range(k)]
    labels = spark.createDataFrame(rows, "query_id string, component string").repartition(5)
    found = {x["component"]: x["split"] for x in graph.greedy_packing(labels, splits.SHARES).collect()}
    assert found == greedy(sizes, splits.SHARES)
    assert graph.greedy_packing(labels.limit(0), splits.SHARES).count() == 0


def test_component_gate(spark):
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "query_id string, component string")
    with pytest.raises(graph.ComponentError):
        graph.checked_components(labels)
    assert graph.checked_components(labels, 0.8) is labels and graph.component_gate(labels).first()["unreachable"]


def test_index_and_totality(spark):
    rows = spark.createDataFrame([("q1", "p1", "train"), ("q2", "p9", "val")], "query_id string, pos_id string, split string")
    part = spark.createDataFrame([("p1", "train"), ("p2", "val")], "id string, split string")
    assert {r["split"]: r["n_outside"] for r in splits.positives_outside(rows, part).collect()} == {"train": 0, "val": 1}
    with pytest.raises(splits.LeakageError):
        splits.inside_index(rows, part)
    assert splits.inside_index(rows.filter("split = 'train'"), part).count() == 1
    assert tuple(splits.totality(part, part.union(part.limit(1))).first()) == (2, 3, 1)


def test_sample_is_refilled_by_unflagged_rows(spark):
    flags = spark.createDataFrame([(f"q{i:02}", i < 3) for i in range(60)], "query_id string, flag boolean")
    found = Counter(r["flag"] for r in filters.refilled_sample(flags.repartition(3), "flag", 20).collect())
    assert found == {True: 3, False: 17}
    many = flags.withColumn("flag", F.col("query_id") < "q40")
    assert Counter(r["flag"] for r in filters.refilled_sample(many, "flag", 20).collect()) == {True: 10, False: 10}


def test_label_scores(spark):
    cells = [("true", "1"), ("true", "1.0"), ("True", "no"), ("false", "yes"), ("false", "0"), ("true", " "), ("true", None)]
    rows = {r["variant"]: r.asDict() for r in filters.label_scores(spark.createDataFrame(cells, "predicted string, label string")).collect()}
    assert [rows["zero"][c] for c in ("n_labeled", "tp", "fp", "fn", "tn", "precision")] == [5, 2, 1, 1, 1, 0.6667]
    none = {r["variant"]: r["precision"] for r in filters.label_scores(spark.createDataFrame([("false", "0")], "predicted string, label string")).collect()}
    assert none == {"zero": 0.0, "undefined": None}


def test_gazetteer_hits(spark):
    q = spark.createDataFrame([("a", "Her BRACHOCELE, after."), ("b", "brachoceles"), ("c", "velar-enlargement of late"), ("d", "Velar  enlargement?"), ("e", None), ("f", "")], "query_id string, query string")
    terms = spark.createDataFrame([("brachocele",), ("velar enlargement",)], "term string")
    assert {tuple(r) for r in filters.gazetteer_hits(q, terms).collect()} == {("a", "brachocele"), ("d", "velar enlargement")}
    assert filters.gazetteer_hits(q, terms.limit(0)).count() == 0 and filters.gazetteer_hits(q.limit(0), terms).count() == 0


def test_partition(spark):
    ids = spark.createDataFrame([(f"p{i}",) for i in range(1000)], "id string")
    one = dict(map(tuple, splits.partitioned(ids.repartition(7)).collect()))
    assert Counter(one.values()) == {"train": 800, "val": 100, "test": 100}
    assert one == dict(map(tuple, splits.partitioned(ids.orderBy(F.desc("id"))).collect()))
    assert one != dict(map(tuple, splits.partitioned(ids, seed=7).collect()))
    with pytest.raises(ValueError):
        splits.partitioned(ids, {"train": 0.5, "test": 0.4})


def test_inheritance_and_audit(spark):
    part = spark.createDataFrame([("p1", "train"), ("p2", "val"), ("p3", "test"), ("p4", "train")], "id string, split string")
    rows = toy(spark, [("q1", "a", "p1", "x", ["p4"]), ("q2", "b", "p2", "x", ["p3"]), ("q3", "c", "p3", "x", None)])
    assigned = splits.checked(splits.inherited(rows, part))
    assert not any(r["violations"] for r in splits.enforce(splits.leakage_audit(assigned, part)).collect())
    with pytest.raises(splits.LeakageError):
        splits.checked(splits.inherited(toy(spark, [("q9", "a", "nowhere", "x", [])]), part))
    leaking = splits.inherited(toy(spark, [("q1", "a", "p1", "x", ["p3"]), ("q2", "A!", "p2", "x", []), ("q3", "c", "p3", "x", [])]), part)
    bad = {r["check"]: r["violations"] for r in splits.leakage_audit(leaking, part).collect() if r["violations"]}
    assert bad == {"test_passages_seen_in_train": 1, "test_pos_ids_in_train_any_role": 1, "test_pos_ids_as_train_negatives": 1, "exact_duplicate_queries_across_splits": 1}
    with pytest.raises(splits.LeakageError):
        splits.enforce(splits.leakage_audit(leaking, part))


def test_top_matches_in_blocks(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(120, 8)).astype(np.float32)
    v[7] = v[90]
    split = ["train", "val", "test"]
    df = spark.createDataFrame([(i, split[i % 3], v[i].tolist()) for i in range(120)], "vec_id bigint, split string, embedding array<float>").repartition(5)
    asked = df.filter("vec_id % 10 = 0")
    sims = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 9)
    for apart in (False, True):
        want = {q: sorted((i for i in range(120) if i != q and not (apart and i % 3 == q % 3)), key=lambda i: (-sims[q, i], i))[:4] for q in range(0, 120, 10)}
        for block in (4096, 5):
            found = defaultdict(list)
            for x in similarity.top_matches(asked, df, 4, apart, block).orderBy("query_id", F.desc("similarity"), "id").collect():
                found[x["query_id"]].append(x["id"])
            assert found == want
    assert similarity.top_matches(asked.limit(0), df, 3).count() == 0


def test_metrics(spark):
    r = random.Random(1)
    run, qrels = [], []
    for q in range(20):
        docs = r.sample(range(60), 25)
        run += [(f"q{q}", f"d{d:02}", round(r.random(), 1)) for d in docs]
        qrels += [(f"q{q}", f"d{d:02}", r.choice((0, 1, 2))) for d in r.sample(range(60), 12)]
    grades = {(q, d): g for q, d, g in qrels}
    found = {x["query_id"]: x for x in metrics.per_query(spark.createDataFrame(run, "query_id string, id string, score double"), spark.createDataFrame(qrels, "query_id string, id string, grade int")).collect()}
    for q in {q for q, _, g in qrels if g}:
        top = [d for _, d, _ in sorted((x for x in run if x[0] == q), key=lambda x: (-x[2], x[1]))[:10]]
        gains = [grades.get((q, d), 0) for d in top]
        ideal = sorted((g for (a, _), g in grades.items() if a == q and g), reverse=True)
        dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g[:10]))
        hits = [i for i, g in enumerate(gains) if g]
        assert found[q]["ndcg"] == pytest.approx(dcg(gains) / dcg(ideal))
        assert found[q]["recall"] == pytest.approx(len(hits) / len(ideal)) and found[q]["precision"] == pytest.approx(len(hits) / 10)
        assert found[q]["mrr"] == pytest.approx(1 / (hits[0] + 1) if hits else 0) and found[q]["hit"] == float(bool(gains and gains[0]))


def test_bootstrap(spark):
    a = spark.range(200).select(F.col("id").cast("string").alias("query_id"), (F.col("id") % 7 / 7 + 0.1).alias("ndcg"))
    b = a.select("query_id", (F.col("ndcg") - 0.1).alias("ndcg"))
    (x,) = metrics.paired_bootstrap(a, b, "ndcg", 200).collect()
    assert x["low"] == pytest.approx(0.1) == x["high"] and x["p"] == 0.0
    (same,) = metrics.paired_bootstrap(a, a, "ndcg", 50).collect()
    assert same["mean_difference"] == 0 and same["low"] == same["high"] == 0


def test_ledger_conserves(spark):
    frames = [("a", "q", spark.range(10)), ("a", "p", spark.range(50)), ("b", "q", spark.range(7)), ("c", "q", spark.range(7)), ("c", "p", spark.range(20))]
    rows = ledger.ledger(spark, frames)
    assert [(r["unit"], r["removed"], r["remaining"]) for r in rows.orderBy("seq").collect()] == [("q", 0, 10), ("p", 0, 50), ("q", 3, 7), ("q", 0, 7), ("p", 30, 20)]
    assert {(r["stage"], r["unit"]): r["remaining"] for r in ledger.tracks(rows).collect()}["b", "p"] == 50
    assert ledger.ledger(spark, []).count() == 0


def test_agreement_and_sample(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(False, True)] + [(True, False)] * 2, "label boolean, predicted boolean")
    (r,) = filters.agreement(df).collect()
    assert (r["precision"], r["recall"], r["accuracy"]) == (0.75, 0.6, 0.5)
    (z,) = filters.agreement(df.limit(0)).collect()
    assert (z["precision"], z["f1"]) == (0.0, 0.0)
    flags = spark.createDataFrame([(f"q{i}", i % 10 == 0) for i in range(100)], "query_id string, flag boolean")
    one, two = (sorted(map(tuple, filters.stratified_sample(flags.repartition(n), "flag", 12).collect())) for n in (2, 5))
    assert one == two and Counter(f for _, f in one) == {True: 10, False: 12}


def test_negatives(spark):
    rows = toy(spark, [(f"q{i}", "a", "p", "x", [f"n{j}" for j in range(i)] + ["hub", "hub"]) for i in range(12)])
    listed = integrity.edges(rows, "query_id", "pos_id")
    use = {r["neg_id"]: (r["n_edges"], r["n_queries"]) for r in negatives.reuse(listed).collect()}
    assert use["hub"] == (24, 12) and use["n0"] == (11, 11)
    assert negatives.high_reuse_pairs(listed, 20).count() == 12
    wide = negatives.training_columns(integrity.first_places(listed, "query_id", "neg_id"), 4).collect()
    assert len(wide) == 9 and {r["query_id"]: r["negative_4"] for r in wide}["q3"] == "hub"
    capped = negatives.capped(integrity.first_places(listed, "query_id", "neg_id"), 5)
    assert max(r["count"] for r in capped.groupBy("query_id").count().collect()) == 5
    have = spark.createDataFrame([("q", "a")], "query_id string, id string")
    cand = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.99), ("q", "c", 0.4), ("q", "d", 0.4), ("r", "a", 0.1)], "query_id string, id string, similarity double")
    assert sorted((r["query_id"], r["id"]) for r in negatives.mined(have, cand, 2, 0.95).collect()) == [("q", "c"), ("r", "a")]


def test_vocabulary(spark):
    blocks = spark.createDataFrame([(b,) for b in RECORDS.split("*NEWRECORD")], "value string")
    terms = {r["term"]: r for r in vocab.vocabulary(vocab.parsed_records(blocks)).collect()}
    assert {"cavolous nephrelitis", "nephrelitis, cavolous", "velar enlargement"} <= set(terms) and not {"pharmacotherapy", "ache", "nameless growth"} & set(terms)
    q = spark.createDataFrame([("a", "Nurick scale and MRI in cavolous nephrelitis, BRACHOCELE"), ("b", "This score of the Clavien-Dindo grade ICU"), ("c", ""), ("d", None)], "query_id string, query string")
    found = defaultdict(list)
    for r in vocab.found_terms(q, vocab.vocabulary(vocab.parsed_records(blocks))).orderBy("query_id", "place").collect():
        found[r["query_id"]].append(r["term"])
    assert found == {"a": ["MRI", "Nurick scale", "cavolous nephrelitis", "brachocele"], "b": ["Clavien-Dindo", "Clavien-Dindo grade"]}


def test_cutoffs(spark):
    run = spark.createDataFrame([("q1", "z", 0.9), ("q1", "a", 0.8), ("q1", "b", 0.1), ("q2", "z", 0.5)], "query_id string, id string, score double")
    qrels = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 1), ("q2", "a", 1), ("q2", "z", 0)], "query_id string, id string, grade int")
    found = {(r["metric"], r["k"]): r["value"] for r in metrics.cutoffs(run, qrels, (1, 5)).collect()}
    assert found["accuracy", 1] == 0 and found["accuracy", 5] == 0.5 and found["precision", 5] == 0.2 and found["recall", 5] == 0.5 and found["mrr", 10] == 0.25
    assert metrics.metric_key({"val_cosine_ndcg@10": 1, "val_dot_ndcg@10": 2}) == "val_cosine_ndcg@10" and metrics.metric_key({"NDCG@10": 1}) == "NDCG@10"
    with pytest.raises(KeyError):
        metrics.metric_key({"mrr@10": 1})


def test_sweep_goes_on_where_it_stopped(tmp_path):
    from trelliq.plans import evaluation

    asked = []
    score = lambda p: asked.append(p) or p["a"] + p["b"] / 10
    rows = evaluation.sweep({"a": [1, 2], "b": [3, 4]}, score, str(tmp_path))
    assert [r["ndcg"] for r in rows] == [2.4, 2.3, 1.4, 1.3] and rows[0]["gain"] == 0 and len(asked) == 4
    assert evaluation.sweep({"a": [1, 2], "b": [3, 4]}, score, str(tmp_path)) == rows and len(asked) == 4
    assert len(evaluation.sweep({"a": [1, 2], "b": [5]}, score, str(tmp_path))) == 2 and len(asked) == 6


def test_chunks_and_claims(spark):
    df = spark.createDataFrame([("x", "One two. Three!  ?? four five six"), ("y", ""), ("z", None)], "answer_id string, text string")
    assert [(r["answer_id"], r["claim"]) for r in metrics.claims(df).orderBy("answer_id", "at").collect()] == [("x", "One two"), ("x", "Three"), ("x", "four five six")]
    chunks = metrics.chunked(spark.createDataFrame([("x", " ".join(map(str, range(100))))], "answer_id string, text string")).orderBy("chunk").collect()
    assert [r["text"].split()[0] for r in chunks] == ["0", "20", "40", "60"] and chunks[-1]["text"].split()[-1] == "99"


def test_mining_counters(spark):
    rows = spark.createDataFrame([("a", "p", ["p", "n1", "n1", "zz", None]), ("b", "p", None), ("c", "p", [])], "query_id string, pos_id string, neg_id array<string>")
    stripped = negatives.strip_counts(rows, spark.createDataFrame([("p",), ("n1",), ("n2",)], "id string"))
    assert {tuple(r) for r in stripped.collect()} == {("a", 4, 1, 1, 1), ("b", 0, 0, 0, 0), ("c", 0, 0, 0, 0)}
    chosen = spark.createDataFrame([("a", False), ("a", True), ("b", True)], "query_id string, mined boolean")
    (x,) = negatives.mining_counters(stripped, chosen, spark.createDataFrame([("b", 3)], "query_id string, n bigint"), 2).collect()
    assert tuple(x) == (3, 4, 1, 1, 2, 3, 2, 3, 1.0)


def test_config_matrix(spark):
    qrels = spark.createDataFrame([("full", "q1", "a", 1), ("full", "q2", "b", 1), ("part", "q1", "a", 1)], "tier string, query_id string, id string, grade int")
    run = [("one", "full", "q1", "a", 0.9), ("one", "full", "q1", "z", 0.5), ("two", "full", "q1", "z", 0.9), ("two", "full", "q1", "a", 0.5), ("one", "part", "q1", "z", 1.0)]
    found = {(r["config"], r["tier"]): (r["n_queries"], r["mrr"]) for r in metrics.config_matrix(spark.createDataFrame(run, "config string, tier string, query_id string, id string, score double"), qrels).collect()}
    assert found == {("one", "full"): (2, 0.5), ("two", "full"): (2, 0.25), ("one", "part"): (1, 0.0)}


def test_faithfulness_and_kappa(spark):
    rows = [("x", "c1", 1, 0.2), ("x", "c1", 2, 0.8), ("x", "c2", 1, 0.4), ("y", "c1", 1, None)]
    found = {r["answer_id"]: (r["n_claims"], r["n_supported"], r["share"]) for r in metrics.faithfulness(spark.createDataFrame(rows, "answer_id string, claim string, chunk int, entailment double")).collect()}
    assert found == {"x": (2, 1, 0.5), "y": (1, 0, 0.0)}
    labels = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")]
    (k,) = metrics.kappa(spark.createDataFrame(labels, "a string, b string")).collect()
    assert k["n"] == 50 and k["kappa"] == pytest.approx(0.4)


def test_entity_sources(spark):
    q = spark.createDataFrame([("a", "new syndrome"), ("b", "velaromegaly"), ("c", None)], "query_id string, query string")
    seen = lambda df: {r["query_id"]: r["has_entity"] for r in df.collect()}
    flags, source = filters.entity_flags(q)
    assert seen(flags) == {"a": True, "b": False, "c": False} and source.startswith("seed")
    flags, source = filters.entity_flags(q, spark.createDataFrame([("b", "velaromegaly")], "query_id string, term string"))
    assert seen(flags) == {"a": False, "b": True, "c": False} and source == "gazetteer"
    flags, source = filters.entity_flags(q, detect=lambda c: c.contains("new"))
    assert seen(flags) == {"a": True, "b": False, "c": False} and source == "model"
