"""The lexical search against a plain one, and that no pair of query and passage is shuffled."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from trelliq.operators import integrity, lexical, splits
from trelliq.plans import cleaning, mining
from trelliq.session import written
from trelliq.sources.tables import CORPUS, MERGED

QUERIES, PASSAGES = 300, 1500


def plain(queries, passages, k, k1, b):
    """{query_id: [(id, score)]} by comparing every query with every passage; the rows of an id are counted together."""
    rows, tf = defaultdict(list), defaultdict(Counter)
    for i, text in passages:
        if words := re.findall(r"\w+", (text or "").lower()):
            rows[i].append(len(words))
            tf[i].update(words)
    lengths = [n for x in rows.values() for n in x]
    n, mean, df = len(lengths), sum(lengths) / len(lengths), Counter(w for x in tf.values() for w in x)
    out = {}
    for q, text in queries:
        scores = Counter()
        for w in set(re.findall(r"\w+", (text or "").lower())):
            for i in tf:
                if tf[i][w] and i is not None:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] += sum(idf * tf[i][w] * (k1 + 1) / (tf[i][w] + k1 * (1 - b + b * dl / mean)) for dl in rows[i])
        if scores:
            out[q] = sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("k, lot, wide", [(1, 40, 0.25), (3, 200, 0.25), (10, 100_000, 0.1), (50, 300, 2.0)])
def test_same_as_plain_search(spark, monkeypatch, k, lot, wide):
    draw = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    passages = [(f"p{i:03}", text(draw.randint(1, 12))) for i in range(200)]
    # Copies that tie, an id in three rows, rows without an id, a text, words or a known letter.
    passages += [(f"é{i}", passages[i][1]) for i in range(60)] + [("p001", text(3)), ("p001", text(7)), (None, text(5)), (None, "w0"), ("x1", None), ("x2", " .,"), ("x3", "w1 Ünd_w2")]
    draw.shuffle(passages)
    queries = [(f"q{i}", text(draw.randint(1, 6))) for i in range(40)] + [("rare", "w59 w58 w0 w1 w2"), ("none", "absent"), ("null", None), ("upper", "W1, w1; ÜND_W2")]
    settings = [(1.2, 0.75), (0.9, 0.0)]
    monkeypatch.setattr(lexical.Postings.__init__, "__defaults__", (wide,))
    found = lexical.bm25_runs(spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(passages, CORPUS).repartition(3), k, settings, lot, 7).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r["setting"], r["query_id"]].append((r["id"], r["score"]))
    assert got == {(s, q): x for s, (k1, b) in enumerate(settings) for q, x in plain(queries, passages, k, k1, b).items()}


def test_passages_below_the_floor_are_skipped():
    lot = pa.table({"id": pa.array([f"p{i:04}" for i in range(2000)]), "lengths": pa.array([[3]] * 2000, pa.list_(pa.int32())), "words": pa.array([["the", "rare" if i < 20 else "of", "x"] for i in range(2000)])})
    vocabulary = pa.array(["the", "rare", "of"])
    postings = lexical.Postings(lot, vocabulary)
    postings.weigh(np.log(1 + (2000 - np.array([2000, 20, 1980]) + 0.5) / (np.array([2000, 20, 1980]) + 0.5)), 3.0, 1.2, 0.75)

    class Lookup:
        """A row of all passages that can be looked up but not added as a whole."""

        def __init__(self, row):
            self.get = row.__getitem__

        def __getitem__(self, docs):
            return self.get(docs)

    assert sorted(postings.wide) == [0, 2]
    postings.wide = {w: Lookup(row) for w, row in postings.wide.items()}
    docs, scores = postings.best(np.array([0, 1]), -np.inf, 5)
    assert docs.tolist() == [0, 1, 2, 3, 4] and len(set(scores.tolist())) == 1
    with pytest.raises(TypeError):
        postings.best(np.array([0, 2]), -np.inf, 5)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All queries belong to the stated set and share words with all passages."""
    ids = [q for q in (f"q{i}" for i in range(100_000)) if int(hashlib.md5(q.encode()).hexdigest()[:8], 16) % 50 == 0][:QUERIES]
    texts = [f"The patient of ward w{i} was seen after {i % 7} days." for i in range(PASSAGES)]
    merged = [(f"the patient of the ward w{i}", q, texts[i], f"p{i}", [texts[i + 1]], [f"p{i + 1}"], None) for i, q in enumerate(ids)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], CORPUS).write.parquet(f"{out}/corpus.parquet")
    spark.createDataFrame(merged, MERGED).write.parquet(f"{out}/merged.parquet")
    return str(out)


def shuffled(spark) -> int:
    """Records written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["faithfulness_scores", "bm25_topk", "sweep_results", "config_matrix", "index_gap", "hard_negatives", "ir_eval", "ir_eval_own_index"])
def test_pairs_are_not_shuffled(spark, folder, name):
    before = shuffled(spark)
    assert entry.queries()[name](spark, folder).collect()
    assert shuffled(spark) - before < QUERIES * PASSAGES / 4


def test_words_of_a_passage_are_cut_alike_in_both_ways(spark):
    """Plain texts are cut by Arrow, others by Spark: each plain character stands alone, within a word, and between capitals."""
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"{chr(c)} a{chr(c)}b A{chr(c)} {chr(c)}Z {chr(c)}{chr(c)}" for c in points] + ["", " ., ", "Ünd_w2 É9’s “X”"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", lexical.plain("text").alias("p"), lexical.tokens("text").alias("w")).collect()
    easy = [r for r in rows if r["p"]]
    assert {chr(0x130), "Σ", "́"}.isdisjoint({t[0] for t in (r["text"] for r in easy) if t}) and len(easy) > 600
    vocabulary = pa.array(sorted({w for r in rows for w in r["w"]}))
    batch = pa.RecordBatch.from_arrays([pa.array([str(r["i"]) for r in rows]), pa.array([r["text"] if r["p"] else None for r in rows]), pa.array([None if r["p"] else r["w"] for r in rows], pa.list_(pa.string()))], ["id", "plain", "words"])
    got = {int(x["id"]): (x["length"], [vocabulary[j].as_py() for j in x["words"]]) for b in lexical.numbered(batch, vocabulary) for x in b.to_pylist()}
    assert got == {r["i"]: (len(r["w"]), r["w"]) for r in rows if r["w"]}


def test_only_asked_words_of_passages_are_kept(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(lexical, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    passages = spark.createDataFrame([("p1", "One two, two three"), ("p2", "four"), ("p3", "TWO Ωmega")], CORPUS)
    found = lexical.bm25_runs(spark.createDataFrame([("q", "two ωmega absent")], "query_id string, query string"), passages, 5, [(1.2, 0.75)])
    assert [r["id"] for r in found.orderBy("rank").collect()] == ["p3", "p1"]
    assert {r["id"]: (r["lengths"], len(r["words"])) for r in tables["passage_words"].collect()} == {"p1": ([4], 2), "p2": ([1], 0), "p3": ([2], 2)}


def calls(monkeypatch, module, name) -> list:
    """One entry for each call of the function from now on."""
    made, function = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: made.append(name) or function(*a))
    return made


@pytest.mark.parametrize("name", ["ir_eval_own_index", "hard_negatives"])
def test_kept_rows_are_made_once(spark, folder, monkeypatch, name):
    made, parts = calls(monkeypatch, integrity, "drop_defects"), calls(monkeypatch, splits, "partitioned")
    assert entry.queries()[name](spark, folder).collect()
    assert len(made) == 1 and len(parts) == 1


def test_labels_do_not_rank_listed_negatives(spark, folder, monkeypatch):
    made = calls(monkeypatch, integrity, "clean_edges")
    assert {r["split"] for r in mining.passage_labels(spark, folder).collect()} == {"train", "val", "test", "shared", "unused"}
    assert not made


def test_whole_corpus_is_not_partitioned(spark, folder, monkeypatch):
    made = calls(monkeypatch, splits, "partitioned")
    assert {r["k"] for r in entry.queries()["ir_eval"](spark, folder).collect()} == {1, 5, 10}
    assert not made


def test_texts_of_kept_rows_are_shuffled_only_where_selected(spark, folder):
    plan = cleaning.kept(spark, folder).select("query_id", "pos_id")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"WindowGroupLimit .*\n\W*Project \[query_id#\d+, pos_id#\d+, loaded_at#\d+, md5\(", plan)
