"""The partition run keeps every query that its rules keep, and fills the training lists."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from trelliq.config import PARTITIONS
from trelliq.plans import pipelines
from trelliq.sources import readers
from trelliq.sources.tables import table

MERGED = "query_id string, query string, pos_id string, pos string, neg_id array<string>, loaded_at timestamp_ntz"


#: Queries of one stand-in vector are no near copies here.
ALONE = replace(PARTITIONS, splits=replace(PARTITIONS.splits, near_duplicate_threshold=None))


def lines(folder):
    return [json.loads(line) for f in folder.glob("*.json") for line in f.read_text().splitlines()]


def test_no_query_is_lost_and_training_lists_are_full(spark, tmp_path):
    corpus = spark.createDataFrame([(f"p{i:03}", f"passage {i} with more than eight words in its own text") for i in range(100)], "id string, text string")
    names = [r["id"] for r in corpus.orderBy("id").collect()]
    # One negative each: for most queries it lies in another partition.
    rows = [(f"q{i:03}", f"Subject number {i} in a question of its own?", names[i], "passage text of more than eight words in all of it", [names[(i * 7 + 13) % 100]], None) for i in range(100)]
    merged = spark.createDataFrame(rows, MERGED)
    # Unlike vectors, so that neither the screening nor the cap takes a pair of two rows.
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(199)]) for i in range(199)], "vec_id bigint, embedding array<float>")
    final = {r["query_id"]: r for r in pipelines.run_partitions(spark, corpus, merged, vectors, str(tmp_path / "run"), ALONE).collect()}
    assert set(final) == {r[0] for r in rows}
    part = {r["id"]: r["split"] for r in pipelines.splits.partitioned(corpus, seed=42).collect()}
    place = {r["id"]: r["at"] for r in corpus.select("id", pipelines.similarity.vector_of(F.col("id"), F.lit(199)).alias("at")).union(merged.select("query_id", pipelines.similarity.vector_of(F.col("query_id"), F.lit(199)))).collect()}
    for q, _, pos, _, negs, _ in rows:
        r, own = final[q], [n for n in negs if n != pos and place[n] != place[q]]
        assert r["split"] == part[pos]
        if r["split"] != "train":
            assert r["neg_ids"] == r["neg_ids_uncapped"] == own
            continue
        own = [n for n in own if part[n] == "train"]
        others = sorted(n for n in names if part[n] == "train" and n != pos and n not in own and place[n] != place[q])
        assert r["neg_ids"] == own + others[: 8 - len(own)] and r["neg_ids_uncapped"] == own
    assert len(lines(tmp_path / "run" / "val")) == len(lines(tmp_path / "run" / "test")) == 10


def test_long_evaluation_lists_stay_whole(spark, tmp_path):
    tables = [table(spark, "/root/testdata/sf0.001", n) for n in ("corpus", "merged", "embeddings")]
    rows = pipelines.run_partitions(spark, *tables, str(tmp_path / "run")).collect()
    assert all(len(r["neg_ids"]) == 8 for r in rows if r["split"] == "train")
    assert any(len(r["neg_ids_uncapped"]) > 8 for r in rows if r["split"] != "train") and all(set(r["neg_ids"]) <= set(r["neg_ids_uncapped"]) for r in rows if r["split"] != "train")


def test_a_given_vocabulary_saves_its_queries(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(b"*NEWRECORD\nMH = Quorbitis\nMN = C01.1\n")
    corpus = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(20)], "id string, text string")
    ask = "How did the patient with quorbitis fare"
    rows = [(f"q{i}", f"{ask} in week {i}?", f"p{i}", "passage text of more than eight words in all of it", [f"p{(i + 1) % 20}"], None) for i in range(20)]
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(199)]) for i in range(199)], "vec_id bigint, embedding array<float>")
    run = lambda name, **more: pipelines.run_partitions(spark, corpus, spark.createDataFrame(rows, MERGED), vectors, str(tmp_path / name), ALONE, **more).count()
    assert run("given", terms=readers.vocabulary_file(spark, str(tmp_path / "v.bin"))) == 20
    assert json.loads((tmp_path / "given" / "report.json").read_text())["vocabulary"] == "given"
    with pytest.warns(UserWarning, match="vocabulary"):
        assert run("none") == 0
    assert json.loads((tmp_path / "none" / "report.json").read_text())["vocabulary"] == "example records"


def test_near_queries_stay_in_the_highest_split_only(spark, tmp_path):
    """Copies by vector across splits: the lower end goes, the audit finds none left, and all artifacts are there."""
    tables = [table(spark, "/root/testdata/sf0.001", n) for n in ("corpus", "merged", "embeddings")]
    out = tmp_path / "run"
    with pytest.warns(UserWarning):
        final = pipelines.run_partitions(spark, *tables, str(out)).collect()
    pairs = spark.read.parquet(str(out / "near_pairs")).collect()
    alive = {r["query_id"]: r["split"] for r in final}
    flagged = [r for r in pairs if r["flagged"]]
    assert all(r["similarity"] >= 0.95 and not (r["query_id"] in alive and r["id"] in alive) for r in flagged)
    report = json.loads((out / "report.json").read_text())
    assert {x["check"]: x["violations"] for x in report["audit"]}["near_duplicate_queries_across_splits"] == 0
    (m,) = report["mining"]
    train = [r for r in final if r["split"] == "train"]
    assert m["n_queries"] == len(train) and m["mean_after"] == 8.0 and m["n_short"] == 0 and m["n_mined"] > 0
    records = {r["id"]: r for r in lines(out / "corpus")}
    texts = {r["id"]: r["text"] for r in tables[0].collect()}
    assert set(records) == set(texts) and all(r["text"] == texts[i] and r["split"] in ("train", "val", "test") for i, r in records.items())
    for split in ("train", "val", "test"):
        for r in lines(out / split):
            assert r["pos"] == texts[r["pos_id"]] and r["negs"] == [texts[n] for n in r["neg_ids"]] and r["split"] == split
    assert (out / "sample").is_dir() and "revision" in json.loads((out / "manifest.json").read_text())


def test_component_run_exports_its_passages(spark, tmp_path):
    tables = [table(spark, "/root/testdata/sf0.001", n) for n in ("corpus", "merged", "embeddings")]
    out = tmp_path / "run"
    gazetteer = spark.createDataFrame([("velaromegaly",)], "term string")
    final = pipelines.run_components(spark, *tables, str(out), gazetteer=gazetteer).collect()
    own = {p: r["split"] for r in final for p in r["alt_pos_ids"]}
    used = {n for r in final for n in r["neg_ids_uncapped"]}
    for r in lines(out / "corpus"):
        assert r["split"] == own.get(r["id"], "shared" if r["id"] in used else "unused")
        assert r["token_count"] == len((r["text"] or "").split())
    assert all(set(r["neg_ids"]) <= set(r["neg_ids_uncapped"]) and len(r["negs"]) == len(r["neg_ids"]) for r in final)
    report = json.loads((out / "report.json").read_text())
    assert report["entity_source"] == "gazetteer" and report["deviation"][0]["within"]
    with pytest.raises(pipelines.DatasetIntegrityError):
        pipelines.run_components(spark, *tables, str(tmp_path / "strict"), strict=True)
