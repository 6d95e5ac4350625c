import json

import pytest
from pyspark.sql import functions as F

from trelliq import config
from trelliq.functions.encoders import hashed
from trelliq.plans import pipelines
from trelliq.sources import readers, writers
from trelliq.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def test_settings(tmp_path):
    assert config.load_settings(str(tmp_path / "none.yaml")) == config.Settings()
    p = tmp_path / "s.yaml"
    p.write_text("seed: 7\nsplits:\n  shares: [0.7, 0.2, 0.1]\n")
    s = config.load_settings(str(p))
    assert s.seed == 7 and s.splits.shares == (0.7, 0.2, 0.1) and s.filters == config.Filters()
    p.write_text("sede: 7\n")
    with pytest.raises(TypeError):
        config.load_settings(str(p))
    (tmp_path / "s.json").write_text(json.dumps(config.as_dict(config.PARTITIONS)))
    assert config.load_settings(str(tmp_path / "s.json")) == config.PARTITIONS


def test_jsonl_round_trip_is_stable(spark, tmp_path):
    df = spark.createDataFrame([("b", "é", None), ("a", "x\ny", ["n1", None])], "query_id string, query string, neg_id array<string>")
    texts = []
    for n in (1, 4):
        writers.jsonl(df.repartition(n), str(tmp_path / str(n)), files=1)
        (file,) = (tmp_path / str(n)).glob("*.json")
        texts.append(file.read_bytes())
    assert texts[0] == texts[1] and texts[0].startswith(b'{"query_id":"a"') and "é".encode() in texts[0] and b'"neg_id":null' in texts[0]
    back = readers.jsonl(spark, str(tmp_path / "1"), readers.SPLIT_RECORD)
    assert {r["query_id"]: r["neg_id"] for r in back.collect()} == {"a": ["n1", None], "b": None}


def test_csv_parquet_and_labels(spark, tmp_path):
    df = spark.createDataFrame([("q1", 'a "b", c\nd', "true", "1"), ("q2", "x", "false", None)], readers.LABELS)
    writers.csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.labels_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, df.collect()))
    writers.parquet(df, str(tmp_path / "p"), by="predicted")
    assert (tmp_path / "p" / "predicted=true").is_dir()
    assert readers.parquet(spark, str(tmp_path / "p"), readers.LABELS).count() == 2


def test_vocabulary_and_gazetteer_files(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(b"*NEWRECORD\r\nMH = Abc, Def\r\nMN = C01.1\r\nENTRY = Ghi \xff|T|x\r\n*NEWRECORD\nMN = C02\n*NEWRECORD\nMH = Pain\nENTRY = Ache\n")
    terms = {r["term"]: r["tree_numbers"] for r in readers.vocabulary_file(spark, str(tmp_path / "v.bin")).collect()}
    assert set(terms) == {"abc, def", "def abc", "ghi �"} and terms["def abc"] == ["C01.1"]
    (tmp_path / "g.txt").write_text(f"Velaromegaly\n abc \n\nvelaromegaly \nFollow-Up\nfollow up\n")
    assert [r["term"] for r in readers.gazetteer(spark, str(tmp_path / "g.txt")).collect()] == ["velaromegaly"]


def test_guards(spark):
    df = spark.range(3)
    assert readers.checked_count(df, "x", 3) is df and readers.checked_count(df, "x", None) is df
    with pytest.raises(config.DatasetIntegrityError):
        readers.checked_count(df, "x", 4)
    with pytest.warns(UserWarning):
        readers.checked_count(df, "x", 4, strict=False)
    own, histogram = readers.graded(spark.createDataFrame([("q", "d", 2), ("q", "e", 7)], readers.QRELS))
    assert own.columns == ["query_id", "id", "grade"] and {r["grade"]: r["known"] for r in histogram.collect()} == {2: True, 7: False}
    with pytest.raises(config.DatasetIntegrityError):
        readers.vector_width(table(spark, SMALL, "embeddings"), 63)
    readers.vector_width(table(spark, SMALL, "embeddings"), 64)


def test_manifest_report_and_rights(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    first = writers.manifest(str(tmp_path / "m.json"), "phase", 1, config.COMPONENTS, [str(tmp_path / "in")], [str(tmp_path / "gone")])
    (tmp_path / "in" / "a.txt").write_text("b")
    assert writers.path_hash(str(tmp_path / "in")) != first["inputs"][str(tmp_path / "in")] and first["outputs"] == {str(tmp_path / "gone"): None}
    writers.report({"s": {3, 1}, "p": tmp_path, "df": spark.range(2)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"s": [1, 3], "p": str(tmp_path), "df": [{"id": 0}, {"id": 1}]}
    writers.set_readonly(str(tmp_path / "in"))
    assert not (tmp_path / "in" / "a.txt").stat().st_mode & 0o222
    writers.set_readonly(str(tmp_path / "in"), False)
    (tmp_path / "in" / "a.txt").write_text("c")


def test_a_session_off_local_mode_needs_a_shared_folder():
    from types import SimpleNamespace

    from trelliq import session

    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    own = SimpleNamespace(conf=SimpleNamespace(get=lambda *x: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(own)


def test_written_tables_are_bucketed_and_deleted(spark, tmp_path):
    from trelliq.session import delete, discard, hadoop_path, written

    df = written(spark.range(100).withColumn("k", F.col("id") % 7), "t", "k", 4)
    plan = df.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and df.count() == 100
    discard(df)
    files, where = hadoop_path(spark, df._trelliq_table)
    assert not files.exists(where)
    (tmp_path / "x").write_text("x")
    delete(spark, f"file://{tmp_path}/x")
    delete(spark, f"file://{tmp_path}/x")
    assert not (tmp_path / "x").exists()


def test_places_by_uri(spark, tmp_path):
    uri = f"file://{tmp_path}"
    writers.report({"a": 1}, f"{uri}/deep/r.json")
    assert json.loads((tmp_path / "deep" / "r.json").read_text()) == {"a": 1}
    assert writers.path_hash(f"{uri}/deep") == writers.path_hash(str(tmp_path / "deep")) != writers.path_hash(f"{uri}/none") is None
    assert writers.revision(str(tmp_path)) == "unknown"


def test_freeze(spark, tmp_path):
    table(spark, SMALL, "corpus").write.parquet(str(tmp_path / "corpus.parquet"))
    with pytest.raises(config.DatasetIntegrityError):
        pipelines.freeze(spark, str(tmp_path), {"corpus": 5}, str(tmp_path / "out"))
    made = pipelines.freeze(spark, str(tmp_path), {"corpus": 108}, str(tmp_path / "out"))
    assert list(made["inputs"].values())[0] and not (tmp_path / "corpus.parquet").stat().st_mode & 0o222
    writers.set_readonly(str(tmp_path / "corpus.parquet"), False)


def test_retrieval_folder(spark, tmp_path):
    spark.createDataFrame([("d1", "x"), ("d2", "y")], "id string, text string").write.json(str(tmp_path / "corpus"))
    spark.createDataFrame([("q1", "x")], "id string, text string").write.json(str(tmp_path / "queries"))
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d2", 5)], readers.QRELS)
    qrels.write.option("header", True).option("sep", "\t").csv(str(tmp_path / "qrels"))
    with pytest.warns(UserWarning, match="grades"):
        corpus, queries, judged = readers.retrieval_folder(spark, str(tmp_path), 2, 1)
    assert (corpus.count(), queries.count(), judged.columns) == (2, 1, ["query_id", "id", "grade"])
    with pytest.raises(config.DatasetIntegrityError):
        readers.retrieval_folder(spark, str(tmp_path), 3)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_vectors_are_encoded_once(spark, tmp_path, scheme):
    seen = []

    def encode(missing):
        seen.append(missing.count())
        return hashed(missing, 8)

    a = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "text string")
    assert writers.cached_vectors(a, f"{scheme}{tmp_path}", "m", encode).count() == 2
    assert writers.cached_vectors(a.union(spark.createDataFrame([("z",)], "text string")), f"{scheme}{tmp_path}", "m", encode).count() == 3
    assert seen == [2, 1]


@pytest.mark.parametrize("name", ["components", "partitions"])
def test_pipelines(spark, tmp_path, name):
    tables = [table(spark, SMALL, n) for n in ("corpus", "merged", "embeddings")]
    run = pipelines.run_components if name == "components" else pipelines.run_partitions
    final = run(spark, *tables, str(tmp_path / name))
    rows = final.collect()
    assert rows and len({r["query_id"] for r in rows}) == len(rows) and all(1 <= len(r["neg_ids"]) <= 8 and r["pos_id"] not in r["neg_ids"] for r in rows)
    by_pos = final.select(F.explode("alt_pos_ids").alias("p"), "split").groupBy("p").agg(F.countDistinct("split").alias("n"))
    assert by_pos.filter("n > 1").count() == 0
    report = json.loads((tmp_path / name / "report.json").read_text())
    assert sum(r["count"] for r in report["splits"]) == len(rows) and (tmp_path / name / "manifest.json").exists()
    ledger = spark.read.csv(str(tmp_path / name / "ledger"), header=True, inferSchema=True).orderBy("seq").collect()
    for unit in ("queries", "pairs"):
        own = [r for r in ledger if r["unit"] == unit]
        assert own[0]["remaining"] - sum(r["removed"] for r in own) == own[-1]["remaining"]
