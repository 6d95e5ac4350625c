"""Queries that write what runs leave behind (JSON lines, Parquet, CSV, reports, manifests, vectors, settings) and read it again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trelliq import config
from trelliq.functions.encoders import hashed
from trelliq.plans import mining as m
from trelliq.plans import sql as s
from trelliq.plans.cleaning import kept
from trelliq.session import new_place
from trelliq.sources import readers, writers
from trelliq.sources.tables import table

WIDTH = 64


def split_files(spark, folder) -> DataFrame:
    """Kept queries with the partition of their positive."""
    return m.inherited(spark, folder).select("query_id", "query", "split", "pos_id")


def jsonl_round_trip(spark, folder):
    """Query records written as JSON lines in the order of their id, one folder a split, and read with their schema."""
    rows, place = split_files(spark, folder), new_place(spark, "jsonl")
    out = None
    for split in ("train", "val", "test"):
        writers.jsonl(rows.filter(F.col("split") == split), f"{place}-{split}")
        back = readers.jsonl(spark, f"{place}-{split}", readers.SPLIT_RECORD).select("query_id", "query", F.lit(split).alias("split"), "pos_id")
        out = back if out is None else out.unionByName(back)
    return out


def parquet_round_trip(spark, folder):
    """Query records as Parquet in folders by split; a filter on the split reads one folder."""
    place = new_place(spark, "parquet")
    writers.parquet(split_files(spark, folder), place, "split")
    return readers.parquet(spark, place, "query_id string, query string, pos_id string, split string").filter("split = 'val'")


def report_values(spark, folder):
    """(split, n) of a JSON report, as a reader finds it."""
    place = f"{new_place(spark, 'report')}/report.json"
    writers.report({"splits": split_files(spark, folder).groupBy("split").agg(F.count("*").alias("n")), "tags": {"b", "a"}}, place)
    text = spark.read.text(place, wholetext=True)
    parsed = text.select(F.from_json("value", "splits array<struct<split string, n bigint>>").alias("r"))
    return parsed.select(F.explode("r.splits").alias("x")).select("x.split", "x.n")


def manifest_table(spark, folder):
    """(role, name, known) of a manifest of the tables read and one that is missing: whether it names a hash."""
    place = f"{new_place(spark, 'manifest')}/manifest.json"
    inputs = [f"{folder}/{n}.parquet" for n in ("corpus", "merged", "no_such_table")]
    writers.manifest(place, "cleaning", 590, config.COMPONENTS, inputs, [])
    text = spark.read.text(place, wholetext=True)
    hashes = text.select(F.explode(F.from_json("value", "inputs map<string, string>")["inputs"]).alias("path", "hash"))
    return hashes.select(F.lit("input").alias("role"), F.regexp_extract("path", "([^/]+)[.]parquet$", 1).alias("name"), (F.length("hash") == 64).alias("known")).withColumn("known", F.coalesce("known", F.lit(False)))


def settings_table(spark, folder):
    """(preset, run, seed, budget, near_duplicate_threshold) of the presets, written as JSON and loaded again."""
    rows = []
    for preset in (config.COMPONENTS, config.PARTITIONS):
        x = config.settings_from(json.loads(json.dumps(config.as_dict(preset))))
        rows.append((x.name, config.run_name(x), x.seed, x.splits.budget, x.splits.near_duplicate_threshold))
    return spark.createDataFrame(rows, "preset string, run string, seed int, budget int, near_duplicate_threshold double")


def encoded_texts(spark, folder):
    """(n_texts, n_vectors, n_unit, width) of a vector cache that two tables fill one after the other: each text is encoded once."""
    place = new_place(spark, "cache")
    texts = [kept(spark, folder).select(F.col("query").alias("text")), table(spark, folder, "corpus").select("text")]
    writers.cached_vectors(texts[0], place, "hashed", lambda rows: hashed(rows, WIDTH))
    both = texts[0].unionByName(texts[1])
    vectors = readers.vector_width(writers.cached_vectors(both, place, "hashed", lambda rows: hashed(rows, WIDTH)), WIDTH)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stored = spark.read.parquet(f"{place}/hashed").agg(F.count("*").alias("n_vectors"))
    return vectors.agg(F.count("*").alias("n_texts"), F.count_if(F.abs(norm - 1) < 1e-5).alias("n_unit"), F.max(F.size("embedding")).alias("width")).crossJoin(F.broadcast(stored))


QUERIES = {f.__name__: f for f in (jsonl_round_trip, parquet_round_trip, report_values, manifest_table, settings_table, encoded_texts)}
TEXTS = "t AS (SELECT query AS text FROM kept WHERE query IS NOT NULL UNION SELECT text FROM corpus WHERE text IS NOT NULL)"
SQL = {
    "jsonl_round_trip": f"WITH {m.INHERITED} SELECT query_id, query, split, pos_id FROM inh",
    "parquet_round_trip": f"WITH {m.INHERITED} SELECT query_id, query, split, pos_id FROM inh WHERE split = 'val'",
    "report_values": f"WITH {m.INHERITED} SELECT split, count(*) AS n FROM inh GROUP BY 1",
    "manifest_table": "SELECT 'input' AS role, name, known FROM (VALUES ('corpus', true), ('merged', true), ('no_such_table', false)) x(name, known)",
    "settings_table": "SELECT * FROM (VALUES ('components', 'components-seed590-budget8', 590, 8, NULL::DOUBLE), ('partitions', 'partitions-seed42-budget8', 42, 8, 0.95::DOUBLE)) x(preset, run, seed, budget, near_duplicate_threshold)",
    "encoded_texts": f"""WITH {s.KEPT}, {TEXTS} SELECT count(*) AS n_texts, count(*) AS n_vectors, count(*) FILTER (WHERE {s.trimmed("text")} <> '') AS n_unit, {WIDTH} AS width FROM t""",
}
