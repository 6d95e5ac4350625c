import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trelliq.llm.bloom import PARTS, Layout, Merged, Seen, has, merged_filter, positions, range_of, repeated
from trelliq.llm.mixing import mix
from trelliq.llm.tokens import TOKENIZERS, BytePairTrie, encoder, token_ids
from trelliq.sources.tables import table

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def official():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  \t x", "<|endoftext|> a<|endoftext|>", "I'll we've 'S 's", "naïve ﬁ ½ ² 𝛼 𝟗", "漢字かな" * 40, "👩🏽‍⚕️‍", "\u0000\u0007\u001b", "﻿a‮b", "a" * 100_000, "word " * 50_000, "ab" * 999,
       "=" * 300, " " * 257, "é" * 100, "é" * 50, "1234567890" * 20, "Zx-9_Q " * 30]


def test_odd_texts(official):
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder(PATH).encode([*ODD, None])] == [*map(official, ODD), []]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json") if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    t.encode_special_tokens = True
    assert np.frombuffer(encoder(PATH).encode([text])[0], np.int32).tolist() == t.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(official):
    own = BytePairTrie(encoder(PATH).ranks, max_words=5)
    texts = [f"word{i} again and again {i}" for i in range(50)]
    assert [np.frombuffer(own.encode([t])[0], np.int32).tolist() for t in texts] == [official(t) for t in texts]


def test_frame(spark, official):
    texts = [*ODD, None, ODD[3]]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc bigint, body string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(1))
    found = sorted((r["doc"], r["ids"]) for r in token_ids(df.repartition(3), "doc", "body").collect())
    assert found == sorted((i % 7, official(t) if t else []) for i, t in enumerate(texts))
    assert token_ids(df.limit(0), "doc", "body").count() == 0


def test_tables(spark, official):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r["doc_id"]: official(r["text"]) if r["text"] else [] for r in docs.collect()}
    assert {r["doc_id"]: r["ids"] for r in token_ids(docs, "doc_id", "text").collect()} == want


def documents(spark, r, sizes):
    rows = [(n, s, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 60)))) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    rows += [(9001, "a", None), (9002, "a", ""), (9003, None, "lost text"), (9004, "untargeted", "b c d")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("n_tokens", F.lit(-1)).withColumn("expected", F.lit("x"))


def test_mixture_meets_shares_and_caps(spark):
    df = documents(spark, random.Random(1), {"a": 900, "b": 300, "c": 40})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 9), (None, 0.2, 1)], "source string, target_share double, max_passes int")
    mixture, report = mix(df.repartition(5), targets)
    rows = mixture.collect()
    uses = {}
    for r in rows:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["copy_no"])
    caps = {"a": 1, "b": 2, "c": 4}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= caps[s] for (s, _), c in uses.items())
    assert not {9001, 9002, 9003, 9004} & {d for _, d in uses}
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"a", "b", "c", "none"} and by["none"]["n_tokens"] == 0
    total = sum(r["n_tokens"] for r in rows)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        got = sum(r["n_tokens"] for r in rows if r["source"] == s)
        assert got == by[s]["n_tokens"] and abs(by[s]["actual_share"] - got / total) < 1e-12
        assert abs(got / total - share / 0.9) < 0.01
    again = mix(df.repartition(2), targets)[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixture_of_a_given_size_stops_at_caps(spark):
    df = documents(spark, random.Random(2), {"a": 500, "c": 10})
    targets = spark.createDataFrame([("a", 0.5, 3), ("c", 0.5, 2)], "source string, target_share double, max_passes int")
    report = {r["source"]: r for r in mix(df, targets, total_tokens=20_000)[1].collect()}
    assert report["c"]["n_tokens"] == 2 * report["c"]["available_tokens"]
    assert abs(report["a"]["n_tokens"] - 10_000) < 150


def test_mixture_of_nothing(spark):
    df = documents(spark, random.Random(2), {"a": 5})
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_passes int")
    assert mix(df.limit(0), targets)[0].count() == 0
    assert mix(df, targets.limit(0))[0].count() == 0
    assert mix(df, targets.limit(0))[1].count() == 0


def build(hashes, layout, parts, tmp_path, spark):
    rows = [r for k in np.array_split(hashes, parts) for b in (lambda s: [*s.add(k), *s.rest()])(Seen(layout)) for r in b.to_pylist()]
    return merged_filter(spark.createDataFrame([(r["range"], r["hashes"], r["counts"]) for r in rows], PARTS), layout)


@pytest.mark.parametrize("n", [1, 1000, 100_000])
def test_the_filter_never_forgets_and_lets_few_through(spark, tmp_path, n):
    r = np.random.default_rng(n)
    hashes = r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    again = hashes[: n // 10 + 1]
    layout = Layout.of(n + len(again), 1 << 16)
    assert layout.ranges * layout.bits >= 12 * n
    folder = build(np.r_[hashes, again], layout, 7, tmp_path, spark)
    assert repeated(folder, layout, again).all()
    if n > 1:
        assert repeated(folder, layout, hashes[len(again) :]).mean() < 0.05


def test_the_filter_follows_the_number_of_hashes():
    """Hashes a thousand times the bits of one range: unique ones still stay out, for the bits follow the hashes."""
    bits, n = 1 << 10, 1000 << 10
    layout = Layout.of(n, bits)
    assert layout.bits <= bits and layout.ranges > 10_000
    hashes = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    ranges = range_of(hashes, layout)
    order = np.argsort(ranges, kind="stable")
    passed = seen = 0
    for own in np.split(order, np.flatnonzero(np.diff(ranges[order])) + 1)[::5]:
        merged = Merged(layout)
        for part in np.array_split(hashes[own], 9):
            merged.add(pa.array([part.tobytes()]), pa.array([np.full(len(part), 65537, np.uint32).tobytes()]))
        passed += int(has(merged.twice, positions(hashes[own], layout.bits)).sum())
        seen += len(own)
    assert seen > 100_000 and passed / seen < 0.05


def test_lots_of_one_partition_count_as_met_again():
    layout = Layout.of(100)
    own = Seen(layout, lot=10)
    batches = [b for k in range(4) for b in own.add(np.arange(8, dtype=np.int64) if k % 2 else np.arange(100 + k, 108 + k, dtype=np.int64))] + list(own.rest())
    merged = Merged(layout)
    for b in batches:
        merged.add(b.column(1), b.column(2))
    assert len(batches) > 1 and has(merged.twice, positions(np.arange(8), layout.bits)).all()


def test_ranges_are_read_where_files_cannot_be_mapped(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from trelliq.llm import bloom

    hashes = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 60_000, dtype=np.int64)
    layout = Layout.of(len(hashes) * 2, 1 << 16)
    folder = build(np.r_[hashes, hashes[:500]], layout, 3, tmp_path, spark)
    mapped = repeated(folder, layout, hashes)
    reader = bloom.RangeFiles(folder)
    reader.files, reader.path = fs.SubTreeFileSystem("/", fs.LocalFileSystem()), reader.path.lstrip("/")
    monkeypatch.setitem(bloom._opened, folder, reader)
    assert (repeated(folder, layout, hashes) == mapped).all() and mapped[:500].all()
    assert layout.ranges > bloom.KEEP >= sum(x is not None for x in reader.ranges.values())
