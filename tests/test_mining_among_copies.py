"""The top-up finds its rows behind any number of near copies of a query, and counts what it rejects."""

import numpy as np
from pyspark.sql import functions as F

from trelliq.operators import similarity
from trelliq.plans import mining


def test_copies_do_not_use_up_the_candidates(spark):
    v = np.random.default_rng(0).normal(size=(100, 16))
    v[1:41] = v[0] + 0.001 * v[1:41]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, "train", v[i].tolist()) for i in range(100)], "vec_id bigint, split string, embedding array<float>").repartition(3)
    sims = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 9)
    asked = df.filter("vec_id % 50 = 0")
    taken = spark.createDataFrame([(0, 0), (0, 60), (50, 50), (50, 99), (50, 98)], "query_id bigint, id bigint")
    found = similarity.top_matches(asked, df, 3, below=0.95, without=taken).orderBy("query_id", F.desc("similarity"), "id").collect()
    out = {0: {0, 60}, 50: {50, 98, 99}}
    for q in (0, 50):
        want = [i for i in sorted(range(100), key=lambda i: (-sims[q, i], i)) if i not in out[q] and sims[q, i] < 0.95][:3]
        assert [r["id"] for r in found if r["query_id"] == q] == want
    counts = dict(map(tuple, similarity.count_at_least(asked, df, 0.95, taken).collect()))
    assert counts == {q: int((sims[q] >= 0.95).sum() - sum(sims[q, i] >= 0.95 for i in out[q])) for q in (0, 50) if (sims[q] >= 0.95).sum() - sum(sims[q, i] >= 0.95 for i in out[q])}


def test_lists_are_filled_from_the_training_partition(spark):
    small = "/root/testdata/sf0.01"
    rows = mining.mine_negatives(spark, small).collect()
    part = {r["id"]: r["split"] for r in mining.partition(spark, small).collect()}
    by = {}
    for r in rows:
        assert part[r["id"]] == "train"
        by.setdefault(r["query_id"], []).append(r)
    assert by and all(sorted(x["rank"] for x in own) == list(range(1, 9)) and len({x["id"] for x in own}) == 8 for own in by.values())
    assert any(x["mined"] for own in by.values() for x in own) and any(not x["mined"] for own in by.values() for x in own)
