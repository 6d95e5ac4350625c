import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trelliq.operators.skew import heavy_keys, key_figures, key_percentiles, value_ranges, weighted_values


def sample(seed):
    """A third of all rows have one key; nulls, ties and repeats everywhere."""
    r = random.Random(seed)
    keys = ["hot"] * 300 + [None] * 30 + [f"k{r.randrange(40)}" for _ in range(570)]
    return [(k, r.choice((None, *(f"v{n}" for n in range(25))))) for k in keys] + [("single", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_figures(spark, seed):
    data = sample(seed)
    df = spark.createDataFrame(data, "k string, v string").withColumn("key", F.lit(1)).withColumn("weight", F.lit(1)).repartition(5)
    by = defaultdict(list)
    for k, v in data:
        if k is not None:
            by[k].append(v)
    want = {}
    for k, vs in by.items():
        c = Counter(v for v in vs if v is not None)
        mode = min((v for v in c if c[v] == max(c.values())), default=None)
        want[k] = (len(vs), len(c), mode, c[mode] if c else 0)
    assert {r["key"]: tuple(r)[1:] for r in key_figures(df, "k", "v").collect()} == want
    n = sum(map(len, by.values()))
    assert {tuple(r) for r in heavy_keys(df, "k", "v", 0.05).collect()} == {(k, len(v)) for k, v in by.items() if len(v) >= 0.05 * n}


@pytest.mark.parametrize("coarse", [1, 3, 32])
def test_percentiles(spark, coarse):
    r = random.Random(coarse)
    data = [("hot", r.choice((r.gauss(0, 1), 0.25, None))) for _ in range(500)] + [("one", 3.0), ("none", None), (None, 1.0)] + [("tie", 2.0)] * 9 + [("hot", 1e300), ("hot", -1e300), ("one", 3.0)] + [(f"k{n % 9}", r.random() * 1e6) for n in range(200)]
    df = spark.createDataFrame(data, "a string, b double").withColumn("bucket", F.lit(1)).repartition(4)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    by = defaultdict(list)
    for k, v in data:
        if k is not None and v is not None:
            by[k].append(v)
    found = {(x["key"], x["share"]): x["percentile"] for x in key_percentiles(df, "a", "b", shares, coarse).collect()}
    assert set(found) == {(k, s) for k in by for s in shares}
    for (k, s), v in found.items():
        assert v == pytest.approx(np.percentile(by[k], s * 100), rel=1e-12, abs=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert key_figures(df, "k", "v").count() == 0 and heavy_keys(df, "k", "v", 0.1).count() == 0 and key_percentiles(df, "k", "v", [0.5]).count() == 0


def tasks(df, *by):
    """Rows in each of 8 tasks after a shuffle by columns."""
    return [n for _, n in sorted((r["p"], r["count"]) for r in df.repartition(8, *by).groupBy(F.spark_partition_id().alias("p")).count().collect())]


def test_a_hot_key_and_an_outlier_burden_no_task(spark):
    """A third of the rows on one key, one value far out: no task gets twice the median rows, without adaptive help."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 120_000
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.xxhash64("id") % 500))
        df = spark.range(n).select(key.alias("k"), F.when(F.col("id") == 0, 1e12).otherwise((F.xxhash64("id", F.lit(1)) % 1000000) / 1e6).alias("v"))
        w = weighted_values(df, "k", "v").withColumn("value", F.col("value").cast("double"))
        for by in (("key", "value"), ("key", "bucket")):
            sizes = tasks(value_ranges(w, "value"), *by)
            assert len(sizes) == 8 and max(sizes) < 2 * np.median(sizes)
        buckets = [r["count"] for r in value_ranges(w, "value").filter("key = 'hot'").groupBy("bucket").count().collect()]
        assert len(buckets) > 900 and max(buckets) < 4 * np.median(buckets)
        plan = key_figures(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("HashAggregate") + plan.count("SortAggregate") == 4
        assert key_figures(df, "k", "v").filter("key = 'hot'").first()["n_rows"] == n // 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
