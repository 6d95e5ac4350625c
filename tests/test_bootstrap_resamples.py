"""The registered bootstrap draws the 10,000 resamples that its specification asks for."""

from pyspark.sql import functions as F

from trelliq.operators import metrics


def test_p_resolves_to_a_ten_thousandth(spark):
    a = spark.range(20).select(F.col("id").cast("string").alias("query_id"), (F.col("id") % 2 - 0.2).alias("ndcg"))
    b = a.select("query_id", F.lit(0.0).alias("ndcg"))
    found, same = metrics.paired_bootstrap(a, b, "ndcg").first(), metrics.paired_bootstrap(a, b, "ndcg", 10000).first()
    fewer = metrics.paired_bootstrap(a, b, "ndcg", 1000).first()
    assert found == same != fewer and 0 < found["p"] < 1 and abs(found["p"] * 5000 - round(found["p"] * 5000)) < 1e-6
