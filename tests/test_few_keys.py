"""Exact percentiles of few keys: no task gets the whole column of a key."""

from pyspark.sql import functions as F

from tillcast.functions.stats import exact_percentiles


def test_values_of_few_keys_are_not_exchanged_by_key(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 3).cast("string").alias("k"),
                                    (F.col("id") % 997).cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "rows"))
    got = exact_percentiles(spark.read.parquet(str(tmp_path / "rows")), "v", [0.1, 0.5, 0.9], ["k"])
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    wanted = {r.k: r.p for r in rows.groupBy("k").agg(
        F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    assert {r.k: r.percentiles for r in got.collect()} == wanted
