"""Time the headline queries and print one JSON line.

Each query runs end to end from the raw tables, staged tables included, and its result is
computed in full without being kept.  ``forecast_pass`` alone starts from a stored series:
it is the all-merchant forecast with its summary.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from checks import spark_queries as registered
from tillcast.plans import forecasting

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "daily_fact", "daily_grid", "panel_features", "forecast_summary_by_supplier",
    "monthly_rollup_by_supplier", "metrics_by_split", "baseline_metrics", "target_profile",
    "future_frame",
)


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("tillcast-bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compute(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    registered.QUERIES["daily_fact_imputed"](spark, FOLDER).count()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        compute(registered.QUERIES[name](spark, FOLDER))
        seconds[name] = round(time.perf_counter() - start, 3)
    observed = registered.stored_observed(spark, FOLDER, "supplier")
    start = time.perf_counter()
    compute(forecasting.Forecasts.of(observed, registered.CFG).summary)
    seconds["forecast_pass"] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")),
        "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
