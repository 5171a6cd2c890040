"""Sinks: every one is a distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillcast.config import Config, DATE, MERCHANT
from tillcast.operators.forecast import report_columns

ROWS_PER_FILE = 1_000_000


def write_fact(fact: DataFrame, path: str) -> None:
    """Parquet snapshot of the merchant-day fact."""
    fact.write.mode("overwrite").parquet(path)


def write_predictions(predictions: DataFrame, path: str, format: str = "parquet") -> None:
    """Tidy predictions, in one folder per part when they name one."""
    writer = predictions.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    if "part" in predictions.columns:
        writer = writer.partitionBy("part")
    writer.save(path)


def write_forecasts(table: DataFrame, path: str, cfg: Config = Config()) -> None:
    """One CSV per merchant, in folders ``merchant_id=<id>``.

    All of a merchant's rows meet in one task (a horizon each), so each folder gets
    one file and the tasks write side by side.
    """
    (report_columns(table, cfg).repartition(MERCHANT).sortWithinPartitions(MERCHANT, "date")
     .write.mode("overwrite").partitionBy(MERCHANT).option("header", True).csv(path))


def write_summary(summary: DataFrame, path: str) -> None:
    """The forecast summary by expected total, largest first."""
    (summary.orderBy(F.desc("horizon_total_expected_gbp"), MERCHANT)
     .write.mode("overwrite").option("header", True).csv(path))


def write_consolidated(forecasts: DataFrame, path: str) -> None:
    """All delivered forecasts in one table, the merchant first, in the fixed column order."""
    (forecasts.select(MERCHANT, "time_idx", F.col(DATE).alias("date"), "q35", "q50", "q65",
                      "expected_gbp")
     .write.mode("overwrite").option("header", True)
     .option("maxRecordsPerFile", ROWS_PER_FILE).csv(path))


def write_rollup(months: DataFrame, path: str) -> None:
    months.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Evaluation and run totals as JSON lines."""
    metrics.write.mode("overwrite").json(path)
