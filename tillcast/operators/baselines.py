"""Naive forecasts to compare with, on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast.config import Config, MERCHANT, TIME

SEASONAL_WEEKS = 4


def baseline_anchors(series: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per day as the last observed one: its revenue, and for each of the 7 days ending
    there the mean over it and the same weekday of the 3 weeks before.

    The series is dense, so lags are exact days; days before its start count as zero.
    """
    by_time = W.partitionBy(MERCHANT).orderBy(TIME)
    revenue = F.col(cfg.raw_target)
    total = revenue
    for week in range(1, SEASONAL_WEEKS):
        total = total + F.lag(revenue, 7 * week, 0.0).over(by_time)
    seasonal = series.select(MERCHANT, TIME, revenue.alias("naive_last"),
                             (total / SEASONAL_WEEKS).alias("_seasonal"))
    recent = F.array(F.col("_seasonal"),
                     *[F.lag("_seasonal", back, 0.0).over(by_time) for back in range(1, 7)])
    return seasonal.select(MERCHANT, TIME, "naive_last", recent.alias("seasonal"))


def with_baselines(predictions: DataFrame, series: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``naive_last`` and ``seasonal_naive`` to rows of ``(merchant, origin, step)``.

    The seasonal value looks back from the last observed day to the step's weekday:
    ``(-step) mod 7`` days before it.
    """
    anchors = baseline_anchors(series, cfg).select(
        MERCHANT, (F.col(TIME) + 1).alias("origin_time_idx"), "naive_last", "seasonal")
    back = F.pmod(-F.col("step"), F.lit(7)).cast("int")
    joined = predictions.join(anchors, [MERCHANT, "origin_time_idx"], "left")
    return joined.withColumns({
        "naive_last": F.coalesce("naive_last", F.lit(0.0)),
        "seasonal_naive": F.coalesce(F.get("seasonal", back), F.lit(0.0)),
    }).drop("seasonal")


def validation_baseline_error(series: DataFrame, origins: DataFrame, cfg: Config = Config()
                              ) -> DataFrame:
    """Last-value error in log space over all decoder days of the given origins."""
    target = series.select(MERCHANT, TIME, cfg.target)
    last = target.select(MERCHANT, (F.col(TIME) + 1).alias("origin_time_idx"),
                         F.col(cfg.target).alias("_last"))
    with_last = origins.select(MERCHANT, "origin_time_idx").join(last, [MERCHANT, "origin_time_idx"])
    rows = with_last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))))
    rows = rows.withColumn(TIME, F.col("origin_time_idx") + F.col("step") - 1)
    return rows.join(target, [MERCHANT, TIME]).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("_last") - F.col(cfg.target))).alias("mae_log"))
