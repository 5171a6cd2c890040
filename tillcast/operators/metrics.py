"""How good forecasts are, in GBP."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillcast.config import Config, MERCHANT
from tillcast.functions.columns import size_band
from tillcast.functions.quantiles import pinball, quantile_name
from tillcast.functions.stats import exact_percentiles, sample_skewness


def _log_error(predicted: Column, actual: Column) -> Column:
    return F.abs(F.log1p(F.greatest(predicted, F.lit(0.0))) - F.log1p(actual))


def _smape_term(predicted: Column, actual: Column) -> Column:
    size = (F.abs(actual) + F.abs(predicted)) / 2
    return F.abs(predicted - actual) / F.greatest(size, F.lit(1e-9))


def _coverage(low: str, high: str) -> Column:
    actual = F.col("actual_gbp")
    return F.avg(((actual >= F.col(low)) & (actual <= F.col(high))).cast("double"))


def forecast_metrics(predictions: DataFrame, keys: Sequence[str] = (), cfg: Config = Config()
                     ) -> DataFrame:
    """All metrics per key: one aggregation, plus a median of absolute errors that does not
    gather them."""
    actual, median = F.col("actual_gbp"), F.col("q50")
    error = median - actual
    loss = F.lit(0.0)
    for level in cfg.quantiles:
        loss = loss + pinball(actual, F.col(quantile_name(level)), level)
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("MAE_gbp"),
        F.sqrt(F.avg(error * error)).alias("RMSE_gbp"),
        F.avg(_log_error(median, actual)).alias("MAE_log"),
        F.when(F.sum(F.abs(actual)) > 0, F.sum(loss) / F.sum(F.abs(actual))).alias("wQL"),
        F.avg(_smape_term(median, actual)).alias("sMAPE"),
        F.avg(error).alias("bias_gbp"),
        # Exact, so that the total does not depend on the order of the rows.
        F.sum(actual.cast("decimal(28,6)")).cast("double").alias("total_actual_gbp"),
        F.sum(median).alias("total_pred_median_gbp"),
        _coverage(quantile_name(cfg.quantiles[0]),
                  quantile_name(cfg.quantiles[-1])).alias("coverage_outer"),
    ]
    inner = (0.1, 0.9)
    measures.append(
        _coverage("q10", "q90").alias("coverage_p10_p90")
        if all(level in cfg.quantiles for level in inner)
        else F.lit(None).cast("double").alias("coverage_p10_p90"))
    keys = list(keys)
    median_error = exact_percentiles(
        predictions.select(*keys, F.abs(error).alias("_error")), "_error", [0.5], keys)
    median_error = median_error.select(*keys, F.col("percentiles")[0].alias("MedAE_gbp"))
    if keys:
        return predictions.groupBy(*keys).agg(*measures).join(median_error, keys)
    return predictions.agg(*measures).withColumn("MedAE_gbp", median_error.scalar())


def baseline_metrics(rows: DataFrame, names: Sequence[str] = ("naive_last", "seasonal_naive")
                     ) -> DataFrame:
    """MAE, RMSE and log MAE, one row for each named baseline even if there is nothing to compare."""
    actual = F.col("actual_gbp")

    def measured(name: str) -> Column:
        error = F.col(name) - actual
        return F.struct(
            F.lit(name).alias("baseline"), F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(error)).alias("MAE_gbp"),
            F.sqrt(F.avg(error * error)).alias("RMSE_gbp"),
            F.avg(_log_error(F.col(name), actual)).alias("MAE_log"))

    return rows.agg(F.array(*[measured(n) for n in names]).alias("_b")).select(F.inline("_b"))


def merchant_level(series: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Mean daily revenue per merchant."""
    return series.groupBy(MERCHANT).agg(F.avg(cfg.raw_target).alias("mean_daily_gbp"))


def metrics_by_band(predictions: DataFrame, series: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Error of the median by merchant size; merchants without revenue have no band."""
    actual, median = F.col("actual_gbp"), F.col("q50")
    banded = merchant_level(series, cfg).select(
        MERCHANT, size_band(F.col("mean_daily_gbp")).alias("band")).where("band IS NOT NULL")
    return predictions.join(banded, MERCHANT).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(median - actual)).alias("MAE_gbp"),
        F.avg(F.abs(F.log1p(median) - F.log1p(actual))).alias("MAE_log"),
        F.avg(_smape_term(median, actual)).alias("sMAPE"))


def target_profile(series: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Level, spread and skew of revenue and of its log, as one row."""
    revenue, level = F.col(cfg.raw_target), F.col(cfg.target)
    median = exact_percentiles(series, cfg.raw_target, [0.5]).select(F.col("percentiles")[0])
    return series.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(revenue).alias("mean_gbp"),
        F.max(revenue).alias("max_gbp"),
        F.avg((revenue == 0).cast("double")).alias("zero_day_share"),
        F.avg(level).alias("mean_log"),
        F.stddev_samp(level).alias("std_log"),
        sample_skewness(level).alias("skew_log"),
        sample_skewness(revenue).alias("skew_gbp"),
    ).withColumn("median_gbp", median.scalar())
