"""Quantile forecasts and their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast.config import Config, DATE, MERCHANT, TIME
from tillcast.functions import quantiles as q
from tillcast.functions.columns import gbp_from_log
from tillcast.operators import panel as pnl

_KEY = (MERCHANT, "origin_time_idx")


def _weekday_quantiles(encoder: DataFrame, cfg: Config) -> DataFrame:
    """Empirical quantiles of the log target per origin and weekday, set out by step.

    Days of one weekday share their index modulo 7.  A group holds at most a seventh of
    an encoder.  Each group then lists the steps that fall on its weekday, so there is
    no join back to the decoder.
    """
    levels = F.array(*[F.lit(level) for level in cfg.quantiles])
    per_weekday = (
        encoder.withColumn("_phase", F.pmod(TIME, F.lit(7)))
        .groupBy(*_KEY, "_phase").agg(F.percentile(cfg.target, levels).alias("q_log")))
    first = F.pmod(F.col("_phase") - F.col("origin_time_idx"), F.lit(7)) + 1
    step = F.explode(F.sequence(first, F.lit(cfg.horizon).cast("long"), F.lit(7).cast("long")))
    return (per_weekday.where(first <= cfg.horizon).withColumn("step", step)
            .select(*_KEY, F.col("step").cast("int").alias("step"),
                    (F.col("origin_time_idx") + F.col("step") - 1).alias(TIME), "q_log"))


def forecast(series: DataFrame, origins: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Quantiles of the log target for each step of each origin:
    ``(merchant_id, origin_time_idx, step, time_idx, q_log)``."""
    return _weekday_quantiles(pnl.encoder_rows(series, origins, [cfg.target]), cfg)


def forecast_part(series: DataFrame, part: str, cfg: Config = Config(),
                  max_t: Column | None = None) -> DataFrame:
    """The same for the origins of an evaluation part, from windows instead of a join.

    Such origins lie inside the dense series, which has a target on every day.  A day's window
    holds the same weekday of the weeks up to it, at most a seventh of an encoder.  It serves the
    steps that fall on its weekday from the origins of the seven days behind it, so each day
    looks for those among the part's origins.  Days too early for the part's encoders are left
    out before the window.
    """
    split = pnl.Split(series, cfg, max_t=max_t)
    after = {"validation": split.sel_cutoff, "holdout": split.val_cutoff}
    reach = series if part not in after else series.where(
        F.col(TIME) > after[part] - cfg.max_encoder_length)
    weeks = W.partitionBy(MERCHANT, F.pmod(TIME, F.lit(7))).orderBy(TIME)
    past = F.collect_list(cfg.target).over(weeks.rowsBetween(-(cfg.max_encoder_length // 7), 0))
    # The last day before origin o on the weekday of step s is day o + s - 8.
    step = F.explode(F.sequence(F.lit(1), F.lit(min(7, cfg.horizon))))
    served = (reach.withColumn("_past", past).withColumn("_first", step)
              .withColumn(TIME, F.col(TIME) + 8 - F.col("_first")))
    inside = F.floor((F.lit(cfg.max_encoder_length - 8) + F.col("_first")) / 7).cast("int") + 1
    parted = (pnl.window_origins(served, part, cfg, max_t=split.max_t, keep=["_past", "_first"])
              .where(inside > 0)
              .select(*_KEY, "_first", F.sort_array(F.when(
                  F.size("_past") > inside, F.slice("_past", -inside, inside)).otherwise(
                  F.col("_past"))).alias("_values")))
    step = F.explode(F.sequence(F.col("_first"), F.lit(cfg.horizon), F.lit(7)))
    return (parted.select(*_KEY, "_first", F.array(*[
                q.of_sorted(F.col("_values"), level) for level in cfg.quantiles]).alias("q_log"))
            .select(*_KEY, step.alias("step"), "q_log")
            .select(*_KEY, "step", (F.col("origin_time_idx") + F.col("step") - 1).alias(TIME),
                    "q_log"))


def forecast_latest(series: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The same for every merchant's newest origin, in one job and without a join.

    The encoder is the tail of the series, which each row can tell by itself.  Merchants
    with too little history give no rows.
    """
    days = F.col("series_last_idx") - F.col("series_start_idx") + 1
    tail = series.where((F.col("series_last_idx") - F.col(TIME) < cfg.max_encoder_length)
                        & (days >= cfg.min_encoder_length))
    encoder = tail.withColumn("origin_time_idx", F.col("series_last_idx") + 1)
    return _weekday_quantiles(encoder, cfg)


def to_gbp(predictions: DataFrame) -> DataFrame:
    """Replace the log quantiles by money, never below zero."""
    return predictions.withColumn(
        "q_gbp", F.transform("q_log", lambda x: gbp_from_log(x))).drop("q_log")


def forecast_table(predictions: DataFrame, first_day: Column, cfg: Config = Config()) -> DataFrame:
    """Money quantiles in ascending order, their expected value, the date, and how many
    neighbouring levels were out of order before sorting."""
    n = len(cfg.quantiles)
    table = to_gbp(predictions)
    table = table.withColumn("crossings", q.crossings(F.col("q_gbp"), n))
    table = table.withColumn("q_gbp", q.rearranged(F.col("q_gbp")))
    return table.select(
        *_KEY, "step", TIME, F.date_add(first_day, F.col(TIME).cast("int")).alias("date"),
        *q.level_columns(F.col("q_gbp"), cfg.quantiles, cfg.quantiles),
        q.expected_value(F.col("q_gbp"), cfg.quantiles).alias("expected_gbp"), "crossings")


def report_columns(table: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The columns of a delivered forecast file, in order, with the merchant first."""
    return table.select(MERCHANT, TIME, "date",
                        *[q.quantile_name(x) for x in cfg.report_quantiles], "expected_gbp")


def tidy_predictions(predictions: DataFrame, series: DataFrame, cfg: Config = Config()
                     ) -> DataFrame:
    """Predictions beside the actual revenue of their day, quantiles left as forecast."""
    actual = series.select(MERCHANT, TIME, DATE, gbp_from_log(F.col(cfg.target)).alias("actual_gbp"))
    joined = to_gbp(predictions).join(actual, [MERCHANT, TIME])
    extra = [c for c in ("part",) if c in predictions.columns]
    return joined.select(
        *extra, *_KEY, TIME, "step", DATE, "actual_gbp",
        *q.level_columns(F.col("q_gbp"), cfg.quantiles, cfg.quantiles),
        q.expected_value(F.col("q_gbp"), cfg.quantiles).alias("expected_gbp"))


def dates_missing(table: DataFrame, frame: DataFrame) -> DataFrame:
    """Forecast days that the frame holding history and future has no date for."""
    return table.join(frame.select(MERCHANT, TIME), [MERCHANT, TIME], "left_anti")


def missing_forecasts(series: DataFrame, table: DataFrame) -> DataFrame:
    """Merchants of the panel without any forecast, with their days of history."""
    days = series.groupBy(MERCHANT).agg(F.count(F.lit(1)).alias("history_days"))
    return days.join(table.select(MERCHANT).distinct(), MERCHANT, "left_anti")
