"""Actuals and forecasts rolled up to merchant-months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillcast.config import Config, DATE, MERCHANT, REPAIR_CAPS
from tillcast.functions.columns import snap_to_zero

LEVELS = tuple(REPAIR_CAPS)


def _daily(level: str) -> str:
    return f"daily_expected_{level}"


def last_activity(actuals: DataFrame) -> DataFrame:
    return actuals.groupBy(MERCHANT).agg(F.max(DATE).alias("last_date"))


def inactive_merchants(actuals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Merchants last seen more than a week before the newest day of all."""
    newest = actuals.agg(F.max(DATE)).scalar()
    return last_activity(actuals).where(
        F.datediff(newest, "last_date") > cfg.inactive_after_days)


def drop_inactive(frame: DataFrame, inactive: DataFrame) -> DataFrame:
    """Anti join: a merchant the actuals never had is kept."""
    return frame.join(inactive.select(MERCHANT), MERCHANT, "left_anti")


def repaired(level: str) -> Column:
    """A quantile put right against the expectation.

    Zero becomes the expectation; a quantile the expectation exceeds by the level's cap
    or more becomes the mean of the two.
    """
    value, expected = F.col(level), F.col("expected_gbp")
    return (F.when(value == 0, expected)
            .when(F.try_divide(expected, value) >= REPAIR_CAPS[level], (expected + value) / 2)
            .otherwise(value))


def repair_forecasts(forecasts: DataFrame) -> DataFrame:
    return forecasts.select(DATE, MERCHANT, *[repaired(x).alias(_daily(x)) for x in LEVELS])


def actual_levels(actuals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Actual revenue in the place of all three levels."""
    revenue = F.col(cfg.raw_target).cast("double")
    return actuals.select(DATE, MERCHANT, *[revenue.alias(_daily(x)) for x in LEVELS])


def monthly_rollup(actuals: DataFrame, forecasts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Merchant-months of three levels over actuals and repaired forecasts.

    Only merchants still active count, from the month in which the earliest of them was
    last seen.  Actuals need ``(merchant_id, request_date, revenue)``, forecasts
    ``(merchant_id, request_date, q35, q50, q65, expected_gbp)``.
    """
    inactive = inactive_merchants(actuals, cfg)
    actuals = drop_inactive(actuals.where(F.col(MERCHANT).isNotNull()), inactive)
    earliest = last_activity(actuals).agg(F.min("last_date")).select(F.trunc("min(last_date)", "MM"))
    forecasts = drop_inactive(forecasts.where(F.col(MERCHANT).isNotNull()), inactive)
    days = actual_levels(actuals, cfg).unionByName(repair_forecasts(forecasts)).where(
        F.col(DATE) >= earliest.scalar())
    return days.groupBy(
        MERCHANT, F.year(DATE).alias("request_year"), F.month(DATE).alias("request_month"),
    ).agg(*[F.coalesce(F.sum(snap_to_zero(F.col(_daily(x)))), F.lit(0.0)).alias(_daily(x))
            for x in LEVELS])
