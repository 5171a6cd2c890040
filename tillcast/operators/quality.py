"""Checks that come back as tables, so that they run on the data itself."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillcast.config import Config, DATE, MERCHANT, SIZE_BANDS, TIME
from tillcast.functions.columns import size_band
from tillcast.operators.calendar import bank_holidays, calendar_from_dates
from tillcast.operators.metrics import merchant_level

AGREEMENT_COLUMNS = ("day_of_week", "day_of_month", "calendar_month", "calendar_week_of_year",
                     "day_type", "day_name", "month_name")
SCALED_PAIRS = (("daily_successful_transaction_count", "log_success_count"),
                ("daily_unsuccessful_amount_gbp", "log_unsuccessful_gbp"),
                ("daily_successful_amount_gbp", "tpv"))


def null_merchant_rows(frame: DataFrame) -> DataFrame:
    """Rows that coercion drops for want of a merchant id."""
    return frame.agg(F.count(F.lit(1)).alias("rows"),
                     F.count_if(F.col(MERCHANT).isNull()).alias("without_merchant"))


def require_complete(panel: DataFrame, cfg: Config = Config()) -> None:
    """Fail if any target or time index is NULL."""
    bad = panel.agg(F.count_if(F.col(cfg.target).isNull() | F.col(TIME).isNull())).first()[0]
    if bad:
        raise ValueError(f"{bad} panel rows lack a target or a time index")


def observed_faults(cfg: Config = Config()) -> dict[str, Column]:
    """Counts that must be zero in the sparse form, for the pass that stores it: what makes a
    target or time index of the dense form NULL or NaN."""
    return {"rows_without_a_date": F.count_if(F.col(DATE).isNull()),
            "rows_without_a_merchant": F.count_if(F.col(MERCHANT).isNull()),
            "rows_with_a_revenue_that_is_no_number": F.count_if(F.isnan(cfg.raw_target))}


def calendar_agreement(lookup: DataFrame) -> DataFrame:
    """Per calendar column: dates compared, share on which the formula agrees with the
    warehouse, and the first date on which it does not."""
    flagged = lookup.where("is_uk_bank_holiday").select(F.col(DATE).alias("holiday_date"))
    formula = calendar_from_dates(lookup.select(DATE), flagged)
    present = [c for c in AGREEMENT_COLUMNS if c in lookup.columns]
    both = lookup.select(DATE, *[F.col(c).alias(f"_{c}") for c in present]).join(formula, DATE)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}").cast("string").eqNullSafe(
            F.col(c).cast("string")).alias("same")) for c in present]))
    return both.select(DATE, pairs.alias("_p")).select(DATE, "_p.*").groupBy("column_name").agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg(F.col("same").cast("double")).alias("agreement"),
        F.min(F.when(~F.col("same"), F.col(DATE))).alias("first_difference"))


def holiday_differences(lookup: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Holidays only one side knows, over the covered dates."""
    flagged = lookup.where("is_uk_bank_holiday").select(F.col(DATE).alias("holiday_date"))
    computed = bank_holidays(lookup.sparkSession, first, last)
    return (flagged.exceptAll(computed).withColumn("only_in", F.lit("warehouse"))
            .unionByName(computed.exceptAll(flagged).withColumn("only_in", F.lit("computed"))))


def upcoming_holidays(spark, covered_to: dt.date, cfg: Config = Config()) -> DataFrame:
    """Holidays inside the next horizon."""
    day = dt.timedelta(days=1)
    return bank_holidays(spark, covered_to + day, covered_to + cfg.horizon * day)


def table_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row-for-row comparison of two tables, duplicates counted."""
    right = right.select(*left.columns)
    only_left = left.exceptAll(right).agg(F.count(F.lit(1)).alias("n"))
    only_right = right.exceptAll(left).agg(F.count(F.lit(1)).alias("n"))
    return left.agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"only_left": only_left.scalar(), "only_right": only_right.scalar()})


def whale_share(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Share of squared standard scores held by the largest size band, raw and logged, and
    the spread left inside the smallest band.

    Means and spreads are taken first, so that scores are sums over one more pass.
    """
    banded = panel.join(
        merchant_level(panel, cfg).select(MERCHANT, size_band(F.col("mean_daily_gbp")).alias("band")),
        MERCHANT)
    names = [c for pair in SCALED_PAIRS for c in pair]
    moments = panel.agg(*[f(c).alias(f"{p}_{c}") for c in names
                          for p, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    scored = banded.select("band", *[
        ((F.col(c) - moments.select(f"mean_{c}").scalar())
         / moments.select(f"sd_{c}").scalar()).alias(c) for c in names])
    smallest, largest = SIZE_BANDS[0][1], SIZE_BANDS[-1][1]
    whales, small = F.col("band") == largest, F.col("band") == smallest
    totals = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(whales).alias("whale_rows"),
        *[(F.sum(F.when(whales, F.col(c) * F.col(c)).otherwise(0.0))
           / F.sum(F.col(c) * F.col(c))).alias(f"share_{c}") for c in names],
        *[F.stddev_pop(F.when(small, F.col(c))).alias(f"spread_{c}") for c in names])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(raw).alias("column_name"),
                 F.col(f"share_{raw}").alias("raw_share"), F.col(f"share_{log}").alias("log_share"),
                 F.col(f"spread_{raw}").alias("raw_spread"),
                 F.col(f"spread_{log}").alias("log_spread"))
        for raw, log in SCALED_PAIRS]))
    return totals.select("rows", "whale_rows", pairs.alias("_p")).select(
        "rows", "whale_rows", "_p.*").withColumn(
        "passes", (F.col("log_share") < F.col("raw_share"))
        & (F.col("log_spread") > F.col("raw_spread") * 5))


def future_calendar_check(future: DataFrame) -> DataFrame:
    """Horizon rows: weekday labels against the real weekday, and the variety of labels."""
    real = (F.weekday(DATE) + 1).cast("string")
    per_merchant = future.groupBy(MERCHANT).agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(~F.col("day_of_week").eqNullSafe(real)).alias("wrong_weekday"),
        F.count_distinct("day_of_week").alias("weekdays"),
        F.count_distinct("day_type").alias("day_types"),
        F.count_if(F.col("is_uk_bank_holiday") == "True").alias("bank_holidays"))
    return per_merchant.withColumn("passes", (F.col("wrong_weekday") == 0)
                                   & (F.col("weekdays") == 7) & (F.col("day_types") >= 2))


def min_history(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Kept merchants, those too short to forecast, and those without a training window."""
    days = panel.groupBy(MERCHANT).agg(F.count(F.lit(1)).alias("days"))
    return days.agg(
        F.count(F.lit(1)).alias("merchants"),
        F.count_if(F.col("days") < cfg.min_encoder_length).alias("too_short_to_forecast"),
        F.count_if(F.col("days") < cfg.training_window_days).alias("without_training_window"),
        F.min("days").alias("shortest"))


def normaliser_spread(normaliser: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Whether scaling is per merchant: distinct pairs, ranges, and scales on the floor."""
    return normaliser.agg(
        F.count(F.lit(1)).alias("merchants"),
        F.count_distinct("center", "scale").alias("distinct_pairs"),
        F.min("center").alias("lowest_center"), F.max("center").alias("highest_center"),
        F.min("scale").alias("lowest_scale"), F.max("scale").alias("highest_scale"),
        F.count_if(F.col("scale") <= cfg.scale_floor).alias("on_floor"))
