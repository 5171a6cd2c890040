"""Panel columns a forecaster reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillcast.config import Config, DATE, MERCHANT, MIX_GROUPS, TIME, ColumnRoles
from tillcast.config import MONTH_HARMONICS, YEAR_HARMONICS
from tillcast.functions.columns import log_gbp, safe_divide, whole_number_text
from tillcast.functions.dates import age_in_days


def with_target(grid: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Revenue without NULLs or negatives, and its log1p as the target."""
    revenue = F.greatest(F.coalesce(F.col(cfg.raw_target), F.lit(0.0)), F.lit(0.0))
    return grid.withColumn(cfg.raw_target, revenue).withColumn(
        cfg.target, log_gbp(F.col(cfg.raw_target)))


def with_age(panel: DataFrame) -> DataFrame:
    """Days since the merchant was created, and their log."""
    age = F.lit(0.0)
    if "merchant_created_datetime" in panel.columns:
        age = age_in_days(F.col(DATE), F.col("merchant_created_datetime"))
    return panel.withColumns({"since_merchant_creation": age, "log_merchant_age": F.log1p(age)})


def with_activity(panel: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Log counts and money, average ticket, and the two idle-day flags."""
    revenue = F.col(cfg.raw_target)
    success = F.col("daily_successful_transaction_count")
    return panel.withColumns({
        "log_success_count": F.log1p(success),
        "log_unsuccessful_gbp": F.log1p("daily_unsuccessful_amount_gbp"),
        "log_fraud_count": F.log1p("daily_fraud_amount"),
        "log_dispute_count": F.log1p("daily_dispute_amount"),
        "log_avg_ticket": F.log1p(safe_divide(revenue, success)),
        "is_zero_day": F.when(revenue <= 0, 1.0).otherwise(0.0),
        "had_no_attempts": F.when(F.col("daily_transaction_amount") <= 0, 1.0).otherwise(0.0),
    })


def ratio_names(columns) -> list[str]:
    """Names of the mix ratios that the present count columns allow."""
    return [f"{c}_ratio" for group in MIX_GROUPS for c in group if c in columns]


def with_mix_ratios(panel: DataFrame) -> DataFrame:
    """Each count as a share of its group's total on the day; absent groups are skipped."""
    ratios = {}
    for group in MIX_GROUPS:
        present = [c for c in group if c in panel.columns]
        if not present:
            continue
        total = F.col(present[0])
        for name in present[1:]:
            total = total + F.col(name)
        ratios.update({f"{c}_ratio": safe_divide(F.col(c), total) for c in present})
    return panel.withColumns(ratios) if ratios else panel


def categories_as_text(panel: DataFrame) -> DataFrame:
    """Categorical columns spelt as text, numbers without a decimal point."""
    columns = {c: whole_number_text(c) for c in ("day_of_week", "day_of_month", "calendar_month")
               if c in panel.columns}
    for name in ("day_type", "merchant_category", "sector_group", "iso_name"):
        if name in panel.columns:
            columns[name] = F.col(name).cast("string")
    if "is_uk_bank_holiday" in panel.columns:
        columns["is_uk_bank_holiday"] = F.initcap(F.col("is_uk_bank_holiday").cast("string"))
    return panel.withColumns(columns)


def column_roles(columns, cfg: Config = Config()) -> ColumnRoles:
    """Roles of the panel's columns; optional columns that are absent are left out."""
    columns = list(columns)
    observed = [cfg.target, "log_success_count", "log_unsuccessful_gbp", "log_fraud_count",
                "log_dispute_count", "log_avg_ticket", "is_zero_day", "had_no_attempts",
                "target_imputed", *ratio_names(columns)]
    harmonics = [f"year_{f}{k}" for k in range(1, YEAR_HARMONICS + 1) for f in ("sin", "cos")]
    harmonics += [f"month_{f}{k}" for k in range(1, MONTH_HARMONICS + 1) for f in ("sin", "cos")]
    known = [*harmonics, "is_month_start", "is_month_end", "is_payday_window", "is_quarter_end",
             "days_to_month_end", "holiday_offset", "log_merchant_age"]

    def present(names) -> tuple[str, ...]:
        return tuple(n for n in names if n in columns)

    return ColumnRoles(
        target=cfg.target,
        known_reals=present(known),
        known_categoricals=present(
            ("day_of_week", "day_of_month", "calendar_month", "is_uk_bank_holiday")),
        observed_reals=present(observed),
        static_categoricals=present((MERCHANT, "merchant_category", "sector_group", "iso_name")),
        static_reals=present(("series_start_idx", "log_tenure_at_series_start")),
    )


def column_spread(panel: DataFrame, columns, cutoff) -> DataFrame:
    """Sample spread of each column over the training rows, as one wide row."""
    return panel.where(F.col(TIME) <= cutoff).agg(*[F.stddev_samp(c).alias(c) for c in columns])


def informative_roles(panel: DataFrame, roles: ColumnRoles, cutoff,
                      tolerance: float = 1e-6) -> ColumnRoles:
    """Drop observed reals that are constant over the training rows.

    One row of spreads comes to the driver, because it decides the plan's columns.
    """
    return informative_by_spread(
        column_spread(panel, roles.observed_reals, cutoff), roles, tolerance)


def informative_by_spread(spread: DataFrame, roles: ColumnRoles, tolerance: float = 1e-6
                          ) -> ColumnRoles:
    """The same from a ready row of spreads."""
    kept = informative_names(spread, roles.observed_reals, tolerance)
    return roles.without_observed([c for c in roles.observed_reals if c not in kept])


def informative_names(spread: DataFrame, columns, tolerance: float = 1e-6) -> list[str]:
    """The columns that vary; without training rows none does."""
    row = spread.first().asDict()
    return [c for c in columns if (row[c] or 0.0) > tolerance]
