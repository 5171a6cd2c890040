"""Calendar expressions over a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tillcast.config import MONTH_HARMONICS, YEAR_HARMONICS


def sunday_week(day: Column) -> Column:
    """Whole weeks since the year's first Sunday, counted from 1; 0 before that Sunday."""
    new_year = F.trunc(day, "YEAR")
    until_sunday = F.pmod(F.lit(6) - F.weekday(new_year), F.lit(7))
    weeks = F.floor((F.dayofyear(day) - 1 - until_sunday) / 7) + 1
    return F.greatest(F.lit(0), weeks).cast("int")


def calendar_columns(day: Column, is_holiday: Column) -> dict[str, Column]:
    """The warehouse's ten calendar columns, worked out from the date alone."""
    return {
        "day_of_week": (F.weekday(day) + 1).cast("int"),
        "day_of_month": F.day(day).cast("int"),
        "calendar_month": F.month(day).cast("int"),
        "month_name": F.date_format(day, "MMMM"),
        "calendar_year": F.year(day).cast("int"),
        "calendar_quarter": F.quarter(day).cast("int"),
        "calendar_week_of_year": sunday_week(day),
        "day_name": F.date_format(day, "EEEE"),
        "day_type": (F.when(is_holiday, "Holiday")
                     .when(F.weekday(day) >= 5, "Weekend")
                     .otherwise("Working Day")),
        "is_uk_bank_holiday": is_holiday,
    }


def seasonality_columns(day: Column) -> dict[str, Column]:
    """Harmonics of the year and the month, and flags around the month's edges."""
    columns: dict[str, Column] = {}
    for k in range(1, YEAR_HARMONICS + 1):
        angle = F.lit(2 * math.pi * k) * F.dayofyear(day) / F.lit(365.25)
        columns[f"year_sin{k}"] = F.sin(angle)
        columns[f"year_cos{k}"] = F.cos(angle)
    number, length = F.day(day), F.day(F.last_day(day))
    for k in range(1, MONTH_HARMONICS + 1):
        angle = F.lit(2 * math.pi * k) * (number - 1) / length
        columns[f"month_sin{k}"] = F.sin(angle)
        columns[f"month_cos{k}"] = F.cos(angle)

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    columns["is_month_start"] = flag(number <= 2)
    columns["is_month_end"] = flag(number >= length - 1)
    columns["is_payday_window"] = flag((number >= 25) | (number <= 3))
    columns["is_quarter_end"] = flag((day == F.last_day(day)) & (F.month(day) % 3 == 0))
    columns["days_to_month_end"] = F.least(length - number, F.lit(15)).cast("double")
    return columns


def age_in_days(day: Column, created: Column) -> Column:
    """Whole days since creation; an unknown or later creation counts as 0."""
    age = F.coalesce(F.datediff(day, created), F.lit(0))
    return F.greatest(age, F.lit(0)).cast("double")
