"""The calendar dimension: warehouse values first, formulas where the warehouse ends."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tillcast.config import (
    CALENDAR_COLUMNS, DATE, HOLIDAY_LOOKAHEAD_DAYS, HOLIDAY_OFFSET_CLIP, MAX_BROADCAST_DAYS,
)
from tillcast.functions.columns import clip, text_flag
from tillcast.functions.dates import calendar_columns, seasonality_columns

# --- fixed values: bank holidays of England and Wales that follow no yearly rule ---
MOVED_EARLY_MAY = {1995: "1995-05-08", 2020: "2020-05-08"}
MOVED_SPRING = {2002: "2002-06-04", 2012: "2012-06-04", 2022: "2022-06-02"}
EXTRA_HOLIDAYS = {
    1999: ("1999-12-31",),
    2002: ("2002-06-03",),
    2011: ("2011-04-29",),
    2012: ("2012-06-05",),
    2022: ("2022-06-03", "2022-09-19"),
    2023: ("2023-05-08",),
}
# --- end of fixed values ---


@dataclass(frozen=True)
class Calendar:
    """A table with one row per date, and how many rows that is."""

    frame: DataFrame
    n_days: int

    def attach(self, frame: DataFrame) -> DataFrame:
        """Left join on the date: broadcast while the table is small, shuffled beyond."""
        days = F.broadcast(self.frame) if self.n_days <= MAX_BROADCAST_DAYS else self.frame
        return frame.drop(*[c for c in self.frame.columns if c != DATE]).join(days, DATE, "left")


def days_between(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """Every date from first to last, from a range so that Spark knows its size."""
    return spark.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias(DATE))


def _easter(years: DataFrame) -> DataFrame:
    """Easter Sunday by the anonymous Gregorian computus."""
    steps = {
        "a": "year % 19",
        "b": "year div 100",
        "c": "year % 100",
        "h": "(19 * a + b - b div 4 - (b - (b + 8) div 25 + 1) div 3 + 15) % 30",
        "l": "(32 + 2 * (b % 4) + 2 * (c div 4) - h - c % 4) % 7",
        "m": "(a + 11 * h + 22 * l) div 451",
        "n": "h + l - 7 * m + 114",
    }
    for name, formula in steps.items():
        years = years.withColumn(name, F.expr(formula))
    day = F.make_date(F.col("year"), F.expr("cast(n div 31 as int)"),
                      F.expr("cast(n % 31 + 1 as int)"))
    return years.select("year", day.alias("easter"))


def bank_holidays(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """Bank holidays of England and Wales from first to last as ``holiday_date``.

    The yearly rules hold from 1978, when the early May holiday began; an earlier year, or one
    past 2199, is an error.
    A holiday on a weekend shows up as its substitute weekday only.
    """
    if last < first:
        return spark.range(0).select(F.current_date().alias("holiday_date"))
    if first.year < 1978 or last.year > 2199:
        raise ValueError(f"no rules for bank holidays from {first} to {last}")
    year = F.col("year")

    def on(month: int, day: int) -> Column:
        return F.make_date(year, F.lit(month), F.lit(day))

    def monday_after(month: int, day: int) -> Column:
        return F.next_day(on(month, day), "Mon")

    def moved(rule: Column, moves: dict[int, str]) -> Column:
        for exception, date in moves.items():
            rule = F.when(year == exception, F.lit(date).cast("date")).otherwise(rule)
        return rule

    def past_weekend(day: Column, from_saturday: int, from_sunday: int) -> Column:
        return (F.when(F.weekday(day) == 5, F.date_add(day, from_saturday))
                .when(F.weekday(day) == 6, F.date_add(day, from_sunday)).otherwise(day))

    extra = F.array().cast("array<date>")
    for exception, dates in EXTRA_HOLIDAYS.items():
        extra = F.when(year == exception,
                       F.array(*[F.lit(d).cast("date") for d in dates])).otherwise(extra)
    yearly = F.array(
        past_weekend(on(1, 1), 2, 1),
        F.date_sub("easter", 2),
        F.date_add("easter", 1),
        moved(monday_after(4, 30), MOVED_EARLY_MAY),
        moved(monday_after(5, 24), MOVED_SPRING),
        monday_after(8, 24),
        past_weekend(on(12, 25), 2, 2),
        past_weekend(on(12, 26), 2, 2),
    )
    years = spark.range(first.year, last.year + 1).select(F.col("id").cast("int").alias("year"))
    # 26 December is only moved off a weekend: after a Sunday Christmas the 27th stands in
    # for the 25th and Monday the 26th stays; a Sunday 26th goes to the 28th with a
    # Saturday 25th on the 27th.
    return (
        _easter(years)
        .select(F.explode(F.concat(yearly, extra)).alias("holiday_date"))
        .where(F.col("holiday_date").between(F.lit(first), F.lit(last))
               & (F.weekday("holiday_date") < 5))
        .distinct()
    )


def calendar_lookup(fact: DataFrame, order: str | None = None) -> DataFrame:
    """The warehouse's own calendar: one row per date that has any row.

    With an order column the earliest row of a date speaks for it, the least row among
    equals; without one the least row does.  Either way it is a row the warehouse has.
    """
    present = [c for c in CALENDAR_COLUMNS if c in fact.columns]
    # Hashing the few distinct rows per date first spares sorting the fact for its texts.
    if not present:
        lookup = fact.select(DATE).distinct()
    elif order is None:
        lookup = fact.select(DATE, *present).distinct().groupBy(DATE).agg(
            F.min(F.struct(*present)).alias("_first")).select(DATE, "_first.*")
    else:
        earliest = fact.groupBy(DATE, *present).agg(F.min(order).alias("_order"))
        first = F.min_by(F.struct(*present), F.struct("_order", *present)).alias("_first")
        lookup = earliest.groupBy(DATE).agg(first).select(DATE, "_first.*")
    if "is_uk_bank_holiday" in present:
        lookup = lookup.withColumn("is_uk_bank_holiday", text_flag("is_uk_bank_holiday"))
    return lookup


def covered_range(lookup: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last date of the warehouse's calendar (a plan-time scalar)."""
    row = lookup.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("the calendar lookup is empty")
    return row["lo"], row["hi"]


def known_holidays(lookup: DataFrame, covered: tuple[dt.date, dt.date], frame_end: dt.date
                   ) -> DataFrame:
    """Holidays the warehouse flags, and computed ones after its last date.

    A warehouse without the flag leaves all of them to the rules.
    """
    first, last = covered
    reach = max(frame_end, last) + dt.timedelta(days=HOLIDAY_LOOKAHEAD_DAYS)
    if "is_uk_bank_holiday" not in lookup.columns:
        return bank_holidays(lookup.sparkSession, first, reach)
    flagged = lookup.where("is_uk_bank_holiday").select(F.col(DATE).alias("holiday_date"))
    computed = bank_holidays(lookup.sparkSession, last + dt.timedelta(days=1), reach)
    return flagged.unionByName(computed).distinct()


def holiday_offsets(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Signed days to the nearest holiday, clipped: 0 on it, negative after it; ties go back.

    The windows below run over one row per date, which is what bounds them.
    """
    timeline = days.select(DATE).join(
        holidays.select(F.col("holiday_date").alias(DATE), F.col("holiday_date")), DATE, "full")
    ordered = W.orderBy(DATE)
    since = F.datediff(DATE, F.last("holiday_date", True).over(
        ordered.rowsBetween(W.unboundedPreceding, -1)))
    until = F.datediff(F.last("holiday_date", True).over(
        W.orderBy(F.desc(DATE)).rowsBetween(W.unboundedPreceding, W.currentRow)), F.col(DATE))
    nearest = (F.when(F.col("_until").isNull(), -F.col("_since"))
               .when(F.col("_since").isNull(), F.col("_until"))
               .when(F.col("_since") <= F.col("_until"), -F.col("_since"))
               .otherwise(F.col("_until")))
    limit = HOLIDAY_OFFSET_CLIP
    offset = clip(F.coalesce(nearest, F.lit(0)), -limit, limit).cast("double")
    return (timeline.withColumn("_since", since).withColumn("_until", until)
            .select(DATE, offset.alias("holiday_offset")))


def calendar_features(lookup: DataFrame, covered: tuple[dt.date, dt.date],
                      frame_end: dt.date | None = None) -> Calendar:
    """All date features, once per date from the first covered one to ``frame_end``.

    The warehouse's values win wherever it has a row for the date; formulas fill the rest.
    """
    first, last = covered
    frame_end = max(frame_end or last, last)
    spark = lookup.sparkSession
    days = days_between(spark, first, frame_end)
    holidays = known_holidays(lookup, covered, frame_end)
    is_known = holidays.select(F.col("holiday_date").alias(DATE), F.lit(True).alias("_holiday"))
    formulas = calendar_columns(F.col(DATE), F.coalesce("_holiday", F.lit(False)))
    lookup = lookup.select(DATE, *[F.col(c).alias(f"_{c}") for c in lookup.columns if c != DATE])
    named = days.join(lookup, DATE, "left").join(is_known, DATE, "left").select(DATE, *[
        (F.coalesce(F.col(f"_{c}").cast("string"), formula.cast("string"))
         if c in ("month_name", "day_name", "day_type")
         else F.coalesce(F.col(f"_{c}"), formula)).alias(c)
        if f"_{c}" in lookup.columns else formula.alias(c)
        for c, formula in formulas.items()
    ])
    frame = (named.withColumns(seasonality_columns(F.col(DATE)))
             .join(holiday_offsets(days, holidays), DATE, "left"))
    return Calendar(frame, (frame_end - first).days + 1)


def calendar_from_dates(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """The ten calendar columns for a table of dates, from formulas and a holiday list."""
    is_known = holidays.select(F.col("holiday_date").alias(DATE), F.lit(True).alias("_holiday"))
    joined = days.select(DATE).join(is_known, DATE, "left")
    formulas = calendar_columns(F.col(DATE), F.coalesce("_holiday", F.lit(False)))
    return joined.select(DATE, *[c.alias(name) for name, c in formulas.items()])
