import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.functions.dates import sunday_week
from tillcast.operators import calendar as cal, quality

D = dt.date


def holidays(spark, first, last):
    return [r.holiday_date for r in
            cal.bank_holidays(spark, first, last).orderBy("holiday_date").collect()]


def test_twenty_one_holidays_in_the_known_range(spark):
    found = holidays(spark, D(2024, 1, 1), D(2026, 7, 27))
    assert len(found) == len(set(found)) == 21
    assert D(2024, 3, 29) in found and D(2025, 4, 21) in found
    assert not any(d.weekday() >= 5 for d in found)


@pytest.mark.parametrize("year, expected", [
    (2020, [(1, 1), (4, 10), (4, 13), (5, 8), (5, 25), (8, 31), (12, 25), (12, 28)]),
    (2021, [(1, 1), (4, 2), (4, 5), (5, 3), (5, 31), (8, 30), (12, 27), (12, 28)]),
    (2022, [(1, 3), (4, 15), (4, 18), (5, 2), (6, 2), (6, 3), (8, 29), (9, 19), (12, 26), (12, 27)]),
    (2023, [(1, 2), (4, 7), (4, 10), (5, 1), (5, 8), (5, 29), (8, 28), (12, 25), (12, 26)]),
])
def test_years_with_moves_and_substitutes(spark, year, expected):
    assert holidays(spark, D(year, 1, 1), D(year, 12, 31)) == [D(year, m, d) for m, d in expected]


def test_no_holidays_in_an_empty_range(spark):
    assert holidays(spark, D(2024, 1, 2), D(2024, 1, 1)) == []


def test_sunday_weeks_match_strftime(spark):
    days = cal.days_between(spark, D(1995, 1, 1), D(2030, 12, 31))
    rows = days.select("request_date", sunday_week(F.col("request_date")).alias("w")).collect()
    assert len(rows) == 13149
    assert all(r.w == int(r.request_date.strftime("%U")) for r in rows)
    weeks = {r.request_date: r.w for r in rows}
    assert weeks[D(2023, 1, 1)] == 1      # a Sunday
    assert weeks[D(2024, 1, 1)] == 0      # a Monday


def offsets(spark, first, last, known):
    days = cal.days_between(spark, first, last)
    table = spark.createDataFrame([(d,) for d in known], "holiday_date date")
    return {r.request_date: r.holiday_offset
            for r in cal.holiday_offsets(days, table).collect()}


def test_holiday_offset_signs_ties_and_clipping(spark):
    got = offsets(spark, D(2024, 1, 1), D(2024, 3, 1), [D(2024, 1, 10), D(2024, 1, 16)])
    assert got[D(2024, 1, 10)] == 0
    assert got[D(2024, 1, 9)] == 1
    assert got[D(2024, 1, 12)] == -2
    assert got[D(2024, 1, 13)] == -3      # three days from both: the past wins
    assert got[D(2024, 1, 14)] == 2
    assert got[D(2024, 1, 1)] == 9        # nothing before
    assert got[D(2024, 2, 20)] == -10     # nothing after, clipped


def test_holiday_offset_without_holidays(spark):
    assert set(offsets(spark, D(2024, 1, 1), D(2024, 1, 5), []).values()) == {0.0}


def test_warehouse_values_win_and_gaps_are_filled(spark):
    lookup = spark.createDataFrame(
        [(D(2024, 1, 1), 9, True), (D(2024, 1, 3), 3, False)],
        "request_date date, day_of_week int, is_uk_bank_holiday boolean")
    calendar = cal.calendar_features(lookup, (D(2024, 1, 1), D(2024, 1, 3)), D(2024, 3, 30))
    rows = {r.request_date: r for r in calendar.frame.collect()}
    assert len(rows) == calendar.n_days == 90
    assert rows[D(2024, 1, 1)].day_of_week == 9
    assert rows[D(2024, 1, 2)].day_of_week == 2
    assert rows[D(2024, 1, 2)].holiday_offset == -1
    assert rows[D(2024, 3, 29)].day_type == "Holiday"       # computed past the coverage
    assert rows[D(2024, 3, 29)].is_uk_bank_holiday


def test_lookup_keeps_the_first_row_by_order(spark):
    rows = [(D(2024, 1, 1), 2, "B", "1"), (D(2024, 1, 1), 1, "A", "TRUE"), (D(2024, 1, 2), 1, "C", None)]
    frame = spark.createDataFrame(
        rows, "request_date date, n int, day_name string, is_uk_bank_holiday string")
    got = {r.request_date.day: (r.day_name, r.is_uk_bank_holiday)
           for r in cal.calendar_lookup(frame, "n").collect()}
    assert got == {1: ("A", True), 2: ("C", False)}


def test_a_wide_calendar_is_not_broadcast(spark):
    days = cal.days_between(spark, D(2024, 1, 1), D(2024, 1, 10))
    frame = days.withColumn("x", F.lit(1))
    plan = lambda n: cal.Calendar(frame, n).attach(days)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10)
    assert "strategy=broadcast" not in plan(10**6)


def test_agreement_finds_a_wrong_label(spark):
    days = cal.days_between(spark, D(2024, 1, 1), D(2024, 1, 10))
    right = cal.calendar_from_dates(days, cal.bank_holidays(spark, D(2024, 1, 1), D(2024, 1, 10)))
    wrong = right.withColumn("day_name", F.when(F.day("request_date") == 3, "Friday")
                             .otherwise(F.col("day_name")))
    table = {r.column_name: (r.agreement, r.first_difference)
             for r in quality.calendar_agreement(wrong).collect()}
    assert table["day_of_week"] == (1.0, None)
    assert table["day_name"] == (0.9, D(2024, 1, 3))
    moved = right.withColumn("is_uk_bank_holiday", F.day("request_date") == 2)
    both = quality.holiday_differences(moved, D(2024, 1, 1), D(2024, 1, 10)).collect()
    assert sorted((r.holiday_date.day, r.only_in) for r in both) == [(1, "computed"), (2, "warehouse")]
