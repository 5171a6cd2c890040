import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillcast.config import Config
from tillcast.operators import daily, quality
from tillcast.plans.prepare import clean_fact
from tillcast.sources.readers import TRANSACTION_SCHEMA


def attempt(**given):
    row = {f.name: None for f in TRANSACTION_SCHEMA}
    row.update(request_date=dt.date(2024, 3, 1), merchant_id="7", response_result="SUCCESS",
               payment_type="CARD", transaction_type="SALE", amount_gbp=Decimal("10.00"))
    row.update(given)
    return tuple(row[f.name] for f in TRANSACTION_SCHEMA)


def one_day(spark, rows, **options):
    return daily.daily_fact(spark.createDataFrame(rows, TRANSACTION_SCHEMA), **options).first()


def test_measures_fold_case_and_split_money(spark):
    row = one_day(spark, [
        attempt(response_result="success", payment_type="card"),
        attempt(payment_type="PAYOUTS", amount_gbp=Decimal("3.00")),
        attempt(transaction_type="Refund", amount_gbp=Decimal("4.00")),
        attempt(transaction_type="VOID", amount_gbp=Decimal("5.00")),
        attempt(response_result="Declined", amount_gbp=Decimal("6.00")),
        attempt(response_result=None, amount_gbp=Decimal("7.00")),
        attempt(acquiring_bank_name="acquired.com", has_dispute=True),
        attempt(has_fraud_notification=None, integration_api="rest"),
    ])
    assert row.daily_transaction_amount == 8
    assert row.daily_successful_transaction_count == 6
    assert row.daily_successful_amount_gbp == Decimal("30.00")
    assert row.daily_payout_amount_gbp == Decimal("3.00")
    assert row.daily_refund_amount_gbp == Decimal("4.00")
    assert row.daily_void_amount_gbp == Decimal("5.00")
    assert row.daily_unsuccessful_amount_gbp == Decimal("6.00")
    assert (row.declined_amount, row.acquired_amount, row.rest_amount) == (1, 1, 1)
    assert (row.daily_fraud_amount, row.daily_dispute_amount) == (0, 1)


def test_strict_reference_has_no_refund_money(spark):
    rows = [attempt(transaction_type="REFUND"), attempt(transaction_type="VOID")]
    row = one_day(spark, rows, strict_reference=True)
    assert row.daily_refund_amount_gbp == 0 and row.daily_void_amount_gbp == 0


def test_only_null_amounts_sum_to_null(spark):
    assert one_day(spark, [attempt(amount_gbp=None)]).daily_successful_amount_gbp is None


def test_attributes_that_vary_in_a_day_give_one_row(spark):
    rows = [attempt(merchant_name="a"), attempt(merchant_name="b"), attempt(merchant_name=None)]
    fact = daily.daily_fact(spark.createDataFrame(rows, TRANSACTION_SCHEMA)).collect()
    assert [(r.merchant_name, r.daily_transaction_amount) for r in fact] == [("b", 3)]


def test_imputation(make_fact):
    rows = clean_fact(make_fact([
        ("a", 0, 10.0, 1), ("a", 1, 20.0, 1), ("a", 2, 0.0, 1), ("a", 3, None, 2),
        ("a", 4, None, 0), ("b", 0, None, 1),
    ])).collect()
    got = {(r.merchant_id, r.request_date.day): (r.daily_successful_amount_gbp, r.target_imputed)
           for r in rows}
    assert got[("a", 4)] == (15.0, 1.0)       # median of its positive days
    assert got[("a", 5)] == (None, 0.0)       # no success: nothing to impute
    assert got[("b", 1)] == (0.0, 1.0)        # no positive day to take a median of
    assert got[("a", 3)] == (0.0, 0.0)


def test_coercion(spark, day):
    fact = spark.createDataFrame(
        [(" 12 ", "2024-01-05", "x", None, "not a time"), (None, "2024-01-05", "1", "n", None),
         ("13", "2024-01-06 10:00:00", "2.5", "n", "2020-02-03T04:05:06Z")],
        "merchant_id string, request_date string, daily_successful_amount_gbp string, "
        "merchant_name string, merchant_created_datetime string")
    rows = {r.merchant_id: r for r in daily.coerce_fact(fact).collect()}
    assert set(rows) == {"12", "13"}
    assert rows["12"].daily_successful_amount_gbp is None
    assert rows["12"].merchant_name == "unknown"
    assert rows["12"].merchant_created_datetime is None
    assert rows["13"].request_date == day(5)
    assert rows["13"].merchant_created_datetime == dt.date(2020, 2, 3)
    assert quality.null_merchant_rows(fact).first().without_merchant == 1
    with pytest.raises(ValueError):
        daily.coerce_fact(fact.drop("merchant_id"))


def test_latest_per_day_breaks_ties_by_all_columns(spark, day):
    rows = [("a", day(0), 1, "x"), ("a", day(0), 2, "a"), ("a", day(0), 2, "b"),
            ("a", day(1), 1, None), ("b", day(0), 5, "z")]
    frame = spark.createDataFrame(rows, "merchant_id string, request_date date, n int, s string")
    kept = sorted(tuple(r) for r in daily.latest_per_day(frame, ["n"]).collect())
    assert kept == [("a", day(0), 2, "b"), ("a", day(1), 1, None), ("b", day(0), 5, "z")]
    again = daily.latest_per_day(frame.orderBy(F.desc("s")), ["n"])
    assert sorted(tuple(r) for r in again.collect()) == kept


def test_clean_fact_imputes_before_dropping_duplicates(spark, day):
    rows = [("a", day(0), 100.0, 1.0, 1), ("a", day(0), 10.0, 1.0, 2), ("a", day(1), None, 1.0, 3)]
    frame = spark.createDataFrame(
        rows, "merchant_id string, request_date date, daily_successful_amount_gbp double, "
              "daily_successful_transaction_count double, n int")
    kept = {r.request_date: r.daily_successful_amount_gbp
            for r in clean_fact(frame, Config(), ["n"]).collect()}
    assert kept == {day(0): 10.0, day(1): 55.0}


def test_without_months(spark):
    rows = [attempt(month_name="July", calendar_year=2026), attempt(month_name="May",
            calendar_year=2026), attempt(month_name="July", calendar_year=2025)]
    frame = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    assert daily.without_months(frame, 2026, ["June", "July"]).count() == 2
