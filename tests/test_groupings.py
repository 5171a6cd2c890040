"""The three ways to bring the log's rows together: equal facts, and what each one moves."""

import datetime as dt
import re
from decimal import Decimal

import pytest

from tillcast.operators import daily
from tillcast.sources.readers import TRANSACTION_SCHEMA


def rows(n=60):
    """Merchant-days of several rows whose attributes differ, with NULLs in every column."""
    choices = {
        "response_result": ["SUCCESS", "Success", "declined", None, "else"],
        "payment_type": ["card", "PAYOUTS", None, "?"],
        "transaction_type": ["sale", "Refund", "VOID", None],
        "acquiring_bank_name": ["Acquired.com", "SHIFT4", None],
        "integration_api": ["core", "REST", None, ""],
        "amount_gbp": [Decimal("1.25"), Decimal("10.10"), None],
        "merchant_name": ["n1", "n2", None], "iso_name": [None, "i1"],
        "iso_id": [3, None, 7], "day_name": ["Monday", None],
        "has_fraud_notification": [True, False, None], "has_dispute": [None, True],
        "merchant_created_datetime": [dt.datetime(2020, 1, 1), None],
    }
    for i in range(n):
        row = {f.name: None for f in TRANSACTION_SCHEMA}
        row.update({c: v[(i // (k + 1)) % len(v)] for k, (c, v) in enumerate(choices.items())})
        row.update(request_date=dt.date(2024, 3, 1 + i % 3), merchant_id=("a", "b", None)[i % 7 % 3])
        yield tuple(row[f.name] for f in TRANSACTION_SCHEMA)


@pytest.mark.parametrize("attributes", [None, [], ["merchant_name"]])
def test_all_groupings_give_the_same_fact(spark, attributes):
    log = spark.createDataFrame(list(rows()), TRANSACTION_SCHEMA)
    facts = {g: daily.daily_fact(log, attributes, grouping=g)
             for g in ("hashed", "sorted", "gathered")}
    bags = {g: sorted(map(repr, f.collect())) for g, f in facts.items()}
    assert len(bags["hashed"]) == 9
    assert bags["sorted"] == bags["hashed"] == bags["gathered"]
    assert facts["sorted"].dtypes == facts["hashed"].dtypes == facts["gathered"].dtypes


def test_an_unknown_grouping_is_an_error(spark):
    with pytest.raises(ValueError):
        daily.daily_fact(spark.createDataFrame([], TRANSACTION_SCHEMA), grouping="other")


def plan(spark, tmp_path, grouping):
    spark.createDataFrame([], TRANSACTION_SCHEMA).write.parquet(str(tmp_path / "log"))
    fact = daily.daily_fact(spark.read.parquet(str(tmp_path / "log")), grouping=grouping)
    return fact._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("grouping", ["sorted", "gathered"])
def test_one_exchange_by_merchant_day(spark, tmp_path, grouping):
    """Texts are no part of the key, so they cannot make it as fine as the log."""
    exchanges = re.findall(r"\bExchange (.*)", plan(spark, tmp_path, grouping))
    assert len(exchanges) == 1
    assert set(re.findall(r"(\w+)#\d+", exchanges[0].split("), ")[0])) == {
        "request_date", "merchant_id"}


def test_merchant_days_shrink_before_or_rows_are_moved_narrow(spark, tmp_path):
    before = plan(spark, tmp_path, "sorted")
    assert "partial_sum" in before[before.rindex("Exchange"):]


def test_gathered_rows_are_grouped_after_the_exchange(spark, tmp_path):
    before = plan(spark, tmp_path, "gathered")
    assert "Aggregate" not in before[before.rindex("Exchange"):]


def test_registered_facts_have_one_wide_exchange(spark, tmp_path):
    from checks import spark_queries as checks

    for merchant in ("supplier", "nation", "region"):
        text = checks.fact(spark, "/root/testdata/sf0.001", merchant)._jdf.queryExecution()
        named = re.findall(r"\bExchange hashpartitioning\((.*?)\), ", text.executedPlan().toString())
        assert [n for n in named if "merchant_name" in n] == []


def test_gathered_days_are_summed_once(spark, tmp_path):
    """No partial sums to merge: both steps would stand behind the exchange, a row for each day."""
    text = plan(spark, tmp_path, "gathered")
    assert "Aggregate" not in text and len(re.findall(r"\bWindow ", text)) == 1
    assert "WindowGroupLimit" not in text


def test_gathered_sums_only_what_is_read(spark, tmp_path):
    plan(spark, tmp_path, "gathered")
    fact = daily.daily_fact(spark.read.parquet(str(tmp_path / "log")), grouping="gathered")
    text = fact.select("merchant_id", "merchant_name", "card_amount")._jdf.queryExecution()
    assert "amount_gbp" not in text.executedPlan().toString()


def test_a_full_gathered_day_is_one_row(spark):
    """More rows of a merchant-day than a window keeps in memory."""
    one = list(rows(1))[0]
    log = spark.createDataFrame([one], TRANSACTION_SCHEMA).crossJoin(spark.range(10_000))
    (fact,) = daily.daily_fact(log, grouping="gathered").collect()
    assert fact.daily_transaction_amount == fact.daily_successful_transaction_count == 10_000
    assert fact.daily_successful_amount_gbp == Decimal("12500.00")
