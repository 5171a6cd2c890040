"""Shapes of physical plans that the work at scale depends on."""

import re

import pytest
from pyspark.sql import functions as F

from tillcast.config import Config, DATE, MERCHANT
from tillcast.operators import daily, forecast as fc, panel as pnl, summary
from tillcast.plans import forecasting as plan
from tillcast.plans.prepare import core_columns, dense_series, observe, prepare
from tillcast.sources.readers import TRANSACTION_SCHEMA


def physical(frame) -> str:
    """The initial plan without the plans of its scalar subqueries."""
    kept, inside = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"\w|\*", line).start() if re.search(r"\w|\*", line) else 0
        if inside is not None and depth > inside:
            continue
        inside = depth if re.match(r"[\s:+|-]*(Reused)?Subquery", line) else None
        if inside is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture
def stored_log(spark, tmp_path):
    spark.createDataFrame([], TRANSACTION_SCHEMA).write.parquet(str(tmp_path / "log"))
    return spark.read.parquet(str(tmp_path / "log"))


@pytest.fixture
def stored_fact(make_fact, tmp_path, spark):
    rows = [(m, n, float(n % 5), 1, m) for m in ("a", "b") for n in range(80)]
    make_fact(rows).write.parquet(str(tmp_path / "fact"))
    return spark.read.parquet(str(tmp_path / "fact"))


def test_the_log_is_hashed_not_sorted(stored_log):
    text = physical(daily.daily_fact(stored_log))
    below_first_exchange = text[text.rindex("Exchange"):]
    assert "HashAggregate" in below_first_exchange
    assert "Sort" not in below_first_exchange
    assert "partial_sum" in below_first_exchange


def test_a_slim_fact_reads_few_columns(stored_log):
    fact = daily.daily_fact(stored_log, []).select(DATE, MERCHANT, "daily_successful_amount_gbp")
    read = re.search(r"FileScan parquet \[(.*?)\]", physical(fact)).group(1)
    assert {c.split("#")[0] for c in read.split(",")} == {
        "request_date", "merchant_id", "response_result", "payment_type", "transaction_type",
        "amount_gbp"}


def test_date_filters_reach_the_scan(stored_log):
    text = physical(daily.daily_fact(stored_log.where(F.col(DATE) >= "2024-01-01"), []))
    assert "GreaterThanOrEqual(request_date,2024-01-01)" in text.replace(" ", "")


def test_series_take_one_exchange_and_one_sort(stored_fact):
    text = physical(dense_series(observe(stored_fact)).select(*core_columns()))
    assert len(re.findall(r"\bExchange\b", text)) == 1
    assert f"hashpartitioning({MERCHANT}" in text
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert "Join" not in text


def whole(frame) -> str:
    """The initial plan, scalar subqueries included."""
    return frame._jdf.queryExecution().executedPlan().toString()


def test_only_texts_widen_the_key_of_the_fact(stored_log):
    text = physical(daily.daily_fact(stored_log))
    first = text[text.rindex("Exchange"):].splitlines()[0]
    named = set(re.findall(r"(\w+)#\d+", first))
    assert {"merchant_name", "iso_name"} <= named
    assert not named & {"iso_id", "merchant_created_datetime", "calendar_year", "day_of_month"}


def test_exchanges_from_the_log_to_a_series(stored_log):
    """Two for the fact; one on the merchant, whose id is trimmed in between."""
    fact = daily.daily_fact(stored_log)
    assert len(re.findall(r"\bExchange\b", physical(fact))) == 2
    assert len(re.findall(r"\bExchange\b", physical(observe(fact)))) == 3


def test_a_prepared_panel_reads_stored_series(stored_log, stored_fact):
    full = stored_fact.withColumns({c: F.lit(0.0) for c in (
        "daily_transaction_amount", "daily_unsuccessful_amount_gbp", "daily_fraud_amount",
        "daily_dispute_amount")})
    ready = prepare(full)
    assert "percentile" not in whole(ready.panel)    # imputation is behind the stored table
    assert "Generate" not in whole(ready.observed.select(ready.split().train_cutoff))


def test_a_summary_expands_only_the_ends_of_series(stored_fact, spark):
    run = plan.Forecasts.of(stored_observed(stored_fact))
    text = whole(run.summary)
    days = [line for line in text.splitlines() if "Generate explode(sequence(greatest(" in line]
    assert 1 <= len(days) <= 2
    assert "Generate explode(sequence(request_date" not in text


def stored_observed(fact):
    from tillcast.functions.staging import snapshot
    return snapshot(observe(fact), "observed")


def test_the_ends_give_the_same_summary(stored_fact):
    observed = stored_observed(stored_fact)
    short = plan.Forecasts.of(observed)
    long = plan.Forecasts(dense_series(observed).select(*core_columns()))
    rows = short.summary.orderBy(MERCHANT).collect()
    assert rows == long.summary.orderBy(MERCHANT).collect() and len(rows) == 2


def test_the_filter_acts_before_densifying(stored_fact):
    text = physical(dense_series(observe(stored_fact)).select(*core_columns()))
    assert text.index("Generate") < text.index("series_active_days")   # plans print top down


def test_latest_forecast_needs_no_join(make_series):
    text = physical(fc.forecast_latest(make_series({"a": (0, [1.0] * 150)})))
    assert "Join" not in text
    assert len(re.findall(r"\bExchange\b", text)) == 1


def test_origins_are_a_filter(make_series):
    series = make_series({"a": (0, [1.0] * 400)})
    for part in ("train", "validation", "holdout"):
        text = physical(pnl.window_origins(series, part))
        assert not re.search(r"\bExchange\b|Join|Window", text)


def test_evaluation_windows_need_no_join(make_series):
    series = make_series({"a": (0, [1.0] * 500)})
    for part in ("validation", "holdout"):
        text = physical(fc.forecast_part(series, part))
        assert "Join" not in text and len(re.findall(r"\bExchange\b", text)) == 1


def test_top_reports_do_not_sort_everything(make_series):
    run = plan.Forecasts(make_series({"a": (0, [1.0] * 200)}))
    assert "TakeOrderedAndProject" in physical(summary.sanity_failures(run.summary))
    assert "TakeOrderedAndProject" in physical(summary.top_merchants(run.series, run.table, 5))


def test_nothing_is_cross_joined(stored_fact):
    run = plan.Forecasts(dense_series(observe(stored_fact)).select(*core_columns()))
    for frame in (run.summary, plan.evaluate(run.series, Config(horizon=14, val_days=14))):
        text = physical(frame)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
