"""What prepared panels store, and the rounding of the checks."""

import os

import pytest
from pyspark.sql import functions as F

from checks import spark_queries as checks
from tillcast.config import CALENDAR_COLUMNS, MERCHANT, PAYMENT_COUNTS
from tillcast.plans.prepare import core_series, prepare

FOLDER = "/root/testdata/sf0.001"


def test_series_are_stored_without_the_calendar(make_fact):
    """The lookup holds the calendar; the panel takes it from there."""
    fact = make_fact([(m, n, float(n % 5), 1, m) for m in ("a", "b") for n in range(80)])
    fact = fact.withColumns({c: F.lit(0.0) for c in (
        "daily_transaction_amount", "daily_unsuccessful_amount_gbp", "daily_fraud_amount",
        "daily_dispute_amount")})
    ready = prepare(fact.withColumn("day_of_week", F.weekday("request_date") + 1))
    assert not set(CALENDAR_COLUMNS) & set(ready.observed.columns)
    assert {r.day_of_week for r in ready.panel.select("day_of_week").collect()} == set("1234567")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_panel_features_store_no_counts_of_ratios(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(checks, "snapshot", lambda frame, label: stored.append(frame) or frame)
    checks.panel_features(spark, FOLDER)
    assert stored and not set(PAYMENT_COUNTS) & set(stored[0].columns)


def test_rounding_leaves_zero_and_null_as_they_are(spark):
    frame = spark.createDataFrame(
        [(0.0,), (-0.0,), (None,), (1.2345675,), (-1e-9,), (float("inf"),)], "x double")
    got = [row.x for row in frame.select(checks.r("x")).collect()]
    assert got == [row.x for row in frame.select((F.round("x", 6) + 0.0).alias("x")).collect()]
    assert [str(v) for v in got[:3]] == ["0.0", "0.0", "None"]


def test_core_series_goes_to_the_log_once(spark, make_fact, tmp_path):
    """The day axis is sought in the stored sparse form, so no window is left in the plan."""
    make_fact([("a", n, float(n % 5), 1) for n in range(80)]).write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    for filtered in (True, False):
        series = core_series(fact, filtered=filtered)
        text = series._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text and "subquery" in text
        assert series.count() == 79
