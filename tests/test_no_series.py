"""Registered queries against their SQL where the filter leaves no series: all are near constant."""

import functools

import duckdb
import pytest

import __spark_entry__ as registry
from checks import spark_queries
from checks.compare import connect, differences

EMPTY = "no rows on either side"


@pytest.fixture(scope="module")
def steady(tmp_path_factory):
    """Two suppliers of two regions, selling the same every day of two years."""
    folder = tmp_path_factory.mktemp("steady")
    tables = {
        "region": "SELECT k::INT AS r_regionkey, 'R' || k AS r_name FROM range(2) t(k)",
        "nation": "SELECT k::INT AS n_nationkey, 'N' || k AS n_name, k::INT AS n_regionkey FROM range(2) t(k)",
        "supplier": "SELECT k AS s_suppkey, 'S' || k AS s_name, k::INT AS s_nationkey, 3000.0::DOUBLE AS s_acctbal "
                    "FROM range(2) t(k)",
        "lineitem": "SELECT d AS l_orderkey, 1::BIGINT AS l_partkey, k AS l_suppkey, 1::INT AS l_linenumber, "
                    "10.0::DOUBLE AS l_quantity, 1000.0::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, "
                    "0.01::DOUBLE AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, "
                    "TIMESTAMP '1995-01-01' + to_days(d::INT) AS l_shipdate FROM range(730) a(d), range(2) b(k)",
    }
    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Store each fact and series once for all queries of this file."""
    patch = pytest.MonkeyPatch()
    for name in ("stored_fact", "stored_observed", "prepared"):
        patch.setattr(spark_queries, name, functools.cache(getattr(spark_queries, name)))
    yield
    patch.undo()


def _check(spark, folder, name, problems=()):
    frame = registry.queries()[name](spark, folder)
    assert differences(frame, connect(folder), registry.oracle_sql()[name]) == list(problems)


@pytest.mark.parametrize("name", [
    "ml_moments", "ml_full_refit_state", "ml_pinball_gradient", "future_batch_vs_single",
    "baseline_metrics", "merchant_report", "scale_alignment_faulty"])
def test_without_series(spark, steady, name):
    _check(spark, steady, name)


@pytest.mark.parametrize("name", [
    "ml_forecast_keys", "ml_evaluation_rows", "informative_columns", "prediction_files"])
def test_no_series_no_rows(spark, steady, name):
    _check(spark, steady, name, [EMPTY])


def test_no_series_no_fitted_forecast(spark, steady):
    assert registry.queries()["ml_quantile_forecast"](spark, steady).count() == 0


def test_without_windows_no_input_carries_information(spark, steady):
    rows = registry.queries()["ml_dropped_inputs"](spark, steady).collect()
    assert {r.windows for r in rows} == {0}
    assert {"constant", "twice", "blend", "level7", "holiday_offset"} <= {r.input for r in rows}
