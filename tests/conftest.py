import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tillcast-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def day():
    """Days counted from a fixed Monday."""
    return lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


FACT = ("merchant_id string, request_date date, daily_successful_amount_gbp double, "
        "daily_successful_transaction_count double, merchant_name string, "
        "merchant_created_datetime date")


@pytest.fixture
def make_fact(spark, day):
    """Merchant-day rows from (merchant, day number, revenue, successes[, name[, created]])."""
    def build(rows):
        full = [(m, day(n), v, float(k), *(rest + [None, None])[:2])
                for m, n, v, k, *rest in rows]
        return spark.createDataFrame(full, FACT)
    return build


@pytest.fixture
def make_series(spark, day):
    """Dense core series from {merchant: (first index, [revenue per day])}."""
    import math

    def build(series):
        rows = []
        for merchant, (start, values) in series.items():
            last = start + len(values) - 1
            rows += [(merchant, f"name {merchant}", day(start + i), start + i, start, last,
                      float(v), math.log1p(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(
            rows, "merchant_id string, merchant_name string, request_date date, time_idx long, "
                  "series_start_idx long, series_last_idx long, "
                  "daily_successful_amount_gbp double, tpv double")
    return build
