import pytest
from pyspark.sql import functions as F

from tillcast.config import Config
from tillcast.functions.staging import snapshot
from tillcast.operators import normaliser as norm, panel as pnl, quality, rollup
from tillcast.plans import forecasting as plan
from tillcast.sources import readers, sinks


def forecasts(spark, rows):
    return spark.createDataFrame(rows, "merchant_id long, request_date date, q35 double, "
                                       "q50 double, q65 double, expected_gbp double")


def test_repair_rules(spark, day):
    got = rollup.repair_forecasts(forecasts(spark, [
        (1, day(0), 0.0, 0.0, 0.0, 0.0),            # zero and nothing expected
        (2, day(0), 0.0, 5.0, 5.0, 9.0),            # zero quantile: the expectation
        (3, day(0), 1.0, 2.0, 3.0, 6.0),            # exactly at each cap: the mean
        (4, day(0), 1.0, 2.0, 3.0, 5.9),            # just below
        (5, day(0), None, 2.0, 3.0, 4.0),
    ])).orderBy("merchant_id").collect()
    assert [tuple(r)[2:] for r in got] == [
        (0.0, 0.0, 0.0), (9.0, 5.0, 5.0), (3.5, 4.0, 4.5), (1.0, 2.0, 3.0), (None, 2.0, 3.0)]


def actuals(spark, rows):
    return spark.createDataFrame(
        rows, "merchant_id long, request_date date, daily_successful_amount_gbp decimal(18,2)")


def test_inactivity_boundary(spark, day):
    from decimal import Decimal as D
    frame = actuals(spark, [(1, day(20), D(1)), (2, day(13), D(1)), (3, day(12), D(1))])
    assert [r.merchant_id for r in rollup.inactive_merchants(frame).collect()] == [3]


def test_monthly_rollup(spark, day):
    from decimal import Decimal as D
    fact = actuals(spark, [
        (1, day(0), D("10.00")), (1, day(40), D("20.00")), (1, day(41), None),
        (2, day(45), D("0.00")), (3, day(1), D("99.00")), (None, day(45), D("5.00"))])
    ahead = forecasts(spark, [
        (1, day(46), 1.0, 2.0, 3.0, 4.0), (2, day(46), 0.001, 0.005, 0.009, 0.005),
        (3, day(46), 7.0, 7.0, 7.0, 7.0), (9, day(46), 5.0, 5.0, 5.0, 5.0)])
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.monthly_rollup(fact, ahead).collect()}
    # Merchant 3 is inactive on both sides, 9 was never seen and stays, January lies before
    # the month in which the earliest active merchant was last seen.
    assert got == {
        (1, 2024, 2): (21.0, 22.0, 23.0), (2, 2024, 2): (0.0, 0.0, 0.0),
        (9, 2024, 2): (5.0, 5.0, 5.0)}


def test_all_null_months_are_zero(spark, day):
    fact = actuals(spark, [(1, day(0), None)])
    row = rollup.monthly_rollup(fact, forecasts(spark, [])).first()
    assert tuple(row) == (1, 2024, 1, 0.0, 0.0, 0.0)


HEADER = "time_idx,date,q35,q50,q65,expected_gbp\n"


def test_reads_flat_files_by_name(spark, tmp_path):
    (tmp_path / "forecast_merchant_12.csv").write_text(HEADER + "5,2024-02-01,1.0,2.0,3.0,2.5\n")
    (tmp_path / "forecast_merchant_7.csv").write_text(HEADER + "6,2024-02-02,,2.0,3.0,2.5\n")
    (tmp_path / "forecast_merchant_M-1 x+%.csv").write_text(HEADER + "1,2024-02-02,1,1,1,1\n")
    (tmp_path / "notes.csv").write_text("a\n1\n")
    rows = readers.read_forecasts(spark, str(tmp_path)).orderBy("merchant_id").collect()
    assert [(r.merchant_id, r.time_idx, r.request_date.day, r.q35) for r in rows] == [
        ("12", 5, 1, 1.0), ("7", 6, 2, None), ("M-1 x+%", 1, 2, 1.0)]


@pytest.fixture
def run(make_series):
    return plan.Forecasts(make_series({
        "12": (0, [10.0 + i % 7 for i in range(200)]), "34": (20, [float(i % 3) for i in range(180)])}))


def test_written_forecasts_come_back(spark, run, tmp_path):
    folder = str(tmp_path / "forecasts")
    sinks.write_forecasts(run.table, folder)
    folders = sorted(p.name for p in (tmp_path / "forecasts").iterdir() if p.is_dir())
    assert folders == ["merchant_id=12", "merchant_id=34"]
    assert len(list((tmp_path / "forecasts" / "merchant_id=12").glob("*.csv"))) == 1
    back = readers.read_forecasts(spark, folder)
    sent = run.table.select("merchant_id", "time_idx",
                            F.col("date").alias("request_date"), "q35", "q50", "q65", "expected_gbp")
    same = quality.table_differences(sent, back).first()
    assert (same.rows, same.only_left, same.only_right) == (182, 0, 0)
    sinks.write_consolidated(back, str(tmp_path / "all"))
    again = spark.read.option("header", True).csv(str(tmp_path / "all"))
    assert again.columns == ["merchant_id", "time_idx", "date", "q35", "q50", "q65", "expected_gbp"]
    assert again.count() == 182


def test_no_merchant_is_lost_for_its_id(spark, make_series, make_fact, tmp_path):
    ids = ["7", "M-1", "a b/c", "x+y=%20", "é"]
    table = plan.Forecasts(make_series({m: (0, [10.0 + i % 7 for i in range(200)]) for m in ids})).table
    sinks.write_forecasts(table, str(tmp_path / "out"))
    back = readers.read_forecasts(spark, str(tmp_path / "out"))
    assert sorted(r.merchant_id for r in back.select("merchant_id").distinct().collect()) == sorted(ids)
    fact = make_fact([(m, 199, 5.0, 1) for m in ids])
    months = plan.monthly(fact, table)
    assert {r.merchant_id for r in months.collect()} == set(ids)


def test_delivery_checks_before_it_writes(spark, make_series, make_fact, tmp_path):
    series = make_series({"a": (0, [float(i % 9) for i in range(200)])})
    table = plan.Forecasts(series).table
    plan.require_deliverable(series, table)
    with pytest.raises(ValueError, match="target"):
        plan.require_deliverable(series.withColumn("tpv", F.lit(None).cast("double")), table)
    with pytest.raises(ValueError, match="history"):
        plan.require_deliverable(series, table.where("merchant_id = 'b'"))
    with pytest.raises(ValueError, match="forecast day"):
        plan.require_deliverable(series, table.where("step <> 5"))
    fact = make_fact([("a", n, float(n % 9), 1) for n in range(200)])
    plan.deliver(fact, str(tmp_path / "out"))
    assert readers.read_forecasts(spark, str(tmp_path / "out" / "forecasts")).count() == 91
    short = make_fact([("a", n, float(n % 9), 1) for n in range(20)])
    with pytest.raises(ValueError, match="history"):
        plan.deliver(short, str(tmp_path / "short"), Config(min_series_days=5, min_active_days=5))
    assert not (tmp_path / "short").exists()


def test_stored_tables_are_checked_in_the_pass_that_writes_them(spark, make_series, make_fact, tmp_path):
    series = make_series({"a": (0, [float(i % 9) for i in range(200)])})
    table = plan.Forecasts(series).table
    kept = snapshot(table, "checked", **plan.table_faults())
    assert kept.count() == 91
    with pytest.raises(ValueError, match="91 days without a value"):
        snapshot(table.withColumn("expected_gbp", F.lit(None).cast("double")), "checked",
                 **plan.table_faults())
    with pytest.raises(ValueError, match="1 days without a date"):
        snapshot(table.withColumn("date", F.when(F.col("step") != 5, F.col("date"))), "checked",
                 **plan.table_faults())
    assert snapshot(table.limit(0), "checked", **plan.table_faults()).count() == 0
    nan = make_fact([("a", n, float("nan") if n == 7 else 3.0 + n % 9, 1) for n in range(200)])
    with pytest.raises(ValueError, match="1 rows with a revenue that is no number"):
        plan.deliver(nan, str(tmp_path / "nan"))
    assert not (tmp_path / "nan").exists()


def test_windows_scaled_by_another_pair_are_an_error(make_series):
    series = make_series({"a": (0, [float(i % 9) for i in range(400)])})
    origins = pnl.window_origins(series, "holdout")
    cutoff = pnl.Split(series).train_cutoff
    fitted = norm.fit_normaliser(series.where(F.col("time_idx") <= cutoff))
    norm.require_aligned(origins, series, fitted, cutoff)
    with pytest.raises(ValueError, match="pair"):
        norm.require_aligned(origins, series, fitted.withColumn("center", F.lit(9.0)), cutoff)


def test_other_sinks(spark, run, make_fact, tmp_path):
    fact = make_fact([("a", 0, 1.0, 1)])
    sinks.write_fact(fact, str(tmp_path / "fact"))
    stored = readers.load_fact(spark, str(tmp_path / "fact"))
    assert tuple(readers.frame_size(stored).first()) == (1, len(fact.columns))
    sinks.write_summary(run.summary.coalesce(1), str(tmp_path / "summary"))
    summary = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert [r.merchant_id for r in summary.collect()] == ["12", "34"]
    sinks.write_metrics(run.summary, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    rows = plan.evaluation_rows(run.series, Config(), ("holdout",))
    sinks.write_predictions(rows, str(tmp_path / "predictions"), "csv")
    assert (tmp_path / "predictions" / "part=holdout").is_dir()
    sinks.write_rollup(run.summary.select("merchant_id"), str(tmp_path / "months"))
    assert spark.read.option("header", True).csv(str(tmp_path / "months")).count() == 2


def test_reads_a_log_from_path_or_table(spark, tmp_path):
    log = spark.createDataFrame([], readers.TRANSACTION_SCHEMA)
    log.write.parquet(str(tmp_path / "log"))
    assert readers.read_transactions(spark, str(tmp_path / "log")).columns == log.columns
    log.createOrReplaceTempView("payment_log")
    assert readers.read_transactions(spark, "payment_log", format="table").isEmpty()
