import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillcast.config import Config, DATE
from tillcast.functions import quantiles as q
from tillcast.functions.columns import size_band
from tillcast.functions import stats
from tillcast.functions.stats import exact_percentiles, sample_skewness
from tillcast.operators import baselines, forecast as fc, metrics, normaliser as norm
from tillcast.operators import panel as pnl, summary
from tillcast.plans import forecasting as plan

LEVELS = Config().quantiles


def test_integration_weights():
    assert q.integration_weights(LEVELS) == pytest.approx(
        [.06, .115, .125, .125, .15, .125, .125, .115, .06])


@given(st.lists(st.floats(0.01, 0.99), min_size=2, max_size=9, unique=True).map(sorted))
@settings(max_examples=50, deadline=None)
def test_weights_are_the_trapezoid_rule(levels):
    values = np.cumsum(np.arange(1, len(levels) + 1, dtype=float))
    padded_levels = np.concatenate([[0.0], levels, [1.0]])
    padded = np.concatenate([values[:1], values, values[-1:]])
    area = np.trapezoid(padded, padded_levels)
    assert float(np.dot(q.integration_weights(levels), values)) == pytest.approx(area)


@pytest.mark.parametrize("values, expected", [
    ([float(i) for i in range(9)], 0), ([float(-i) for i in range(9)], 8), ([2.0] * 9, 0)])
def test_crossings_and_rearrangement(spark, values, expected):
    row = spark.createDataFrame([(values,)], "v array<double>").select(
        q.crossings(F.col("v"), 9).alias("n"), q.rearranged(F.col("v")).alias("s"),
        q.expected_value(F.col("v"), LEVELS).alias("e")).first()
    assert row.n == expected and row.s == sorted(values)


def test_uniform_and_lognormal_expectations(spark):
    levels = [.02, .1, .25, .5, .75, .9, .98]
    row = spark.createDataFrame([([100 * x for x in levels],)], "v array<double>")
    assert abs(row.select(q.expected_value(F.col("v"), levels)).first()[0] - 50) < 6
    from statistics import NormalDist
    for sigma in (.6, 1.2, 2.0):
        values = [math.exp(sigma * NormalDist().inv_cdf(x)) for x in levels]
        got = spark.createDataFrame([(values,)], "v array<double>").select(
            q.expected_value(F.col("v"), levels)).first()[0]
        assert 1.0 < got < math.exp(sigma ** 2 / 2) * 1.05     # flat tails stay conservative


def test_forecast_is_the_weekday_quantile(make_series):
    values = [float((i % 7 + 1) * 10 + i // 7) for i in range(140)]
    series = make_series({"a": (0, values), "short": (100, [1.0] * 27)})
    rows = {r.step: r for r in fc.forecast_latest(series).collect()}
    assert sorted(rows) == list(range(1, 92))
    logs = np.log1p(values)
    for step in (1, 6, 7, 8, 91):
        target = 139 + step
        past = [logs[t] for t in range(20, 140) if (target - t) % 7 == 0]
        assert rows[step].time_idx == target and rows[step].origin_time_idx == 140
        assert rows[step].q_log == pytest.approx(list(np.quantile(past, LEVELS)))
    missing = fc.missing_forecasts(series, fc.forecast_latest(series)).collect()
    assert [(r.merchant_id, r.history_days) for r in missing] == [("short", 27)]


@pytest.mark.parametrize("part", ["train", "validation", "holdout"])
def test_windows_and_join_give_the_same_forecasts(make_series, part):
    cfg = Config(horizon=10, val_days=20, max_encoder_length=30, min_encoder_length=4)
    series = make_series({"a": (3, [float(i % 11) for i in range(80)]),
                          "b": (40, [float(i % 5) for i in range(43)])})
    left = fc.forecast_part(series, part, cfg)
    right = fc.forecast(series, pnl.window_origins(series, part, cfg), cfg).select(*left.columns)
    key = lambda r: (r.merchant_id, r.origin_time_idx, r.step)
    one, two = sorted(left.collect(), key=key), sorted(right.collect(), key=key)
    assert one and list(map(key, one)) == list(map(key, two))
    for x, y in zip(one, two):
        assert x.time_idx == y.time_idx and x.q_log == pytest.approx(y.q_log, abs=1e-12)


def test_latest_and_general_forms_agree(make_series):
    series = make_series({"a": (3, [float(i % 11) for i in range(200)]),
                          "b": (9, [float(i % 5) for i in range(40)])})
    origins = pnl.latest_origins(series)
    left, right = fc.forecast(series, origins), fc.forecast_latest(series)
    key = lambda r: (r.merchant_id, r.step)
    assert sorted(map(tuple, left.collect()), key=lambda t: (t[0], t[2])) == sorted(
        map(tuple, right.collect()), key=lambda t: (t[0], t[2]))
    assert left.count() == 182


def test_baselines_against_brute_force(make_series):
    cfg = Config(horizon=10, min_encoder_length=8, max_encoder_length=9, val_days=5)
    values = {"a": (0, [float(i * i % 17) for i in range(40)]),
              "b": (18, [float(i % 6) for i in range(22)])}
    series = make_series(values)
    origins = pnl.window_origins(series, "holdout", cfg)
    rows = baselines.with_baselines(pnl.decoder_rows(origins, cfg), series, cfg).collect()
    assert len(rows) == 20
    for r in rows:
        start, revenue = values[r.merchant_id]
        at = lambda t: revenue[t - start] if 0 <= t - start < len(revenue) else 0.0
        origin = r.origin_time_idx - 1
        back = -r.step % 7
        assert r.naive_last == at(origin)
        assert r.seasonal_naive == sum(at(origin - back - 7 * k) for k in range(4)) / 4


def predictions(spark, rows):
    names = [q.quantile_name(x) for x in LEVELS]
    return spark.createDataFrame(
        [(m, float(a), *map(float, qs)) for m, a, qs in rows],
        "merchant_id string, actual_gbp double, " + ", ".join(f"{n} double" for n in names))


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(5)
    actual = np.round(rng.gamma(1.0, 100.0, 41), 2)
    predicted = np.sort(rng.gamma(1.0, 100.0, (41, 9)), axis=1)
    frame = predictions(spark, [("a", a, p) for a, p in zip(actual, predicted)])
    row = metrics.forecast_metrics(frame).first()
    error = predicted[:, 4] - actual
    loss = sum(np.maximum(t * (actual - predicted[:, i]), (t - 1) * (actual - predicted[:, i])).sum()
               for i, t in enumerate(LEVELS))
    assert row.n == 41
    assert row.MAE_gbp == pytest.approx(np.abs(error).mean())
    assert row.RMSE_gbp == pytest.approx(np.sqrt((error ** 2).mean()))
    assert row.MedAE_gbp == pytest.approx(np.median(np.abs(error)))
    assert row.wQL == pytest.approx(loss / actual.sum())
    assert row.coverage_p10_p90 == pytest.approx(
        ((actual >= predicted[:, 1]) & (actual <= predicted[:, 7])).mean())


def test_wql_is_undefined_without_revenue(spark):
    row = metrics.forecast_metrics(predictions(spark, [("a", 0, [0] * 9)])).first()
    assert row.wQL is None and row.sMAPE == 0


@pytest.mark.parametrize("level, band", [
    (0.0, None), (0.01, "<100"), (100.0, "<100"), (100.01, "100-1k"), (1000.0, "100-1k"),
    (10000.0, "1k-10k"), (100000.0, "10k-100k"), (100000.5, ">100k"), (None, None)])
def test_size_bands(spark, level, band):
    row = spark.createDataFrame([(level,)], "x double").select(size_band(F.col("x"))).first()
    assert row[0] == band


@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False) | st.sampled_from([0.0, 5.0]),
                min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]))
@settings(max_examples=8, deadline=None)
def test_exact_percentiles(spark, values, level):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    row = exact_percentiles(frame, "x", [level, 0.5]).first()
    assert row.percentiles == pytest.approx(
        [np.quantile(values, level), np.quantile(values, 0.5)], rel=1e-9, abs=1e-9)


def test_exact_percentiles_per_key_with_a_hot_value(spark):
    frame = spark.range(3000).select(
        (F.col("id") % 3).alias("k"), F.when(F.col("id") % 4 == 0, 1.5).otherwise(
            F.sqrt("id")).alias("x")).where("k < 2 OR id < 30")
    rows = exact_percentiles(frame, "x", LEVELS, ["k"]).collect()
    data = frame.toPandas()
    assert len(rows) == 3
    for r in rows:
        assert r.percentiles == pytest.approx(list(data[data.k == r.k].x.quantile(LEVELS)))


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e12])
def test_exact_percentiles_at_any_magnitude(spark, scale):
    """Values of a narrow range are ordered in part only, whatever their size."""
    frame = spark.range(0, 200_000, 1, 8).select(
        (F.pmod(F.xxhash64("id"), F.lit(100_000)) * scale).alias("x"))
    row = exact_percentiles(frame, "x", LEVELS).first()
    assert row.percentiles == pytest.approx(
        list(frame.toPandas().x.quantile(LEVELS)), rel=1e-12, abs=0)


def test_a_bad_sketch_does_not_change_percentiles(spark, monkeypatch):
    monkeypatch.setattr(stats, "ACCURACY", 3)
    frame = spark.range(0, 1000, 1, 8).select((F.col("id") % 3).alias("k"), F.sqrt("id").alias("x"))
    data = frame.toPandas()
    for r in exact_percentiles(frame, "x", LEVELS, ["k"]).collect():
        assert r.percentiles == pytest.approx(list(data[data.k == r.k].x.quantile(LEVELS)))


def test_no_values_have_no_percentiles(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert exact_percentiles(empty, "x", [0.5]).count() == 0
    assert exact_percentiles(empty, "x", [0.5], ["k"]).count() == 0


def test_percentiles_without_cross_joins_or_many_exchanges(spark):
    frame = spark.range(100).select((F.col("id") % 3).alias("k"), F.rand(1).alias("x"))
    for keys in ([], ["k"]):
        plan = exact_percentiles(frame, "x", [0.1, 0.5], keys)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) <= 6


def test_skewness_is_bias_corrected(spark):
    row = spark.createDataFrame([(x,) for x in (1.0, 2.0, 10.0, 20.0)], "x double").agg(
        sample_skewness(F.col("x"))).first()
    assert row[0] == pytest.approx(0.97788, abs=1e-5)


def test_scale_floor_and_fallback(spark):
    rows = [("a", 5.0)] * 10 + [("b", float(x)) for x in np.linspace(0, 10, 10)] + [("one", 2.0)]
    fitted = norm.fit_normaliser(spark.createDataFrame(rows, "merchant_id string, tpv double"))
    got = {r.merchant_id: (r.center, r.scale) for r in fitted.collect()}
    assert got["a"] == (5.0, 0.25)
    assert got["b"] == pytest.approx((5.0, np.std(np.linspace(0, 10, 10), ddof=1)))
    assert got["one"] == (2.0, 0.25)
    pairs = {r.merchant_id: r for r in norm.scale_pairs(
        spark.createDataFrame([("a",), ("new",)], "merchant_id string"), fitted).collect()}
    assert not pairs["a"].cold_start and pairs["new"].cold_start
    assert (pairs["new"].center, pairs["new"].scale) == (5.0, 0.25)


def test_codes_are_dense_and_ordered(spark):
    values = [f"m{i:04d}" for i in range(500)]
    frame = spark.createDataFrame([(v,) for v in values + values[:99]] + [(None,)], "x string")
    codes = norm.category_codes(frame.repartition(7), "x")
    assert [(r.value, r.code) for r in codes.orderBy("value").collect()] == [
        (v, i + 1) for i, v in enumerate(values)]
    unseen = spark.createDataFrame([("m0003",), ("zz",), (None,)], "x string")
    coded = sorted(r.x_code for r in norm.encode(unseen, "x", codes).collect())
    assert coded == [0, 0, 4]


def test_masking_is_repeatable_and_near_its_rate(spark):
    origins = spark.range(20000).select(
        (F.col("id") % 100).cast("string").alias("merchant_id"),
        F.col("id").alias("origin_time_idx"), F.lit(7).alias("merchant_id_code"))
    masked = norm.mask_identity(origins)
    share = masked.agg(F.avg((F.col("merchant_id_code") == 0).cast("double"))).first()[0]
    assert 0.13 < share < 0.17
    assert norm.mask_identity(origins.repartition(5)).exceptAll(masked).isEmpty()


def test_summary_flags_and_undefined_ratios(make_series):
    live = [50.0 + i % 7 for i in range(400)]
    dormant = [50.0 + i % 7 for i in range(300)] + [0.0] * 100
    series = make_series({"live": (0, live), "dormant": (0, dormant), "new": (340, live[:60]),
                          "stale": (0, live[:200])})
    run = plan.Forecasts(series)
    rows = {r.merchant_id: r for r in run.summary.collect()}
    assert rows["live"].days_since_last_observation == 0
    assert rows["stale"].days_since_last_observation == 200
    assert rows["new"].cold_start and not rows["new"].had_training_windows
    assert not rows["live"].cold_start and rows["live"].had_training_windows
    assert rows["dormant"].recent28_mean_gbp == 0 and rows["dormant"].level_ratio is None
    assert 0.9 < rows["live"].level_ratio < 1.1
    assert (rows["live"].forecast_end_date - rows["live"].forecast_start_date).days == 90
    totals = summary.run_totals(run.summary).first()
    assert (totals.forecasts, totals.current, totals.stale) == (4, 3, 1)
    assert (totals.cold_start, totals.untrained, totals.dormant) == (1, 1, 1)
    failing = {r.merchant_id for r in summary.sanity_failures(run.summary).collect()}
    assert "live" not in failing
    assert summary.top_merchants(series, run.table, 2).count() == 2
    assert summary.top_merchants(series, run.table, -1).count() == 4
    assert summary.top_merchants(series, run.table, 0).count() == 0


def test_scale_alignment_counts_a_shifted_pair(make_series):
    series = make_series({m: (0, [float(i % k) for i in range(420)]) for m, k in (("a", 5), ("b", 9))})
    split = pnl.Split(series)
    fitted = norm.fit_normaliser(series.where(F.col("time_idx") <= split.train_cutoff))
    origins = pnl.window_origins(series, "validation").withColumn("part", F.lit("validation"))
    good = norm.scale_alignment(origins, series, fitted, split.train_cutoff).first()
    assert (good.checked, good.mismatched) == (26, 0)
    off = fitted.withColumn("scale", F.when(F.col("merchant_id") == "a", F.col("scale") + .1)
                            .otherwise(F.col("scale")))
    assert norm.scale_alignment(origins, series, off, split.train_cutoff).first().mismatched == 13


@pytest.mark.parametrize("start", [0, 117])
def test_window_arrays_are_cut_from_blocks_of_days(spark, make_series, start):
    series = make_series({"a": (start, [float(i % 9) for i in range(520)]), "b": (3, [1.0 + i for i in range(430)])})
    origins = pnl.window_origins(series, "validation")
    scales = norm.fit_normaliser(series)
    arrays = pnl.window_arrays(series, origins, [Config().target], [DATE], scales, Config())
    values = {(r.merchant_id, r.time_idx): (r[Config().target], r[DATE]) for r in series.collect()}
    want = {(o.merchant_id, o.origin_time_idx): o.encoder_start_idx for o in origins.collect()}
    rows = arrays.collect()
    assert len(rows) == len(want) > 0
    for row in rows:
        origin = row.origin_time_idx
        first = want[row.merchant_id, origin]
        assert [tuple(d) for d in row.encoder] == [
            (t, *values[row.merchant_id, t]) for t in range(first, origin)]
        assert [tuple(d) for d in row.decoder] == [
            (t, values[row.merchant_id, t][1]) for t in range(origin, origin + Config().horizon)]
        assert row.scale is not None
    plan = arrays._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.count("Join") == 2
