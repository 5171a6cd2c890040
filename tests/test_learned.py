import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.config import Config
from tillcast.operators import effects as fx
from tillcast.operators import learned, quality
from tillcast.operators import moments as mm
from tillcast.operators import quantile_fit as qf
from tillcast.operators import window_blocks as wb
from tillcast.operators.baselines import with_baselines
from tillcast.operators.metrics import baseline_metrics
from tillcast.plans.forecasting import Forecasts, evaluate, evaluation_rows
from tillcast.plans.learned import Learner, learned_forecast
from tillcast.plans.prepare import core_columns, prepare

CFG = Config(horizon=14, val_days=42, max_encoder_length=56, min_encoder_length=28)


@pytest.fixture
def prepared(make_fact):
    week = [100, 110, 120, 130, 300, 40, 20]
    rows = [(m, n, scale * (week[n % 7] + (n * 37) % 11), 5, m)
            for m, scale in (("small", 1.0), ("large", 100.0)) for n in range(300)]
    fact = make_fact(rows).withColumns({
        "daily_transaction_amount": F.col("daily_successful_transaction_count"),
        **{c: F.lit(0.0) for c in ("daily_unsuccessful_amount_gbp", "daily_fraud_amount",
                                   "daily_dispute_amount")}})
    return prepare(fact, CFG)


def test_learned_forecast_follows_the_week(prepared):
    rows = learned_forecast(prepared, CFG).collect()
    assert len(rows) == 28
    assert all(list(r.q_log) == sorted(r.q_log) for r in rows)
    level = {(r.merchant_id, r.time_idx % 7): r.q_log[4] for r in rows}
    for merchant in ("small", "large"):
        assert level[(merchant, 4)] > level[(merchant, 3)] > level[(merchant, 6)]
    assert all(level[("large", d)] > level[("small", d)] + 3 for d in range(7))


def test_a_calendar_without_warehouse_columns(prepared):
    panel = prepared.panel
    quality.require_complete(panel)
    new_year = panel.where("request_date = '2024-01-01'").first()
    assert new_year.is_uk_bank_holiday == "True" and new_year.holiday_offset == 0
    assert new_year.day_of_week == "1"
    with pytest.raises(ValueError):
        quality.require_complete(panel.withColumn("tpv", F.lit(None).cast("double")))


@pytest.fixture
def learner(prepared):
    return Learner(prepared, CFG, stride=5)


def test_sums_equal_those_of_exploded_windows(learner):
    windows = learner.windows(learner.origins("train"), training=True)
    state = {(r["left"], r["right"]): r["total"] for r in learner.state(windows).collect()}
    rows = learned.window_rows(learner.days, windows, CFG)
    names = [*learner.names, mm.ONE, mm.LABEL]
    pairs = [(a, b) for a in names for b in names if a <= b]
    expected = rows.agg(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).first()
    assert set(state) == set(pairs)
    for pair, value in zip(pairs, expected):
        assert state[pair] == pytest.approx(value, rel=1e-9, abs=1e-6), pair


def test_sums_need_no_row_per_step(learner):
    windows = learner.windows(learner.origins("train"))
    frame = mm.moments(learner.days, windows, list(learned.ORIGIN_INPUTS), ["is_month_end"], CFG)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_a_refit_adds_the_later_windows(learner):
    first, later, every = (learner.origins("train"), learner.origins("validation"),
                           learner.origins("train", full=True))
    assert first.count() < every.count() and later.count()
    fit = learner.fit()
    refit = learner.refit(fit)
    whole = learner.state(learner.windows(every, training=True))
    got, want = ({(r["left"], r["right"]): r["total"] for r in s.collect()} for s in (refit.state, whole))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in want)
    assert refit.plan.rows > fit.plan.rows


def test_every_training_window_gives_rows_to_the_fit(prepared):
    learner = Learner(prepared, CFG)
    fit = learner.fit()
    windows = learner.windows(learner.origins("train"), training=True)
    rows = learned.window_rows(learner.days, windows, CFG)
    assert rows.count() == windows.count() * CFG.horizon == fit.plan.rows
    got, want = (qf.optimality(r, fit.plan, fit.levels, CFG.quantiles) for r in (fit.rows, rows))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6, abs=1e-12)


def _sums(rows, plan, fits):
    """Both kernels of a round and the slopes of the optimality check, over all rows."""
    tried = np.stack([fits, fits + 0.1], axis=1)
    rows = qf._stored(rows)
    return [qf._summed(rows, plan, qf._normal(fits, CFG.quantiles, 0.1)),
            qf._summed(rows, plan, qf._losses(tried, CFG.quantiles, 0.1)),
            np.array([g[2] for g in qf.optimality(rows, plan, fits, CFG.quantiles)])]


def _plan_and_fits(learner, windows, names):
    plan = qf.design(learner.state(windows), names)
    fits = np.random.default_rng(3).normal(size=(len(CFG.quantiles), 1 + len(plan.names)))
    return plan, plan.least_squares + 0.1 * fits


@pytest.mark.parametrize("without", [(), (mm.WEEKDAY,), (mm.STEP, "level7"), (mm.WEEKDAY, mm.STEP)])
def test_sums_over_blocks_equal_those_over_rows(learner, without):
    windows = learner.windows(learner.origins("train"), training=True)
    plan, fits = _plan_and_fits(learner, windows, [n for n in learner.names if n not in without])
    blocks = wb.stored_blocks(learner.days, windows, learned.ORIGIN_INPUTS,
                              learned.day_inputs(learner.roles), plan.rows, CFG)
    rows = learned.window_rows(learner.days, windows, CFG)
    for got, want in zip(_sums(blocks, plan, fits), _sums(rows, plan, fits), strict=True):
        assert got == pytest.approx(want, rel=1e-8, abs=1e-7)


def test_blocks_of_days_missing_or_twice(learner):
    windows = learner.windows(learner.origins("train"), training=True)
    plan, fits = _plan_and_fits(learner, windows, learner.names)
    days = learner.days.where("NOT (merchant_id = 'small' AND time_idx IN (50, 51, 70))")
    days = days.where("merchant_id = 'small' OR time_idx < 84 OR time_idx >= 98")   # a whole block
    days = days.unionByName(days.where("merchant_id = 'large' AND time_idx IN (60, 120)"))
    begun = days.select("merchant_id", F.col("time_idx").alias("origin_time_idx"))
    windows = windows.join(begun, ["merchant_id", "origin_time_idx"], "left_semi")
    blocks = wb.stored_blocks(days, windows, learned.ORIGIN_INPUTS,
                              learned.day_inputs(learner.roles), plan.rows, CFG)
    rows = learned.window_rows(days, windows, CFG)
    for got, want in zip(_sums(blocks, plan, fits), _sums(rows, plan, fits), strict=True):
        assert got == pytest.approx(want, rel=1e-8, abs=1e-7)


def test_a_fit_stores_no_row_per_step(learner):
    fit = learner.fit()
    assert fit.rows.frame.count() <= 2 * (300 // CFG.horizon + 1)


def test_fit_reaches_a_minimum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + (1 + 0.5 * np.abs(x[:, 0])) * rng.exponential(size=20_000)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)],
                                 "a double, b double, label double").repartition(4).cache()
    names = ["a", "b", "one", "label"]
    columns = dict(zip(names, [x[:, 0], x[:, 1], np.ones(len(y)), y]))
    state = spark.createDataFrame([(p, q, float(columns[p] @ columns[q])) for p in names for q in names
                                   if p <= q], mm.SCHEMA)
    plan = qf.design(state, ["a", "b"])
    levels = (0.02, 0.5, 0.9)
    fits = qf.fit_quantiles(rows, plan, levels)
    assert max(gap for _, _, gap in qf.optimality(rows, plan, fits, levels)) < 0.002
    scored = rows.select("label", qf.quantile_columns(plan, fits).alias("q"))
    for i, level in enumerate(levels):
        share = scored.agg(F.avg((F.col("label") <= F.col("q")[i]).cast("double"))).first()[0]
        assert share == pytest.approx(level, abs=0.004)


def test_inputs_without_information_are_named(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 500))
    data = {"a": a, "b": b, "flat": np.full(500, 7.0), "sum": a - 2 * b + 3, "one": np.ones(500),
            "label": a + b}
    names = sorted(data)
    state = spark.createDataFrame([(p, q, float(data[p] @ data[q])) for p in names for q in names if p <= q],
                                  mm.SCHEMA)
    plan = qf.design(state, ["a", "flat", "b", "sum"])
    assert plan.names == ("a", "b") and plan.dropped == ("flat", "sum") and plan.rows == 500
    assert plan.least_squares[1:] / plan.spread == pytest.approx([1, 1])


def test_effects_are_learned_elsewhere(spark):
    cfg = Config(horizon=10)
    rows = [(t, "x" if t % 2 else "y", 4.0 if t < 10 else 1.0) for t in range(100)] + [(5, None, 9.0)]
    frame = spark.createDataFrame(rows, "time_idx long, kind string, label double")
    found = fx.category_effects(frame, ["kind"], cfg, folds=5, prior=10)
    told = {r.value: (r.days, list(r.effects)) for r in found.collect()}
    assert set(told) == {"x", "y"} and told["x"][0] == 50
    assert told["x"][1][0] == pytest.approx((5 * 4 + 45) / 60)
    assert told["x"][1][1] == pytest.approx(40 / 50)          # without the fold of days 0-9 and 50-59
    assert told["x"][1][2] == pytest.approx((5 * 4 + 35) / 50)
    new = spark.createDataFrame([(3, "x"), (13, "x"), (400, "x"), (3, "z"), (3, None)], "time_idx long, kind string")
    fold = F.when(F.col("time_idx") < 100, fx.fold_of(F.col("time_idx"), cfg))
    got = [r.kind_effect for r in fx.with_effects(new, found, ["kind"], fold).collect()]
    assert sorted(got) == pytest.approx(sorted([0.8, 1.1, 65 / 60, 0.0, 0.0]))


def test_masked_windows_know_no_merchant(learner):
    origins = learner.origins("train")
    masked = learner.windows(origins, training=True).where("identity = 0").count()
    assert 0.05 < masked / origins.count() < 0.3
    newest = learner.windows(origins.limit(5))
    assert newest.where("identity != 0").count() == 5
    strange = newest.withColumn("merchant_id", F.lit("nobody")).drop("identity")
    rows = learned.with_identity(strange, learner.effects, learner.cutoff, CFG).collect()
    assert [r.identity for r in rows] == [0.0] * 5


def test_the_fitted_forecaster_is_delivered(prepared):
    series = prepared.panel.select(*core_columns(CFG))
    learner = Learner(prepared, CFG, stride=5)
    fit = learner.fit()
    table = evaluate(series, CFG, forecaster=lambda part: learner.forecast(fit, part)).collect()
    assert {r.part for r in table} == {"validation", "holdout"} and all(r.n > 0 for r in table)
    rows = evaluation_rows(series, CFG, ("holdout",), forecaster=lambda part: learner.forecast(fit, part))
    naive = {r.baseline: r.MAE_log for r in baseline_metrics(with_baselines(rows, series, CFG)).collect()}
    (fitted,) = (r.MAE_log for r in table if r.part == "holdout")
    assert fitted < 0.5 * naive["naive_last"], (fitted, naive)
    run = Forecasts.of(prepared.observed, CFG, learner.forecast(fit))
    assert run.table.count() == 2 * CFG.horizon and run.missing.count() == 0
    assert run.summary.count() == 2
