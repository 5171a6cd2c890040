import pytest
from pyspark.sql import functions as F

from tillcast.config import Config
from tillcast.operators import features, panel as pnl
from tillcast.plans.prepare import clean_fact, core_series, observe

LOOSE = Config(min_series_days=1, min_log_std=0.0, min_active_days=0)


def grid(fact, cfg=Config()):
    return {(r.merchant_id, r.request_date): r
            for r in pnl.daily_grid(clean_fact(fact, cfg), cfg).collect()}


def test_gaps_become_zeros_and_attributes_carry(make_fact, day):
    rows = grid(make_fact([("a", 0, 5.0, 1, None, None), ("a", 3, 7.0, 2, "n", day(-9))]))
    assert len(rows) == 4
    gap = rows[("a", day(1))]
    assert gap.daily_successful_amount_gbp == 0 and gap.daily_successful_transaction_count == 0
    assert gap.target_imputed == 0
    assert gap.merchant_name == "unknown"
    assert gap.merchant_created_datetime == day(-9)         # filled from the row to come


def test_attributes_never_known_stay_null(make_fact):
    rows = grid(make_fact([("a", 0, 5.0, 1), ("a", 2, 7.0, 2)]))
    assert {r.merchant_created_datetime for r in rows.values()} == {None}


def test_latest_attribute_wins_in_a_gap(make_fact, day):
    rows = grid(make_fact([("a", 0, 5.0, 1, "old", day(-1)), ("a", 2, 7.0, 2, "new", None)]))
    assert rows[("a", day(1))].merchant_name == "old"
    assert rows[("a", day(2))].merchant_name == "new"
    assert rows[("a", day(2))].merchant_created_datetime == day(-1)


def test_leading_zeros_are_trimmed_and_saleless_merchants_vanish(make_fact, day):
    fact = make_fact([("a", 0, 0.0, 0), ("a", 2, 5.0, 1), ("a", 4, 0.0, 0), ("b", 0, 0.0, 1),
                      ("b", 1, None, 0)])
    assert sorted(grid(fact)) == [("a", day(n)) for n in (2, 3, 4)]
    untrimmed = grid(fact, Config(trim_leading_zeros=False))
    assert len(untrimmed) == 7


def test_sparse_statistics_equal_dense_ones(make_fact):
    fact = make_fact([("a", n, float(n % 4) * 10, 1) for n in range(0, 90, 3)]
                     + [("b", 5, 3.0, 1)] + [("c", n, 8.0, 1) for n in range(40)])
    sparse = {r.merchant_id: r for r in observe(fact).select(
        "merchant_id", *pnl.STAT_COLUMNS).distinct().collect()}
    dense = {r.merchant_id: r for r in pnl.series_stats(
        core_series(fact, Config(), filtered=False)).collect()}
    assert set(sparse) == set(dense) == {"a", "b", "c"}
    for merchant, row in dense.items():
        other = sparse[merchant]
        assert other.series_days == row.days and other.series_active_days == row.active_days
        assert other.series_log_std == pytest.approx(row.log_std, abs=1e-12)
    assert sparse["b"].series_log_std is None                # one day has no spread


def test_both_filters_keep_the_same_series(make_fact):
    fact = make_fact([("long", n, float(n % 5), 1) for n in range(60)]
                     + [("flat", n, 8.0, 1) for n in range(60)]
                     + [("short", n, float(n), 1) for n in range(29)]
                     + [("idle", n * 3, float(n + 1), 1) for n in range(19)])
    kept = {r.merchant_id for r in core_series(fact).select("merchant_id").distinct().collect()}
    dense = core_series(fact, Config(), filtered=False)
    same = {r.merchant_id for r in pnl.filter_series(dense).select("merchant_id").distinct().collect()}
    assert kept == same == {"long"}
    report = pnl.filter_report(pnl.series_stats(dense)).first()
    assert (report.merchants, report.kept) == (4, 1)
    assert (report.too_short, report.near_constant, report.barely_active) == (1, 1, 1)


def test_axis_starts_at_the_first_sale_of_any_series(make_fact, day):
    fact = make_fact([("gone", 3, 1.0, 1)] + [("a", n, float(n % 5), 1) for n in range(10, 70)])
    first = core_series(fact).orderBy("request_date").first()
    assert first.merchant_id == "a"
    assert first.request_date == day(11) and first.time_idx == 8 == first.series_start_idx


@pytest.mark.parametrize("days_before, expected", [(27, None), (28, 28), (120, 120), (121, 120)])
def test_encoder_bounds(make_series, days_before, expected):
    series = make_series({"a": (5, [1.0] * (days_before + 91))})
    origins = pnl.window_origins(series, "holdout").collect()
    if expected is None:
        assert origins == []
    else:
        assert [(o.origin_time_idx, o.encoder_length) for o in origins] == [
            (5 + days_before, expected)]
        assert origins[0].encoder_start_idx == origins[0].origin_time_idx - expected


def test_holdout_needs_the_newest_day(make_series):
    series = make_series({"a": (0, [1.0] * 200), "b": (0, [1.0] * 199)})
    assert [o.merchant_id for o in pnl.window_origins(series, "holdout").collect()] == ["a"]


def test_origins_against_brute_force(make_series):
    cfg = Config(horizon=5, val_days=20, min_encoder_length=4, max_encoder_length=10, val_stride=3)
    spans = {"a": (0, 60), "b": (7, 40), "c": (30, 30), "d": (52, 8)}
    series = make_series({m: (s, [1.0] * n) for m, (s, n) in spans.items()})
    max_t = 59
    val, sel = max_t - 5, max_t - 25

    def expected(part):
        found = set()
        for m, (s, n) in spans.items():
            last, taken = s + n - 1, 0
            for o in range(s + 4, last - 4 + 1):
                if part == "train" and o + 4 <= sel:
                    found.add((m, o))
                if part == "validation" and o > sel and o + 4 <= val:
                    if taken % 3 == 0:
                        found.add((m, o))
                    taken += 1
                if part == "holdout" and o > val:
                    found.add((m, o))
        return found

    for part in ("train", "validation", "holdout"):
        rows = pnl.window_origins(series, part, cfg).collect()
        assert {(r.merchant_id, r.origin_time_idx) for r in rows} == expected(part), part
    full = pnl.window_origins(series, "train", cfg, full=True).agg(F.max("origin_time_idx")).first()[0]
    assert full == max_t - 4


def test_split_bounds(make_series):
    row = pnl.split_bounds(make_series({"a": (0, [1.0] * 300), "b": (250, [2.0] * 50)})).first()
    assert (row.max_time_idx, row.val_cutoff, row.sel_cutoff, row.train_cutoff) == (299, 208, 28, 28)
    assert (row.train_rows, row.train_merchants) == (29, 1)


def test_ratios_skip_absent_groups_and_empty_days(spark):
    frame = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0)], "core_amount double, rest_amount double")
    rows = features.with_mix_ratios(frame).collect()
    assert [(r.core_amount_ratio, r.rest_amount_ratio) for r in rows] == [(0.75, 0.25), (0.0, 0.0)]
    assert features.ratio_names(frame.columns) == ["core_amount_ratio", "rest_amount_ratio"]


def test_roles_guard_the_target():
    roles = features.column_roles(["tpv", "year_sin1", "merchant_id", "day_of_week"])
    assert roles.observed_reals == ("tpv",) and roles.known_reals == ("year_sin1",)
    with pytest.raises(ValueError):
        roles.without_observed(["tpv"])
    with pytest.raises(ValueError):
        Config(report_quantiles=(0.4,))


def test_constant_columns_are_pruned(spark):
    frame = spark.createDataFrame(
        [(0, 1.0, 5.0), (1, 2.0, 5.0), (9, 3.0, 6.0)],
        "time_idx long, tpv double, log_fraud_count double")
    roles = features.column_roles(frame.columns)
    kept = features.informative_roles(frame, roles, F.lit(5))
    assert kept.observed_reals == ("tpv",)      # the other only varies after the cutoff
