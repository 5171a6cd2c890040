"""Registered Spark queries: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillcast.config import (
    CALENDAR_COLUMNS, COUNT_COLUMNS, Config, DATE, MERCHANT, MERCHANT_ATTRIBUTES, PAYMENT_COUNTS,
    TIME, ZERO_ON_INACTIVE_DAY,
)
from tillcast.functions.columns import size_band
from tillcast.functions import quantiles
from tillcast.functions.quantiles import quantile_name
from tillcast.functions.staging import snapshot, staging_folder
from tillcast.functions.stats import exact_percentiles
from tillcast.operators import (
    baselines, calendar as cal, daily, effects as fx, features, forecast as fc, learned, metrics,
    moments as mm, normaliser as norm, panel as pnl, quality, quantile_fit as qf, rollup, summary,
)
from tillcast.plans import forecasting as plan
from tillcast.plans.learned import Learner, learned_forecast
from tillcast.plans.prepare import (
    Prepared, clean_fact, core_columns, core_series, dense_series, observe, prepare,
)
from tillcast.sources import fixture, readers, sinks

CFG = Config()
QCOLS = [quantile_name(q) for q in CFG.quantiles]
RATIOS = features.ratio_names(COUNT_COLUMNS)
#: Thresholds of which each drops some suppliers of the test tables.
SELECTIVE = Config(min_series_days=2480, min_log_std=3.35, min_active_days=275)
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def r(column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero.  Most values of an idle day are zero as they are."""
    if not isinstance(column, str):
        return F.round(column, digits) + F.lit(0.0)
    value = F.col(column)
    rounded = F.round(value, digits) + F.lit(0.0)
    return F.when(value == 0, F.lit(0.0)).otherwise(rounded).alias(column)


def log(spark: SparkSession, folder: str, merchant: str = "supplier", calendar: bool = False):
    rows = fixture.transactions(spark, folder, merchant)
    return fixture.with_warehouse_calendar(rows) if calendar else rows


#: Suppliers have few line items a day; nations and regions have many, of many suppliers' names.
GROUPING = {"supplier": "gathered", "nation": "sorted", "region": "sorted"}
#: All of the fact that features other than the mix ratios are made from.
BESIDE_RATIOS = (DATE, MERCHANT, *ZERO_ON_INACTIVE_DAY, *CALENDAR_COLUMNS, *MERCHANT_ATTRIBUTES)
#: The same but for the suppliers' names, which neither a forecaster nor the calendar reads.
UNNAMED = tuple(c for c in BESIDE_RATIOS if c != "merchant_name")
MEASURED = (*UNNAMED, *[c for c in COUNT_COLUMNS if c not in UNNAMED])


def fact(spark, folder, merchant="supplier", calendar=False, columns=None) -> DataFrame:
    """All of the fact, or the columns that a query reads.

    The texts of nations and regions are few but for the suppliers' names.  Without those the log
    is hashed: a task holds a row for each merchant-day and category, however long its share.
    """
    rows, grouping = log(spark, folder, merchant, calendar), GROUPING[merchant]
    if columns is None:
        return daily.daily_fact(rows, grouping=grouping)
    if grouping == "sorted" and "merchant_name" not in columns:
        grouping = "hashed"
    attributes = [c for c in (*CALENDAR_COLUMNS, *MERCHANT_ATTRIBUTES) if c in columns]
    return daily.daily_fact(rows, attributes, grouping=grouping).select(*columns)


def slim_fact(spark, folder, merchant="supplier") -> DataFrame:
    """Revenue, successes and names only: the rest is never read, summed or grouped by."""
    rows = daily.daily_fact(log(spark, folder, merchant), ["merchant_name"],
                            grouping=GROUPING[merchant])
    return rows.select(
        DATE, MERCHANT, "merchant_name", CFG.raw_target, "daily_successful_transaction_count")


def stored_fact(spark, folder, merchant="supplier", columns=None) -> DataFrame:
    """The fact with its calendar as a stored table, read several times by a prepared panel."""
    return snapshot(fact(spark, folder, merchant, True, columns), "fact")


def prepared(spark, folder, merchant="region", filtered=True, columns=None) -> Prepared:
    return prepare(stored_fact(spark, folder, merchant, columns), CFG, filtered)


def stored_observed(spark, folder, merchant="region") -> DataFrame:
    """The sparse series, stored: a single pass over the raw log."""
    return snapshot(observe(slim_fact(spark, folder, merchant), CFG), "observed")


def stored_series(spark, folder, merchant="region") -> DataFrame:
    """Dense series over the stored sparse one."""
    observed = stored_observed(spark, folder, merchant)
    return dense_series(observed, CFG).select(*core_columns(CFG))


def both_forms(spark, folder, merchant="region") -> tuple[DataFrame, DataFrame]:
    """Dense series and the sparse form they are made from."""
    observed = stored_observed(spark, folder, merchant)
    return dense_series(observed, CFG).select(*core_columns(CFG)), observed


# ---------------------------------------------------------------- daily fact

@query
def daily_fact(spark, folder):
    rows = fact(spark, folder, calendar=True)
    money = [c for c in rows.columns if c.endswith("_gbp")]
    return rows.withColumns({c: F.col(c).cast("double") for c in money})


@query
def daily_fact_by_region(spark, folder):
    rows = fact(spark, folder, "region")
    money = [c for c in rows.columns if c.endswith("_gbp")]
    return rows.withColumns({c: F.col(c).cast("double") for c in money})


@query
def daily_fact_strict_returns(spark, folder):
    rows = daily.daily_fact(log(spark, folder), [], strict_reference=True)
    return rows.select(DATE, MERCHANT, F.col("daily_refund_amount_gbp").cast("double").alias(
        "daily_refund_amount_gbp"), F.col("daily_void_amount_gbp").cast("double").alias(
        "daily_void_amount_gbp"))


@query
def log_size(spark, folder):
    rows = log(spark, folder, calendar=True)
    return readers.frame_size(rows).withColumn(
        "without_merchant", quality.null_merchant_rows(rows).select("without_merchant").scalar())


@query
def presentation_cutoff(spark, folder):
    rows = daily.without_months(log(spark, folder, calendar=True), 1998, ["June", "July"])
    return daily.daily_fact(rows, ["calendar_year", "calendar_month"]).groupBy("calendar_year", "calendar_month").agg(
        F.count(F.lit(1)).alias("merchant_days"),
        F.sum("daily_successful_amount_gbp").cast("double").alias("revenue_gbp"))


@query
def daily_fact_imputed(spark, folder):
    rows = clean_fact(slim_fact(spark, folder), CFG)
    return rows.select(MERCHANT, DATE, r(CFG.raw_target), "target_imputed",
                       "daily_successful_transaction_count")


@query
def coerced_attributes(spark, folder):
    rows = daily.coerce_fact(fact(spark, folder))
    return rows.select(MERCHANT, DATE, "merchant_name", "merchant_category", "sector_group",
                       "iso_name", "merchant_created_datetime", "unknown_amount")


@query
def coerced_text(spark, folder):
    """Dates and money as text, some of it unreadable, and ids with blanks around them."""
    rows = fixture.table(spark, folder, "lineitem").select(
        F.concat(F.lit("  "), F.col("l_suppkey").cast("string"), F.lit(" ")).alias(MERCHANT),
        F.when(F.col("l_linenumber") == 7, "not a date").otherwise(
            F.date_format("l_shipdate", "yyyy-MM-dd")).alias(DATE),
        F.when(F.col("l_discount") == 0, "n/a").otherwise(
            F.col("l_extendedprice").cast("string")).alias(CFG.raw_target))
    return daily.coerce_fact(rows).groupBy(MERCHANT, DATE).agg(
        F.count(F.lit(1)).alias("rows"), F.count(CFG.raw_target).alias("readable"),
        r(F.sum(CFG.raw_target), 2).alias("revenue_gbp"))


@query
def imputed_after_copies(spark, folder):
    """Rows of the log as copies of a day: medians over all of them, the last one kept."""
    rows = log(spark, folder).select(
        DATE, MERCHANT, "ingest_key", "ingest_line", F.col("amount_gbp").alias(CFG.raw_target),
        F.when(F.upper("response_result") == "SUCCESS", 1.0).otherwise(0.0)
        .alias("daily_successful_transaction_count"))
    kept = clean_fact(rows, CFG, ["ingest_key", "ingest_line"])
    return kept.select(MERCHANT, DATE, "ingest_key", "ingest_line", r(CFG.raw_target),
                       "target_imputed")


@query
def latest_row_per_day(spark, folder):
    rows = log(spark, folder).drop("iso_id")
    last = daily.latest_per_day(rows, ["ingest_key", "ingest_line"])
    return last.select(DATE, MERCHANT, "ingest_key", "ingest_line", "response_result",
                       "payment_type", "transaction_type",
                       F.col("amount_gbp").cast("double").alias("amount_gbp"))


# ---------------------------------------------------------------- calendar

def lookup_and_range(spark, folder):
    rows = log(spark, folder, calendar=True).select(DATE, *CALENDAR_COLUMNS)
    lookup = snapshot(cal.calendar_lookup(rows), "calendar")
    return lookup, cal.covered_range(lookup)


@query
def calendar_lookup(spark, folder):
    return cal.calendar_lookup(log(spark, folder, calendar=True))


@query
def calendar_lookup_first_row(spark, folder):
    """Rows of a date disagree about its labels: the earliest speaks, as a whole."""
    items = fixture.table(spark, folder, "lineitem")
    rows = items.select(F.col("l_shipdate").cast("date").alias(DATE), "l_orderkey",
                        F.col("l_linenumber").alias("day_of_week"),
                        F.col("l_returnflag").alias("day_name"),
                        F.col("l_linestatus").alias("day_type"))
    return cal.calendar_lookup(rows, "l_orderkey")


@query
def calendar_dim(spark, folder):
    days = log(spark, folder).select(DATE).distinct()
    return cal.calendar_from_dates(days, cal.bank_holidays(spark, *fixture.CALENDAR_YEARS))


@query
def calendar_week(spark, folder):
    lookup, (first, last) = lookup_and_range(spark, folder)
    days = cal.days_between(spark, first, last + dt.timedelta(days=CFG.horizon))
    dim = cal.calendar_from_dates(days, cal.bank_holidays(spark, first, last))
    return dim.select(DATE, "calendar_week_of_year")


@query
def bank_holidays(spark, folder):
    _, (first, last) = lookup_and_range(spark, folder)
    return cal.bank_holidays(spark, first, last)


@query
def calendar_features(spark, folder):
    lookup, covered = lookup_and_range(spark, folder)
    end = covered[1] + dt.timedelta(days=CFG.horizon)
    frame = cal.calendar_features(lookup, covered, end).frame
    waves = [c for c in frame.columns if "_sin" in c or "_cos" in c]
    return frame.select(*[c for c in frame.columns if c not in waves], *[r(c) for c in waves])


@query
def holiday_offset(spark, folder):
    lookup, covered = lookup_and_range(spark, folder)
    return cal.calendar_features(lookup, covered).frame.select(DATE, "holiday_offset")


@query
def calendar_agreement(spark, folder):
    lookup, _ = lookup_and_range(spark, folder)
    return quality.calendar_agreement(lookup)


@query
def holiday_diff(spark, folder):
    lookup, (first, last) = lookup_and_range(spark, folder)
    return quality.holiday_differences(lookup, first, last).agg(
        F.count(F.lit(1)).alias("differences"))


def faulty_lookup(spark, folder):
    """A warehouse calendar with wrong labels, missing holidays and holidays of its own."""
    lookup, covered = lookup_and_range(spark, folder)
    day, month = F.dayofmonth(DATE), F.month(DATE)
    return lookup.withColumns({
        "day_name": F.when(day == 13, "Someday").otherwise(F.col("day_name")),
        "day_of_month": F.when((day == 1) & (month == 3), 2).otherwise(F.col("day_of_month")),
        "is_uk_bank_holiday": F.when((month == 12) & (day == 26), False)
        .when((month == 6) & (day == 2), True).otherwise(F.col("is_uk_bank_holiday")),
    }), covered


@query
def calendar_agreement_faulty(spark, folder):
    table = quality.calendar_agreement(faulty_lookup(spark, folder)[0])
    return table.select("column_name", "dates", r("agreement"), "first_difference")


@query
def holiday_diff_faulty(spark, folder):
    lookup, (first, last) = faulty_lookup(spark, folder)
    return quality.holiday_differences(lookup, first, last)


@query
def upcoming_holidays(spark, folder):
    _, (_, last) = lookup_and_range(spark, folder)
    return quality.upcoming_holidays(spark, last, CFG)


# ---------------------------------------------------------------- panel

def _grid(spark, folder, trim: bool) -> DataFrame:
    cfg = Config(trim_leading_zeros=trim)
    grid = pnl.daily_grid(clean_fact(fact(spark, folder), cfg), cfg)
    return grid.select(
        MERCHANT, DATE, r(CFG.raw_target), "daily_transaction_amount",
        "daily_successful_transaction_count",
        F.col("daily_payout_amount_gbp").cast("double").alias("daily_payout_amount_gbp"),
        "target_imputed", "card_amount", "shift4_amount", "merchant_name", "merchant_category",
        "sector_group", "iso_name", "merchant_created_datetime")


@query
def daily_grid(spark, folder):
    return _grid(spark, folder, trim=False)


@query
def grid_trimmed(spark, folder):
    return _grid(spark, folder, trim=True)


@query
def grid_by_nation(spark, folder):
    """Attributes vary inside a nation, so the carried values show."""
    grid = pnl.daily_grid(clean_fact(fact(spark, folder, "nation"), CFG), CFG)
    return grid.select(MERCHANT, DATE, r(CFG.raw_target), "merchant_name", "merchant_category",
                       "iso_name", "merchant_created_datetime")


@query
def series_span(spark, folder):
    series = core_series(slim_fact(spark, folder), CFG, filtered=False)
    return series.groupBy(MERCHANT).agg(
        F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
        F.min("series_start_idx").alias("series_start_idx"),
        F.max(TIME).alias("last_time_idx"))


FEATURES = ["log_success_count", "log_unsuccessful_gbp", "log_fraud_count", "log_dispute_count",
            "log_avg_ticket", "log_merchant_age", "log_tenure_at_series_start"]


def _features(spark, folder, merchant, filtered):
    panel = prepared(spark, folder, merchant, filtered, BESIDE_RATIOS).panel
    return panel.select(
        MERCHANT, DATE, TIME, "series_start_idx", r("tpv"), *[r(c) for c in FEATURES],
        "is_zero_day", "had_no_attempts", "target_imputed", "since_merchant_creation",
        "day_of_week", "day_of_month", "calendar_month", "day_type", "is_uk_bank_holiday",
        "merchant_category", "sector_group", "iso_name", r("year_sin1"), r("month_cos2"),
        "is_payday_window", "holiday_offset")


@query
def panel_features(spark, folder):
    return _features(spark, folder, "supplier", filtered=False)


@query
def panel_features_by_nation(spark, folder):
    return _features(spark, folder, "nation", filtered=True)


@query
def mix_ratios(spark, folder):
    series = core_series(fact(spark, folder, "nation"), CFG, filtered=False)
    return features.with_mix_ratios(series).select(MERCHANT, DATE, *[r(c) for c in RATIOS])


@query
def series_stats(spark, folder):
    panel = core_series(slim_fact(spark, folder), CFG, filtered=False)
    stats = pnl.series_stats(panel, CFG)
    return stats.select(MERCHANT, "days", r("log_std"), "active_days")


@query
def series_filter(spark, folder):
    cfg = SELECTIVE
    observed = observe(slim_fact(spark, folder), cfg)
    return pnl.where_usable(observed, cfg).groupBy(MERCHANT).agg(
        F.count(F.lit(1)).alias("observed_days"))


@query
def filter_report(spark, folder):
    cfg = SELECTIVE
    panel = core_series(slim_fact(spark, folder), cfg, filtered=False)
    return pnl.filter_report(pnl.series_stats(panel, cfg), cfg)


@query
def filtered_panel(spark, folder):
    cfg = SELECTIVE
    panel = core_series(slim_fact(spark, folder), cfg, filtered=False)
    return pnl.filter_series(panel, cfg).groupBy(MERCHANT).agg(
        F.count(F.lit(1)).alias("days"), r(F.sum(cfg.raw_target), 4).alias("revenue_gbp"))


@query
def target_profile(spark, folder):
    profile = metrics.target_profile(stored_series(spark, folder, "nation"), CFG)
    return profile.select("n", r("mean_gbp", 4), "median_gbp", "max_gbp", r("zero_day_share"),
                          r("mean_log"), r("std_log"), r("skew_log"), r("skew_gbp"))


# ---------------------------------------------------------------- split and windows

@query
def split_bounds(spark, folder):
    return pnl.split_bounds(stored_series(spark, folder), CFG)


@query
def split_bounds_full(spark, folder):
    return pnl.split_bounds(stored_series(spark, folder), CFG, full=True)


@query
def window_origins(spark, folder):
    series = stored_series(spark, folder, "nation")
    return pnl.window_origins(series, "train", CFG)


@query
def val_origins_strided(spark, folder):
    return pnl.window_origins(stored_series(spark, folder, "nation"), "validation", CFG)


@query
def holdout_origins(spark, folder):
    return pnl.window_origins(stored_series(spark, folder, "nation"), "holdout", CFG)


@query
def window_arrays(spark, folder):
    """Arrays of the validation windows, folded to sums that depend on every element's place."""
    ready = prepared(spark, folder, "region")
    panel, split = ready.panel, ready.split(CFG)
    origins = pnl.window_origins(panel, "validation", CFG, max_t=split.max_t)
    scales = norm.fit_normaliser(panel.where(F.col(TIME) <= split.train_cutoff), CFG)
    arrays = pnl.window_arrays(panel, origins, ["tpv", "log_success_count"],
                               ["days_to_month_end", "holiday_offset"], scales, CFG)

    def weighted(array: str, field: str) -> Column:
        terms = F.transform(array, lambda x, i: x[field] * (i + 1))
        return r(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 4)

    return arrays.select(
        MERCHANT, "origin_time_idx", F.size("encoder").cast("long").alias("encoder_days"),
        F.size("decoder").cast("long").alias("decoder_days"),
        weighted("encoder", "tpv").alias("encoder_tpv"),
        weighted("encoder", "holiday_offset").alias("encoder_offset"),
        weighted("decoder", "days_to_month_end").alias("decoder_month_end"),
        r("center"), r("scale"))


# ---------------------------------------------------------------- codes and scaling

@query
def category_codes(spark, folder):
    panel = fact(spark, folder).select(MERCHANT, "merchant_category", "sector_group", "iso_name")
    frames = [norm.category_codes(panel, c).select(F.lit(c).alias("column_name"), "value", "code")
              for c in panel.columns]
    both = frames[0]
    for frame in frames[1:]:
        both = both.unionByName(frame)
    return both


@query
def encoded_rows(spark, folder):
    """Codes learnt from early rows only, applied to all: unseen and NULL give 0."""
    rows = fact(spark, folder).select(DATE, MERCHANT, "iso_name")
    early = rows.where(F.col(DATE) < F.lit(dt.date(1995, 1, 20)))
    coded = norm.encode(rows, "iso_name", norm.category_codes(early, "iso_name"))
    return coded.groupBy("iso_name", "iso_name_code").agg(F.count(F.lit(1)).alias("rows"))


def _fitted(spark, folder, merchant="nation"):
    series = stored_series(spark, folder, merchant)
    training = series.where(F.col(TIME) <= pnl.Split(series, CFG).train_cutoff)
    return series, norm.fit_normaliser(training, CFG)


@query
def group_normaliser(spark, folder):
    _, fitted = _fitted(spark, folder)
    return fitted.select(MERCHANT, r("center"), r("scale"))


@query
def normaliser_fallback(spark, folder):
    _, fitted = _fitted(spark, folder)
    return norm.fallback_scale(fitted).select(r("center"), r("scale"))


@query
def normalised_target(spark, folder):
    series, fitted = _fitted(spark, folder)
    scaled = norm.normalise(series, fitted, CFG)
    back = norm.denormalised(F.col("tpv_scaled"))
    return scaled.select(MERCHANT, TIME, r("tpv_scaled", 5), r(back, 5).alias("tpv_back"))


@query
def cold_start(spark, folder):
    """Scale pairs when the fit ends before some suppliers' first sale."""
    series = snapshot(core_series(slim_fact(spark, folder), CFG, filtered=False).select(
        MERCHANT, TIME, "tpv"), "series")
    fitted = norm.fit_normaliser(series.where(F.col(TIME) <= 10), CFG)
    return norm.scale_pairs(series, fitted).select(
        MERCHANT, "cold_start", r("center"), r("scale"))


@query
def column_spread(spark, folder):
    ready = prepared(spark, folder, "nation", columns=MEASURED)
    panel = ready.panel
    roles = features.column_roles(panel.columns, CFG)
    spread = features.column_spread(
        panel, roles.observed_reals, ready.split(CFG).train_cutoff)
    return spread.select(*[r(c) for c in spread.columns])


@query
def informative_columns(spark, folder):
    ready = prepared(spark, folder, "nation")
    roles = features.column_roles(ready.panel.columns, CFG)
    cutoff = ready.split(CFG).train_cutoff
    spread = snapshot(features.column_spread(ready.panel, roles.observed_reals, cutoff), "spread")
    kept = features.informative_names(spread, roles.observed_reals)
    names = F.array(*[F.lit(c) for c in kept]).cast("array<string>")
    return spread.select(F.explode(names).alias("column_name"))


@query
def group_mask(spark, folder):
    series = stored_series(spark, folder, "nation")
    codes = norm.category_codes(series, MERCHANT)
    origins = pnl.window_origins(series, "validation", CFG)
    return norm.mask_identity(norm.encode(origins, MERCHANT, codes), CFG)


@query
def scale_alignment(spark, folder):
    series, fitted = _fitted(spark, folder)
    origins = pnl.window_origins(series, "validation", CFG).withColumn("part", F.lit("validation"))
    origins = origins.unionByName(
        pnl.window_origins(series, "holdout", CFG).withColumn("part", F.lit("holdout")))
    cutoff = pnl.Split(series, CFG).train_cutoff
    return norm.scale_alignment(origins, series, fitted, cutoff)


@query
def scale_floor(spark, folder):
    """The floor bites where the log of the ticket count hardly moves."""
    series = snapshot(core_series(slim_fact(spark, folder), CFG).select(
        MERCHANT, TIME, F.log1p("daily_successful_transaction_count").alias("tpv")), "series")
    fitted = norm.fit_normaliser(series, CFG)
    spread = quality.normaliser_spread(fitted, CFG)
    return spread.select("merchants", "distinct_pairs", r("lowest_center"), r("highest_center"),
                         r("lowest_scale"), r("highest_scale"), "on_floor")


# ---------------------------------------------------------------- future frame

def _future(spark, folder, merchant="region", columns=None):
    ready = prepared(spark, folder, merchant, columns=columns)
    calendar = ready.future_calendar(CFG)
    return ready, calendar


@query
def future_frame(spark, folder):
    ready, calendar = _future(spark, folder, "nation", (*UNNAMED, *PAYMENT_COUNTS))
    rows = pnl.future_rows(ready.panel, calendar, ready.ratio_names, CFG)
    return rows.select(
        MERCHANT, TIME, DATE, "tpv", CFG.raw_target, "log_success_count", "card_amount_ratio",
        "card_amount", "day_of_week", "day_of_month", "calendar_month", "day_type",
        "is_uk_bank_holiday", "holiday_offset", "days_to_month_end", r("year_cos1"),
        r("log_merchant_age"), r("log_tenure_at_series_start"), "since_merchant_creation")


@query
def history_and_future(spark, folder):
    ready, calendar = _future(spark, folder, columns=UNNAMED)
    whole = pnl.with_future(ready.panel, calendar, ready.ratio_names, CFG)
    return whole.groupBy(MERCHANT).agg(
        F.count(F.lit(1)).alias("days"), F.min(TIME).alias("first_time_idx"),
        F.max(TIME).alias("last_time_idx"), F.max(DATE).alias("last_date"),
        F.sum("is_zero_day").alias("zero_days"))


@query
def future_batch_vs_single(spark, folder):
    """The stalest, shortest and largest merchant, each built alone, against the batch."""
    ready, calendar = _future(spark, folder)
    panel = snapshot(ready.panel, "panel")
    ends = panel.groupBy(MERCHANT).agg(F.max(TIME).alias("t"), F.count(F.lit(1)).alias("n"),
                                       F.avg(CFG.raw_target).alias("v"))
    chosen = set(ends.agg(F.min_by(MERCHANT, F.struct("t", MERCHANT)),
                          F.min_by(MERCHANT, F.struct("n", MERCHANT)),
                          F.max_by(MERCHANT, F.struct("v", MERCHANT))).first()) - {None}
    batch = pnl.with_future(panel, calendar, ready.ratio_names, CFG)
    singles = panel.limit(0)  # all there is to compare if the filter left no merchant
    for merchant in sorted(chosen):
        singles = singles.unionByName(
            pnl.single_future(panel, merchant, calendar, ready.ratio_names, CFG))
    return quality.table_differences(
        singles, batch.where(F.col(MERCHANT).isin(*chosen))).select("only_left", "only_right")


@query
def future_calendar_check(spark, folder):
    ready, calendar = _future(spark, folder, columns=UNNAMED)
    return quality.future_calendar_check(
        pnl.future_rows(ready.panel, calendar, ready.ratio_names, CFG))


@query
def min_history(spark, folder):
    """Lengths chosen among those of the suppliers' series."""
    cfg = Config(min_encoder_length=2475, max_encoder_length=2475, horizon=10)
    return quality.min_history(core_series(slim_fact(spark, folder), cfg), cfg)


# ---------------------------------------------------------------- forecasts

def _table(spark, folder, merchant="region"):
    return plan.Forecasts.of(stored_observed(spark, folder, merchant), CFG)


@query
def quantile_forecast(spark, folder):
    rows = fc.forecast_latest(stored_series(spark, folder), CFG)
    return rows.select(MERCHANT, "origin_time_idx", "step", TIME,
                       *[r(F.col("q_log")[i]).alias(c) for i, c in enumerate(QCOLS)])


@query
def quantile_forecast_by_origin(spark, folder):
    """The general form over explicit origins gives the newest origin's forecast too."""
    series = stored_series(spark, folder)
    rows = fc.forecast(series, pnl.latest_origins(series, CFG), CFG)
    return rows.select(MERCHANT, "origin_time_idx", "step", TIME,
                       *[r(F.col("q_log")[i]).alias(c) for i, c in enumerate(QCOLS)])


@query
def forecast_report(spark, folder):
    table = _table(spark, folder).table
    return fc.report_columns(table, CFG).select(
        MERCHANT, TIME, "date", r("q35", 4), r("q50", 4), r("q65", 4), r("expected_gbp", 4))


@query
def ml_quantile_forecast(spark, folder):
    """The fitted forecaster (no SQL: it solves a regression)."""
    rows = learned_forecast(prepared(spark, folder, "nation"), CFG)
    return rows.select(MERCHANT, "origin_time_idx", "step", TIME,
                       *[r(F.col("q_log")[i]).alias(c) for i, c in enumerate(QCOLS)])


@query
def ml_forecast_keys(spark, folder):
    """Merchant, origin, step and date of every row the fitted forecaster gives."""
    ready = prepared(spark, folder, "nation")
    first_day = pnl.axis_start(ready.observed)
    return learned_forecast(ready, CFG).select(
        MERCHANT, "origin_time_idx", "step", TIME,
        F.date_add(first_day, F.col(TIME).cast("int")).alias("date"))


#: Inputs of the matrix that SQL sums over exploded windows.
SOME_DAYS = ("year_cos1", "is_month_start", "is_payday_window", "days_to_month_end",
             "holiday_offset", "log_merchant_age")
SOME_LEVELS = ("level7", "level28", "level120", "highest", "idle")


def _some_moments(learner: Learner, origins: DataFrame) -> DataFrame:
    windows = learner.windows(origins)
    return mm.moments(learner.days, windows, list(SOME_LEVELS), list(SOME_DAYS), CFG)


def _means(state: DataFrame) -> DataFrame:
    """Sums of products per row of the windows, and how many such rows there are."""
    rows = state.where("left = 'one' AND right = 'one'").select("total").scalar()
    return state.select("left", "right", r(F.when(rows > 0, F.col("total") / rows), 5).alias("mean"),
                        F.round(rows).cast("long").alias("n"))


@query
def ml_moments(spark, folder):
    """The products of all training windows and steps, summed in one pass over the days."""
    learner = Learner(prepared(spark, folder, "region"), CFG)
    return _means(snapshot(_some_moments(learner, learner.origins("train")), "moments"))


@query
def ml_full_refit_state(spark, folder):
    """The sums of the training windows and those of the later ones, merged."""
    learner = Learner(prepared(spark, folder, "region"), CFG)
    first, every = learner.origins("train"), learner.origins("train", full=True)
    new = every.join(first, [MERCHANT, "origin_time_idx"], "left_anti")
    return _means(snapshot(mm.merged(
        _some_moments(learner, first), _some_moments(learner, new)), "moments"))


@query
def category_effects(spark, folder):
    """Effects of merchants, sectors and calendar columns, out of fold and shrunken."""
    learner = Learner(prepared(spark, folder, "nation", columns=UNNAMED), CFG)
    return learner.effects.select("column", "value", "days", *[
        r(F.col("effects")[i]).alias(f"effect{i}") for i in range(fx.FOLDS + 1)])


@query
def masked_identity(spark, folder):
    """Training windows of each merchant: how many are masked, and that those have effect zero."""
    learner = Learner(prepared(spark, folder, "nation", columns=UNNAMED), CFG)
    windows = learner.windows(learner.origins("train"), training=True)
    return windows.groupBy(MERCHANT).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col(learned.IDENTITY) == 0).alias("without_identity"),
        r(F.sum(learned.IDENTITY), 4).alias("total_identity"))


@query
def ml_pinball_gradient(spark, folder):
    """How far each level's fit is from a minimum of its pinball loss: the largest slope."""
    fit = Learner(prepared(spark, folder, "region"), CFG).fit()
    gaps = qf.optimality(fit.rows, fit.plan, fit.levels, CFG.quantiles)
    rows = spark.createDataFrame(gaps, "level double, input string, gap double")
    return rows.groupBy("level").agg(r(F.max("gap"), 2).alias("largest_gap"))


@query
def ml_dropped_inputs(spark, folder):
    """Constant and collinear inputs that the fit names and leaves out, from the sums alone."""
    learner = Learner(prepared(spark, folder, "region"), CFG)
    days = learner.days.withColumns({
        "constant": F.lit(3.5), "twice": 2 * F.col("days_to_month_end") - 1,
        "blend": F.col("is_month_start") - 3 * F.col("is_payday_window")})
    names = [*SOME_DAYS, "constant", "twice", "blend"]
    state = mm.moments(days, learner.windows(learner.origins("train")), list(SOME_LEVELS), names, CFG)
    plan_ = qf.design(snapshot(state, "moments"), [*SOME_LEVELS, *names])
    return spark.createDataFrame([(n,) for n in plan_.dropped], "input string").withColumn(
        "windows", F.lit(int(plan_.rows / CFG.horizon)).cast("long"))


@query
def ml_evaluation_rows(spark, folder):
    """The fitted forecaster in the evaluation: rows, origins and revenue by part and merchant."""
    learner = Learner(prepared(spark, folder, "region"), CFG)
    fit = learner.fit()
    series, observed = both_forms(spark, folder)
    rows = plan.evaluation_rows(series, CFG, observed=observed,
                                forecaster=lambda part: learner.forecast(fit, part))
    ordered = F.lit(True)
    for low, high in zip(QCOLS, QCOLS[1:]):
        ordered = ordered & (F.col(low) <= F.col(high))
    return rows.groupBy("part", MERCHANT).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("origin_time_idx").alias("origins"),
        F.round(F.sum(F.col("actual_gbp").cast("decimal(28,6)")), 2).cast("double").alias("actual_gbp"),
        F.count_if(~ordered).alias("crossed"))


@query
def scale_alignment_faulty(spark, folder):
    """Pairs of every third merchant shifted, and those of every fifth stretched."""
    series, fitted = _fitted(spark, folder)
    number = F.col(MERCHANT).cast("int")
    shifted = fitted.withColumns({
        "center": F.col("center") + F.when(number % 3 == 0, 0.5).otherwise(0.0),
        "scale": F.col("scale") * F.when(number % 5 == 0, 1.5).otherwise(1.0)})
    origins = pnl.window_origins(series, "validation", CFG)
    found = norm.scale_alignment(origins, series, shifted, pnl.Split(series, CFG).train_cutoff, ())
    return found.withColumn("part", F.lit("validation"))


@query
def decoder_dates(spark, folder):
    ready, calendar = _future(spark, folder)
    series = snapshot(ready.panel, "panel")
    frame = pnl.with_future(series, calendar, ready.ratio_names, CFG)
    return fc.dates_missing(plan.Forecasts(series, CFG).table, frame).agg(
        F.count(F.lit(1)).alias("days_without_date"))


@query
def holdout_predictions(spark, folder):
    series, observed = both_forms(spark, folder)
    rows = plan.evaluation_rows(series, CFG, ("holdout",), observed)
    return rows.select("part", MERCHANT, "origin_time_idx", TIME, "step", DATE,
                       r("actual_gbp", 4), *[r(c, 4) for c in QCOLS], r("expected_gbp", 4))


@query
def validation_predictions(spark, folder):
    series, observed = both_forms(spark, folder, "nation")
    rows = plan.evaluation_rows(series, CFG, ("validation",), observed)
    return rows.select("part", MERCHANT, "origin_time_idx", TIME, "step", DATE,
                       r("actual_gbp", 4), *[r(c, 4) for c in QCOLS], r("expected_gbp", 4))


@query
def baseline_last(spark, folder):
    series, observed = both_forms(spark, folder, "nation")
    rows = plan.holdout_baselines(series, CFG, observed)
    return rows.select(MERCHANT, "step", TIME, r("actual_gbp", 4), r("naive_last", 4))


@query
def baseline_seasonal(spark, folder):
    series, observed = both_forms(spark, folder, "nation")
    rows = plan.holdout_baselines(series, CFG, observed)
    return rows.select(MERCHANT, "step", TIME, r("actual_gbp", 4), r("seasonal_naive", 4))


@query
def baseline_metrics(spark, folder):
    series, observed = both_forms(spark, folder)
    rows = plan.holdout_baselines(series, CFG, observed)
    table = metrics.baseline_metrics(rows)
    return table.select("baseline", "n", r("MAE_gbp", 4), r("RMSE_gbp", 4), r("MAE_log"))


@query
def baseline_val_mae(spark, folder):
    series = stored_series(spark, folder, "nation")
    origins = pnl.window_origins(series, "validation", CFG)
    error = baselines.validation_baseline_error(series, origins, CFG)
    return error.select("n", r("mae_log"))


def _rounded_metrics(table):
    money = ["MAE_gbp", "RMSE_gbp", "MedAE_gbp", "bias_gbp"]
    keys = [c for c in table.columns if c in ("part", "n")]
    return table.select(
        *keys, *[r(c, 4) for c in money], r("total_actual_gbp", 2), r("total_pred_median_gbp", 2),
        *[r(c) for c in ("MAE_log", "wQL", "sMAPE", "coverage_p10_p90", "coverage_outer")])


@query
def forecast_metrics(spark, folder):
    series, observed = both_forms(spark, folder)
    rows = plan.evaluation_rows(series, CFG, ("holdout",), observed)
    return _rounded_metrics(metrics.forecast_metrics(snapshot(rows, "predictions"), (), CFG))


@query
def metrics_by_split(spark, folder):
    series, observed = both_forms(spark, folder, "nation")
    return _rounded_metrics(plan.evaluate(series, CFG, observed))


@query
def metrics_by_band(spark, folder):
    series, observed = both_forms(spark, folder, "nation")
    rows = plan.evaluation_rows(series, CFG, ("holdout",), observed)
    table = metrics.metrics_by_band(rows, series, CFG)
    return table.select("band", "n", r("MAE_gbp", 4), r("MAE_log"), r("sMAPE"))


@query
def exact_medians(spark, folder):
    """Global and per-flag exact percentiles of line item prices, without gathering them."""
    items = fixture.table(spark, folder, "lineitem")
    q = exact_percentiles(items, "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"])
    return q.select("l_returnflag", *[
        r(F.col("percentiles")[i], 4).alias(c) for i, c in enumerate(("q10", "q50", "q90"))])


# ---------------------------------------------------------------- summary

def _rounded_summary(table):
    money = ["recent28_mean_gbp", "horizon_total_median_gbp", "horizon_total_expected_gbp"]
    return table.withColumns({**{c: r(F.col(c), 2) for c in money},
                              **{c: r(F.col(c)) for c in ("level_ratio", "dispersion_ratio")}})


@query
def forecast_summary(spark, folder):
    return _rounded_summary(_table(spark, folder).summary)


@query
def forecast_summary_by_supplier(spark, folder):
    return _rounded_summary(_table(spark, folder, "supplier").summary)


@query
def sanity_failures(spark, folder):
    failures = summary.sanity_failures(_table(spark, folder, "nation").summary, 15)
    return failures.select(MERCHANT, "history_days", "days_since_last_observation",
                           r("recent28_mean_gbp", 2), r("horizon_total_median_gbp", 2),
                           r("level_ratio"), r("dispersion_ratio"))


@query
def top_merchants(spark, folder):
    run = _table(spark, folder, "nation")
    return summary.top_merchants(run.series, run.table, 10, CFG).select(
        MERCHANT, r("mean_daily_gbp", 4))


@query
def run_totals(spark, folder):
    totals = summary.run_totals(_table(spark, folder, "nation").summary)
    return totals.withColumns({c: r(F.col(c), 2) for c in
                               ("total_median_gbp", "total_expected_gbp")})


def uneven_fact(spark, folder) -> DataFrame:
    """Nations of which some stop early, some start late, and some sell nothing at the end."""
    kind = F.col(MERCHANT).cast("int") % 5
    rows = slim_fact(spark, folder, "nation").where(
        ~((kind == 0) & (F.col(DATE) >= dt.date(1999, 1, 1)))
        & ~((kind == 1) & (F.col(DATE) < dt.date(2001, 6, 1))))
    silent = (kind == 2) & (F.col(DATE) >= dt.date(2001, 1, 1))
    revenue = F.col(CFG.raw_target).cast("double")
    return rows.withColumn(CFG.raw_target, F.when(silent, 0.0).otherwise(revenue))


def _uneven_run(spark, folder) -> plan.Forecasts:
    return plan.Forecasts.of(snapshot(observe(uneven_fact(spark, folder), CFG), "observed"), CFG)


@query
def forecast_summary_uneven(spark, folder):
    return _rounded_summary(_uneven_run(spark, folder).summary)


@query
def run_totals_uneven(spark, folder):
    totals = summary.run_totals(_uneven_run(spark, folder).summary)
    return totals.withColumns({c: r(F.col(c), 2) for c in
                               ("total_median_gbp", "total_expected_gbp")})


@query
def quantile_order(spark, folder):
    """Levels out of order: columns of line items as if they were quantiles."""
    price, quantity, tax = (F.col(f"l_{c}") for c in ("extendedprice", "quantity", "tax"))
    levels = F.array(quantity * 1000, price, tax * 500000, price / quantity * 10)
    rows = fixture.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias(MERCHANT), quantiles.crossings(levels, 4).alias("crossings"),
        quantiles.rearranged(levels).alias("q"))
    return rows.groupBy(MERCHANT).agg(
        F.sum("crossings").cast("long").alias("crossings"),
        *[r(F.sum(F.col("q")[i]), 2).alias(f"level_{i + 1}") for i in range(4)])


@query
def recent_level(spark, folder):
    history = summary.merchant_history(stored_series(spark, folder, "nation"), F.lit(10**9), CFG)
    return history.select(MERCHANT, "merchant_name", "history_days", "last_observed_date",
                          "last_time_idx", r("recent28_mean_gbp", 4))


@query
def missing_forecasts(spark, folder):
    """Suppliers whose series is too short for a forecast, from the unfiltered panel."""
    cfg = Config(min_encoder_length=2470, max_encoder_length=2470)
    series = snapshot(core_series(slim_fact(spark, folder), cfg, filtered=False).select(
        *core_columns(cfg)), "series")
    return plan.Forecasts(series, cfg).missing


@query
def merchant_report(spark, folder):
    """Ratios as log1p: floored denominators make them as large as 1e12."""
    run = _table(spark, folder)
    report = summary.merchant_report(run.series, run.table, "1", CFG)
    money = [c for c in report.columns if c.endswith("_gbp")]
    return report.withColumns({
        **{c: r(F.col(c), 2) for c in money},
        **{f"{c}_log1p": r(F.log1p(c)) for c in ("level_ratio", "dispersion_ratio")},
    }).drop("level_ratio", "dispersion_ratio")


@query
def merchant_bands(spark, folder):
    levels = metrics.merchant_level(stored_series(spark, folder, "nation"), CFG)
    return levels.select(MERCHANT, r("mean_daily_gbp", 4),
                         size_band(F.col("mean_daily_gbp")).alias("band"))


@query
def training_days(spark, folder):
    series = stored_series(spark, folder, "nation")
    cutoff = pnl.Split(series, CFG).train_cutoff
    return summary.merchant_history(series, cutoff, CFG).select(
        MERCHANT, "train_days", (F.col("train_days") >= CFG.training_window_days).alias(
            "had_training_windows"))


@query
def whale_share(spark, folder):
    panel = snapshot(prepared(spark, folder, "nation").panel.select(
        MERCHANT, *[c for pair in quality.SCALED_PAIRS for c in pair]), "panel")
    table = quality.whale_share(panel, CFG)
    return table.select("column_name", "rows", "whale_rows", "passes",
                        *[r(c, 5) for c in ("raw_share", "log_share", "raw_spread", "log_spread")])


@query
def whale_share_scaled(spark, folder):
    """Revenue scaled by nation, so that the smallest and the largest band are filled."""
    kind = F.col(MERCHANT).cast("int") % 3
    factor = F.when(kind == 0, 0.001).when(kind == 1, 10.0).otherwise(1.0)
    rows = fact(spark, folder, "nation", True, UNNAMED).withColumn(
        CFG.raw_target, F.col(CFG.raw_target).cast("double") * factor)
    panel = snapshot(prepare(snapshot(rows, "fact"), CFG).panel.select(
        MERCHANT, *[c for pair in quality.SCALED_PAIRS for c in pair]), "panel")
    table = quality.whale_share(panel, CFG)
    return table.select("column_name", "rows", "whale_rows", "passes",
                        *[r(c, 5) for c in ("raw_share", "log_share", "raw_spread", "log_spread")])


# ---------------------------------------------------------------- rollup and files

def _actuals(spark, folder, merchant="supplier"):
    rows = slim_fact(spark, folder, merchant).select(
        F.col(MERCHANT).cast("long").alias(MERCHANT), DATE, CFG.raw_target)
    return snapshot(rows, "fact")


@query
def inactive_merchants(spark, folder):
    return rollup.inactive_merchants(_actuals(spark, folder), CFG)


@query
def forecast_repair(spark, folder):
    """Repair rules over line items: price as the expectation, shares of it as quantiles."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    rows = fixture.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias(MERCHANT), F.col("l_shipdate").cast("date").alias(DATE),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(quantity * 100).alias("q35"),
        F.when(F.col("l_tax") == 0, 0.0).otherwise(quantity * 300).alias("q50"),
        F.when(F.col("l_linenumber") != 3, quantity * 700).alias("q65"),
        price.alias("expected_gbp"))
    fixed = rollup.repair_forecasts(rows)
    return fixed.groupBy(MERCHANT, DATE).agg(
        *[r(F.sum(c), 4).alias(c) for c in fixed.columns if c.startswith("daily_")])


def _rounded_months(months):
    return months.withColumns({c: r(F.col(c), 2) for c in months.columns
                               if c.startswith("daily_")})


def _numbered(rows):
    """The test tables' merchants are numbers."""
    return rows.withColumn(MERCHANT, F.col(MERCHANT).cast("long"))


def _labelled(rows):
    """Merchants under ids that are no numbers and no plain folder names."""
    return rows.withColumn(MERCHANT, F.concat(F.lit("S-"), MERCHANT, F.lit(" a/b+50%")))


def _run(source) -> plan.Forecasts:
    """Forecasts of a stored fact, over its stored sparse series."""
    return plan.Forecasts.of(snapshot(observe(source, CFG), "observed"), CFG)


@query
def monthly_rollup(spark, folder):
    source = snapshot(slim_fact(spark, folder, "region"), "fact")
    return _numbered(_rounded_months(plan.monthly(source, _run(source).table, CFG)))


@query
def monthly_rollup_text_ids(spark, folder):
    source = snapshot(_labelled(slim_fact(spark, folder, "region")), "fact")
    return _rounded_months(plan.monthly(source, _run(source).table, CFG))


@query
def monthly_rollup_by_supplier(spark, folder):
    source = snapshot(slim_fact(spark, folder), "fact")
    return _numbered(_rounded_months(plan.monthly(source, _run(source).table, CFG)))


@query
def forecast_files_scan(spark, folder):
    """Forecast files written per merchant, read back by path and consolidated."""
    target = f"{staging_folder(spark).rstrip('/')}/forecast-files-{uuid.uuid4().hex}"
    sinks.write_forecasts(_table(spark, folder).table, target, CFG)
    rows = _numbered(readers.read_forecasts(spark, target))
    return rows.select(MERCHANT, TIME, DATE, *[r(c, 4) for c in (
        "q35", "q50", "q65", "expected_gbp")])


@query
def forecast_files_text_ids(spark, folder):
    """The same for merchants whose ids a folder's name must escape."""
    target = f"{staging_folder(spark).rstrip('/')}/forecast-files-{uuid.uuid4().hex}"
    sinks.write_forecasts(_labelled(_table(spark, folder).table), target, CFG)
    return readers.read_forecasts(spark, target).select(
        MERCHANT, TIME, DATE, *[r(c, 4) for c in ("q35", "q50", "q65", "expected_gbp")])


# ---------------------------------------------------------------- files

def _path(spark, name: str) -> str:
    return f"{staging_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _csv(spark, frame, path):
    return spark.read.schema(frame.schema).option("header", True).csv(path)


@query
def log_files(spark, folder):
    """The log written under its full schema and read back by path."""
    path = _path(spark, "log")
    rows = log(spark, folder, calendar=True)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in readers.TRANSACTION_SCHEMA]).write.parquet(path)
    facts = daily.daily_fact(readers.read_transactions(spark, path),
                             grouping=GROUPING["supplier"])
    return facts.withColumns({
        "merchant_created_datetime": F.col("merchant_created_datetime").cast("date"),
        **{c: F.col(c).cast("double") for c in facts.columns if c.endswith("_gbp")}})


@query
def fact_files(spark, folder):
    path = _path(spark, "fact")
    sinks.write_fact(daily_fact_by_region(spark, folder), path)
    return readers.load_fact(spark, path)


@query
def prediction_files(spark, folder):
    path, rows = _path(spark, "predictions"), holdout_predictions(spark, folder)
    sinks.write_predictions(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query
def summary_files(spark, folder):
    path, table = _path(spark, "summary"), _table(spark, folder).summary
    sinks.write_summary(table, path)
    return _rounded_summary(_csv(spark, table, path))


@query
def consolidated_files(spark, folder):
    path = _path(spark, "consolidated")
    table = fc.report_columns(_table(spark, folder).table, CFG)
    sinks.write_consolidated(table.withColumnRenamed("date", DATE), path)
    return _csv(spark, table, path).select(
        MERCHANT, TIME, "date", *[r(c, 4) for c in ("q35", "q50", "q65", "expected_gbp")])


@query
def rollup_files(spark, folder):
    path, source = _path(spark, "months"), snapshot(slim_fact(spark, folder, "region"), "fact")
    months = plan.monthly(source, _run(source).table, CFG)
    sinks.write_rollup(months, path)
    return _numbered(_rounded_months(_csv(spark, months, path)))


@query
def metric_files(spark, folder):
    path, table = _path(spark, "metrics"), forecast_metrics(spark, folder)
    sinks.write_metrics(table, path)
    return spark.read.schema(table.schema).json(path)


@query
def event_series(spark, folder):
    """The other fixture: a week's horizon over a month of user events."""
    cfg = Config(horizon=7, val_days=7, min_encoder_length=7, max_encoder_length=14,
                 min_series_days=10, min_active_days=5)
    rows = core_series(fixture.event_revenue(spark, folder), cfg)
    return rows.select(MERCHANT, DATE, TIME, "series_start_idx", r(cfg.raw_target), r("tpv"))
