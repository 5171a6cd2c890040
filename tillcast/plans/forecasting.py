"""Forecast every merchant, evaluate past forecasts, and sum both up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillcast.config import Config, DATE, MERCHANT, TIME
from tillcast.functions.staging import snapshot
from tillcast.operators import (
    baselines, forecast as fc, metrics, panel, quality, rollup, summary,
)
from tillcast.plans.learned import learned_forecast
from tillcast.plans.prepare import core_columns, dense_series, observe, prepare
from tillcast.sources import sinks


def first_day(series: DataFrame) -> Column:
    """The date of index 0, worked out from any row of the series."""
    return series.agg(F.min(F.date_sub(DATE, F.col(TIME).cast("int")))).scalar()


@dataclass(frozen=True)
class Forecasts:
    """Forecasts of all merchants of a stored series, newest origin each.

    Without ``predictions`` the empirical forecaster is used; any forecaster's rows
    ``(merchant, origin, step, time_idx, q_log)`` may be given instead.  With the sparse form of the series the day axis is read from it, and only the days that
    an encoder or a recent level looks back to are made dense.
    """

    series: DataFrame
    cfg: Config = Config()
    observed: DataFrame | None = None
    predictions: DataFrame | None = None

    @staticmethod
    def of(observed: DataFrame, cfg: Config = Config(), predictions: DataFrame | None = None
           ) -> "Forecasts":
        series = dense_series(observed, cfg).select(*core_columns(cfg))
        return Forecasts(series, cfg, observed, predictions)

    def _last(self, days: int) -> DataFrame:
        if self.observed is None:
            return self.series
        tail = dense_series(self.observed, self.cfg, last_days=days)
        return tail.select(*core_columns(self.cfg))

    @property
    def table(self) -> DataFrame:
        start = (first_day(self.series) if self.observed is None
                 else panel.axis_start(self.observed))
        rows = self.predictions
        if rows is None:
            rows = fc.forecast_latest(self._last(self.cfg.max_encoder_length), self.cfg)
        return fc.forecast_table(rows, start, self.cfg)

    @property
    def summary(self) -> DataFrame:
        end = None if self.observed is None else panel.axis_end(self.observed, self.cfg)
        split = panel.Split(self.series, self.cfg, max_t=end)
        newest = None if self.observed is None else panel.with_time_index(
            panel.where_usable(self.observed, self.cfg)
            .where(F.col(DATE) == F.col("series_last_date")), panel.axis_start(self.observed))
        return summary.forecast_summary(self.table, self._last(self.cfg.recent_days), split.max_t,
                                        split.train_cutoff, self.cfg, newest)

    @property
    def missing(self) -> DataFrame:
        return fc.missing_forecasts(self.series, self.table)


def evaluation_rows(series: DataFrame, cfg: Config = Config(),
                    parts: tuple[str, ...] = ("validation", "holdout"),
                    observed: DataFrame | None = None,
                    forecaster: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Tidy predictions of the evaluation parts, each origin forecast from its own past.

    ``forecaster`` gives the rows of a part; the empirical one does if there is none.
    """
    frames = []
    end = None if observed is None else panel.axis_end(observed, cfg)
    for part in parts:
        rows = (fc.forecast_part(series, part, cfg, end) if forecaster is None
                else forecaster(part))
        frames.append(rows.withColumn("part", F.lit(part)))
    both = frames[0]
    for frame in frames[1:]:
        both = both.unionByName(frame)
    return fc.tidy_predictions(both, series, cfg)


def evaluate(series: DataFrame, cfg: Config = Config(), observed: DataFrame | None = None,
             forecaster: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """All metrics by part.  The rows are stored, as several statistics pass over them."""
    rows = snapshot(evaluation_rows(series, cfg, observed=observed, forecaster=forecaster),
                    "predictions", **table_faults(DATE))
    return metrics.forecast_metrics(rows, ["part"], cfg)


def holdout_baselines(series: DataFrame, cfg: Config = Config(),
                      observed: DataFrame | None = None) -> DataFrame:
    """Both naive forecasts beside the holdout's predictions."""
    rows = evaluation_rows(series, cfg, ("holdout",), observed)
    return baselines.with_baselines(rows, series, cfg)


def require_whole(kept: DataFrame, table: DataFrame, cfg: Config = Config()) -> None:
    """Fail unless each merchant of the kept rows, sparse or dense, has one whole, dated forecast."""
    short = fc.missing_forecasts(kept, table).count()
    if short:
        raise ValueError(f"{short} merchants have too little history for a forecast")
    holes = table.groupBy(MERCHANT).agg(
        F.count_distinct(F.when(F.col("date").isNotNull() & F.col("expected_gbp").isNotNull(),
                                F.col("date"))).alias("days")).where(F.col("days") != cfg.horizon)
    broken = holes.count()
    if broken:
        raise ValueError(f"{broken} merchants lack a date or a value on some forecast day")


def require_deliverable(series: DataFrame, table: DataFrame, cfg: Config = Config()) -> None:
    """Fail unless all series are complete and each has one whole, dated forecast."""
    quality.require_complete(series, cfg)
    require_whole(series, table, cfg)


def table_faults(date: str = "date") -> dict[str, Column]:
    """Counts that must be zero in a table of forecasts, for the pass that stores it."""
    return {"days_without_a_date": F.count_if(F.col(date).isNull()),
            "days_without_a_value": F.count_if(F.col("expected_gbp").isNull())}


def deliver(fact: DataFrame, folder: str, cfg: Config = Config(),
            order: list[str] | None = None, learned: bool = False) -> Forecasts:
    """Forecast all merchants of a stored fact, check the result, and write what is delivered:
    a folder per merchant, the summary and the monthly rollup.  With ``learned`` the fitted
    forecaster does it, refitted on everything.

    Dates and values are checked in the passes that store the sparse series and the forecasts;
    the dense series is not made for a check.  Nothing is delivered if one fails.
    """
    if learned:
        ready = prepare(fact, cfg, order=order)
        observed = ready.observed
        run = Forecasts.of(observed, cfg, snapshot(learned_forecast(ready, cfg, full=True), "predictions"))
    else:
        observed = snapshot(observe(fact, cfg, order), "observed", **quality.observed_faults(cfg))
        run = Forecasts.of(observed, cfg)
    table = snapshot(run.table, "forecasts", **table_faults())
    require_whole(panel.where_usable(observed, cfg), table, cfg)
    sinks.write_forecasts(table, f"{folder}/forecasts", cfg)
    sinks.write_summary(run.summary, f"{folder}/forecast_summary")
    sinks.write_rollup(monthly(fact, table, cfg), f"{folder}/months")
    return run


def monthly(fact: DataFrame, table: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Monthly rollup of the fact's actuals and a forecast table.  Merchant ids are text."""
    actuals = fact.select(F.col(MERCHANT).cast("string").alias(MERCHANT), DATE, cfg.raw_target)
    forecasts = fc.report_columns(table, cfg).select(
        F.col(MERCHANT).cast("string").alias(MERCHANT), F.col("date").alias(DATE),
        "q35", "q50", "q65", "expected_gbp")
    return rollup.monthly_rollup(actuals, forecasts, cfg)
