"""From a merchant-day fact to the prepared panel."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tillcast.config import CALENDAR_COLUMNS, Config, DATE, MERCHANT, TIME
from tillcast.functions.staging import snapshot
from tillcast.operators import calendar as cal
from tillcast.operators import daily, features, panel, quality


@dataclass(frozen=True)
class Prepared:
    panel: DataFrame
    observed: DataFrame
    lookup: DataFrame
    covered: tuple[dt.date, dt.date]
    ratio_names: list[str]
    filtered: bool = True

    def split(self, cfg: Config = Config(), full: bool = False) -> panel.Split:
        """The cut points, read from the sparse form."""
        return panel.Split(self.panel, cfg, full, panel.axis_end(self.observed, cfg, self.filtered))

    def future_calendar(self, cfg: Config = Config()) -> cal.Calendar:
        """The calendar as far as a forecast from the newest day can reach."""
        end = self.covered[1] + dt.timedelta(days=cfg.horizon)
        return cal.calendar_features(self.lookup, self.covered, end)


def clean_fact(fact: DataFrame, cfg: Config = Config(), order: list[str] | None = None) -> DataFrame:
    """Coerced and imputed, one row per merchant and day.

    A fact that may hold copies of a day needs its order of arrival: the last row counts.
    Medians are taken over all copies, as they come before the copies go; the fill itself
    waits until each merchant is down to one row per day.
    """
    fact = daily.coerce_fact(fact)
    if not order:
        return daily.impute_revenue(fact, cfg)
    medians = daily.positive_medians(fact, cfg)
    return daily.impute_revenue(daily.latest_per_day(fact, order), cfg, medians)


def observe(fact: DataFrame, cfg: Config = Config(), order: list[str] | None = None) -> DataFrame:
    """The sparse form of all series: observed days, trimmed, with each series' statistics.

    This is the form worth storing.  It has no row for an absent day, yet holds all that
    the filter, the day axis and the dense form are made from.
    """
    observed = panel.observed_series(clean_fact(fact, cfg, order), cfg)
    return panel.with_series_stats(panel.with_tenure(observed), cfg)


def dense_series(observed: DataFrame, cfg: Config = Config(), filtered: bool = True,
                 last_days: int | None = None) -> DataFrame:
    """Dense series with time index and target, from the sparse form.

    The filter acts before densifying.  The day axis starts at the earliest first sale of
    all series, kept or not.  With ``last_days`` only the ends of the series are made.
    """
    first_day = panel.axis_start(observed)
    if filtered:
        observed = panel.where_usable(observed, cfg)
    grid = panel.densify(observed.drop(*panel.STAT_COLUMNS), last_days).drop(*CALENDAR_COLUMNS)
    return features.with_target(panel.with_time_index(grid, first_day), cfg)


def core_series(fact: DataFrame, cfg: Config = Config(), filtered: bool = True,
                order: list[str] | None = None) -> DataFrame:
    """Dense series from a fact: all that forecasting itself needs.

    The sparse form is stored, as the day axis and the series both read it: unstored, each of
    the two would go back to the raw log.
    """
    observed = observe(fact, cfg, order)
    if not filtered:
        observed = observed.drop(*panel.STAT_COLUMNS)
    return dense_series(snapshot(observed, "observed"), cfg, filtered)


def prepare(fact: DataFrame, cfg: Config = Config(), filtered: bool = True,
            order: list[str] | None = None) -> Prepared:
    """Coerce, impute, dedup, calendar, grid, features, filter.

    Pass a stored fact (see ``snapshot``): the sparse series and the calendar each read it.
    Both are stored, as the panel, the day axis and the date features refer to them again.
    """
    lookup = snapshot(cal.calendar_lookup(
        daily.coerce_fact(fact), order[0] if order else None), "calendar")
    covered = cal.covered_range(lookup)
    dated = fact.drop(*CALENDAR_COLUMNS)  # the lookup has them: no need to exchange and store them
    observed = snapshot(observe(dated, cfg, order), "observed", **quality.observed_faults(cfg))
    series = dense_series(observed, cfg, filtered)
    frame = cal.calendar_features(lookup, covered).attach(series)
    frame = features.with_activity(features.with_age(frame), cfg)
    frame = features.categories_as_text(features.with_mix_ratios(frame))
    return Prepared(frame.drop("series_first_date", "series_last_date"), observed, lookup, covered,
                    features.ratio_names(series.columns), filtered)


def core_columns(cfg: Config = Config()) -> list[str]:
    return [MERCHANT, "merchant_name", DATE, TIME, "series_start_idx", "series_last_idx",
            cfg.raw_target, cfg.target]
