"""Fit quantile lines on training windows, forecast any origins, refit on everything."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tillcast.config import Config, MERCHANT, TIME
from tillcast.functions.staging import snapshot
from tillcast.operators import (
    effects as fx, features, learned, moments as mm, normaliser as norm, panel as pnl, quality,
    quantile_fit as qf, window_blocks as wb,
)
from tillcast.plans.prepare import Prepared


@dataclass(frozen=True)
class Fit:
    """A fitted forecaster and the sums it came from, which later windows can be added to."""

    state: DataFrame
    plan: qf.Design
    levels: np.ndarray
    rows: qf.Stored


@dataclass
class Learner:
    """The stored tables that fits and forecasts of one panel share.

    Scale pairs, effects and masks come from the training days, and a refit keeps them: the sums
    over the training windows then stay valid, and those of the later windows are added.
    Every training window gives rows to the quantile fit unless the caller sets a ``stride``.
    """

    prepared: Prepared
    cfg: Config = field(default_factory=Config)
    stride: int = 1

    def __post_init__(self) -> None:
        cfg = self.cfg
        self.panel = snapshot(self.prepared.panel, "panel")
        quality.require_complete(self.panel, cfg)
        self.roles = features.column_roles(self.panel.columns, cfg)
        self.split = self.prepared.split(cfg)
        self.cutoff = self.split.train_cutoff
        known = self.panel.where(F.col(TIME) <= self.cutoff)
        self.fitted = norm.fit_normaliser(known, cfg)
        self.pairs = snapshot(norm.scale_pairs(self.panel, self.fitted), "pairs").drop("cold_start")
        label = (F.col(cfg.target) - F.col("center")) / F.col("scale")
        columns = [MERCHANT, *learned.effect_columns(self.roles)]
        self.effects = snapshot(fx.category_effects(
            known.join(self.pairs, MERCHANT).withColumn(mm.LABEL, label), columns, cfg), "effects")
        self.days = snapshot(self._days(self.panel), "days")
        self.levels = snapshot(learned.encoder_levels(self.panel, self.pairs, cfg), "levels")

    def _days(self, frame: DataFrame) -> DataFrame:
        return learned.day_rows(frame, self.pairs, self.effects, self.roles, self.cutoff, self.cfg)

    @property
    def names(self) -> list[str]:
        return learned.input_names(self.roles)

    def origins(self, part: str, full: bool = False) -> DataFrame:
        return pnl.window_origins(self.panel, part, self.cfg, full, self.split.max_t).select(
            MERCHANT, "origin_time_idx")

    def windows(self, origins: DataFrame, training: bool = False) -> DataFrame:
        """Origins with what they know of their past."""
        rows = origins.select(MERCHANT, "origin_time_idx").join(
            self.levels, [MERCHANT, "origin_time_idx"])
        return learned.with_identity(rows, self.effects, self.cutoff, self.cfg, training)

    def state(self, windows: DataFrame) -> DataFrame:
        return snapshot(mm.moments(self.days, windows, list(learned.ORIGIN_INPUTS),
                                   learned.day_inputs(self.roles), self.cfg), "moments")

    def _fit(self, state: DataFrame, windows: DataFrame) -> Fit:
        plan = qf.design(state, self.names)
        rows = wb.stored_blocks(self.days, learned.thinned(windows, self.stride), learned.ORIGIN_INPUTS,
                                learned.day_inputs(self.roles), plan.rows, self.cfg)
        return Fit(state, plan, qf.fit_quantiles(rows, plan, self.cfg.quantiles), rows)

    def fit(self) -> Fit:
        """On the windows that end before the cut."""
        windows = self.windows(self.origins("train"), training=True)
        return self._fit(self.state(windows), windows)

    def refit(self, first: Fit) -> Fit:
        """On all windows: the sums of those that end after the cut are added to the first fit's."""
        every = self.origins("train", full=True)
        new = every.join(self.origins("train"), [MERCHANT, "origin_time_idx"], "left_anti")
        state = snapshot(mm.merged(first.state, self.state(self.windows(new, training=True))), "moments")
        return self._fit(state, self.windows(every, training=True))

    def forecast(self, fit: Fit, part: str | None = None) -> DataFrame:
        """``(merchant, origin, step, time_idx, q_log)`` of a part's origins, or of the newest.

        A fit without training windows can only forecast no origins at all.
        """
        if part:
            origins = self.origins(part)
            norm.require_aligned(origins, self.panel, self.fitted, self.cutoff, self.cfg)
            days = self.days
        else:
            origins = pnl.latest_origins(self.panel, self.cfg)
            ahead = pnl.future_rows(self.panel, self.prepared.future_calendar(self.cfg),
                                    self.prepared.ratio_names, self.cfg)
            days = self._days(ahead)
        if not fit.plan.rows and not origins.isEmpty():
            raise ValueError("no series is long enough for a training window, so nothing was fitted")
        rows = learned.window_rows(days, self.windows(origins), self.cfg)
        return learned.predict(rows, fit.plan, fit.levels)


def learned_forecast(prepared: Prepared, cfg: Config = Config(), full: bool = False) -> DataFrame:
    """Forecast of every merchant's newest origin; with ``full`` after a refit on everything."""
    learner = Learner(prepared, cfg)
    fit = learner.fit()
    return learner.forecast(learner.refit(fit) if full else fit)
