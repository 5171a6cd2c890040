"""Inputs and forecasts of the fitted forecaster: a line per quantile for all merchants and steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast.config import Config, MERCHANT, TIME, ColumnRoles
from tillcast.functions.quantiles import rearranged
from tillcast.operators import effects as fx
from tillcast.operators import normaliser as norm
from tillcast.operators.moments import LABEL, ONE, STEP, WEEKDAY
from tillcast.operators.panel import decoder_rows
from tillcast.operators.quantile_fit import Design, quantile_columns

LEVEL_SPANS = (7, 28, 120)
#: What a window knows at its origin, and besides those the level of the step's weekday.
IDENTITY = "identity"
LEVEL_INPUTS = (*[f"level{n}" for n in LEVEL_SPANS], "spread", "highest", "idle")
ORIGIN_INPUTS = (*LEVEL_INPUTS, IDENTITY)
_KEY = [MERCHANT, "origin_time_idx"]


def encoder_levels(panel: DataFrame, normaliser: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per origin: trailing means of the scaled log target and its mean by weekday; over the
    longest span also its spread, its highest value and the share of days without revenue.

    All are windows over the dense series as of the day before the origin.
    """
    pairs = F.col("center"), F.col("scale")
    scaled = panel.join(normaliser, MERCHANT).select(
        MERCHANT, TIME, *pairs, ((F.col(cfg.target) - pairs[0]) / pairs[1]).alias("_y"),
        (F.col(cfg.target) <= 0).cast("double").alias("_idle"))
    by_time = W.partitionBy(MERCHANT).orderBy(TIME)
    longest = by_time.rowsBetween(1 - LEVEL_SPANS[-1], 0)
    weekly = F.col("_y")
    for week in (1, 2, 3):
        weekly = weekly + F.coalesce(F.lag("_y", 7 * week).over(by_time), F.col("_y"))
    levels = scaled.withColumns({
        **{f"level{n}": F.avg("_y").over(by_time.rowsBetween(1 - n, 0)) for n in LEVEL_SPANS},
        "spread": F.stddev_pop("_y").over(longest), "highest": F.max("_y").over(longest),
        "idle": F.avg("_idle").over(longest), "_weekly": weekly / 4})
    weekdays = F.array(*[F.coalesce(F.lag("_weekly", back).over(by_time), F.col("level28"))
                         for back in range(7)])
    return levels.select(
        MERCHANT, (F.col(TIME) + 1).alias("origin_time_idx"), *pairs,
        *LEVEL_INPUTS, weekdays.alias("_weekdays"))


def effect_columns(roles: ColumnRoles) -> list[str]:
    """Categorical inputs: known ones, and static ones but for the merchant itself."""
    return [*roles.known_categoricals, *[c for c in roles.static_categoricals if c != MERCHANT]]


def day_inputs(roles: ColumnRoles) -> list[str]:
    return [*roles.known_reals, *[f"{c}_effect" for c in effect_columns(roles)]]


def day_rows(frame: DataFrame, pairs: DataFrame, effects: DataFrame, roles: ColumnRoles, cutoff,
             cfg: Config = Config()) -> DataFrame:
    """Inputs of a day and its scaled target, for history and, where given, future rows."""
    fold = F.when(F.col(TIME) <= cutoff, fx.fold_of(F.col(TIME), cfg))
    label = (F.col(cfg.target) - F.col("center")) / F.col("scale")
    joined = fx.with_effects(frame, effects, effect_columns(roles), fold)
    return joined.join(pairs.select(MERCHANT, "center", "scale"), MERCHANT).select(
        MERCHANT, TIME, *day_inputs(roles), F.lit(1.0).alias(ONE), label.alias(LABEL))


def with_identity(windows: DataFrame, effects: DataFrame, cutoff, cfg: Config = Config(),
                  training: bool = False) -> DataFrame:
    """Add the merchant's own effect, out of fold up to the cutoff.

    Of the training windows a share is masked, and a masked window has the effect of a merchant
    the fit never saw: zero.  So the fit learns what to do without it.
    """
    fold = F.when(F.col("origin_time_idx") <= cutoff, fx.fold_of(F.col("origin_time_idx"), cfg))
    known = fx.with_effects(windows, effects, [MERCHANT], fold)
    if training:
        known = norm.mask_identity(known, cfg, f"{MERCHANT}_effect").drop("masked")
    return known.withColumnRenamed(f"{MERCHANT}_effect", IDENTITY)


def thinned(origins: DataFrame, stride: int) -> DataFrame:
    """Every n-th origin; a stride without a factor of seven meets all weekdays."""
    return origins.where(F.pmod("origin_time_idx", F.lit(stride)) == 0)


def window_rows(days: DataFrame, windows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per window and step: inputs of the origin, of the weekday and of the step's day."""
    back = F.pmod(-F.col("step"), F.lit(7)).cast("int")
    return (decoder_rows(windows, cfg).join(windows, _KEY).join(days, [MERCHANT, TIME])
            .withColumn(WEEKDAY, F.get("_weekdays", back)).drop("_weekdays")
            .withColumn(STEP, F.col("step") / cfg.horizon))


def input_names(roles: ColumnRoles) -> list[str]:
    return [*ORIGIN_INPUTS, WEEKDAY, STEP, *day_inputs(roles)]


def predict(rows: DataFrame, plan: Design, fits: np.ndarray, keep: Sequence[str] = ()) -> DataFrame:
    """Quantiles in log revenue, ascending: the columns ``forecast`` gives."""
    levels = F.transform(quantile_columns(plan, fits),
                         lambda x: x * F.col("scale") + F.col("center"))
    return rows.select(*keep, *_KEY, "step", TIME, rearranged(levels).alias("q_log"))
