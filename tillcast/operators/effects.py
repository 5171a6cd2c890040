"""Effects of categories on the scaled target, learned out of fold and shrunken.

A category's effect is the mean of the scaled target over its training days, drawn towards zero
by ``prior`` days without an effect.  A training day gets the effect learned from the other folds,
so that it never sees itself; folds are whole stretches of ``horizon`` days, as neighbouring days
are alike.  All other days get the effect of all folds.  What the fit never saw has effect zero.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tillcast.config import Config, TIME
from tillcast.functions.joins import lookup_join

FOLDS, PRIOR = 5, 200


def fold_of(day: Column, cfg: Config = Config(), folds: int = FOLDS) -> Column:
    return F.pmod(F.floor(day / cfg.horizon), F.lit(folds)).cast("int")


def category_effects(training: DataFrame, columns: Iterable[str], cfg: Config = Config(),
                     folds: int = FOLDS, prior: float = PRIOR) -> DataFrame:
    """``(column, value, days, effects)``: first the effect of all folds, then that without each.

    ``training`` holds the training days with their ``label``.  Partial sums form before the
    exchange, so that a value of a third of all days sends a row per task and fold.
    """
    each = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    sums = (training.select(fold_of(F.col(TIME), cfg, folds).alias("fold"), "label", each.alias("_c"))
            .where("_c.value IS NOT NULL").groupBy("_c.column", "_c.value", "fold")
            .agg(F.sum("label").alias("total"), F.count(F.lit(1)).alias("days")))
    per_fold = [F.sum(F.when(F.col("fold") == k, F.col(c))) for k in range(folds) for c in ("total", "days")]
    wide = sums.groupBy("column", "value").agg(
        F.sum("total").alias("total"), F.sum("days").alias("days"),
        *[F.coalesce(s, F.lit(0)).alias(f"_{i}") for i, s in enumerate(per_fold)])
    without = [(F.col("total") - F.col(f"_{2 * k}")) / (F.col("days") - F.col(f"_{2 * k + 1}") + prior)
               for k in range(folds)]
    return wide.select("column", "value", "days",
                       F.array(F.col("total") / (F.col("days") + prior), *without).alias("effects"))


def with_effects(frame: DataFrame, effects: DataFrame, columns: Iterable[str], fold: Column
                 ) -> DataFrame:
    """Add ``<column>_effect``; ``fold`` is NULL on rows outside the training days."""
    for name in columns:
        lookup = effects.where(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("effects").alias("_effects"))
        frame = lookup_join(frame.withColumn("_value", F.col(name).cast("string")), lookup, "_value")
        effect = F.get("_effects", F.coalesce(fold + 1, F.lit(0)))
        frame = frame.withColumn(f"{name}_effect", F.coalesce(effect, F.lit(0.0))).drop(
            "_value", "_effects")
    return frame
