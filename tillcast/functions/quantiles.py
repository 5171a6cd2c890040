"""Expressions over arrays that hold one value per quantile level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def quantile_name(level: float) -> str:
    return f"q{round(level * 100):02d}"


def level_column(array: Column, levels: Sequence[float], level: float) -> Column:
    return F.element_at(array, list(levels).index(level) + 1)


def level_columns(array: Column, levels: Sequence[float], wanted: Sequence[float]) -> list[Column]:
    return [level_column(array, levels, q).alias(quantile_name(q)) for q in wanted]


def integration_weights(levels: Sequence[float]) -> list[float]:
    """Weight of each level in the trapezoid integral of the quantile function over (0, 1).

    Outside the outermost levels the function is held flat, so those two levels take
    the whole tail besides half of their inner interval.
    """
    last = len(levels) - 1
    weights = []
    for i, level in enumerate(levels):
        left = level if i == 0 else (level - levels[i - 1]) / 2
        right = 1 - level if i == last else (levels[i + 1] - level) / 2
        weights.append(left + right)
    return weights


def expected_value(array: Column, levels: Sequence[float]) -> Column:
    """Mean of the distribution the quantiles describe: one fixed linear combination."""
    total = F.lit(0.0)
    for i, weight in enumerate(integration_weights(levels)):
        total = total + F.element_at(array, i + 1) * F.lit(weight)
    return total


def rearranged(array: Column) -> Column:
    """Monotone rearrangement: the row's quantiles in ascending order."""
    return F.array_sort(array)


def crossings(array: Column, n_levels: int) -> Column:
    """How many neighbouring levels are out of order."""
    drops = [(F.element_at(array, i + 1) < F.element_at(array, i)).cast("int")
             for i in range(1, n_levels)]
    total = F.lit(0)
    for drop in drops:
        total = total + F.coalesce(drop, F.lit(0))
    return total


def pinball(actual: Column, predicted: Column, level: float) -> Column:
    shortfall = actual - predicted
    return F.greatest(F.lit(level) * shortfall, F.lit(level - 1.0) * shortfall)


def of_sorted(values: Column, level: float) -> Column:
    """A level's interpolated quantile of an ascending array with at least one element."""
    position = (F.size(values) - 1) * F.lit(float(level))
    below = F.floor(position).cast("int")
    low, high = F.get(values, below), F.get(values, F.ceil(position).cast("int"))
    return low + (high - low) * (position - below)
