"""Sums of feature products over all windows and steps, without a row for either.

A window's step sees three kinds of inputs: features of the origin, the level of the step's
weekday, and features of the day it falls on.  A product of an origin's and a day's feature,
summed over windows and steps, is a sum over days of the day's feature times the sum of the
origin's feature over the origins whose horizon covers the day.  The latter are window sums over
at most ``horizon`` rows of a series, so one pass over the panel gives the whole matrix.

The sums are a mergeable state: states of disjoint sets of windows add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast.config import Config, MERCHANT, TIME

ONE, LABEL, WEEKDAY, STEP = "one", "label", "weekday_level", "step_share"
SCHEMA = "left string, right string, total double"


def phases(horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Per weekday of the encoder's end, counted back: its steps, and the sum of their shares."""
    steps = np.arange(1, horizon + 1)
    back = -steps % 7
    return (np.bincount(back, minlength=7).astype(float),
            np.bincount(back, steps / horizon, minlength=7))


def _weekday_sum(by_time: W, horizon: int) -> Column:
    """Over the origins that cover a day: the level that each of them has for it."""
    def first(steps: int) -> Column:
        total = F.lit(0.0)
        for step in range(1, steps + 1):
            total = total + F.coalesce(F.lag(f"_w{-step % 7}", step - 1).over(by_time), F.lit(0.0))
        return total
    return first(7), first(horizon % 7)


def covering(days: DataFrame, windows: DataFrame, names: list[str], cfg: Config = Config()
             ) -> DataFrame:
    """Each day with the sums over the windows whose horizon covers it.

    ``windows`` has one row per origin with its features and ``_weekdays``, the levels of the
    seven days before it, newest first.  Added for each day: ``_n`` windows, ``_sum_<name>``
    for the origin features, the weekday level and the step's share, and, where the day is an origin
    itself, ``_own_<name>`` and ``_w0`` to ``_w6``.
    """
    origin = windows.select(
        MERCHANT, F.col("origin_time_idx").alias(TIME), *[F.col(n).alias(f"_own_{n}") for n in names],
        *[F.get("_weekdays", F.lit(k)).alias(f"_w{k}") for k in range(7)])
    rows = days.join(origin, [MERCHANT, TIME], "left")
    by_time = W.partitionBy(MERCHANT).orderBy(TIME)
    reach = by_time.rowsBetween(1 - cfg.horizon, 0)
    is_origin = F.col("_w0").isNotNull()
    whole, rest = _weekday_sum(by_time, cfg.horizon)
    rows = rows.withColumns({
        "_n": F.count(F.when(is_origin, 1)).over(reach).cast("double"),
        "_at": F.coalesce(F.sum(F.when(is_origin, F.col(TIME))).over(reach), F.lit(0)),
        **{f"_sum_{n}": F.coalesce(F.sum(f"_own_{n}").over(reach), F.lit(0.0)) for n in names},
        "_week": whole, "_part_week": rest})
    weeks = cfg.horizon // 7
    total = F.coalesce(F.lag("_part_week", 7 * weeks).over(by_time), F.lit(0.0))
    for back in range(weeks):
        total = total + F.coalesce(F.lag("_week", 7 * back).over(by_time), F.lit(0.0))
    share = ((F.col(TIME) + 1) * F.col("_n") - F.col("_at")) / cfg.horizon
    return rows.withColumns({f"_sum_{WEEKDAY}": total, f"_sum_{STEP}": share}).drop(
        "_week", "_part_week", "_at")


def moments(days: DataFrame, windows: DataFrame, origin_names: list[str], day_names: list[str],
            cfg: Config = Config()) -> DataFrame:
    """``(left, right, total)``: the sum over all windows and steps of the product of each two
    inputs, ``one`` and the label among them.  Names of a pair are in ascending order.  Without
    windows each pair's sum is zero.

    ``days`` is the dense panel with ``one``, ``label`` and the named columns.  A task sends
    one row per pair, whatever its number of days.
    """
    daily = [*day_names, ONE, LABEL]
    covered = [*origin_names, WEEKDAY, STEP]
    count, shares = phases(cfg.horizon)
    steps = np.arange(1, cfg.horizon + 1) / cfg.horizon
    rows = covering(days, windows, origin_names, cfg).where("_n > 0").select(
        *[F.col(c).cast("double").alias(f"day_{c}") for c in daily], "_n",
        *[f"_sum_{c}" for c in covered], *[f"_own_{c}" for c in origin_names],
        *[f"_w{k}" for k in range(7)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], float] = {}

        def add(left: list[str], right: list[str], block: np.ndarray) -> None:
            for a, line in zip(left, block, strict=True):
                for b, value in zip(right, line, strict=True):
                    pair = (a, b) if a <= b else (b, a)
                    sums[pair] = sums.get(pair, 0.0) + float(value)

        def add_once(names: list[str], block: np.ndarray) -> None:
            for i, a in enumerate(names):
                add([a], names[i:], block[i:i + 1, i:])

        for batch in batches:
            table = {n: batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                     for i, n in enumerate(batch.schema.names)}
            day = np.stack([table[f"day_{c}"] for c in daily], axis=1)
            add_once(daily, (day * table["_n"][:, None]).T @ day)
            add(covered, daily, np.stack([table[f"_sum_{c}"] for c in covered]) @ day)
            own = ~np.isnan(table["_w0"])
            level = np.stack([table[f"_own_{c}"][own] for c in origin_names], axis=1)
            week = np.stack([table[f"_w{k}"][own] for k in range(7)], axis=1)
            add_once(origin_names, cfg.horizon * level.T @ level)
            add(origin_names, [WEEKDAY, STEP], np.stack(
                [level.T @ (week @ count), level.sum(0) * steps.sum()], axis=1))
            add_once([WEEKDAY, STEP], np.array([
                [(week ** 2 @ count).sum(), (week @ shares).sum()],
                [0.0, len(week) * (steps ** 2).sum()]]))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in sums]), pa.array([b for _, b in sums]),
                 pa.array(list(sums.values()))], ["left", "right", "total"])

    names = sorted([*daily, *covered])
    nothing = days.sparkSession.createDataFrame(
        [(a, b, 0.0) for i, a in enumerate(names) for b in names[i:]], SCHEMA)
    return merged(rows.mapInArrow(run, SCHEMA), nothing)


def merged(*states: DataFrame) -> DataFrame:
    """The state of all windows of the given states."""
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    return rows.groupBy("left", "right").agg(F.sum("total").alias("total"))
