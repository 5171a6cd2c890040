"""Training windows in blocks of days: all windows and steps of a fit, without a stored row for either.

A row of the fit is a window and a step, and its inputs are those of the window, the level of the
step's weekday, the step, and those of the day it falls on.  A block holds the windows that begin in
``horizon`` days and the days that they reach, so each day is stored twice and not once for each
window over it.  In the task, weights of rows are a matrix of windows by days, and sums over
rows are products of that matrix with the inputs of either side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillcast.config import Config, MERCHANT, TIME
from tillcast.functions.staging import snapshot
from tillcast.operators.moments import LABEL, STEP, WEEKDAY
from tillcast.operators.panel import day_blocks
from tillcast.operators.quantile_fit import Design, Matrix, Rows, Stored

#: A block has ``horizon`` squared rows of the fit at most, some 10 ms of work in each pass.
BLOCKS_PER_TASK = 16


def window_blocks(days: DataFrame, windows: DataFrame, origin_names: Sequence[str],
                  day_names: Sequence[str], cfg: Config = Config()) -> DataFrame:
    """``(merchant, block, origins, own, times, inputs)``: windows that begin in a block of days, with
    their inputs and ``_weekdays``, and the days of this block and the next, with theirs and the label.

    A window begins on one of the ``days``.  The days are exchanged by merchant, the windows by block.
    """
    daily = F.array(*[F.col(c).cast("double") for c in [*day_names, LABEL]])
    reached = F.concat("own", "after")
    of_days = day_blocks(days.select(MERCHANT, TIME, daily.alias("inputs")), ["inputs"], cfg.horizon).select(
        MERCHANT, "block", F.transform(reached, lambda d: d[TIME]).alias("times"),
        F.flatten(F.transform(reached, lambda d: d["inputs"])).alias("inputs"))
    own = F.array(*[F.col(c).cast("double") for c in origin_names],
                  *[F.get("_weekdays", F.lit(k)) for k in range(7)])
    begun = windows.groupBy(
        MERCHANT, F.floor(F.col("origin_time_idx") / cfg.horizon).cast("int").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("origin_time_idx", own.alias("own")))).alias("_windows"))
    return begun.select(
        MERCHANT, "block", F.transform("_windows", lambda w: w["origin_time_idx"]).alias("origins"),
        F.flatten(F.transform("_windows", lambda w: w["own"])).alias("own")).join(
            of_days, [MERCHANT, "block"])


def stored_blocks(days: DataFrame, windows: DataFrame, origin_names: Sequence[str],
                  day_names: Sequence[str], count: float, cfg: Config = Config()) -> Stored:
    """Blocks as a table of the fit.  ``count`` rows are about to be read: few bytes, but much work,
    so they are dealt out by their number and not by size."""
    spark = days.sparkSession
    blocks = window_blocks(days, windows, origin_names, day_names, cfg)
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = int(min(most, 1 + count // (BLOCKS_PER_TASK * cfg.horizon ** 2)))
    table = snapshot(blocks.repartition(tasks, MERCHANT, "block"), "fit_blocks")
    return Stored(table, _columns, partial(block_rows, origin_names=tuple(origin_names),
                                           day_names=tuple(day_names), horizon=cfg.horizon))


def _columns(plan: Design) -> list[str]:
    return ["origins", "own", "times", "inputs"]


def block_rows(batch: pa.RecordBatch, plan: Design, origin_names: Sequence[str],
               day_names: Sequence[str], horizon: int) -> Iterator[Rows]:
    """The rows of each block, inputs in units of their spread."""
    first = [n for n in plan.names if n in origin_names]
    middle = [n for n in plan.names if n in (WEEKDAY, STEP)]
    last = [n for n in plan.names if n in day_names]
    if [*first, *middle, *last] != [*plan.names]:
        raise ValueError(f"inputs are not those of windows, steps and days in this order: {plan.names}")
    cuts = np.cumsum([len(first), len(middle)])
    mean, spread = np.split(plan.mean, cuts), np.split(plan.spread, cuts)
    steps = np.arange(1, horizon + 1)

    def column(name: str, i: int) -> np.ndarray:
        return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

    for i in range(batch.num_rows):
        origins, times = column("origins", i), column("times", i)
        known = column("own", i).reshape(len(origins), -1)
        daily = column("inputs", i).reshape(len(times), -1)
        own = (known[:, [origin_names.index(n) for n in first]] - mean[0]) / spread[0]
        own = np.concatenate([np.ones((len(own), 1)), own], axis=1)
        week = known[:, len(origin_names):]
        cells = [((week[:, -steps % 7] if n == WEEKDAY else np.tile(steps / horizon, (len(own), 1))) - m) / s
                 for n, m, s in zip(middle, mean[1], spread[1], strict=True)]
        day = (daily[:, [day_names.index(n) for n in last]] - mean[2]) / spread[2]
        at = origins - times[0]
        if (np.diff(times) == 1).all() and (at >= 0).all() and (at + horizon <= len(times)).all():
            yield Windows(own, cells, day, at[:, None] + steps - 1, daily[:, -1])
        else:  # days missing or twice: a row for each day that is there
            ahead = times - origins[:, None]
            w, d = np.nonzero((ahead >= 0) & (ahead < horizon))
            s = ahead[w, d]
            yield Matrix(np.concatenate([own[w], *[c[w, s][:, None] for c in cells], day[d]], axis=1),
                         daily[d, -1])


class Windows(Rows):
    """The windows of a block and all their steps: ``of_day`` is the day of each."""

    def __init__(self, own: np.ndarray, cells: list[np.ndarray], day: np.ndarray, of_day: np.ndarray,
                 label: np.ndarray) -> None:
        self.own, self.cells, self.day, self.of_day = own, cells, day, of_day
        self.label = label[of_day]
        self.size = of_day.size

    def rest(self, fit: np.ndarray) -> np.ndarray:
        own, middle, day = np.split(fit, np.cumsum([self.own.shape[1], len(self.cells)]))
        rest = self.label - (self.day @ day)[self.of_day] - (self.own @ own)[:, None]
        for slope, cell in zip(middle, self.cells, strict=True):
            rest -= slope * cell
        return rest

    def _by_day(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_day.ravel(), weights.ravel(), len(self.day))

    def along(self, weights: np.ndarray, part=None) -> np.ndarray:
        own, day, *cells = [part(x) if part else x for x in (self.own, self.day, *self.cells)]
        return np.concatenate([weights.sum(1) @ own, [np.vdot(weights, c) for c in cells],
                               self._by_day(weights) @ day])

    def gram(self, weights: np.ndarray) -> np.ndarray:
        n, k = self.own.shape[1], len(self.cells)
        spread = np.zeros((len(self.own), len(self.day)))
        np.put_along_axis(spread, self.of_day, weights, 1)
        out = np.zeros((n + k + self.day.shape[1],) * 2)
        out[:n, :n] = (self.own * weights.sum(1)[:, None]).T @ self.own
        out[:n, n + k:] = self.own.T @ (spread @ self.day)
        out[n + k:, n + k:] = (self.day * spread.sum(0)[:, None]).T @ self.day
        for i, cell in enumerate(self.cells):
            part = weights * cell
            out[:n, n + i] = part.sum(1) @ self.own
            out[n + i, n + i:n + k] = [np.vdot(part, c) for c in self.cells[i:]]
            out[n + i, n + k:] = self._by_day(part) @ self.day
        return out[np.triu_indices(len(out))]
