"""Linear quantile regression on rows that stay distributed.

The pinball loss is smoothed over a band of residuals, and the band is narrowed from round to
round.  In each round every level's rows are weighted by how close they are to its present fit;
the weighted normal equations are summed where the rows are, and only the sums come to the driver:
two symmetric matrices and a vector per level, whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillcast.operators.moments import LABEL, ONE

#: Bands of the rounds, in units of the scaled target.
BANDS = (0.3, 0.3, 0.1, 0.1, 0.1, 0.03, 0.03, 0.03, 0.03, 0.01, 0.01, 0.01, 0.01)


@dataclass(frozen=True)
class Design:
    """The inputs that carry information, their means and spreads, and a least-squares fit."""

    names: tuple[str, ...]
    dropped: tuple[str, ...]
    mean: np.ndarray
    spread: np.ndarray
    least_squares: np.ndarray
    rows: float


def design(state: DataFrame, names: Sequence[str], tolerance: float = 1e-6) -> Design:
    """Read from the sums alone: constant inputs and those that others explain are dropped.

    Inputs are taken in order; one stays if what the ones before leave of its variance is above
    ``tolerance``.  The state has one row per pair of inputs, whatever the size of the data.
    Without any window no input varies, and all are dropped.
    """
    total = {(r["left"], r["right"]): r["total"] for r in state.collect()}

    def product(a: str, b: str) -> float:
        return total[min(a, b), max(a, b)]

    rows = product(ONE, ONE)
    if not rows:
        return Design((), tuple(names), np.empty(0), np.empty(0), np.zeros(1), 0.0)
    every = [*names, LABEL]
    means = np.array([product(ONE, n) for n in every]) / rows
    cov = np.array([[product(a, b) for b in every] for a in every]) / rows - np.outer(means, means)
    spreads = np.sqrt(np.maximum(np.diag(cov), 0.0))
    # A spread within rounding of the mean's square is none.
    constant = spreads <= 1e-7 * np.maximum(1.0, np.abs(means))
    scaled = cov / np.outer(np.where(constant, 1.0, spreads), np.where(constant, 1.0, spreads))
    kept: list[int] = []
    left = scaled.copy()
    for i in range(len(names)):
        if constant[i] or left[i, i] <= tolerance:
            continue
        kept.append(i)
        left = left - np.outer(left[:, i], left[i, :]) / left[i, i]
    slope = np.linalg.solve(scaled[np.ix_(kept, kept)], scaled[kept, -1]) * spreads[-1]
    return Design(tuple(names[i] for i in kept),
                  tuple(n for i, n in enumerate(names) if i not in kept),
                  means[kept], spreads[kept], np.append(means[-1], slope), rows)


class Rows:
    """Rows of a fit: inputs with a leading one, in units of their spread, and a label."""

    size: int

    def rest(self, fit: np.ndarray) -> np.ndarray:
        """What a fit leaves of each label.  Weights of rows have the same shape."""
        raise NotImplementedError

    def along(self, weights: np.ndarray, part: Callable[[np.ndarray], np.ndarray] | None = None
              ) -> np.ndarray:
        """Each input, or a part of its value, times the weights, summed."""
        raise NotImplementedError

    def gram(self, weights: np.ndarray) -> np.ndarray:
        """The weighted products of each two inputs, summed: the upper triangle."""
        raise NotImplementedError


class Matrix(Rows):
    """A line for each row."""

    def __init__(self, inputs: np.ndarray, label: np.ndarray) -> None:
        self.inputs, self.label, self.size = inputs, label, len(label)

    def rest(self, fit: np.ndarray) -> np.ndarray:
        return self.label - self.inputs @ fit

    def along(self, weights: np.ndarray, part: Callable[[np.ndarray], np.ndarray] | None = None
              ) -> np.ndarray:
        return (part(self.inputs) if part else self.inputs).T @ weights

    def gram(self, weights: np.ndarray) -> np.ndarray:
        return ((self.inputs * weights[:, None]).T @ self.inputs)[np.triu_indices(self.inputs.shape[1])]


def _matrix(batch: pa.RecordBatch, plan: Design) -> Iterator[Rows]:
    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
    inputs = (np.stack(columns[:-1], axis=1) - plan.mean) / plan.spread
    yield Matrix(np.concatenate([np.ones((len(inputs), 1)), inputs], axis=1), columns[-1])


@dataclass(frozen=True)
class Stored:
    """A stored table, the columns of it that a plan reads, and the rows of the fit in a batch of them."""

    frame: DataFrame
    columns: Callable[[Design], list[str]] = lambda plan: [*plan.names, LABEL]
    read: Callable[[pa.RecordBatch, Design], Iterator[Rows]] = _matrix


def _stored(rows: DataFrame | Stored) -> Stored:
    return rows if isinstance(rows, Stored) else Stored(rows)


def _summed(rows: Stored, plan: Design, kernel: Callable[[Rows], np.ndarray]) -> np.ndarray:
    """The sum of a matrix of figures over all rows; a task sends each figure once.

    No rows have the sum zero, in the shape that the kernel gives.
    """
    read = rows.read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for some in read(batch, plan):
                part = kernel(some)
                total = part if total is None else total + part
        if total is not None:
            line, slot = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(line.ravel(), pa.int32()), pa.array(slot.ravel(), pa.int32()),
                 pa.array(total.ravel())], ["line", "slot", "total"])

    parts = rows.frame.select(*rows.columns(plan)).mapInArrow(run, "line int, slot int, total double")
    found = parts.groupBy("line", "slot").agg(F.sum("total").alias("total")).collect()
    out = kernel(Matrix(np.ones((0, 1 + len(plan.names))), np.empty(0)))
    for row in found:
        out[row.line, row.slot] = row.total
    return out


def _normal(fits: np.ndarray, levels: Sequence[float], band: float):
    """Per level: the curvature of the smoothed loss, a bound of it, and its slope."""
    def kernel(rows: Rows) -> np.ndarray:
        lines = []
        for fit, level in zip(fits, levels, strict=True):
            rest = rows.rest(fit)
            below = 0.5 * (1.0 - np.tanh(0.5 * rest / band))
            size = np.maximum(np.abs(rest), 1e-6 * band)
            bound = np.tanh(0.5 * size / band) / (2.0 * size)
            lines.append(np.concatenate([
                rows.gram(below * (1.0 - below) / band), rows.gram(bound), rows.along(below - level)]))
        return np.array(lines)
    return kernel


def _losses(tried: np.ndarray, levels: Sequence[float], band: float):
    """Per level: the smoothed loss of each of its tried fits."""
    def loss(rest: np.ndarray, level: float) -> float:
        over = np.log(1.0 + np.exp(-np.abs(rest) / band)) + np.maximum(-rest / band, 0.0)
        return level * rest.sum() + band * over.sum()

    def kernel(rows: Rows) -> np.ndarray:
        return np.array([[loss(rows.rest(fit), level) for fit in fits]
                         for fits, level in zip(tried, levels, strict=True)])
    return kernel


def _steps(line: np.ndarray, p: int) -> list[np.ndarray]:
    """Steps to try: along the curvature, whole and shortened, and along its bound, stretched.

    A step along the bound always lowers the loss, one along the curvature is better near the end.
    """
    upper, half = np.triu_indices(p), p * (p + 1) // 2
    slope, found = line[2 * half:], []
    for part, ridge in ((line[:half], 1e-4), (line[half:2 * half], 1e-9)):
        matrix = np.zeros((p, p))
        matrix[upper] = part
        matrix = matrix + np.triu(matrix, 1).T
        matrix += (ridge * np.trace(matrix) / p + 1e-12) * np.eye(p)
        found.append(np.linalg.solve(matrix, slope))
    return [found[0], found[0] / 2, found[0] / 4, found[1], 2 * found[1], 4 * found[1], 8 * found[1]]


def fit_quantiles(rows: DataFrame | Stored, plan: Design, levels: Sequence[float],
                  bands: Sequence[float] = BANDS) -> np.ndarray:
    """Per level the intercept and slopes in units of the inputs' spread.

    ``rows`` is a stored table, read twice in each round.  The loss of a round's band never grows.
    Windows of which none gave a row are an error; without windows there is nothing to fit.
    """
    rows = _stored(rows)
    if plan.rows and rows.frame.isEmpty():
        raise ValueError("none of the training windows is among those that give rows to the fit")
    fits = np.tile(plan.least_squares, (len(levels), 1))
    for band in bands:
        sums = _summed(rows, plan, _normal(fits, levels, band))
        tried = np.array([[fit, *(fit - step for step in _steps(line, len(fit)))]
                          for fit, line in zip(fits, sums, strict=True)])
        losses = _summed(rows, plan, _losses(tried, levels, band))
        fits = tried[np.arange(len(levels)), np.nanargmin(losses, axis=1)]
    return fits


def quantile_columns(plan: Design, fits: np.ndarray) -> Column:
    """The array of all levels' predictions, scaled, out of a row's inputs."""
    levels = []
    for fit in fits:
        slopes = fit[1:] / plan.spread
        value = F.lit(float(fit[0] - slopes @ plan.mean))
        for name, slope in zip(plan.names, slopes, strict=True):
            value = value + F.lit(float(slope)) * F.col(name)
        levels.append(value)
    return F.array(*levels)


def optimality(rows: DataFrame | Stored, plan: Design, fits: np.ndarray, levels: Sequence[float],
               band: float = 3 * BANDS[-1]) -> list[tuple[float, str, float]]:
    """(level, input, gap): how far zero is from the loss's slope along each input, per row.

    Residuals within ``band`` of zero may count to either side, as they may at a minimum.
    """
    def kernel(rows: Rows) -> np.ndarray:
        lines = []
        for fit, level in zip(fits, levels, strict=True):
            rest = rows.rest(fit)
            near = np.abs(rest) <= band
            far = rows.along(np.where(near, 0.0, np.where(rest < 0, 1.0 - level, -level)))
            plus, minus = (rows.along(near.astype(float), partial(bound, 0.0)) for bound in (np.maximum, np.minimum))
            lines.append(np.concatenate([far - level * plus + (1.0 - level) * minus,
                                         far - level * minus + (1.0 - level) * plus, [rows.size]]))
        return np.array(lines)

    p = fits.shape[1]
    sums = _summed(_stored(rows), plan, kernel)
    gaps = np.maximum(0.0, np.maximum(sums[:, :p], -sums[:, p:2 * p])) / max(1.0, sums[0, -1])
    return [(float(level), name, float(gap)) for level, line in zip(levels, gaps, strict=True)
            for name, gap in zip([ONE, *plan.names], line, strict=True)]
