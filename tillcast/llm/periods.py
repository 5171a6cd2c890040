"""Periodic run detection with string synchronising sets.

A run is a stretch of words that repeats with its smallest period q at least ``REPEATS`` times,
and that no neighbouring word extends.  Periods are looked for at dyadic scales: scale t is
responsible for t <= q < 2t.  At a scale, the windows of t words get hashed names; a position is
in the synchronising set if the least name among the t + 1 windows that begin at it or up to t
words behind it stands at either end.  Whether a position is chosen depends on its 2t words only,
so that equal contexts are chosen alike, and each stretch of t positions holds a chosen one
unless its 3t - 1 words have a period of at most t / 4.  Such highly periodic regions are left
out of the set; they are known by then: periods below ``SMALL`` from comparing the words with
themselves shifted, the others as runs of the scales before.

Why no run is missed: at its scale, the first three periods of a run hold a chosen position, and
the same 2t words stand q words later, chosen too.  Equal contexts are more than t / 4 apart, so
that the seven next ones reach beyond 2t.  Each such pair proposes its distance as a period, and
the names of 1, 2, 4, ... words tell how far the pair can be extended to both sides.

Documents are rows; the words of some hundred documents are looked at together, parted by words
that equal no other.  A row needs some 250 bytes for each of its words.

Defined results: null and empty texts have no word and no run; ``runs`` is then empty and
``collapsed`` is empty text.  A word is dropped if a run holds it behind the run's first period.
Rows are independent: ties, repeated rows, null ids and extra columns stay as they are, and new
columns are renamed where the table has theirs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillcast.llm.common import fresh

REPEATS, SHORTEST = 4, 6
#: Periods below this are found by shifting; the scales begin here.
SMALL = 8
#: Words looked at together, unless one text has more.
CHUNK_WORDS = 150_000
RUNS = "array<struct<start: long, length: long, period: long>>"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for two names, one beside the other."""
    h = left * _ODD[0]
    h ^= h >> np.uint64(29)
    h += right
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    h *= _ODD[2]
    h ^= h >> np.uint64(31)
    return h


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def _covered(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of the positions lie in one of the intervals."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    return depth[:-1].cumsum() > 0


def _small(ids: np.ndarray, period: int) -> np.ndarray:
    begin, end = _stretches(ids[period:] == ids[:-period])
    return np.stack([begin, end + period, np.full(len(begin), period)])


def _chosen(names: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set of a scale."""
    order = np.where(periodic, _LAST, names)
    least, width = order, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    at_end = (order[:len(least)] == least) | (order[scale:] == least)
    return np.flatnonzero(at_end & (least != _LAST))


def _pairs(chosen: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions of equal context whose distance is a period of this scale."""
    at = chosen[np.argsort(contexts[chosen], kind="stable")]
    left, right = [], []
    for ahead in range(1, 8):
        a, b = at[:-ahead], at[ahead:]
        fit = (contexts[a] == contexts[b]) & (b - a >= scale) & (b - a < 2 * scale)
        left.append(a[fit])
        right.append(b[fit])
    return np.concatenate(left), np.concatenate(right)


def _common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from a and b on (or before them), by names of 2 ** k words."""
    n, total = len(names[0]), np.zeros(len(a), np.int64)
    for k in reversed(range(len(names))):
        size = 1 << k
        i, j = (a - total - size, b - total - size) if back else (a + total, b + total)
        inside = (i >= 0) & (j + size <= n)
        same = inside.copy()
        same[inside] = names[k][i[inside]] == names[k][j[inside]]
        total += same * size
    return total


def find_runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """(begin, end, period) of all runs, by begin and then period.

    ``ids`` are numbers of words; texts are parted by numbers found nowhere else, and no text
    has more than ``longest`` words.
    """
    found = [np.zeros((3, 0), np.int64)]

    def keep(runs: np.ndarray) -> None:
        length = runs[1] - runs[0]
        found.append(runs[:, length >= np.maximum(SHORTEST, REPEATS * runs[2])])

    for period in range(1, min(SMALL, longest // REPEATS + 1)):
        keep(_small(ids, period))
    names = [_mix(ids.astype(np.uint64), np.uint64(1))]
    while (1 << len(names)) <= longest:
        half = 1 << (len(names) - 1)
        names.append(_mix(names[-1][:-half], names[-1][half:]))
    scale = SMALL
    while REPEATS * scale <= longest:
        at_scale = names[scale.bit_length() - 1]
        begin, end, period = np.concatenate(found, axis=1)
        tight = (REPEATS * period <= scale) & (end - begin >= scale)
        periodic = _covered(begin[tight], end[tight] - scale + 1, len(at_scale))
        a, b = _pairs(_chosen(at_scale, scale, periodic), names[scale.bit_length()], scale)
        keep(np.stack([a - _common(names, a, b, True), b + _common(names, a, b, False), b - a]))
        scale *= 2
    # Several proposals may give one stretch; its smallest period is among them.
    runs = np.concatenate(found, axis=1)
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(0)
    runs = runs[:, new]
    return runs[:, np.lexsort((runs[2], runs[0]))]


def _analysed(texts: list[list[bytes]]) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of some texts, each a list of words."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(words) for words in texts])
    begin = np.concatenate([[0], (sizes + 1).cumsum()])
    ids = np.empty(begin[-1], np.int64)
    for i, (words, start) in enumerate(zip(texts, begin[:-1].tolist(), strict=True)):
        ids[start:start + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        ids[start + len(words)] = -1 - i
    runs = find_runs(ids, int(sizes.max(initial=0)))
    dropped = _covered(runs[0] + runs[2], runs[1], len(ids))
    of = np.searchsorted(begin, runs[0], side="right") - 1
    counts = np.bincount(of, minlength=len(texts))
    offsets = pa.array(np.concatenate([[0], counts.cumsum()]), pa.int32())
    entries = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (runs[0] - begin[of], runs[1] - runs[0], runs[2])],
        ["start", "length", "period"])
    collapsed = []
    for words, start, n in zip(texts, begin.tolist(), counts.tolist()):
        if n:
            gone = dropped[start:start + len(words)].tolist()
            words = [w for w, g in zip(words, gone, strict=True) if not g]
        collapsed.append(b" ".join(words))
    return pa.ListArray.from_arrays(offsets, entries), pa.array(collapsed, pa.binary()).cast(pa.string())


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Texts as words, together up to ``CHUNK_WORDS``, with the row of the first."""
    first, chunk, size = 0, [], 0
    for row, text in enumerate(texts):
        words = (text or "").encode().split()
        if chunk and size + len(words) > CHUNK_WORDS:
            yield first, chunk
            first, chunk, size = row, [], 0
        chunk.append(words)
        size += len(words)
    if chunk:
        yield first, chunk


def periodic_runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The given rows with ``runs`` (by start, then period, in words) and ``collapsed``: the
    words that no run repeats, joined by one space."""
    runs_name, collapsed_name = fresh(docs, "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields,
                           *T._parse_datatype_string(f"`{runs_name}` {RUNS}, `{collapsed_name}` string")])
    at = docs.columns.index(text_column)

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, chunk in _chunks(batch.column(at).to_pylist()):
                rows = batch.slice(first, len(chunk))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *_analysed(chunk)],
                    [*batch.schema.names, runs_name, collapsed_name])

    return docs.mapInArrow(analyse, schema)
