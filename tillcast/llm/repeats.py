"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``min_bytes`` bytes that covers it also begins earlier: in a row of a
smaller id, or before it in the same row.  To sort all suffixes would take a row for every byte;
only their first ``min_bytes`` bytes matter, and most of them are found unique early.

* Bucket identifiers are names: eight bytes name themselves, and the name of 2h bytes is made
  of the identifier at a place and the identifier h bytes later.  So each refinement reuses the
  identifiers of the one before, and no exchange has to bring updates back to the places.
* The first buckets hold places by ``GRAM`` bytes.  Each string is represented by its least
  gram (leftmost of equals), and neighbouring strings of one such anchor are one item, with the
  identifiers of its first and last string as the refined bucket.  Items are sorted by bucket,
  refined bucket and origin.  A bucket of one item is unique and done.  An item behind another of
  its refined bucket is repeated and done.  Only the first items of refined buckets that share
  a bucket stay open.
* Open items are cut into items of 8 strings, then of single ones, whose bucket is the
  identifier of the bytes that all strings at their distance from the anchor have in common,
  and are refined and sorted likewise.  A single string is its own bucket: nothing stays open.

Items of exact copies leave a task as one interval, because a task drops what it has already seen
itself; so a bucket that holds a third of all documents sends one row per batch.

Defined results: a null text is empty.  Rows of equal id and text are one document; rows of equal
id and other text are ordered by a hash of the text; a null id stands before all others.  The text
of a document is not changed: ``kept`` is binary, since cuts may part a character.  Extra
columns are carried along, and new ones renamed where the table has theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.staging import snapshot
from tillcast.llm.common import fresh, small_side

#: Half a string: short enough that neighbours share their least gram, long enough to be rare.
GRAM = 48
#: Items at later levels hold so many strings.
WIDTHS = (8, 1)
#: An item of the first level holds at most so many strings.
WIDEST = 64
#: Bytes looked at together; a longer text is looked at in pieces.
CHUNK_BYTES = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_ORDER = ["id", "digest"]


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The identifier for two identifiers, one after the other."""
    h = left * _ODD[0]
    h ^= h >> np.uint64(29)
    h += right
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    h *= _ODD[2]
    h ^= h >> np.uint64(31)
    return h


class Identifiers:
    """Bucket identifiers of all strings of some bytes, refined as far as they are asked for."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(8), np.uint8)
        self.size = len(data)
        eight = np.lib.stride_tricks.sliding_window_view(raw, 8)[:max(0, self.size - 7)]
        self.powers = {8: np.ascontiguousarray(eight).view("<u8").ravel()}

    def of(self, length: int) -> np.ndarray:
        """The identifier at each place where a string of this length begins."""
        half = 8
        while 2 * half <= length:
            if 2 * half not in self.powers:
                known = self.powers[half]
                self.powers[2 * half] = _mix(known[:-half], known[half:])
            half *= 2
        return self.at(length, np.arange(self.size - length + 1)) if half != length else self.powers[half]

    def at(self, length: int, places: np.ndarray) -> np.ndarray:
        """The same at some places only; the two halves may overlap."""
        half = 8
        while 2 * half <= length:
            half *= 2
        known = self.of(half)
        return known[places] if half == length else _mix(known[places], known[places + length - half])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _anchored(grams: np.ndarray, least: np.ndarray, valid: np.ndarray, reach: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): strings whose leftmost least gram is the same one."""
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= begins[1:] | ~valid[1:]
    last = np.flatnonzero(ends)
    anchor = first.copy()
    for start in range(0, len(first), 1 << 14):
        part = slice(start, start + (1 << 14))
        near = grams[first[part, None] + np.arange(reach)] == least[first[part], None]
        anchor[part] += near.argmax(1)
    # Strings behind the anchor have the same gram once more within reach: rare, or a period.
    again = np.flatnonzero(last > anchor)
    if not len(again):
        return first, last, anchor
    more = []
    for a, b in zip(first[again].tolist(), last[again].tolist()):
        places = a + np.flatnonzero(grams[a:b + reach] == least[a])
        places = places[:np.searchsorted(places, b) + 1]
        begin = np.concatenate([[a], places[:-1] + 1])
        more.append(np.stack([begin, np.minimum(places, b), places]))
    rest = np.delete(np.stack([first, last, anchor]), again, axis=1)
    return tuple(np.concatenate([rest, *more], axis=1))


def _cut(items: np.ndarray, widest: int) -> np.ndarray:
    """Items of more than ``widest`` strings, cut by the distance from the anchor."""
    first, last, anchor = items
    near, far = (anchor - last) // widest, (anchor - first) // widest
    counts = far - near + 1
    of = np.repeat(np.arange(len(first)), counts)
    step = np.arange(len(of)) - np.repeat(counts.cumsum() - counts, counts)
    high = anchor[of] - (near[of] + step) * widest
    return np.stack([np.maximum(first[of], high - widest + 1), np.minimum(last[of], high), anchor[of]])


def _unseen(bucket: np.ndarray, refined: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which items are the first of their refined bucket here, or equal to the first."""
    order = np.lexsort((first, rank, refined, bucket))
    b, r, d, f = (x[order] for x in (bucket, refined, rank, first))
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), bool)
    out[order] = (d == d[head]) & (f == f[head])
    return out


def _joined(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent items of a document as one interval each: index of the document's row, first, last."""
    order = np.lexsort((first, rank))
    d, a, b = rank[order], first[order], last[order]
    begin = np.ones(len(order), bool)
    begin[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1] + 1)
    end = np.append(begin[1:], True)[:len(order)]
    return d[begin], a[begin], b[end]


def _ranks(ids: list, digests: list) -> np.ndarray:
    """The order of documents: null ids first, then by id, then by digest."""
    keys = [(i is not None, 0 if i is None else i, d) for i, d in zip(ids, digests, strict=True)]
    place = {key: n for n, key in enumerate(sorted(set(keys)))}
    return np.array([place[key] for key in keys], np.int64)


class _Items:
    """Collects the items of some documents and writes them as one batch."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.names: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, row: int, base: int, items: np.ndarray, bucket: np.ndarray, refined: np.ndarray):
        of = np.full((1, items.shape[1]), row)
        self.parts.append(np.concatenate([of, items + base]))
        self.names.append((bucket, refined))

    def batch(self, ids: pa.Array, digests: pa.Array) -> pa.RecordBatch:
        none = np.zeros((4, 0), np.int64)
        row, first, last, anchor = np.concatenate([none, *self.parts], axis=1)
        blank = np.zeros(0, np.uint64)
        bucket, refined = (np.concatenate([blank, *(n[i] for n in self.names)]) for i in (0, 1))
        ranks = _ranks(ids.to_pylist(), digests.to_pylist())
        fresh_here = _unseen(bucket, refined, ranks[row], first)
        seen = ~fresh_here
        by_rank = np.zeros(len(ranks), np.int64)
        by_rank[ranks] = np.arange(len(ranks))
        done_rank, done_first, done_last = _joined(ranks[row[seen]], first[seen], last[seen])
        rows = np.concatenate([row[fresh_here], by_rank[done_rank]])
        first = np.concatenate([first[fresh_here], done_first])
        n = len(done_first)
        # Intervals that are done take part in no bucket: they get one of their own.
        alone = _mix(rows[len(rows) - n:].astype(np.uint64), done_first.astype(np.uint64))
        columns = [
            np.concatenate([bucket[fresh_here], alone]).view(np.int64),
            np.concatenate([refined[fresh_here], alone]).view(np.int64),
            first, np.concatenate([last[fresh_here], done_last]),
            np.concatenate([anchor[fresh_here], done_first]),
            np.arange(len(first)) >= len(first) - n]
        taken = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [ids.take(taken), digests.take(taken), *map(pa.array, columns)],
            ["id", "digest", "bucket", "refined", "first", "last", "anchor", "done"])


def _schema(kind: T.DataType) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("digest", "bucket", "refined", "first", "last", "anchor")]
    return T.StructType([T.StructField("id", kind), *longs, T.StructField("done", T.BooleanType())])


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows, together up to ``CHUNK_BYTES``."""
    begin, total = 0, 0
    for row, size in enumerate(sizes):
        if row > begin and total + size > CHUNK_BYTES:
            yield begin, row
            begin, total = row, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _first_items(min_bytes: int):
    """Level 1: the items of all strings of whole texts, by their anchors."""
    reach = min_bytes - GRAM + 1

    def named(data: bytes, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = Identifiers(data)
        grams = ids.of(GRAM)
        least = _least(grams, reach)
        items = _cut(np.stack(_anchored(grams, least, valid, reach)), WIDEST)
        whole = [ids.at(min_bytes, items[i]) for i in (0, 1)]
        shape = ((items[2] - items[0]) << 8 | (items[2] - items[1])).astype(np.uint64)
        return items, grams[items[2]], _mix(_mix(*whole), shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for begin, end in _groups([len(t) for t in texts]):
                some, found = texts[begin:end], _Items()
                if len(some) == 1:
                    (text,) = some
                    for base in range(0, len(text) - min_bytes + 1, CHUNK_BYTES):
                        piece = text[base:base + CHUNK_BYTES + min_bytes - 1]
                        found.add(0, base, *named(piece, np.ones(len(piece) - min_bytes + 1, bool)))
                else:
                    _together(some, found)
                yield found.batch(batch.column(0).slice(begin, end - begin),
                                  batch.column(1).slice(begin, end - begin))

    def _together(some: list[bytes], found: _Items) -> None:
        data = b"".join(some)
        if len(data) < min_bytes:
            return
        sizes = np.array([len(t) for t in some])
        starts = sizes.cumsum() - sizes
        row = np.repeat(np.arange(len(some)), sizes)[:len(data) - min_bytes + 1]
        # A string is valid if it ends in the text it begins in.
        valid = np.arange(len(row)) + min_bytes <= (starts + sizes)[row]
        # Neighbouring texts never share an item: the last strings of a text are not valid.
        items, bucket, refined = named(data, valid)
        of = row[items[0]]
        found.parts.append(np.concatenate([of[None], items - starts[of]]))
        found.names.append((bucket, refined))

    return run


def _finer_items(min_bytes: int, width: int):
    """Later levels: open items cut into smaller ones, by distance from the anchor."""
    core = min_bytes - width + 1

    def named(data: bytes, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = Identifiers(data)
        parts = _cut(items, width)
        first, last, anchor = parts
        group = (anchor - last) // width
        bucket = _mix(ids.at(core, anchor - group * width), group.astype(np.uint64))
        shape = ((anchor - first) << 8 | (anchor - last)).astype(np.uint64)
        # The halves of a string go in one by one: two identifiers of 64 bits tell it apart.
        half = 1 << (min_bytes.bit_length() - 1)
        refined = shape
        for place in (first, first + min_bytes - half, last, last + min_bytes - half):
            refined = _mix(refined, ids.at(half, place))
        return parts, bucket, refined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for begin, end in _groups([len(t) for t in texts]):
                found = _Items()
                for row in range(begin, end):
                    opened = batch.column(3)[row].values
                    items = np.stack([opened.field(n).to_numpy(zero_copy_only=False).astype(np.int64)
                                      for n in ("first", "last", "anchor")])
                    items = items[:, np.argsort(items[0])]
                    cuts = np.searchsorted(items[0], np.arange(0, len(texts[row]) + 1, CHUNK_BYTES))
                    for a, b in zip(cuts, [*cuts[1:], items.shape[1]]):
                        if a < b:
                            some = items[:, a:b]
                            base = int(some[0].min())
                            stop = int(max(some[1].max() + min_bytes, some[2].max() + min_bytes))
                            parts, *names = named(texts[row][base:stop], some - base)
                            found.add(row - begin, base, parts, *names)
                yield found.batch(batch.column(0).slice(begin, end - begin),
                                  batch.column(1).slice(begin, end - begin))

    return run


def judged(items: DataFrame) -> DataFrame:
    """(id, digest, first, last, anchor, done): repeated items, and those that stay open."""
    bucket = W.partitionBy("bucket")
    earlier = F.rank().over(W.partitionBy("bucket", "refined").orderBy(*_ORDER, "first"))
    ranked = items.withColumn("earlier", earlier).withColumns({
        "low": F.min("refined").over(bucket), "high": F.max("refined").over(bucket)})
    done = F.col("done") | (F.col("earlier") > 1)
    return (ranked.where(done | (F.col("low") != F.col("high")))
            .select(*_ORDER, "first", "last", "anchor", done.alias("done")))


def _key(left: DataFrame, right: DataFrame, id_name: str, digest_name: str) -> Column:
    return (left[id_name].eqNullSafe(right["id"])) & (left[digest_name] == right["digest"])


def _collected(spans: DataFrame) -> DataFrame:
    """(id, digest, spans) of each document; never more than its own text has strings."""
    return spans.groupBy(*_ORDER).agg(F.collect_list(F.struct("first", "last", "anchor")).alias("spans"))


def _without(text: bytes, spans: np.ndarray, min_bytes: int) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many stretches."""
    first, last = spans[:, np.argsort(spans[0])]
    end = np.maximum.accumulate(last + min_bytes)
    new = np.append(True, first[1:] > end[:-1])
    begin, stop = first[new], end[np.append(new[1:], True)]
    kept, at = [], 0
    for a, b in zip(begin.tolist(), stop.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), int((stop - begin).sum()), len(begin)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   min_bytes: int = 100) -> DataFrame:
    """The given rows with ``kept`` (the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    ``min_bytes`` is 64 or more and at most 255.
    """
    if not 64 <= min_bytes <= 255:
        raise ValueError("min_bytes must lie between 64 and 255")
    kind = docs.schema[id_column].dataType
    text = F.coalesce(F.col(text_column), F.lit(""))
    plain = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    items = plain.where(F.octet_length("text") >= min_bytes).mapInArrow(_first_items(min_bytes), _schema(kind))
    spans = [snapshot(judged(items), "spans_0")]
    keys = small_side(snapshot(spans[0].select(*_ORDER).distinct(), "touched"))

    digest, at, kept, *counts = fresh(docs, "digest", "spans", "kept", "n_bytes", "n_removed", "n_spans")
    keyed = docs.withColumn(digest, F.xxhash64(text))
    touched = snapshot(keyed.join(keys, _key(keyed, keys, id_column, digest), "left_semi"), "texts")
    suspects = touched.select(F.col(id_column).alias("id"), F.col(digest).alias("digest"), text.alias("text"))
    for width in WIDTHS:
        opened = _collected(spans[-1].where("NOT done"))
        whole = suspects.join(opened, _key(suspects, opened, "id", "digest")).select(
            suspects["id"], suspects["digest"], "text", "spans")
        finer = whole.mapInArrow(_finer_items(min_bytes, width), _schema(kind))
        spans.append(snapshot(judged(finer), f"spans_{width}"))

    done = spans[0].where("done")
    for level in spans[1:]:
        done = done.unionByName(level.where("done"))
    gone = _collected(done).withColumnRenamed("spans", at)
    with_gone = touched.join(gone, _key(touched, gone, id_column, digest), "left").drop(
        gone["id"], gone["digest"]).drop(digest)
    free = keyed.join(keys, _key(keyed, keys, id_column, digest), "left_anti").drop(digest)
    both = with_gone.unionByName(free.withColumn(at, F.lit(None).cast(with_gone.schema[at].dataType)))
    schema = T.StructType([*docs.schema.fields, T.StructField(kept, T.BinaryType()),
                           *(T.StructField(n, T.LongType()) for n in counts)])
    n, place = len(docs.columns), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
            out = []
            for row, text_ in enumerate(texts):
                listed = batch.column(n)[row]
                if listed.is_valid:
                    spans_ = np.stack([listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last")])
                    left, *gone_ = _without(text_, spans_, min_bytes)
                    out.append((left, len(text_), *gone_))
                else:
                    out.append((text_, len(text_), 0, 0))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *made],
                                             [*batch.schema.names[:n], kept, *counts])

    return both.select(*docs.columns, at).mapInArrow(run, schema)
