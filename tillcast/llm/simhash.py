"""SimHash near-dedup with an inverted index of positional bytes.

Fingerprints of 64 bits that differ in at most 3 have at least 5 of their 8 bytes in common,
position by position.  A list of one byte holds a 256th of all fingerprints, and tallying
such lists would pair nearly everything; the index therefore keeps lists of joint postings:
three positions out of one half of the bytes, with their values.  Five shared positions
always contain three in one half, so eight such lists (4 triples for each half) miss no pair.
Within a list, pairs that share at least 5 positional bytes are verified bit by bit.

Equal fingerprints are one entry.  A list is compared in one place up to ``BLOCK`` entries;
a longer one is dealt into blocks, and each pair of blocks is compared in its own group.
Of the links found in a group only a spanning forest leaves it: what the components need,
and never all pairs of a dense list.

Defined results: a text without words, or null, has fingerprint zero and links like any
other; rows repeated or tied share a fingerprint; ids may be null, a component of null ids
only has a null id.  Extra columns are carried along by ``keep_one`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.staging import snapshot
from tillcast.llm.common import fresh, row_key
from tillcast.llm.components import components

BITS, BYTES, MAX_DIFFERENT, SHARED = 64, 8, 3, 5
SHINGLE, SEED = 3, 42
#: Positions indexed together: all triples of either half of the bytes.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Entries of a list that are compared in one group.
BLOCK = 1024
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text, as a signed long."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        n = len(words) - SHINGLE + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, _CHUNK):
        part = np.fromiter(hashes, np.dtype("<u8"), min(_CHUNK, n - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    return docs.select(F.col(id_column), _fingerprints(F.col(text_column)).alias("fingerprint"))


def _byte(at: int):
    return F.shiftrightunsigned("fp", 8 * at).bitwiseAND(F.lit(255))


def postings(entries: DataFrame) -> DataFrame:
    """(list, fp): each fingerprint under its eight joint postings."""
    lists = []
    for n, places in enumerate(TRIPLES):
        value = F.lit(n).cast("long")
        for at in places:
            value = F.shiftleft(value, 8).bitwiseOR(_byte(at))
        lists.append(value)
    return entries.select("fp", F.explode(F.array(*lists)).alias("list"))


def blocks(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Groups to compare: (fps) of one list, or of two blocks of a long list."""
    listed = postings(entries)
    long_lists = (listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > block)
                  .select("list", F.ceil(F.col("n") / block).cast("int").alias("n_blocks")))
    dealt = (listed.join(long_lists, "list", "left")
             .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))))
    return (dealt.groupBy("list", F.least("own", "other").alias("low"),
                          F.greatest("own", "other").alias("high"))
            .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps"))


def _near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and, of these, differ in few enough bits."""
    differ = left ^ right
    shared = (differ[..., None].view(np.uint8) == 0).sum(-1, dtype=np.uint8)
    near = shared >= SHARED
    near[near] = np.bitwise_count(differ[near]) <= MAX_DIFFERENT
    return near


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within the list, one fewer than each tree's nodes."""
    left, a, b = np.unique(fps), [], []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.zeros(len(left), bool)
            source = np.zeros(len(left), reached.dtype)
            for start in range(0, len(reached), 256):
                part = reached[start:start + 256]
                hit = _near(part[:, None], left[None, :])
                new = hit.any(0) & ~near
                source[new] = part[hit[:, new].argmax(0)]
                near |= new
            a.append(source[near])
            b.append(left[near])
            reached, left = left[near], left[~near]
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = column.offsets.to_numpy()
        sizes = np.diff(offsets)
        pairs = offsets[:-1][sizes == 2]
        left, right = values[pairs], values[pairs + 1]
        near = _near(left, right)
        a, b = [left[near]], [right[near]]
        for start, size in zip(offsets[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            more = _forest(values[start:start + size])
            a.append(more[0])
            b.append(more[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def links(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that is connected."""
    return blocks(entries, block).mapInArrow(_links, "a long, b long")


def near_groups(prints: DataFrame, id_column: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(fingerprint, component_id): for each distinct fingerprint the least id reachable."""
    entries = snapshot(prints.groupBy(F.col("fingerprint").alias("fp"))
                       .agg(F.min(id_column).alias("least")), "entries")
    return _least_of(entries, links(entries, block))


def least_ids(prints: DataFrame, id_column: str, found: DataFrame) -> DataFrame:
    """The same by given links between fingerprints."""
    return _least_of(prints.groupBy(F.col("fingerprint").alias("fp"))
                     .agg(F.min(id_column).alias("least")), found)


def _least_of(entries: DataFrame, found: DataFrame) -> DataFrame:
    nodes = components(found)
    joined = entries.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return (joined.join(least, "component")
            .select(F.col("fp").alias("fingerprint"), "component_id"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    block: int = BLOCK) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    prints = snapshot(fingerprints(docs, id_column, text_column), "fingerprints")
    groups = near_groups(prints, id_column, block)
    return prints.join(groups, "fingerprint").select(
        id_column, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             block: int = BLOCK) -> DataFrame:
    """One row of each group of near duplicates: that of the least id, with all its columns.

    Among rows of the same least id, and in a group of null ids, the least row digest stays;
    of equal rows one stays.
    """
    key = row_key(F.col(id_column), F.col(text_column))
    prints = snapshot(docs.select(
        F.col(id_column).alias("id"), key.alias("row"),
        _fingerprints(F.col(text_column)).alias("fingerprint")), "fingerprints")
    return keep_rows(docs, key, prints, near_groups(prints, "id", block))


def keep_rows(docs: DataFrame, key: Column, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by their ``prints`` (id, row, fingerprint) and groups."""
    chosen = (prints.join(groups, "fingerprint")
              .where(F.col("id").eqNullSafe(F.col("component_id")))
              .groupBy("fingerprint", "component_id").agg(F.min("row").alias("row")))
    # Null ids form a component of their own only where no id is known.
    chosen = snapshot(
        chosen.where("component_id IS NOT NULL").groupBy("component_id")
        .agg(F.min("row").alias("row")).select("row")
        .unionByName(chosen.where("component_id IS NULL").select("row")), "chosen")
    (name,) = fresh(docs, "row")
    return (docs.withColumn(name, key).join(chosen.withColumnRenamed("row", name), name, "left_semi")
            .dropDuplicates([name]).drop(name))
