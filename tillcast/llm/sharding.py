"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a set of bins.  The two with the largest spread are combined again and
again, the fullest bin of one with the emptiest of the other, until one is left.  Rows of
equal text are a group and stay together.

At scale: groups are dealt into parts, each part is differenced into a few bundles in a task
of its own, and the bundles take the groups' place, round after round, until they are few.
The largest groups are left out of that and meet the bundles in the last differencing, over
at most ``LAST`` of each, so that one huge group is met by bins without it and the fine sizes
even out the rest.

Defined results: null texts form one group and empty texts another; a null text has size 1;
repeated rows belong to the same group and take a slot each; the order of ties is by the
group's digest, so that the result does not depend on the partitioning.  An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot
from tillcast.llm.common import fresh, row_key

#: The most single groups, and about the most bundles, in the last differencing.
LAST = 4096
PART = 16_384
BUNDLES = 32


def differencing(sizes: list[int], ways: int) -> list[int]:
    """A bin for each size, by Karmarkar-Karp differencing."""
    if not sizes:
        return []
    # An entry: spread, order, bins as (load above the least, members), fullest first.
    heap = [(-s, i, [(s, i)] + [(0, None)] * (ways - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        bins = [(a + b, m if n is None else n if m is None else (m, n))
                for (a, m), (b, n) in zip(one, reversed(two), strict=True)]
        bins.sort(key=lambda x: -x[0])
        least = bins[-1][0]
        bins = [(load - least, m) for load, m in bins]
        heapq.heappush(heap, (-bins[0][0], made, bins))
        made += 1
    out = [0] * len(sizes)
    for at, (_, members) in enumerate(heap[0][2]):
        left = [] if members is None else [members]
        while left:
            top = left.pop()
            if isinstance(top, tuple):
                left += top
            else:
                out[top] = at
    return out


def _bundle(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
    bins = differencing(part["size"].tolist(), BUNDLES)
    return pd.DataFrame({"item": part["item"], "size": part["size"], "part": part["part"],
                         "bin": pd.Series(bins, dtype="int32")})


def assign(groups: DataFrame, shards: int, last: int = LAST, part: int = PART) -> DataFrame:
    """(item, shard) for (item, size): groups of a unique text key and a size in bytes."""
    if last < BUNDLES or part < 2 * BUNDLES:
        raise ValueError(f"rounds only shrink with last >= {BUNDLES} and part >= {2 * BUNDLES}")
    spark = groups.sparkSession
    items = snapshot(groups.select("item", "size"), "groups")
    largest = items.orderBy(F.desc("size"), "item").limit(last)
    top = [(r["item"], r["size"]) for r in largest.collect()]  # at most `last` rows
    singles = spark.createDataFrame(top, "item string, size long")
    rest = items.join(F.broadcast(singles.select("item")), "item", "left_anti")
    placed = None
    count = rest.count()
    level = 0
    bundles: list[tuple[str, int]] = []
    while count:
        parts = -(-count // part)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
        bound = dealt.groupBy("part").applyInPandas(
            _bundle, "item string, size long, part int, bin int")
        bound = snapshot(bound.withColumn(
            "bundle", F.concat_ws("/", F.lit(f"bundle {level}"), "part", "bin")), "bundles")
        step = bound.select("item", "bundle")
        placed = step if placed is None else (
            placed.join(step.select(F.col("item").alias("bundle"), F.col("bundle").alias("next")),
                        "bundle")
            .select("item", F.col("next").alias("bundle")))
        rest = bound.groupBy(F.col("bundle").alias("item")).agg(F.sum("size").alias("size"))
        count = rest.count()
        level += 1
        if count <= last:
            bundles = [(r["item"], r["size"]) for r in rest.collect()]  # at most `last` rows
            break
    every = sorted(top + bundles, key=lambda x: (-x[1], x[0]))
    bins = differencing([size for _, size in every], shards)
    chosen = spark.createDataFrame([(k, b) for (k, _), b in zip(every, bins, strict=True)],
                                   "item string, shard int")
    # At most `last` groups and `last` bundles: both sides below are that small.
    out = singles.select("item").join(F.broadcast(chosen), "item")
    if placed is not None:
        out = out.unionByName(placed.join(
            F.broadcast(chosen.withColumnRenamed("item", "bundle")), "bundle").select("item", "shard"))
    return out


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text",
          last: int = LAST, part: int = PART) -> DataFrame:
    """The given columns and: size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    size, crc, at, slot, item, row, deal = fresh(
        docs, "size", "text_crc32", "shard", "slot", "item", "row", "deal")
    text = F.col(text_column)
    sha = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    whole = docs.withColumns({
        item: F.when(text.isNull(), F.lit("none")).otherwise(sha),
        size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        crc: F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        row: row_key(F.col(id_column), text)})
    groups = whole.groupBy(F.col(item).alias("item")).agg(F.sum(size).alias("size"))
    places = snapshot(assign(groups, shards, last, part), "shards")
    spark = docs.sparkSession
    # Slots are numbered within small parts of each shard, behind the parts before them.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = snapshot(whole.join(places.withColumnsRenamed({"item": item, "shard": at}), item)
                      .withColumn(deal, F.pmod(F.xxhash64(row), F.lit(parts)).cast("int")), "placed")
    counts = joined.groupBy(at, deal).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(at).orderBy(deal).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(at, deal, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(slot))
    # One row for each shard and part: their number is fixed by the settings.
    number = F.row_number().over(Window.partitionBy(at, deal).orderBy(row))
    return (joined.join(F.broadcast(offsets), [at, deal])
            .withColumn(slot, (F.col(slot) + number - 1).cast("long"))
            .select(*docs.columns, size, crc, at, slot))


def write_shards(sharded: DataFrame, path: str, column: str = "shard") -> None:
    """Write a folder for each shard."""
    sharded.repartition(F.col(column), F.pmod(F.xxhash64("slot"), F.lit(16))).write.partitionBy(column).parquet(path)
