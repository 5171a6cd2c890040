"""Karmarkar-Karp shards: indivisible groups, balance, gapless slots."""

import random
import zlib
from collections import defaultdict

import pytest

from tillcast.llm import sharding


def spread(sizes, bins, ways):
    load = [0] * ways
    for s, b in zip(sizes, bins, strict=True):
        load[b] += s
    return max(load) - min(load)


def test_differencing_beats_the_greedy_way():
    assert spread([8, 7, 6, 5, 4], sharding.differencing([8, 7, 6, 5, 4], 2), 2) == 2
    rng = random.Random(4)
    for ways in (2, 3, 8):
        sizes = [rng.randrange(1, 10_000) for _ in range(400)]
        load = [0] * ways
        for s in sorted(sizes, reverse=True):
            load[load.index(min(load))] += s
        own = spread(sizes, sharding.differencing(sizes, ways), ways)
        assert own <= max(load) - min(load) and own < 0.01 * sum(sizes) / ways
    assert sharding.differencing([], 3) == [] and sharding.differencing([5], 3) == [0]


@pytest.mark.parametrize(("last", "part"), [(4096, 16_384), (100, 64), (200, 300)])
def test_levels(spark, last, part):
    rng = random.Random(last)
    sizes = [int(rng.paretovariate(2.5) * 100) for _ in range(900)]
    sizes[0] = sum(sizes) // 2  # one group with a third of everything
    frame = spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(sizes)], "item string, size long")
    rows = sharding.assign(frame, 8, last, part).collect()
    assert sorted(r["item"] for r in rows) == sorted(f"g{i}" for i in range(900))
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += sizes[int(r["item"][1:])]
    loads = sorted(load.values(), reverse=True)
    assert len(loads) == 8 and loads[0] == sizes[0]  # it is alone
    assert loads[1] - loads[-1] < 0.02 * loads[1]
    with pytest.raises(ValueError):
        sharding.assign(frame, 8, 4, 10)


def test_whole_table(spark, small):
    frame = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in frame.collect()}
    rows = sharding.shard(frame.select("doc_id", "text")).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    load, slots, home = defaultdict(int), defaultdict(list), {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert home.setdefault(raw, r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.001 * max(load.values())


def test_awkward_rows_and_columns(awkward, tmp_path, spark):
    rows = sharding.shard(awkward, 3)
    assert rows.columns == [*awkward.columns, "size", "text_crc32", "shard_", "slot"]
    got = rows.collect()
    assert len(got) == 10 and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard_ == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(awkward.limit(0)).count() == 0
    sharding.write_shards(rows, str(tmp_path / "out"), "shard_")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
