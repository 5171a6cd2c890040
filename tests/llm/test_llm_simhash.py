"""SimHash near-dedup against a plain version."""

import random
from collections import defaultdict

import numpy as np
import xxhash

from tillcast.llm import simhash
from tillcast.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc -> least doc reachable, by comparing everything with everything."""
    docs = sorted(prints)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


TEXTS = [None, "", " \n", "one", "Two words", "two WORDS", "a b c", "a b c d", "É é x y z",
         "a b c d e", "x\x1cy z a b"]


def test_fingerprints(docs):
    got = {r.doc_id: r.fingerprint & (1 << 64) - 1
           for r in simhash.fingerprints(docs(TEXTS)).collect()}
    assert got == {i: plain_print(t) for i, t in enumerate(TEXTS)}


def test_fingerprints_are_sparks_hash(spark, docs):
    from pyspark.sql import functions as F
    row = docs(["Abc"]).select(F.xxhash64(F.lower("text")).alias("h")).first()
    assert simhash.fingerprint("Abc") == row.h


def test_whole_table(spark, small):
    frame = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = simhash.near_duplicates(frame).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert all(prints[d] == plain_print(t) for d, t in list(texts.items())[:150])
    expected = plain_components(prints)
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert len(set(expected.values())) < len(expected)


def test_dense_lists_in_blocks(spark):
    """Chains and clouds around few centres: every list is long, all links must be found."""
    rng = random.Random(5)
    prints = set()
    for centre in (0x0123456789ABCDEF, 0x0123456789ABCD00, rng.getrandbits(64)):
        at = centre
        for _ in range(120):
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints |= {at, at ^ 1 << rng.randrange(64), centre ^ rng.getrandbits(8) << 56}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fingerprint long")
    expected = plain_components({i: p & (1 << 64) - 1 for i, p in enumerate(signed)})
    ids = {p: i for i, p in enumerate(signed)}
    for block in (8, 1024):
        groups = simhash.near_groups(frame, block=block).collect()
        assert {ids[g.fingerprint]: g.component_id for g in groups} == expected
    # A spanning forest of each list, never all its pairs.
    entries = frame.selectExpr("fingerprint AS fp")
    assert simhash.links(entries).count() <= 8 * len(signed)


def test_every_near_pair_shares_a_posting():
    rng = random.Random(1)
    for _ in range(2000):
        places = {b // 8 for b in rng.sample(range(64), 3)}
        assert any(not places & set(t) for t in simhash.TRIPLES)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 540)] + [(7, 7)]
    seen = defaultdict(set)
    for a, b in links:
        seen[a].add(b)
        seen[b].add(a)

    def least(x):
        reached, left = {x}, [x]
        while left:
            for y in seen[left.pop()] - reached:
                reached.add(y)
                left.append(y)
        return min(reached)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links for x in (a, b) if a != b}
    assert got == {x: least(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows_and_columns(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 10
    empty = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert empty == {1}
    assert [r.component_id for r in rows if r.doc_id is None] .count(None) == 1
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    # Three empty texts and a null id beside them are one group; the repeated row stays once.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 7, 8, 9, None]
    assert simhash.keep_one(awkward.limit(0)).count() == 0
