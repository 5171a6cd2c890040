"""Periodic runs against comparing every word with every later one."""

import random

import numpy as np
import pytest

from tillcast.llm import periods, queries


def plain(words):
    """(start, length, period) of all runs: every period, every stretch."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in periods.periodic_runs(frame).collect():
        words = [w.decode() for w in (texts[row.doc_id] or "").encode().split()]
        runs = plain(words)
        assert [tuple(r) for r in row.runs] == runs, (row.doc_id, words[:40])
        assert row.collapsed == plain_collapsed(words, runs)


def made(seed):
    """Words out of few, with repeated stretches of all sizes, some nested."""
    rng = random.Random(seed)
    words = []
    while len(words) < rng.randint(1, 900):
        part = [rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(rng.randint(1, 70))]
        for _ in range(rng.randint(0, 2)):
            part = part * rng.randint(1, 5) + part[:rng.randint(0, len(part))]
        words += part[:600]
    return " ".join(words)


def test_against_every_comparison(spark):
    check(spark, [made(seed) for seed in range(400)])


def test_few_letters(spark):
    rng = random.Random(3)
    check(spark, [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(400)])


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100])
def test_each_period(spark, period):
    rng = np.random.default_rng(period)
    part = [f"w{x}" for x in rng.integers(0, max(2, period // 3), period)]
    check(spark, [" ".join(["x"] * lead + part * 6 + part[:cut] + ["y"]) for lead in (0, 1, 5)
                  for cut in (0, period // 2)])


def test_fibonacci_words(spark):
    a, b = "a", "a b"
    for _ in range(11):
        a, b = b, f"{b} {a}"
    check(spark, [b, " ".join([a] * 5), " ".join([b] * 4)])


def test_awkward_rows(spark, awkward):
    rows = periods.periodic_runs(awkward).collect()
    assert len(rows) == 10
    told = {r.doc_id: r for r in rows}
    assert told[1].runs == [] and told[1].collapsed == "" and told[3].collapsed == ""
    (run,) = told[7].runs
    assert (run.start, run.length, run.period) == (0, 200_000, 977)
    assert told[7].collapsed.split() == [f"word{i}" for i in range(977)]
    clash = awkward.withColumnRenamed("row", "runs").withColumnRenamed("Words", "COLLAPSED")
    assert periods.periodic_runs(clash).columns[-2:] == ["runs_", "collapsed_"]
    assert periods.periodic_runs(awkward.limit(0)).count() == 0


def test_planted_words(spark, docs):
    import zlib
    texts = [(i, f"{' '.join(f'w{k}' for k in range(i % 97))}\n") for i in range(300)]
    got = {r.doc_id: (r.text or "").split() for r in queries.with_planted_runs(
        docs([*texts, (None, "a a"), (7000, None)])).collect()}
    for i, text in texts:
        words, h = text.split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        assert got[i] == words
    assert got[None] == ["a", "a"] and got[7000] == []
