"""Removal of repeated strings against looking up every string."""

import random

import pytest
from pyspark.sql import functions as F

from tillcast.llm import repeats


def plain(rows, length):
    """row -> (kept, bytes, removed, spans) for rows (id, text) of distinct ids."""
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i:i + length]
            if string in seen:
                gone[i:i + length] = b"\1" * length
            seen[string] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (kept, len(data), sum(gone), spans)
    return out


def check(spark, rows, length=100, partitions=3):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans)
           for r in repeats.remove_repeats(frame, min_bytes=length).collect()}
    assert got == plain(rows, length)
    return got


def made(seed, n=60):
    """Texts that share passages of all lengths, with single letters changed here and there."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 80))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = ""
        while rng.random() < 0.8:
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            part = rng.choice([part, part[a:], part[:a + 1], rng.choice(words) * rng.randint(1, 30)])
            for _ in range(rng.choice([0, 0, 1, 3])):
                k = rng.randrange(len(part))
                part = part[:k] + rng.choice("xyz") + part[k + 1:]
            text += part + " "
        rows.append((rng.randrange(-10**6, 10**6) * 100 + i, text))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_shared_passages(spark, seed):
    got = check(spark, made(seed))
    assert 0 < sum(r[2] for r in got.values()) < sum(r[1] for r in got.values())


@pytest.mark.parametrize("length", [64, 65, 127, 128, 200])
def test_other_lengths(spark, length):
    check(spark, made(length, 40), length)


def test_periods_and_borders(spark, monkeypatch):
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(400))
    rows = [(1, "a" * 1000), (2, "a" * 99), (3, "a" * 100), (4, "ab" * 300), (5, noise * 3),
            (6, noise[:99]), (7, noise[:100]), (8, "x" + noise[1:101]), (9, noise[300:] + noise[:40]),
            (10, noise[-100:] + "a" * 150 + noise[:100]), (11, None), (12, ""), (None, noise[50:160])]
    check(spark, rows)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 137)
    check(spark, rows, partitions=1)
    check(spark, made(77, 30))


def test_copies_and_repeated_rows(spark):
    text = " ".join(f"w{i * i}" for i in range(200))
    other = " ".join(f"v{i * i}" for i in range(200))
    rows = [(2, text), (1, text), (1, text), (3, text + " end"), (4, other), (4, text), (None, other)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = sorted((r.doc_id or 0, r.text == text, r.n_removed) for r in got)
    size, more = len(text), len(other)
    assert told == [(0, False, 0), (1, True, 0), (1, True, 0), (2, True, size),
                    (3, False, size), (4, False, more), (4, True, size)]


def test_one_letter_apart(spark):
    """Strings on either side of a changed letter, and none that holds it."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij ") for _ in range(1200))
    rows = [(0, base)] + [(k, base[:at] + "#" + base[at + 1:]) for k, at in enumerate(range(40, 1200, 61), 1)]
    check(spark, rows)


def test_awkward_rows(spark, awkward):
    clash = (awkward.withColumnRenamed("row", "kept").withColumnRenamed("ids", "ID")
             .withColumnRenamed("Words", "spans").withColumnRenamed("shard", "digest"))
    out = repeats.remove_repeats(clash)
    assert out.columns == [*clash.columns, "kept_", "n_bytes", "n_removed", "n_spans"]
    rows = out.collect()
    assert len(rows) == 10 and all(r.n_removed == 0 and bytes(r.kept_) == (r.text or "").encode()
                                   for r in rows if r.doc_id != 7)
    (long_row,) = (r for r in rows if r.doc_id == 7)
    assert long_row.n_removed > 0.99 * long_row.n_bytes and long_row.n_spans == 1
    assert repeats.remove_repeats(awkward.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(awkward, min_bytes=20)


def test_text_ids(spark):
    rows = [("b", "q" * 150), ("a", "q" * 120), (None, "z" * 99)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.doc_id: r.n_removed for r in got.select("doc_id", F.col("n_removed")).collect()} == {
        "a": 119, "b": 150, None: 0}
