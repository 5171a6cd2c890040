"""Winnowing against a plain version."""

import random
import re

import pytest

from tillcast.llm import winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(texts, items, window):
    out = []
    for text in texts:
        doc, hit, ids = words(text), set(), set()
        for item, own in items:
            own = words(own)
            n = min(window, len(own))
            grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(doc) - n + 1):
                if n and tuple(doc[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
        out.append((len(doc), len(hit), sorted(ids)))
    return out


def check(spark, texts, items, window=10, k=5):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = winnow.contamination(docs, bench, window=window, k=k).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows}
    assert got == dict(enumerate(plain(texts, items, window))) and len(rows) == len(texts)
    return got


def test_every_long_shared_span_is_found(spark):
    """A vocabulary of a few words: repeats, overlaps and near misses everywhere."""
    rng = random.Random(8)
    some = lambda n: [rng.choice("a b c dd É é 7".split()) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([0, 1, 3, 6, 9, 10, 11, 14, 30])))) for i in range(25)]
    texts = [None, "", "a", "A,b;C"]
    for _ in range(40):
        doc = some(rng.randrange(0, 30))
        for _, text in rng.sample(items, 2):
            own = text.split()
            at = rng.randrange(len(own) + 1)
            doc += own[at:at + rng.randrange(1, 20)] + some(rng.randrange(0, 6))
        texts.append(" ".join(doc))
    got = check(spark, texts, items)
    assert any(n for _, n, _ in got.values())


@pytest.mark.parametrize(("window", "k"), [(6, 3), (4, 4), (5, 1)])
def test_other_windows(spark, window, k):
    rng = random.Random(window)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 15)))) for i in range(6)]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(12)]
    check(spark, texts, items, window, k)


def test_nulls_repeats_and_no_items(spark, awkward):
    items = [(None, "one line two lines"), (4, None), (5, "no id at all"), (5, "no id at all"), (6, "NO, ID at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = winnow.contamination(awkward, bench).collect()
    assert len(rows) == 10
    assert sorted((str(r.doc_id), r["items"]) for r in rows if r.n_hit) == [
        ("4", [""]), ("4", [""]), ("None", ["5", "6"])]
    kept = winnow.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == 7
    assert winnow.drop_contaminated(awkward, bench.limit(0)).count() == 10
    assert winnow.contamination(awkward.limit(0), bench).count() == 0


def test_native_plan(spark, docs):
    frame = winnow.contamination(docs(["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_items_are_not_broadcast(spark):
    entries = spark.createDataFrame([(1, ["abc"] * 100), (2, ["de"])], "entry long, own array<string>")
    marked = lambda **how: "broadcast" in (
        winnow.small_words(entries, **how)._jdf.queryExecution().logical().toString())
    assert marked(size=401) and not marked(size=400) and not marked(rows=1)
    assert marked() and winnow.small_words(entries.limit(0)).count() == 0


def test_joined_rows_follow_the_input(spark):
    """A phrase, and a whole window, that n texts and n items share."""
    def joined(n):
        tail = lambda kind, i: " ".join(f"{kind}{i}w{j}" for j in range(20))
        phrase, passage = "which of the following is", "p q r s t u v w x y z zz"
        texts = [f"{tail('d', i)} {phrase} {tail('e', i)}" + (f" {passage}" if i % 2 else "") for i in range(n)]
        items = [(i, f"{tail('a', i)} {phrase} {tail('b', i)} {passage}") for i in range(n)]
        bench = winnow.Benchmark(spark.createDataFrame(items, "item_id long, text string"),
                                 "item_id", "text", 10)
        docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
        split = docs.select("row", winnow.words_of(docs["text"]).alias("words"))
        found = winnow.shared_windows(split, bench)
        assert found.join(bench.classes, winnow.CLASS).count() == found.count()
        return found.count()

    assert joined(20) == 10 * 3 and joined(40) == 20 * 3
