"""Cross-entropy difference against a plain version, and on labelled documents."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillcast.llm import crossentropy as ce


def plain_loss(counted, text, order, smoothing):
    """Mean loss per byte of a text under counts of (past + byte) from the given texts."""
    grams = Counter()
    for t in counted:
        t = b"\0" * (order - 1) + t
        for i in range(order - 1, len(t)):
            grams[t[i - order + 1:i + 1]] += 1
    tables = [Counter() for _ in range(order + 1)]
    pasts = [Counter() for _ in range(order + 1)]
    for g, n in grams.items():
        for k in range(1, order + 1):
            tables[k][g[order - k:]] += n
            pasts[k][g[order - k:-1]] += n
    padded, total = b"\0" * (order - 1) + text, 0.0
    for i in range(order - 1, len(padded)):
        p = 1 / 256
        for k in range(1, order + 1):
            g = padded[i - k + 1:i + 1]
            p = (tables[k][g] + smoothing * p) / (pasts[k][g[:-1]] + smoothing)
        total -= math.log(p)
    return total / len(text)


TEXTS = ["the cat sat on the mat", "the dog sat", "xx yy zz", "zz yy xx xx", "é the cat", "cat",
         "on the mat the dog", "zzz", None, ""]


@pytest.mark.parametrize("split_bytes", [8, 10 ** 6])
def test_plain_version(spark, split_bytes):
    frame = spark.createDataFrame(
        [(i, t, i in (0, 1, 4)) for i, t in enumerate(TEXTS)], "doc_id long, text string, target boolean")
    fold = {r.doc_id: r.f for r in frame.select(
        "doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).alias("f")).collect()}
    rows = {r.doc_id: r for r in ce.difference(
        frame, order=3, smoothing=2.0, split_bytes=split_bytes).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if not t:
            assert rows[i].score is None and rows[i].n_tokens == 0
            continue
        others = [(j, (x or "").encode()) for j, x in enumerate(TEXTS) if fold[j] != fold[i]]
        target = plain_loss([x for j, x in others if j in (0, 1, 4)], t.encode(), 3, 2.0)
        background = plain_loss([x for _, x in others], t.encode(), 3, 2.0)
        assert rows[i].target_loss == pytest.approx(target, rel=1e-5)
        assert rows[i].background_loss == pytest.approx(background, rel=1e-5)
        assert rows[i].score == pytest.approx(target - background, abs=1e-5)


def test_held_out_labels(spark, small):
    """Scores of documents that the models have not seen tell good ones from junk."""
    folder = small.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = labels.where("quality = 1 AND toxic = 0").select("doc_id", F.lit(True).alias("target"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = ce.difference(docs.join(good, "doc_id", "left"), order=4).join(labels, "doc_id").collect()
    right = [r.score for r in rows if r.quality == 1]
    wrong = [r.score for r in rows if r.quality == 0]
    wins = sum((a < b) + 0.5 * (a == b) for a in right for b in wrong)
    assert wins / (len(right) * len(wrong)) > 0.9


def test_awkward_rows_and_columns(awkward):
    rows = ce.difference(awkward.withColumn("target", F.lit(None).cast("boolean"))).collect()
    assert len(rows) == 10 and sum(r.score is None for r in rows) == 3
    empty = awkward.limit(0).withColumn("target", F.lit(True))
    assert ce.difference(empty).count() == 0
