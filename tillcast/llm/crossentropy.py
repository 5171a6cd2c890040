"""LM scoring by cross-entropy difference of two byte n-gram models.

The target model is counted on chosen documents, the background model on all documents.
Both have the same vocabulary (the 256 bytes), order and smoothing: counts of an order are
interpolated with the next lower one, down to the uniform distribution.  A document's score
is its mean loss per byte under the target model less that under the background model; the
lower, the closer to the target.

No document is scored by counts it took part in: texts are in one of two folds by a hash of
the text, copies together, and each fold is scored by the counts of the other.

Documents are dealt by a hash into splits of bounded size.  A split sends each distinct
n-gram once with its two counts, the totals make the models, and the split gets back the two
losses of just its own n-grams.  So neither the models nor the corpus are ever in one place,
and what is sent grows with the corpus.

Defined results: a null or empty text has no tokens and null losses; without target documents
the target model is uniform; each row is scored for itself, a row given twice gets the same
score twice; a null in the target column is no target.  An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot
from tillcast.llm.common import row_key

ORDER = 5
SMOOTHING = 4.0
SPLIT_BYTES = 24_000_000
FOLDS = 2
_CHUNK = 2_000_000


def _chunks(texts: list[bytes], order: int):
    """(documents from, to, codes, bounds): n-gram codes of some documents at a time.

    A code is the byte and the ``order - 1`` bytes before it; bytes before a text are zero.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _CHUNK):
            size += len(texts[end])
            end += 1
        pad = b"\0" * (order - 1)
        whole = np.frombuffer(b"".join([pad + t for t in texts[at:end]]), np.uint8)
        codes = np.zeros(len(whole), np.uint64)
        for back in range(order):
            codes[back:] |= whole[:len(whole) - back].astype(np.uint64) << np.uint64(8 * back)
        lengths = np.array([len(t) for t in texts[at:end]])
        first = np.cumsum(lengths + order - 1) - lengths
        real = np.ones(len(whole), bool)
        for back in range(1, order):
            real[first - back] = False
        yield at, end, codes[real], np.concatenate([[0], np.cumsum(lengths)])
        at = end


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, where, np.concatenate([p[1] for p in parts]))
    return codes, total


def _count(table: pa.Table, order: int) -> pa.Table:
    texts = table["text"].to_pylist()
    chosen = np.array(table["target"].to_pylist(), bool)
    every, target = [], []
    for at, end, codes, bounds in _chunks(texts, order):
        every.append(np.unique(codes, return_counts=True))
        within = np.repeat(chosen[at:end], np.diff(bounds))
        if within.any():
            target.append(np.unique(codes[within], return_counts=True))
        if len(every) > 8:
            every, target = [_merged(every)], [_merged(target)]
    codes, n_all = _merged(every)
    own, n_own = _merged(target)
    n_target = np.zeros(len(codes), np.int64)
    n_target[np.searchsorted(codes, own)] = n_own
    return pa.table({"split": pa.array(np.full(len(codes), table["split"][0].as_py(), np.int32)),
                     "gram": pa.array(codes.view(np.int64)),
                     "n_target": pa.array(n_target), "n_all": pa.array(n_all)})


def _score(docs: pa.Table, losses: pa.Table, order: int) -> pa.Table:
    grams = losses["gram"].to_numpy().view(np.uint64)
    sort = np.argsort(grams)
    grams = grams[sort]
    target = losses["target_loss"].to_numpy()[sort]
    background = losses["background_loss"].to_numpy()[sort]
    texts = docs["text"].to_pylist()
    n = np.array([len(t) for t in texts], np.int64)
    sums = np.zeros((2, len(texts)))
    for at, end, codes, bounds in _chunks(texts, order):
        if not len(codes):
            continue
        place = np.searchsorted(grams, codes)
        for row, loss in enumerate((target, background)):
            total = np.concatenate([[0.0], np.cumsum(loss[place], dtype=np.float64)])
            sums[row, at:end] = total[bounds[1:]] - total[bounds[:-1]]
    with np.errstate(invalid="ignore", divide="ignore"):
        means = sums / n
    none = n == 0
    return pa.table({
        "doc": docs["doc"], "n_tokens": pa.array(n),
        "target_loss": pa.array(means[0], mask=none),
        "background_loss": pa.array(means[1], mask=none),
        "score": pa.array(means[0] - means[1], mask=none)})


def losses(counts: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> DataFrame:
    """(gram, fold, target_loss, background_loss) from (gram, t_<fold>, a_<fold>).

    Lower orders are sums over the same counts.  Each order divides by the count of what came
    before the byte and leans on the order below it with a weight of ``smoothing`` counts.
    """
    def part(code, length: int):
        return code.bitwiseAND(F.lit((1 << 8 * length) - 1))

    kinds = [f"{model}_{fold}" for model in "ta" for fold in range(FOLDS)]
    lower = None
    for length in range(1, order + 1):
        here = (counts.groupBy(part(F.col("gram"), length).alias("code"))
                .agg(*(F.sum(k).alias(k) for k in kinds)))
        # At most 256 bytes follow the same past.
        before = Window.partitionBy(F.shiftrightunsigned("code", 8))
        here = here.select("*", *(F.sum(k).over(before).alias(f"past_{k}") for k in kinds))
        if lower is None:
            here = here.select("*", *(F.lit(1 / 256).alias(f"p_{k}") for k in kinds))
        else:
            here = (here.withColumn("shorter", part(F.col("code"), length - 1))
                    .join(lower.withColumnRenamed("code", "shorter"), "shorter"))
        lower = here.select("code", *(
            ((F.col(k) + smoothing * F.col(f"p_{k}")) / (F.col(f"past_{k}") + smoothing))
            .alias(f"p_{k}") for k in kinds))
    each = F.array(*(F.struct(F.lit(fold).alias("fold"), (-F.log(f"p_t_{fold}")).alias("target_loss"),
                              (-F.log(f"p_a_{fold}")).alias("background_loss"))
                     for fold in range(FOLDS)))
    return lower.select(F.col("code").alias("gram"), F.inline(each))


def difference(docs: DataFrame, target: str = "target", id_column: str = "doc_id",
               text_column: str = "text", order: int = ORDER, smoothing: float = SMOOTHING,
               split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row.

    ``target`` names a boolean column: whether the row belongs to the target corpus.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    splits = max(1, -(-size // (split_bytes * FOLDS)))  # of each fold
    fold = F.pmod(F.xxhash64(text), F.lit(FOLDS))
    place = F.pmod(F.xxhash64(row_key(F.col(id_column), F.col(text_column))), F.lit(splits))
    dealt = docs.select(
        (place * FOLDS + fold).cast("int").alias("split"), F.col(id_column).alias("doc"),
        F.coalesce(F.col(target), F.lit(False)).alias("target"),
        F.encode(text, "utf-8").alias("text"))
    counts = snapshot(dealt.groupBy("split").applyInArrow(
        lambda table: _count(table, order),
        "split int, gram long, n_target long, n_all long"), "gram_counts")
    here = F.pmod("split", F.lit(FOLDS))
    others = [(f"{short}_{fold}", F.coalesce(F.sum(F.when(here != fold, F.col(name))), F.lit(0)))
              for short, name in (("t", "n_target"), ("a", "n_all")) for fold in range(FOLDS)]
    totals = counts.groupBy("gram").agg(*(total.alias(name) for name, total in others))
    model = losses(snapshot(totals, "gram_totals"), order, smoothing)
    # Broadcasting the losses would tie the model's size to an executor's memory.
    slices = (counts.select("split", "gram", here.cast("int").alias("fold"))
              .join(model, ["gram", "fold"]).select(
                  "split", "gram", F.col("target_loss").cast("float"),
                  F.col("background_loss").cast("float")))
    kind = dict(docs.dtypes)[id_column]
    scored = dealt.groupBy("split").cogroup(slices.groupBy("split")).applyInArrow(
        lambda left, right: _score(left, right, order),
        f"doc {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return scored.select(F.col("doc").alias(id_column), "n_tokens", "target_loss",
                         "background_loss", "score")
