"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``w`` consecutive hashes of ``k`` words the least is a fingerprint of the text, with
``w = window - k + 1``.  Two texts that share ``window`` words share all the hashes of that
span, hence its least one: no shared span of that length can be missed.  Fingerprints of the
documents are joined with those of the benchmark.  Texts with a common one are extended to
whole windows: each of their runs of ``window`` words meets the one benchmark window of equal
words, by 128 bits of hashes, so that a phrase shorter than a window costs nothing beyond its
own texts, however many items hold it.  Windows that the same items own form one class, and
a text meets the items of a class once.  An item of fewer than ``window`` words is one window;
it is looked up by the hash of all its words, for each of the few lengths that occur.

Defined results: null texts have no words, so they hit nothing and are hit by nothing; a row
given twice gets the same result twice; an item given twice under two ids counts twice, a
null item id counts as the empty id.  Empty tables give no hits.  Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot
from tillcast.llm.common import BROADCAST_ROWS, TOKEN, ascii_lower, digest, held, row_key, small_side

GRAM = 5
#: Arrays of texts of more bytes than this are joined by a shuffle.
BROADCAST_BYTES = 1 << 24
CLASS = ["c1", "c2"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def grams(words: str, k: int) -> Column:
    """Hashes of all runs of k words; none for fewer words."""
    word = F.col(words)
    return F.when(F.size(word) >= k, F.transform(
        F.sequence(F.lit(0), F.size(word) - k),
        lambda i: F.xxhash64(*(F.get(word, i + j) for j in range(k))))).otherwise(
        F.array().cast("array<bigint>"))


def fingerprints(hashes: str, w: int) -> Column:
    """The distinct least hashes of all windows of w hashes; none for fewer hashes."""
    h = F.col(hashes)
    return F.when(F.size(h) >= w, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(h) - w + 1),
        lambda i: F.array_min(F.slice(h, i, F.lit(w)))))).otherwise(
        F.array().cast("array<bigint>"))


def windows(words: str, length: int) -> Column:
    """(h1, h2, at): 128 bits of hashes of all runs of so many words, and where they begin."""
    word = F.col(words)

    def run(i: Column) -> Column:
        first, second = digest(*(F.get(word, i + j) for j in range(length)))
        return F.struct(first.alias("h1"), second.alias("h2"), i.alias("at"))

    return F.when(F.size(word) >= length, F.transform(
        F.sequence(F.lit(0), F.size(word) - length), run))


class Benchmark:
    """The benchmark's windows and the hashes under which documents look them up."""

    def __init__(self, items: DataFrame, id_column: str, text_column: str, window: int,
                 k: int = GRAM):
        if not 1 <= k <= window:
            raise ValueError("a gram has between one and `window` words")
        self.window, self.k, self.w = window, k, window - k + 1
        listed = held(items.select(
            F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"),
            F.col(text_column).alias("text")), words=words_of(F.col("text")))
        self.items = snapshot(listed.where(F.size("words") > 0).select(
            "item", "words", F.size("words").alias("n")).distinct(), "benchmark_items")
        #: Lengths of the short items: below the window, hence at most window - 1 of them.
        self.short = sorted(r.n for r in self.items.where(F.col("n") < window)
                            .select("n").distinct().collect())
        found = held(self.items.where(F.col("n") >= window), h=grams("words", k))
        index = found.select(F.explode(fingerprints("h", self.w)).alias("hash"), F.lit(k).alias("length"))
        owned = self._owned(self.items.where(F.col("n") >= window), window)
        for length in self.short:
            whole = self.items.where(F.col("n") == length)
            index = index.unionByName(held(whole, h=grams("words", length)).select(
                F.get("h", F.lit(0)).alias("hash"), F.lit(-length).alias("length")))
            owned = owned.unionByName(self._owned(whole, length))
        #: (hash, length of the gram); the length is negative for the whole of a short item.
        self.index = snapshot(index.distinct(), "benchmark_index")
        owned = (owned.groupBy("length", "h1", "h2")
                 .agg(F.sort_array(F.collect_set("item")).alias("ids")))
        owned = snapshot(owned.withColumns(dict(zip(CLASS, digest(F.col("ids")), strict=True))),
                         "benchmark_windows")
        #: (length, h1, h2, class) of each window, and the sorted ids of the items of a class.
        self.windows = owned.select("length", "h1", "h2", *CLASS)
        self.classes = owned.groupBy(*CLASS).agg(F.first("ids").alias("ids"))

    @staticmethod
    def _owned(items: DataFrame, length: int) -> DataFrame:
        return items.select("item", F.inline(windows("words", length))).select(
            "item", F.lit(length).alias("length"), "h1", "h2")

    def lookups(self) -> list[int]:
        return [self.k, *(-length for length in self.short)]


def small_words(entries: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES,
                column: str = "own") -> DataFrame:
    """Mark entries for broadcast if their number and the bytes of their texts are small."""
    n, total = entries.limit(rows + 1).agg(
        F.count(F.lit(1)), F.sum(F.octet_length(F.array_join(column, " ")))).first()
    return F.broadcast(entries) if n <= rows and (total or 0) <= size else entries


def candidates(texts: DataFrame, bench: Benchmark) -> DataFrame:
    """Keys of the texts that share a fingerprint with the benchmark (columns row, words)."""
    found = None
    for length in bench.lookups():
        h = held(texts, h=grams("words", abs(length)))
        each = fingerprints("h", bench.w) if length > 0 else F.array_distinct("h")
        index = bench.index.where(F.col("length") == length).select("hash")
        hits = (h.select("row", F.explode(each).alias("hash"))
                .join(small_side(index), "hash", "left_semi").select("row"))
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def shared_windows(suspects: DataFrame, bench: Benchmark) -> DataFrame:
    """(row, at, length, class) of each run of words in (row, words) that is a window.

    A place meets at most one window of each length: the rows grow with the texts alone.
    """
    found = None
    for length in (bench.window, *bench.short):
        own = bench.windows.where(F.col("length") == length)
        each = (suspects.select("row", F.inline(windows("words", length)))
                .join(small_side(own), ["h1", "h2"]).select("row", "at", "length", *CLASS))
        found = each if found is None else found.unionByName(each)
    return found


def hits(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = 10,
         k: int = GRAM) -> DataFrame:
    """For each row key with a hit: ``n_hit`` words, ``items``: sorted ids of items that occur."""
    bench = Benchmark(items, item_id, item_text, window, k)
    texts = docs.select(row_key(F.col(id_column), F.col(text_column)).alias("row"),
                        F.col(text_column).alias("text"))
    keys = snapshot(candidates(
        held(texts, words=words_of(F.col("text"))).select("row", "words"), bench), "suspects")
    suspects = snapshot(texts.join(keys, "row", "left_semi").dropDuplicates(["row"]), "suspect_texts")
    suspects = held(suspects, words=words_of(F.col("text"))).drop("text")

    of_class = (shared_windows(suspects, bench).groupBy("row", *CLASS)
                .agg(F.collect_list(F.struct("at", "length")).alias("spans")))
    places = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(
        s["at"], s["at"] + s["length"] - 1))
    return (of_class.join(small_words(bench.classes, column="ids"), CLASS).groupBy("row")
            .agg(F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_hit"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id",
                  text_column: str = "text", **how) -> DataFrame:
    """One row per document: its key columns, ``n_words``, ``n_hit`` and ``items``."""
    found = hits(docs, items, id_column, text_column, **how)
    counted = docs.select(
        F.col(id_column), row_key(F.col(id_column), F.col(text_column)).alias("row"),
        F.coalesce(F.regexp_count(ascii_lower(F.col(text_column)), F.lit(TOKEN)), F.lit(0))
        .cast("long").alias("n_words"))
    return (counted.join(found, "row", "left").drop("row")
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id",
                      text_column: str = "text", **how) -> DataFrame:
    """The documents without a hit, with their own columns."""
    found = hits(docs, items, id_column, text_column, **how).select("row")
    found = snapshot(found, "contaminated")
    return (docs.join(found, row_key(docs[id_column], docs[text_column]) == found["row"],
                      "left_anti"))
