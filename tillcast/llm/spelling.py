"""Spelling variants by a relational frontier over a trie.

Two words are near if one inserted, deleted or replaced letter turns one into the other.  The
trie is a table: a node is the hash of a prefix, and an edge leads from a node by the next letters
to a deeper node.  States (word, position, node) of one edit move down the trie by joins with the
edges until the word is used up; a state that then stands on a word is a neighbour.

* States without an edit stand on the word's own prefixes, so they need no join.  Their next
  level is: a letter replaced, by another child of the node, or a letter left out, at the node
  itself.  A letter put in is the other word's letter left out.
* With one edit, either the first or the second half of a word is untouched.  So the frontier
  starts in the middle: in the trie for edits of the second half, in the trie of the reversed
  words for the first half.  No state ever stands at the root, where all words would meet.
* A child is entered only if the word's next letter leads on from it.  From there the frontier
  takes edges of 1, 2, 4, ... letters, by the binary digits of what is left of the word, so that
  the number of joins grows with the logarithm of the longest word.
* Words of more than ``LONG`` letters go by the hashes of the word without each of its letters:
  equal ones at the same position are a replacement, one equal to a whole word is a deletion.
  Each pair found either way is compared letter by letter, so that a hash decides nothing.

Defined results: an empty word has no neighbours, null ones are left out, and a word given twice
counts with the sum of its numbers.  Of near words equal in number, the least in code-point order is the form.  An empty
table gives an empty result.  Only the two named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot

#: Letters of a spelling: those of the alphabet and of Latin-1.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Longer words take the way of ``_long_pairs``; the results are the same.
LONG = 64
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def count_words(words: DataFrame, min_letters: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words long and frequent enough, from one row per occurrence."""
    return (words.where(F.char_length("word") >= min_letters).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _node(prefix: Column) -> Column:
    return F.xxhash64(prefix)


def _prefixes(words: DataFrame) -> DataFrame:
    """(parent, letter, node, is_word): the edges of the trie by one letter."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("word")))
    each = words.select("word", at.alias("depth"))
    return (each.select(
        _node(F.expr("left(word, depth - 1)")).alias("parent"),
        F.expr("substr(word, depth, 1)").alias("letter"),
        _node(F.expr("left(word, depth)")).alias("node"),
        (F.col("depth") == F.char_length("word")).alias("is_word"))
        .groupBy("parent", "letter", "node").agg(F.max("is_word").alias("is_word")))


def _children(edges: DataFrame) -> DataFrame:
    """(parent, children): at most one child for each letter, with the letters that lead on."""
    onward = edges.groupBy(F.col("parent").alias("node")).agg(
        F.array_join(F.collect_list("letter"), "").alias("next"))
    return (edges.join(onward, "node", "left").groupBy("parent").agg(F.collect_list(F.struct(
        "letter", "node", "is_word", F.coalesce("next", F.lit("")).alias("next"))).alias("children")))


def _frontier(words: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, node, rest): states of one edit in the second half of a word, at its next letter."""
    n = F.char_length("word")
    at = F.explode(F.sequence(F.floor(n / 2).cast("int"), n - 1))
    spine = words.select("word", at.alias("at")).select(
        "word", "at", _node(F.expr("left(word, at)")).alias("parent"),
        F.expr("substr(word, at + 1, 1)").alias("own"), F.expr("substr(word, at + 2)").alias("rest"))
    turned = (spine.join(_children(edges), "parent")
              .select("word", "own", "rest", F.inline("children"))
              .where((F.col("letter") != F.col("own")) & F.when(
                  F.col("rest") == "", F.col("is_word")).otherwise(
                  F.expr("contains(next, left(rest, 1))")))
              .select("word", "node", "rest"))
    # The next letter of a left-out one must differ, or leaving that one out is the same.
    left_out = (spine.where((F.col("rest") == "") | (F.expr("left(rest, 1)") != F.col("own")))
                .select("word", F.col("parent").alias("node"), "rest"))
    return turned.unionByName(left_out)


def _jumps(words: DataFrame, step: int) -> DataFrame:
    """(node, label, below): all edges of ``step`` letters."""
    at = F.explode(F.sequence(F.lit(step), F.char_length("word")))
    return (words.where(F.char_length("word") >= step).select("word", at.alias("depth")).select(
        _node(F.expr(f"left(word, depth - {step})")).alias("node"),
        F.expr(f"substr(word, depth - {step} + 1, {step})").alias("label"),
        _node(F.expr("left(word, depth)")).alias("below")).distinct())


def _walked(words: DataFrame, longest: int) -> DataFrame:
    """(word, near): replacements and deletions in the second half of each word."""
    edges = snapshot(_prefixes(words), "trie")
    states = snapshot(_frontier(words, edges), "frontier")
    step = 1
    while step <= longest // 2:
        moves = F.expr(f"char_length(rest) & {step} > 0")
        taken = (states.where(moves).withColumn("label", F.expr(f"left(rest, {step})"))
                 .join(_jumps(words, step), ["node", "label"])
                 .select("word", F.col("below").alias("node"), F.expr(f"substr(rest, {step + 1})").alias("rest")))
        states = snapshot(taken.unionByName(states.where(~moves)), "frontier")
        step *= 2
    ends = words.select(_node(F.col("word")).alias("node"), F.col("word").alias("near"))
    return states.join(ends, "node").select("word", "near")


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, at, hash) of each word without its letter at each place, and whole: at -1."""
    for batch in batches:
        for word in batch.column(0).to_pylist():
            letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
            letters = (letters + np.uint64(7)) * _FOLD
            letters ^= letters >> np.uint64(31)
            power = np.full(len(letters), _FOLD)
            power[0] = 1
            power = np.multiply.accumulate(power)
            sums = np.concatenate([[np.uint64(0)], np.add.accumulate(letters * power)])
            # Behind the missing letter, each power is lower by one: divided by an odd number.
            back = np.uint64(pow(int(_FOLD), -1, 1 << 64))
            without = sums[:-1] + (sums[-1] - sums[1:]) * back
            at = np.arange(-1, len(letters))
            hashes = np.concatenate([sums[-1:], without])
            for begin in range(0, len(at), 1 << 14):
                part = slice(begin, begin + (1 << 14))
                size = len(at[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(word) - 1] * size, pa.int32()), pa.array(at[part].astype(np.int32)),
                     pa.array(hashes[part].view(np.int64)), pa.array([_key(word)] * size, pa.int64())],
                    ["size", "at", "hash", "word"])


def _key(word: str) -> int:
    """What xxhash64 gives for the word."""
    return int(np.uint64(xxhash.xxh64_intdigest(word.encode(), 42)).view(np.int64))


def _long_pairs(words: DataFrame) -> DataFrame:
    """(word, near) both ways for words of more than ``LONG`` letters, and those one shorter."""
    made = snapshot(words.where(F.char_length("word") >= LONG).mapInArrow(
        _deletions, "size int, at int, hash long, word long"), "long_words")
    cut = made.where("at >= 0")
    # Words that are equal without the letter at one place: as many as the alphabet has letters.
    pairs = cut.alias("a").join(cut.alias("b"), ["size", "at", "hash"]).where("a.word != b.word")
    replaced = pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"))
    whole = made.where("at = -1").select((F.col("size") + 1).alias("size"), "hash", F.col("word").alias("near"))
    shorter = cut.join(whole, ["size", "hash"]).select("word", "near")
    hashed = words.select("word", F.xxhash64("word").alias("key"))
    both = replaced.unionByName(shorter).unionByName(
        shorter.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()
    left = hashed.select(F.col("word").alias("left"), F.col("key").alias("word"))
    right = hashed.select(F.col("word").alias("right"), F.col("key").alias("near"))
    return (both.join(left, "word").join(right, "near")
            .select(F.col("left").alias("word"), F.col("right").alias("near")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): every pair of distinct given words that one edit parts, both ways."""
    words = words.select("word").where("word != ''").distinct()
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    short = words.where(F.char_length("word") <= LONG)
    ahead = _walked(short, min(longest, LONG))
    back = _walked(short.select(F.reverse("word").alias("word")), min(longest, LONG)).select(
        F.reverse("word").alias("word"), F.reverse("near").alias("near"))
    found = ahead.unionByName(back)
    found = found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near")))
    if longest > LONG:
        found = found.unionByName(_long_pairs(words))
    return found.distinct().where(F.levenshtein("word", "near", 1) == 1)


def variants(counts: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n).

    ``form`` is the most frequent near word, if it is ``factor`` times as frequent or more;
    ``root`` is the end of the chain of forms.
    """
    counts = snapshot(counts.where(F.col("word").isNotNull()).groupBy("word")
                      .agg(F.sum("n").cast("long").alias("n")), "words")
    near = near_pairs(counts).join(
        counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    often = -F.col("best.minus") >= factor * F.col("n")
    told = snapshot(counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.form")).alias("form"),
        F.when(often, -F.col("best.minus")).cast("long").alias("form_n")), "forms")
    return told.join(_roots(told), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the steps along the forms.

    Numbers grow along a chain, so it ends, and after a logarithm of them steps.
    """
    chain = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = snapshot(chain.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "roots")
        chain = longer.drop("moved")
        if not longer.where("moved").limit(1).count():
            return chain
