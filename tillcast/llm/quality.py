"""Quality rules: a ledger of failure bits, versioned policies, ablations by bits.

Every rule is evaluated once for each text.  The ledger keeps the measurements and one long
with a bit for each failed rule.  ``stored`` writes it once, with the version of the rules; a
policy is a mask over these bits, so that another policy or an ablation reads the stored
bits and never a text again.  A ledger of other rules is refused.

Defined results: a null or empty text has no words and fails ``few_words``.  Rows are judged
one by one: ties, repeated rows and other columns do not matter.  Windows of words are
compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot
from tillcast.llm.common import WORD, fresh, held

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_bangs", "n_capitals")

#: Rule -> condition under which a text fails, over the measurements.  The order gives the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "shouting": "10 * n_bangs > 3 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
BIT = {name: 1 << at for at, name in enumerate(RULES)}
#: To be raised whenever a rule or its bit changes.
RULES_VERSION = 1
#: Version of the policy -> the rules it applies.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: tuple(RULES),
}
BASE = POLICIES[1]


def mask(rules) -> int:
    return sum(BIT[rule] for rule in rules)


def ledger(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The given columns, all measurements, and ``failures``: a bit for each failed rule."""
    text, words, lines, windows, ordered, names = _names(docs)
    frame = held(docs, **{text: F.coalesce(F.col(text_column), F.lit(""))})
    frame = held(frame, **{
        words: F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))})
    word = F.col(words)
    frame = held(frame, **{windows: F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))))
        .otherwise(F.array().cast("array<bigint>"))})
    # Only texts with a repeated window are sorted, by hash, so that equals stand together.
    frame = held(frame, **{ordered: F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))})
    at = lambda j: F.get(F.col(ordered), j).h
    repeated = F.filter(ordered, lambda x, j: F.coalesce(x.h == at(j - 1), F.lit(False))
                        | F.coalesce(x.h == at(j + 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(
        repeated, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    made = {
        "n_words": F.size(words),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"),
                                  lambda total, x: total + F.char_length(x)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col(ordered).isNull(), 0).otherwise(F.size(covered)),
        "n_bangs": F.regexp_count(text, F.lit("!")),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
    }
    frame = held(frame, **{names[k]: v.cast("long") for k, v in made.items()})
    failures = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        for name in MEASURES:
            condition = condition.replace(name, f"`{names[name]}`")
        failures = failures + F.when(F.expr(condition), F.lit(BIT[rule])).otherwise(0)
    return (frame.withColumn(names["failures"], failures)
            .drop(text, words, lines, windows, ordered))


def _names(docs: DataFrame) -> tuple:
    inner = fresh(docs, "whole", "words", "lines", "windows", "ordered", *MEASURES, "failures", "rules")
    return (*inner[:5], dict(zip((*MEASURES, "failures", "rules"), inner[5:], strict=True)))


def stored(docs: DataFrame, text_column: str = "text", with_text: bool = False) -> DataFrame:
    """The ledger as a written table, with the version of its rules; the text only if asked for."""
    names = _names(docs)[5]
    rows = ledger(docs, text_column).withColumn(names["rules"], F.lit(RULES_VERSION))
    return snapshot(rows if with_text else rows.drop(text_column), "quality_ledger")


def verdict(failures: Column, version: int, rules: Column | None = None) -> Column:
    """Whether a policy keeps the text; with ``rules``, the ledger's version of them is checked."""
    kept = failures.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0
    return kept if rules is None else F.when(rules == RULES_VERSION, kept).otherwise(
        F.raise_error(F.lit("the ledger was written by other rules")))


def keep(docs: DataFrame, text_column: str = "text", version: int = 2) -> DataFrame:
    """The rows that a policy keeps, with their own columns only, from a stored ledger."""
    names = _names(docs)[5]
    judged = stored(docs, text_column, with_text=True)
    return judged.where(verdict(F.col(names["failures"]), version, F.col(names["rules"]))).select(
        *docs.columns)


def ablation(rows: DataFrame, version: int = 2) -> DataFrame:
    """What each rule of a policy does, from a ledger: texts it rejects, texts it alone rejects.

    The ledger is first counted by its masks, of which there are at most two to the number of
    rules; the rest are bit operations over these counts.
    """
    rules = POLICIES[version]
    seen = F.col("failures").bitwiseAND(F.lit(mask(rules)))
    masks = rows.groupBy(seen.alias("failures")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                               for r in rules))).alias("r")
    hit = F.col("failures").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failures") == F.col("r.bit")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return (masks.select("*", each).groupBy(F.col("r.rule").alias("rule"))
            .agg(total(hit).alias("n_rejected"), total(alone).alias("n_only_by_this"),
                 total(F.col("failures") == 0).alias("n_kept"),
                 total((F.col("failures") == 0) | alone).alias("n_kept_without")))
