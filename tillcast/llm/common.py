"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\x0c\r"
#: A word of the corpus: whatever stands between blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A word of the benchmark comparison: digits, a-z and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of at most this many narrow rows may be broadcast, after counting it.
BROADCAST_ROWS = 1_000_000


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that the frame has no column for, whatever their case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return (F.when(F.char_length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def digest(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes: at 128 bits, no collision is to be expected."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *parts)]


def row_key(doc_id: Column, text: Column) -> Column:
    """What a result is joined back by: the id and a digest of the text.

    Rows that repeat an id with another text stay apart; rows equal in both get equal results.
    The struct itself is never null, so that a null id joins like any other.
    """
    first, second = digest(F.coalesce(text, F.lit("")), text.isNull())
    return F.struct(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"),
                    doc_id.isNull().alias("none"), first.alias("a"), second.alias("b"))


def held(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimiser cannot fold into what uses them.

    An array that a lambda looks into must be computed once for a row.  Written as plain
    projections, the optimiser may put its expression into the lambda.
    """
    made = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return frame.select("*", F.inline(made))


def small_side(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored, narrow table for broadcast if a count proves it small; else leave it."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame
