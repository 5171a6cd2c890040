"""Joins to lookup tables of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# At some 100 bytes a row this is 50 MB on each executor.
MAX_BROADCAST_ROWS = 500_000


def lookup_join(frame: DataFrame, lookup: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join a lookup: broadcast if a count shows it small, else as an ordinary join.

    Few lookup rows mean few keys, and so hot ones; a broadcast leaves those rows where
    they are.  A large lookup has many keys, and adaptive execution splits any hot one.
    The count reads the lookup alone and stops at the bound.
    """
    small = lookup.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return frame.join(F.broadcast(lookup) if small else lookup, on, how)
