"""Connected components of a distributed list of links, by alternating stars.

A round sends every node's larger neighbours to its smallest one, then every node's smaller
neighbours to the smallest of them, until no link changes: then each component is a star
around its smallest node.  Each round is written to the shared folder, so that no round
depends on the executors that made an earlier one.  Links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.staging import snapshot


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = (both.groupBy("a").agg(F.min("b").alias("m"))
             .select("a", F.least("a", "m").alias("m")))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = (down.join(least, "a").where(F.col("b") != F.col("m"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): every linked node with the smallest node it can reach.

    ``links`` has columns a and b of one orderable type.  Loops and repeats do no harm.
    """
    stars = snapshot(links.where("a != b").select("a", "b").distinct(), "links")
    state = _state(stars)
    while state[0]:
        stars = snapshot(_small_star(_large_star(stars)), "stars")
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
