"""Exact statistics that never bring a whole column into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast.functions.staging import snapshot

#: Of the sketch: brackets reach two steps of it to either side of the rank.
ACCURACY = 10_000


def sample_skewness(column: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def exact_percentiles(frame: DataFrame, value: str, levels: Sequence[float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated percentiles per key, as ``(keys..., percentiles ARRAY<DOUBLE>)``.

    The built-in exact percentile gathers all distinct values of a key in one task.
    Here a mergeable sketch brackets each rank, a second pass counts what lies below and
    inside the brackets, and only values inside them are put in order: some 4 in
    ``ACCURACY`` of a key's rows, equal ones counted as one.  An end of a bracket that the
    counts prove wrong is left open, so the result never leans on the sketch.  Without keys
    the brackets are scalars; with keys they are joined.  Keys without a value give no row.
    Joined tables are stored first: by its true size a table of few keys is broadcast, where an
    exchange on the key would bring the column into as few tasks as there are keys.
    """
    keys = list(keys)
    values = frame.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    margin = 2 / ACCURACY
    ends = [end for p in levels for end in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_cuts"))
    cuts = [f"_cut{i}" for i in range(len(ends))]
    counts = _beside(values, sketch, keys).select(
        *keys, "_v", F.col("_m._n").alias("_n"),
        *[F.get("_m._cuts", F.lit(i)).alias(c) for i, c in enumerate(cuts)]
    ).groupBy(*keys, "_n", *cuts).agg(
        *[F.count_if(F.col("_v") < F.col(c)).alias(f"_below{c}") for c in cuts[::2]],
        *[F.count_if(F.col("_v") <= F.col(c)).alias(f"_upto{c}") for c in cuts[1::2]])
    wanted = []
    for i, p in enumerate(levels):
        position = (F.col("_n") - 1) * F.lit(float(p))
        first, last = F.floor(position), F.ceil(position)
        low, high = cuts[2 * i], cuts[2 * i + 1]
        begins = F.col(f"_below{low}") <= first
        wanted.append(F.struct(
            F.lit(i).alias("i"), (position - first).alias("weight"),
            first.alias("first"), last.alias("last"),
            F.when(begins, F.col(low)).alias("low"),
            F.when(last < F.col(f"_upto{high}"), F.col(high)).alias("high"),
            F.when(begins, F.col(f"_below{low}")).otherwise(F.lit(0)).alias("before")))
    brackets = counts.select(*keys, F.array(*wanted).alias("_wanted"))
    v = F.col("_v")
    inside = F.filter("_m._wanted", lambda w: F.coalesce(v >= w["low"], F.lit(True))
                      & F.coalesce(v <= w["high"], F.lit(True)))
    rank = ["i", "weight", "first", "last", "before"]
    counted = (_beside(values, brackets, keys).select(*keys, "_v", F.inline(inside))
               .groupBy(*keys, *rank, "_v").agg(F.count(F.lit(1)).alias("_size")))
    running = W.partitionBy(*keys, "i").orderBy("_v").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    placed = counted.withColumn("_end", F.col("before") + F.sum("_size").over(running))

    def at(place: str) -> Column:
        here = (F.col(place) >= F.col("_end") - F.col("_size")) & (F.col(place) < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    per_level = placed.groupBy(*keys, "i", "weight").agg(
        (at("first") + (at("last") - at("first")) * F.col("weight")).alias("_value"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "_value")))
    return (per_level.groupBy(*keys)
            .agg(F.transform(ordered, lambda s: s["_value"]).alias("percentiles"))
            .where(F.size("percentiles") > 0))


def _beside(frame: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its key's row of a table as ``_m``; the only row is a scalar."""
    packed = table.select(*keys, F.struct(*[c for c in table.columns if c not in keys]).alias("_m"))
    if not keys:
        return frame.withColumn("_m", packed.scalar())
    return frame.join(snapshot(packed, "brackets"), keys)
