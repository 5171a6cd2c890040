"""Category codes, per-merchant scaling and identity masking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillcast.config import Config, MERCHANT, TIME
from tillcast.functions.joins import lookup_join
from tillcast.functions.staging import staging_folder
from tillcast.functions.stats import exact_percentiles


def category_codes(frame: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: distinct values in ascending order, numbered from 1; 0 is unknown.

    Distinct values are sorted across partitions and kept with ``checkpoint()``, so that
    the partition sizes and the positions inside the partitions belong to one and the same
    sort.  A partition's offset is the summed size of those before it.
    """
    staging_folder(frame.sparkSession)
    values = (frame.select(F.col(column).alias("value")).where("value IS NOT NULL")
              .distinct().orderBy("value")
              .withColumn("_id", F.monotonically_increasing_id()).checkpoint())
    # The id holds the partition number above bit 33 and the position below it.
    placed = values.select("value", F.shiftright("_id", 33).alias("_part"),
                           F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_position"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").select(
        "value", (F.col("_offset") + F.col("_position") + 1).alias("code"))


def encode(frame: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Add ``<column>_code``; NULL and unseen values get 0."""
    lookup = codes.select(F.col("value").alias(column), F.col("code").alias(f"{column}_code"))
    return (lookup_join(frame, lookup, column)
            .withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(0))))


def fit_normaliser(training: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per merchant: mean and floored sample spread of the log target."""
    spread = F.coalesce(F.stddev_samp(cfg.target), F.lit(0.0))
    return training.groupBy(MERCHANT).agg(
        F.avg(cfg.target).alias("center"),
        F.greatest(spread, F.lit(cfg.scale_floor)).alias("scale"))


def fallback_scale(normaliser: DataFrame) -> DataFrame:
    """One row: the medians over all merchants, for merchants the fit never saw."""
    center = exact_percentiles(normaliser, "center", [0.5]).select(F.col("percentiles")[0])
    scale = exact_percentiles(normaliser, "scale", [0.5]).select(F.col("percentiles")[0])
    return normaliser.sparkSession.range(1).select(
        center.scalar().alias("center"), scale.scalar().alias("scale"))


def scale_pairs(merchants: DataFrame, normaliser: DataFrame) -> DataFrame:
    """Each merchant with its own pair, or the fallback and ``cold_start`` set."""
    fallback = fallback_scale(normaliser)
    joined = merchants.select(MERCHANT).distinct().join(normaliser, MERCHANT, "left")
    return joined.select(
        MERCHANT, F.col("center").isNull().alias("cold_start"),
        F.coalesce("center", fallback.select("center").scalar()).alias("center"),
        F.coalesce("scale", fallback.select("scale").scalar()).alias("scale"))


def normalise(frame: DataFrame, normaliser: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``tpv_scaled`` = (target - center) / scale, cold merchants on the fallback."""
    pairs = scale_pairs(frame, normaliser)
    return frame.join(pairs, MERCHANT).withColumn(
        f"{cfg.target}_scaled", (F.col(cfg.target) - F.col("center")) / F.col("scale"))


def denormalised(scaled: Column) -> Column:
    """Back to log revenue, given ``center`` and ``scale`` on the row."""
    return scaled * F.col("scale") + F.col("center")


def mask_identity(origins: DataFrame, cfg: Config = Config(), code: str = "merchant_id_code"
                  ) -> DataFrame:
    """Set the identity code of a share of the windows to unknown, a whole window at a time.

    The draw is a digest of merchant, origin and seed: it repeats on retries and reruns, and
    other engines can draw the same.
    """
    digest = F.md5(F.concat_ws("|", MERCHANT, F.col("origin_time_idx").cast("string"),
                               F.lit(str(cfg.seed))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000
    masked = draw < int(cfg.group_id_dropout * 10_000)
    return origins.withColumn("masked", masked).withColumn(
        code, F.when(masked, F.lit(0)).otherwise(F.col(code)))


def require_aligned(origins: DataFrame, panel: DataFrame, normaliser: DataFrame, cutoff,
                    cfg: Config = Config()) -> None:
    """Fail if any window's pair is not that of its merchant's own training rows."""
    bad = scale_alignment(origins, panel, normaliser, cutoff, (), cfg=cfg).first()["mismatched"]
    if bad:
        raise ValueError(f"{bad} windows are scaled by a pair that is not their merchant's")


def scale_alignment(origins: DataFrame, panel: DataFrame, normaliser: DataFrame, cutoff,
                    parts: Iterable[str] = ("part",), tolerance: float = 1e-2,
                    cfg: Config = Config()) -> DataFrame:
    """Compare the pair each window would get with one recomputed from its own training rows.

    Windows checked, cold ones (no training rows) and mismatches, over all windows.
    """
    level = F.col(cfg.target)
    own = panel.where(F.col(TIME) <= cutoff).groupBy(MERCHANT).agg(
        (F.sum(level) / F.count(level)).alias("_center"),
        F.greatest(F.coalesce(F.sqrt(F.var_samp(level)), F.lit(0.0)),
                   F.lit(cfg.scale_floor)).alias("_scale"))
    off = ((F.abs(F.col("center") - F.col("_center")) > tolerance)
           | (F.abs(F.col("scale") - F.col("_scale")) > tolerance))
    paired = (origins.join(normaliser.select(MERCHANT, "center", "scale"), MERCHANT, "left")
              .join(own, MERCHANT, "left"))
    cold = F.col("center").isNull() | F.col("_center").isNull()
    return paired.groupBy(*parts).agg(
        F.count_if(~cold).alias("checked"),
        F.count_if(cold).alias("cold"),
        F.count_if(~cold & off).alias("mismatched"))
