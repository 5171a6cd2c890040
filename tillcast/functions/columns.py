"""Scalar expressions: coercion, safe arithmetic, flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from tillcast.config import SIZE_BANDS


def equals_folded(column: str, text: str) -> Column:
    """Case-insensitive equality; NULL stays NULL and so never matches a filter."""
    return F.upper(F.col(column)) == F.lit(text)


def is_true(column: str) -> Column:
    """SQL ``IS TRUE``: NULL counts as false."""
    return F.coalesce(F.col(column), F.lit(False))


def as_double(column: str) -> Column:
    """To double; text that is no number becomes NULL instead of an error."""
    return F.col(column).try_cast("double")


def as_identifier(column: str) -> Column:
    return F.trim(F.col(column).cast("string"))


def as_date(column: str, dtype: T.DataType) -> Column:
    """To a date without a time; unreadable text becomes NULL."""
    if isinstance(dtype, T.StringType):
        return F.to_date(F.try_to_timestamp(F.col(column)))
    return F.to_date(F.col(column))


def text_flag(column: str) -> Column:
    """True for the texts true and 1 (any case), false for all else and NULL."""
    return F.coalesce(F.lower(F.col(column).cast("string")).isin("true", "1"), F.lit(False))


def or_unknown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("unknown"))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Zero unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """NULL unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def clip(column: Column, low, high) -> Column:
    return F.when(column < low, F.lit(low)).when(column > high, F.lit(high)).otherwise(column)


def log_gbp(column: Column) -> Column:
    """log1p of revenue, with NULL and negative revenue read as zero."""
    return F.log1p(F.greatest(F.coalesce(column, F.lit(0.0)), F.lit(0.0)))


def gbp_from_log(column: Column) -> Column:
    return F.greatest(F.expm1(column), F.lit(0.0))


def whole_number_text(column: str) -> Column:
    """5, never 5.0: one spelling per category, whatever the numeric type."""
    return F.col(column).cast("int").cast("string")


def snap_to_zero(column: Column, threshold: float = 0.01) -> Column:
    return F.when(column < threshold, F.lit(0.0)).otherwise(column)


def size_band(level: Column) -> Column:
    """Name of the decade a mean daily revenue falls in; NULL for none at all."""
    band = F.when(level <= 0, F.lit(None).cast("string"))
    for upper, name in SIZE_BANDS:
        band = band.when(level <= F.lit(float(upper)), F.lit(name))
    return band
