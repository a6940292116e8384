"""Column expressions; all stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN is how rasters mark a missing value; inside the engine it is NULL."""
    return F.nullif(c, F.lit(float("nan")))


def nans_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: nan_to_null(F.col(c)) for c in columns})


def safe_add(a: Column, b: Column) -> Column:
    """Sum in which a missing value counts as nothing, unless both are missing."""
    return F.coalesce(a + b, a, b)


def skip_max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def quality_floor(c: Column, least: float) -> Column:
    """Missing and zero quality become a small positive one."""
    filled = F.coalesce(c, F.lit(0.0))
    return F.when(filled == 0, F.lit(least)).otherwise(filled)


def log_shift(c: Column, shift: float) -> Column:
    """ln(c + shift), NULL where that is not positive."""
    return F.when(c + F.lit(shift) > 0, F.log(c + F.lit(shift)))


def proximity(distance: Column, dispersal: Column, alpha: Column) -> Column:
    return F.exp(-distance * alpha / dispersal)


#: A kernel of one's own is any function of (distance, dispersal, alpha).
Kernel = Callable[[Column, Column, Column], Column]


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Rescaling to 0-1; NULL for a constant raster."""
    return F.try_divide(c - low, high - low)


def scaled_short(c: Column, scale: float) -> Column:
    """A value as a 16-bit multiple of `scale`."""
    return F.round(c / F.lit(scale)).cast("smallint")


#: Added before rounding, so that values half-way between two roundings go the same way in every engine.
NUDGE = 1e-09


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, 6)
