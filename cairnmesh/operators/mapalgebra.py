"""Map algebra on long rasters (keys..., row, col, value); NULL is a missing value."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid
from ..functions.columns import min_max, scaled_short


def scale_percent(df: DataFrame, keys: Sequence[str], value: str = "pct", strict: bool = True) -> DataFrame:
    """Percent to fraction, each raster by its own range. A raster outside percents stops the run; if not strict, all its values are missing."""
    span = df.groupBy(*keys).agg(F.max(value).alias("__high"), F.min(value).alias("__low"))
    ok = (F.col("__high") > 1) & (F.col("__low") < 100)
    wrong = F.raise_error(F.lit("raster values are not percents")).cast("double") if strict else F.lit(None).cast("double")
    scaled = F.when(ok, F.col(value) / 100).otherwise(wrong)
    return df.join(span, list(keys)).withColumn("value", scaled).drop("__high", "__low")


def cell_stats(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation and count of each cell over the rasters: one partial and one final aggregate."""
    return pixels.groupBy(*keys, "row", "col").agg(F.avg("value").alias("mean_suitability"), F.stddev_pop("value").alias("std_suitability"), F.count("value").alias("valid_count"))


def cell_state(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., row, col, n, mean, m2) of each cell: how many values, their mean and the sum of squares around it. States of disjoint pixels merge."""
    value = F.col("value")
    return pixels.groupBy(*keys, "row", "col").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged_states(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state of both states' pixels together: new rasters are folded into a kept state without reading the others again.

    One join by cell; squares around two means add up around the common one, so
    nothing cancels however small the deviations are.
    """
    at = [*keys, "row", "col"]
    left, right = (df.select(*at, F.struct("n", "mean", "m2").alias(name)) for df, name in ((a, "__a"), (b, "__b")))
    get = lambda name, field, plain: F.coalesce(F.col(f"{name}.{field}"), F.lit(plain))
    na, nb, ma, mb = get("__a", "n", 0), get("__b", "n", 0), get("__a", "mean", 0.0), get("__b", "mean", 0.0)
    n, apart = na + nb, mb - ma
    both = left.join(right, at, "full")
    mean = F.when(n > 0, ma + apart * F.try_divide(nb, n))
    m2 = F.when(n > 0, get("__a", "m2", 0.0) + get("__b", "m2", 0.0) + apart * apart * F.try_divide(na * nb, n))
    return both.select(*at, n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def state_stats(state: DataFrame) -> DataFrame:
    """What `cell_stats` of all the state's pixels gives."""
    rest = [c for c in state.columns if c not in ("n", "mean", "m2")]
    return state.select(*rest, F.col("mean").alias("mean_suitability"), F.sqrt(F.try_divide("m2", "n")).alias("std_suitability"), F.col("n").alias("valid_count"))


def coarsen(df: DataFrame, factor: int, height: int, width: int, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Block mean; rows and columns that don't fill a block are trimmed."""
    kept = df.where((F.col("row") < height - height % factor) & (F.col("col") < width - width % factor))
    return kept.groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg(value).alias(value))


def extents(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., top, left, height, width) of the smallest rectangle around each raster's cells."""
    span = df.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("low", F.min), ("high", F.max))])
    size = lambda c: (F.col(f"high_{c}") - F.col(f"low_{c}") + 1).alias({"row": "height", "col": "width"}[c])
    return span.select(*keys, F.col("low_row").alias("top"), F.col("low_col").alias("left"), size("row"), size("col"))


def frames(rectangles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., row, col) of every cell of rectangles (keys..., top, left, height, width), dealt over tasks by row."""
    span = lambda at, size: F.explode(F.sequence(F.col(at).cast("int"), (F.col(at) + F.col(size) - 1).cast("int")))
    rows = rectangles.select(*keys, "left", "width", span("top", "height").alias("row")).repartition(*keys, "row")
    return rows.select(*keys, "row", span("left", "width").alias("col"))


def coarsen_by(df: DataFrame, factor: str, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Block mean of rasters with each one's own factor and rectangle (columns factor, top, left, height, width); blocks begin at the rectangle's corner."""
    f = F.col(factor)
    r, c = F.col("row") - F.col("top"), F.col("col") - F.col("left")
    kept = df.where((r < F.col("height") - F.col("height") % f) & (c < F.col("width") - F.col("width") % f))
    return kept.groupBy(*keys, F.floor(r / f).cast("int").alias("row"), F.floor(c / f).cast("int").alias("col")).agg(F.avg(value).alias(value))


def upscale(df: DataFrame, resolution: float, grid: Grid, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Block mean to cells of at least `resolution`; the grid's cells must be square."""
    return coarsen(df, math.ceil(resolution / grid.square()), grid.height, grid.width, keys, value)


def resolution(coords: DataFrame, axis: str) -> DataFrame:
    """Mean distance between neighbouring coordinates of an axis; the window sees distinct coordinates only."""
    w = Window.orderBy(axis)
    steps = coords.select(axis).distinct().select((F.col(axis) - F.lag(axis).over(w)).alias("step"))
    return steps.agg(F.abs(F.avg("step")).alias("resolution"))


def with_xy(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumn("x", F.lit(grid.x0) + (F.col("col") + 0.5) * grid.resolution).withColumn("y", F.lit(grid.y0) - (F.col("row") + 0.5) * grid.resolution)


def align(points: DataFrame, grid: Grid) -> DataFrame:
    """Snap (x, y) to the grid's rows and columns; points beyond it go."""
    out = points.withColumn("row", F.floor((F.lit(grid.y0) - F.col("y")) / grid.resolution).cast("int")).withColumn("col", F.floor((F.col("x") - F.lit(grid.x0)) / grid.resolution).cast("int"))
    return out.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))


def cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every (row, col) of a grid, dealt over tasks by row."""
    rows = spark.range(grid.height).select(F.col("id").cast("int").alias("row"))
    return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("col"))


def pad(spark: SparkSession, df: DataFrame, grid: Grid, margin: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Each raster on the dense grid with `margin` more cells on each side; missing cells are NULL."""
    bigger = Grid(grid.height + 2 * margin, grid.width + 2 * margin, grid.resolution)
    frame = cells(spark, bigger).select((F.col("row") - margin).cast("int").alias("row"), (F.col("col") - margin).cast("int").alias("col"))
    if keys:  # every raster on the whole grid, a product by definition
        frame = df.select(*keys).distinct().crossJoin(frame)
    return frame.join(df, [*keys, "row", "col"], "left")


def rescale(df: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Each raster to 0-1. The ranges are one row a raster and meet the pixels by join, so no window gathers a raster."""
    span = df.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    joined = df.join(span, list(keys)) if keys else df.crossJoin(F.broadcast(span))  # one row
    return joined.withColumn(value, min_max(F.col(value), F.col("__low"), F.col("__high"))).drop("__low", "__high")


def combine(df: DataFrame, how: str, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Cellwise combination of all rasters of a key: "max", or "mean" (which is a sum that skips missing values)."""
    agg = {"max": F.max, "mean": F.sum}[how](value)
    return df.groupBy(*keys, "row", "col").agg(agg.alias(value))


def unpivot_bands(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.unpivot([*keys, "row", "col"], list(bands), "band", "value")


def pivot_bands(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "row", "col").pivot("band", list(bands)).agg(F.first("value"))


def pack_int16(df: DataFrame, scale: float, value: str = "value") -> DataFrame:
    """16-bit codes and what they decode to."""
    return df.withColumn("packed", scaled_short(F.col(value), scale)).withColumn("decoded", F.col("packed") * F.lit(scale))


def downscale(coarse: DataFrame, fine: DataFrame, factor: int, strict: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Each fine cell takes the value of its coarse block; beyond the last block NULL.

    strict=(height, width) of the coarse grid: cells outside the range of block
    centres are NULL too, as a lookup without extrapolation has it.
    """
    at = fine.withColumn("__r", F.floor(F.col("row") / factor).cast("int")).withColumn("__c", F.floor(F.col("col") / factor).cast("int"))
    right = coarse.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    out = at.join(right, [*keys, "__r", "__c"], "left").drop("__r", "__c")
    if strict:
        half = (factor - 1) / 2
        inside = F.col("row").between(half, strict[0] * factor - 1 - half) & F.col("col").between(half, strict[1] * factor - 1 - half)
        out = out.withColumn("value", F.when(inside, F.col("value")))
    return out


def _envelope(cols: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (into cols) of the parabolas (x - col)**2 + down that are lowest somewhere, and where each begins to be; one pass from left to right."""
    held: list[int] = []
    begin: list[float] = []
    base = down + cols * cols
    for i in range(len(cols)):
        x = -np.inf
        while held:
            x = (base[i] - base[held[-1]]) / (2 * (cols[i] - cols[held[-1]]))
            if x >= begin[-1]:
                break
            held.pop()
            begin.pop()
        held.append(i)
        begin.append(x if len(held) > 1 else -np.inf)
    return np.array(held), np.array(begin)


def _fill_row(keys: list[str], values: list[str]):
    """One row of a raster whose cells know the nearest value in their column: the nearest of all columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        out = pdf[[*keys, "row", "col", *values]].copy()
        have = np.flatnonzero(pdf["__at"].notna().to_numpy())
        holes = np.flatnonzero(pdf[values[0]].isna().to_numpy() & (pdf["__only"].to_numpy(bool) if "__only" in pdf else True))
        if not len(have) or not len(holes):
            return out
        col, at = pdf["col"].to_numpy(float), pdf["__at"].to_numpy()
        low, begin = _envelope(col[have], (at[have] - float(pdf["row"].iloc[0])) ** 2)
        low = have[low]
        last = np.searchsorted(begin, col[holes], "right") - 1
        first = np.maximum(np.searchsorted(begin, col[holes], "left") - 1, 0)
        best = low[last]
        for i in np.flatnonzero(first < last):  # equal distances: the smallest row, then column
            best[i] = min(low[first[i] : last[i] + 1], key=lambda k: (at[k], col[k]))
        for n, v in enumerate(values):
            new = out[v].to_numpy(float, copy=True)
            new[holes] = pdf[f"__v{n}"].to_numpy()[best]
            out[v] = new
        return out

    return run


def fill_nearest(df: DataFrame, keys: Sequence[str] = (), values: str | Sequence[str] = "value", only: Column | None = None) -> DataFrame:
    """Missing cells take the value of the nearest cell that has one (ties: smallest row, then column).

    Several bands with the same holes (those of the first) are filled at once;
    where `only` is given, no other cells than those for which it holds.
    The distance transform in its two passes: down the columns every cell finds
    the nearest value above and below (two windows), then each row takes, for
    its missing cells, the lowest of the columns' parabolas, in one pass along
    the row. Two shuffles and work in proportion to the cells, whatever the size
    of the holes. A raster without any value stays missing.
    """
    values = [values] if isinstance(values, str) else list(values)
    known = F.when(F.col(values[0]).isNotNull(), F.struct(F.col("row").alias("at"), *[F.col(v).alias(f"v{n}") for n, v in enumerate(values)]))
    column = Window.partitionBy(*keys, "col")
    above = F.last(known, ignorenulls=True).over(column.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    below = F.last(known, ignorenulls=True).over(column.orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0))
    some = [] if only is None else [F.coalesce(only, F.lit(False)).alias("__only")]
    found = df.select(*keys, "row", "col", *values, *some).withColumn("__a", above).withColumn("__b", below)
    up = F.col("__b").isNull() | (F.col("row") - F.col("__a.at") <= F.col("__b.at") - F.col("row"))
    best = F.when(F.col("__a").isNotNull() & up, F.col("__a")).otherwise(F.col("__b"))
    found = found.select(*keys, "row", "col", *values, *(["__only"] if some else []), best["at"].cast("double").alias("__at"), *[best[f"v{n}"].alias(f"__v{n}") for n in range(len(values))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, "row", "col", *values).schema.fields)
    return found.groupBy(*keys, "row").applyInPandas(_fill_row(list(keys), values), schema)


def fill_in_mask(df: DataFrame, filled: DataFrame, mask: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Own value where there is one, else the filled one where the mask has the cell; cells outside the mask keep their own."""
    inside = filled.join(mask.select("row", "col"), ["row", "col"], "left_semi").select(*keys, "row", "col", F.col(value).alias("__filled"))
    return df.join(inside, [*keys, "row", "col"], "left").withColumn(value, F.coalesce(value, "__filled")).drop("__filled")


def elementwise(rasters: Sequence[DataFrame], f: Callable[..., Column], keys: Sequence[str] = (), how: str = "inner", value: str = "value") -> DataFrame:
    """f of the values that aligned rasters (keys..., row, col, value) have at each cell; f maps columns to a column."""
    out = rasters[0].select(*keys, "row", "col", F.col(value).alias("__0"))
    for n, r in enumerate(rasters[1:], 1):
        out = out.join(r.select(*keys, "row", "col", F.col(value).alias(f"__{n}")), [*keys, "row", "col"], how)
    return out.select(*keys, "row", "col", f(*[F.col(f"__{n}") for n in range(len(rasters))]).alias(value))


def single_band(df: DataFrame) -> DataFrame:
    """A raster of one band without its band column; one of several bands stays as it is."""
    if "band" not in df.columns or df.select("band").distinct().limit(2).count() > 1:
        return df
    return df.drop("band")


def narrowed(df: DataFrame, *values: str) -> DataFrame:
    """Values as 32-bit floats, for sinks."""
    return df.withColumns({v: F.col(v).cast("float") for v in values})
