"""Rasters on other grids: reprojection and matching by the inverse map, and by nearest labels of irregular axes.

Every target cell asks where its centre lies in the source, so the target has no
gaps and no collisions whatever the resolutions. Which target cell takes which
source cell is one table of (row, col, source row, source col), made by columns
alone and joined to the rasters by the source cell: all rasters of one grid use
the same table, and no raster meets a cell that it doesn't hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid
from ..functions.projections import convert, converted
from ..sources.tables import cut
from .mapalgebra import cells

#: Points along each side of a grid's outline whose images bound the projected grid.
OUTLINE = 65
#: Labels of an axis that a row carries at most; a cell with a run of each axis makes at most their product of rows at once.
RUN = 64


def projected_grid(grid: Grid, crs: str, resolution: float) -> Grid:
    """The smallest grid of another system, with cells of `resolution` on whole multiples of it, that holds the projected outline of a grid."""
    high = abs(grid.resolution_y or grid.resolution)
    share = [i / (OUTLINE - 1) for i in range(OUTLINE)]
    w, h = grid.width * grid.resolution, grid.height * high
    outline = [(grid.x0 + s * w, grid.y0 - e * h) for s in share for e in (0, 1)] + [(grid.x0 + e * w, grid.y0 - s * h) for s in share for e in (0, 1)]
    found = [convert(x, y, grid.crs, crs) for x, y in outline]
    west, east = math.floor(min(x for x, _ in found) / resolution), math.ceil(max(x for x, _ in found) / resolution)
    south, north = math.floor(min(y for _, y in found) / resolution), math.ceil(max(y for _, y in found) / resolution)
    return Grid(north - south, east - west, resolution, west * resolution, north * resolution, crs=crs)


def _centres(spark: SparkSession, target: Grid, source: Grid) -> DataFrame:
    """(row, col, u, v): each target cell and where its centre lies in the source, in cells from the north-west corner."""
    x = F.lit(target.x0) + (F.col("col") + 0.5) * target.resolution
    y = F.lit(target.y0) - (F.col("row") + 0.5) * abs(target.resolution_y or target.resolution)
    at = converted(cells(spark, target).select("row", "col", x.alias("x"), y.alias("y")), target.crs, source.crs)
    u, v = (F.lit(source.y0) - F.col("y")) / abs(source.resolution_y or source.resolution), (F.col("x") - F.lit(source.x0)) / source.resolution
    return at.select("row", "col", u.alias("u"), v.alias("v"))


def _inside(c: Column, size: int) -> Column:
    return (c >= 0) & (c < size)


def matched(spark: SparkSession, target: Grid, source: Grid) -> DataFrame:
    """(row, col, srow, scol): the source cell that holds each target cell's centre; centres beyond the source are left out."""
    at = _centres(spark, target, source).select("row", "col", F.floor("u").cast("int").alias("srow"), F.floor("v").cast("int").alias("scol"))
    return at.where(_inside(F.col("srow"), source.height) & _inside(F.col("scol"), source.width))


def weights(spark: SparkSession, target: Grid, source: Grid) -> DataFrame:
    """(row, col, srow, scol, weight): the four source cells around each target centre with their bilinear weights; zero weights are left out."""
    at = _centres(spark, target, source).where(_inside(F.col("u"), source.height) & _inside(F.col("v"), source.width))
    at = at.select("row", "col", *[part for c, n in (("u", "r"), ("v", "c")) for part in (F.floor(F.col(c) - 0.5).alias(f"{n}0"), (F.col(c) - 0.5 - F.floor(F.col(c) - 0.5)).alias(f"{n}1"))])
    corner = lambda a, b: F.struct((F.col("r0") + a).cast("int").alias("srow"), (F.col("c0") + b).cast("int").alias("scol"), ((F.col("r1") if a else 1 - F.col("r1")) * (F.col("c1") if b else 1 - F.col("c1"))).alias("weight"))
    four = at.select("row", "col", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("k")).select("row", "col", "k.*")
    return four.where("weight > 0")


def regrid(df: DataFrame, source: Grid, target: Grid, keys: Sequence[str] = (), values: Sequence[str] = ("value",), method: str = "nearest") -> DataFrame:
    """(keys..., row, col, values...) of rasters of the source grid on the target grid, in whatever system each is.

    nearest: the source cell that holds the target cell's centre. bilinear: the
    weighted mean of the four cells around it, of those that have a value. Cells
    without a value in the source are no rows. The joins are merges: rows and
    arrays that are exploded into cells look small before, and neither side is.
    """
    spark = df.sparkSession
    held = df.select(*keys, F.col("row").alias("srow"), F.col("col").alias("scol"), *values)
    if method == "nearest":
        return held.join(matched(spark, target, source).hint("merge"), ["srow", "scol"]).select(*keys, "row", "col", *values)
    if method != "bilinear":
        raise ValueError(f"no resampling {method}")
    joined = held.join(weights(spark, target, source).hint("merge"), ["srow", "scol"])
    mean = [(F.sum(F.col(v) * F.col("weight")) / F.sum(F.when(F.col(v).isNotNull(), F.col("weight")))).alias(v) for v in values]
    return joined.groupBy(*keys, "row", "col").agg(*mean)


def _nearest(source: DataFrame, target: DataFrame) -> DataFrame:
    """(label, nearest, range, n): nearest_labels with the range of the axis that a label lies in and its number there."""
    both = source.select("label").distinct().withColumn("own", F.lit(True)).unionByName(target.select("label").distinct().withColumn("own", F.lit(False)))
    dealt = cut(both.repartitionByRange("label").withColumn("range", F.spark_partition_id()))
    own = F.when(F.col("own"), F.col("label"))
    last = lambda order: F.last(own, ignorenulls=True).over(Window.partitionBy("range").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    ends = dealt.groupBy("range").agg(F.min(own).alias("low"), F.max(own).alias("high"))  # one row a range
    before, after = (Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.col("range"), F.desc("range")))
    around = ends.select("range", F.last("high", ignorenulls=True).over(before).alias("before"), F.last("low", ignorenulls=True).over(after).alias("after"))
    n = F.row_number().over(Window.partitionBy("range").orderBy("label"))
    near = dealt.withColumn("below", last(F.col("label"))).withColumn("n", n).withColumn("above", last(F.desc("label"))).where(~F.col("own")).join(F.broadcast(around), "range")
    near = near.select("label", F.coalesce("below", "before").alias("below"), F.coalesce("above", "after").alias("above"), "range", "n").where(F.col("below").isNotNull() & F.col("above").isNotNull())
    nearest = F.when(F.col("label") - F.col("below") <= F.col("above") - F.col("label"), F.col("below")).otherwise(F.col("above"))
    return near.select("label", nearest.alias("nearest"), "range", "n")


def nearest_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """(label, nearest) of axes (label): each target label within the source's range with its nearest source label (of two equally near ones the smaller).

    The labels of both axes are dealt over tasks by ranges, into the shared
    folder. Within a range two windows, one up and one down, find the source
    labels around each label in one pass; beyond its ends a range sees the
    nearest source label of the ranges before and after, one row a range.
    """
    return _nearest(source, target).select("label", "nearest")


def match_labels(df: DataFrame, x: DataFrame, y: DataFrame, keys: Sequence[str] = (), values: Sequence[str] = ("value",), shown: Callable[[Column], Column] = lambda label: label) -> DataFrame:
    """(keys..., x, y, values...) of rasters (keys..., x, y, values...) at the nearest labels of other axes, tables x and y with a column label.

    As a lookup by nearest label has it: beyond the outermost labels there is
    nothing. Axes may be irregular. `shown` is what stands for a label in the
    result (never null); it is made once a label.

    The result has the product of both axes' labels, far more rows than any
    table before it. So a cell meets runs of labels, not labels; cells with their
    runs are dealt over all tasks, however few bytes they are, and only then
    become rows, which nothing shuffles or joins any more.
    """

    def runs(at: str) -> DataFrame:
        near = _nearest(df.select(F.col(at).alias("label")), {"x": x, "y": y}[at])
        grouped = near.groupBy("range", "nearest", F.floor(F.col("n") / RUN).alias("run")).agg(F.collect_list(shown(F.col("label"))).alias(f"t{at}"))
        return grouped.select(F.col("nearest").alias(at), f"t{at}").hint("merge")

    met = df.select(*keys, "x", "y", *values).join(runs("y"), "y").join(runs("x"), "x").select(*keys, "tx", "ty", *values)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(tasks, *keys, F.element_at("tx", 1), F.element_at("ty", 1))  # with a number, so that tasks aren't joined for their few bytes
    return dealt.select(*keys, "tx", F.explode("ty").alias("y"), *values).select(*keys, F.explode("tx").alias("x"), "y", *values)
