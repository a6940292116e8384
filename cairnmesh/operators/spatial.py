"""Vector layers on the grid: fills, touches, buffers and masks as sets of cells.

Layers are edge tables (layer, geom_id, x1, y1, x2, y2). An edge makes rows only
for the grid rows or cells near it, so nothing is joined to the whole grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid


def total_bounds(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min(F.least("x1", "x2")).alias("minx"), F.min(F.least("y1", "y2")).alias("miny"), F.max(F.greatest("x1", "x2")).alias("maxx"), F.max(F.greatest("y1", "y2")).alias("maxy"))


def _row_of(y: Column, grid: Grid) -> Column:
    return (F.lit(grid.y0) - y) / grid.resolution


def _col_of(x: Column, grid: Grid) -> Column:
    return (x - F.lit(grid.x0)) / grid.resolution


def _span(low: Column, high: Column, most: int) -> Column:
    """Every whole number from low to high within 0 to most - 1; none where they don't meet."""
    a, b = F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.floor(high), F.lit(most - 1)).cast("int")
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def fill(edges: DataFrame, grid: Grid) -> DataFrame:
    """Cells (layer, row, col) whose centre lies in a polygon: scan lines through the centres of rows.

    An edge crosses a row's line if exactly one of its ends is at or below it,
    so a shared corner counts once. Crossings are paired from west to east
    within a polygon, and each pair becomes the columns between.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("*", F.explode(_span(_row_of(high, grid) - 1, _row_of(low, grid) + 1, grid.height)).alias("row"))
    rows = rows.withColumn("py", F.lit(grid.y0) - (F.col("row") + 0.5) * grid.resolution).where((F.col("y1") <= F.col("py")) != (F.col("y2") <= F.col("py")))
    crossed = rows.select("layer", "geom_id", "row", (F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    w = Window.partitionBy("layer", "geom_id", "row").orderBy("x")
    pairs = crossed.withColumn("nth", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).where("nth % 2 = 1")
    # centre px with x <= px < to
    first, last = F.ceil(_col_of(F.col("x"), grid) - 0.5), F.ceil(_col_of(F.col("to"), grid) - 0.5) - 1
    return pairs.select("layer", "row", F.explode(_span(first, last, grid.width)).alias("col")).distinct()


def _near(edges: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """Edges with each cell (row, col) of their box, `margin` metres wider, and the centre (px, py)."""
    m = margin / grid.resolution
    rows = edges.select("*", F.explode(_span(_row_of(F.greatest("y1", "y2"), grid) - m - 1, _row_of(F.least("y1", "y2"), grid) + m + 1, grid.height)).alias("row"))
    both = rows.select("*", F.explode(_span(_col_of(F.least("x1", "x2"), grid) - m - 1, _col_of(F.greatest("x1", "x2"), grid) + m + 1, grid.width)).alias("col"))
    return both.withColumn("px", F.lit(grid.x0) + (F.col("col") + 0.5) * grid.resolution).withColumn("py", F.lit(grid.y0) - (F.col("row") + 0.5) * grid.resolution)


def touched(edges: DataFrame, grid: Grid) -> DataFrame:
    """Cells (layer, row, col) whose closed square an edge meets: the edge is clipped to the square side by side."""
    half = grid.resolution / 2
    low, high = F.lit(0.0), F.lit(1.0)
    hit = F.lit(True)
    for p, q, centre in (("x1", "x2", "px"), ("y1", "y2", "py")):
        step = F.col(q) - F.col(p)
        a, b = (F.col(centre) - half - F.col(p)), (F.col(centre) + half - F.col(p))
        flat = step == 0
        enter = F.when(~flat, F.least(a / F.when(~flat, step), b / F.when(~flat, step)))
        leave = F.when(~flat, F.greatest(a / F.when(~flat, step), b / F.when(~flat, step)))
        low, high = F.greatest(low, enter), F.least(high, leave)
        hit = hit & (~flat | ((a <= 0) & (b >= 0)))
    return _near(edges, grid, 0).where(hit & (low <= high)).select("layer", "row", "col").distinct()


def buffered(edges: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Cells (layer, row, col) whose centre lies within `radius` of an edge."""
    return _near(edges, grid, radius).where(_to_edge(F.col("px"), F.col("py")) <= radius * radius).select("layer", "row", "col").distinct()


def _to_edge(x: Column, y: Column) -> Column:
    """Squared distance of a point to the row's edge."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.when(size > 0, size)))).otherwise(0.0)
    return F.pow(x - F.col("x1") - t * dx, F.lit(2)) + F.pow(y - F.col("y1") - t * dy, F.lit(2))


def distances(edges: DataFrame, grid: Grid, most: float) -> DataFrame:
    """(row, col, d2): squared distance between a closed cell and the polygons, 0 inside and where an edge touches, for cells within `most` metres.

    A cell of a polygon's buffer of r metres, all touched cells included, is one
    with d2 <= r * r. Cells beyond the grid are found too. The distance of an
    edge and a square that don't meet is that of an end of one and the other.
    """
    margin = math.ceil(most / grid.resolution) + 1
    big = Grid(grid.height + 2 * margin, grid.width + 2 * margin, grid.resolution, grid.x0 - margin * grid.resolution, grid.y0 + margin * grid.resolution)
    half = grid.resolution / 2
    beyond = lambda c, at: F.greatest(F.abs(F.col(c) - F.col(at)) - half, F.lit(0.0))
    ends = [F.pow(beyond(f"x{i}", "px"), F.lit(2)) + F.pow(beyond(f"y{i}", "py"), F.lit(2)) for i in (1, 2)]
    corners = [_to_edge(F.col("px") + a * half, F.col("py") + b * half) for a in (-1, 1) for b in (-1, 1)]
    near = _near(edges, big, most).select("row", "col", F.least(*ends, *corners).alias("d2")).where(F.col("d2") <= most * most)
    zero = fill(edges, big).unionByName(touched(edges, big)).select("row", "col", F.lit(0.0).alias("d2"))
    found = near.unionByName(zero).groupBy("row", "col").agg(F.min("d2").alias("d2"))
    return found.select((F.col("row") - margin).cast("int").alias("row"), (F.col("col") - margin).cast("int").alias("col"), "d2")


def cells_of(df: DataFrame) -> DataFrame:
    return df.select("row", "col").distinct()


def polygon_all_touched(edges: DataFrame, grid: Grid) -> DataFrame:
    return cells_of(fill(edges, grid).unionByName(touched(edges, grid)))


def polygon_buffer(edges: DataFrame, grid: Grid, radius: float) -> DataFrame:
    return cells_of(fill(edges, grid).unionByName(buffered(edges, grid, radius)))


def aquatic_mask(lakes: DataFrame, rivers: DataFrame, grid: Grid) -> DataFrame:
    """Lakes and rivers together; every touched cell counts."""
    return cells_of(polygon_all_touched(lakes, grid).unionByName(touched(rivers, grid).select("row", "col")))


def terrestrial_mask(lakes: DataFrame, grid: Grid) -> DataFrame:
    """The lakes' bounding box without lake cells (by their centres); rivers stay."""
    box = total_bounds(lakes)
    rows = box.select("*", F.explode(_span(_row_of(F.col("maxy"), grid) - 1, _row_of(F.col("miny"), grid) + 1, grid.height)).alias("row"))
    inside = rows.select("*", F.explode(_span(_col_of(F.col("minx"), grid) - 1, _col_of(F.col("maxx"), grid) + 1, grid.width)).alias("col"))
    px, py = F.lit(grid.x0) + (F.col("col") + 0.5) * grid.resolution, F.lit(grid.y0) - (F.col("row") + 0.5) * grid.resolution
    inside = inside.where(px.between(F.col("minx"), F.col("maxx")) & py.between(F.col("miny"), F.col("maxy")))
    return inside.select("row", "col").join(fill(lakes, grid).select("row", "col"), ["row", "col"], "left_anti")


def clip(df: DataFrame, cells: DataFrame) -> DataFrame:
    return df.join(cells.select("row", "col"), ["row", "col"], "left_semi")


class Masks:
    """Registered masks by habitat; a written mask is read back instead of built again."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.makers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, make: Callable[[SparkSession], DataFrame]) -> None:
        self.makers[name] = make

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.makers:
            raise KeyError(f"no mask {name}")
        if not self.folder:
            return self.makers[name](self.spark)
        path = f"{self.folder}/mask={name}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            self.makers[name](self.spark).write.parquet(path)
        return self.spark.read.parquet(path)
