"""Raster and table sinks and sources: Parquet (zstd) partitioned by band or key, plain-text grids, CSV reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nans_to_null
from ..operators.mapalgebra import narrowed, pivot_bands, unpivot_bands

TRAITS = T.StructType([
    T.StructField("species_id", T.LongType()), T.StructField("species", T.StringType()), T.StructField("Dispersal_km", T.DoubleType()),
    T.StructField("CH3Div.group", T.StringType()), T.StructField("CH3Div.scheme", T.StringType()),
])
RASTER = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())])


def read_traits(spark: SparkSession, path: str, schema: T.StructType = TRAITS) -> DataFrame:
    """The trait file, by a declared schema, with the engine's column names."""
    t = spark.read.csv(path, header=True, schema=schema)
    return t.select("species_id", "species", F.col("Dispersal_km").alias("dispersal_km"), F.col("`CH3Div.group`").alias("grp"), F.col("`CH3Div.scheme`").alias("habitat"))


def write_bands(df: DataFrame, path: str, bands: Sequence[str]) -> None:
    unpivot_bands(df, bands).write.partitionBy("band").option("compression", "zstd").mode("overwrite").parquet(path)


def read_bands(spark: SparkSession, path: str, bands: Sequence[str]) -> DataFrame:
    return nans_to_null(pivot_bands(spark.read.parquet(path), bands), *bands)


def write_elasticity(df: DataFrame, path: str, run_id: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id", "habitat", "grp", "sens").option("compression", "zstd").mode("overwrite").parquet(path)


def read_elasticity(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_scores(df: DataFrame, path: str, run_id: str, how: str) -> None:
    """Scores (habitat, row, col, value), the combined one included, as 32-bit floats."""
    out = narrowed(df, "value").withColumns({"run_id": F.lit(run_id), "how": F.lit(how)})
    out.write.partitionBy("run_id", "how", "habitat").option("compression", "zstd").mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str, run_id: str, how: str) -> DataFrame:
    found = spark.read.parquet(path).where((F.col("run_id") == run_id) & (F.col("how") == how))
    return nans_to_null(found.select("habitat", "row", "col", F.col("value").cast("double").alias("value")), "value")


def read_grids(spark: SparkSession, path: str, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(file, row, col, value) of plain-text grid files (.asc): six header lines (ncols, nrows, xllcorner, yllcorner, cellsize, NODATA_value), then rows.

    A file is one raster and is read by one task. Values are value * scale +
    offset; nodata and what is no number are missing. Cell sizes and corners
    are columns, so that grids can be checked and snapped.
    """
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")
    head = lambda i: F.element_at(F.split(F.trim(lines[i]), r"\s+"), 2).cast("double")
    names = {"ncols": 0, "nrows": 1, "xll": 2, "yll": 3, "cellsize": 4, "nodata": 5}
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), lines.alias("lines"), *[head(i).alias(n) for n, i in names.items()])
    rows = files.select("file", "xll", "yll", "cellsize", "nodata", F.posexplode(F.expr("slice(lines, 7, greatest(size(lines) - 6, 0))")).alias("row", "line"))
    cells = rows.select("file", "xll", "yll", "cellsize", "nodata", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "text"))
    raw = F.expr("try_cast(text as double)")
    value = F.when(raw.isNotNull() & ~F.isnan(raw) & (raw != F.col("nodata")), raw * scale + offset)
    return cells.select("file", "row", "col", value.alias("value"), "xll", "yll", "cellsize")
