"""Stand-ins for rasters, traits and vector layers, built from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EUCLIDEAN, LEAST_COST

CELLS = 1024
SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _traits() -> list[Column]:
    """What a part has as a species, besides its name."""
    return [
        F.col("p_partkey").alias("species_id"),
        F.col("p_type").alias("grp"),
        F.when(F.col("p_size") <= 25, "aquatic").otherwise("terrestrial").alias("habitat"),
        (F.col("p_size").cast("double") / 100).alias("dispersal_km"),
    ]


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trait rows: (species_id, species, grp, habitat, dispersal_km)."""
    p = table(spark, sf_dir, "part").select("*", *_traits())
    return p.select("species_id", F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("species"), "grp", "habitat", "dispersal_km")


def group_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, distance) of the groups that occur."""
    kinds = F.when(F.col("grp").isin("ECONOMY", "PROMO"), EUCLIDEAN).otherwise(LEAST_COST)
    return species(spark, sf_dir).select("grp").distinct().withColumn("distance", kinds)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (species_id, row, col, pct): suitability in percent on the 32 x 32 frame."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") % CELLS).cast("int").alias("cell"), (F.col("l_quantity") * 2).alias("v"))
    pixels = items.groupBy(F.col("l_partkey").alias("species_id"), "cell").agg(F.avg("v").alias("pct"))
    return pixels.select("species_id", F.floor(F.col("cell") / SIDE).cast("int").alias("row"), (F.col("cell") % SIDE).cast("int").alias("col"), "pct")


def suitability_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of every group and habitat: (habitat, grp, species_id, row, col, value), as a fraction."""
    traits = species(spark, sf_dir).select("species_id", "habitat", "grp")
    return observations(spark, sf_dir).join(traits, "species_id").select("habitat", "grp", "species_id", "row", "col", (F.col("pct") / 100).alias("value"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense raster (row, col, value), 64 columns wide."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "e"))
    return e.select("row", "col", (F.col("e").cast("double") + 0.6).alias("value"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raster file for each species that has pixels."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("species_id")).distinct()
    named = species(spark, sf_dir).join(seen.hint("merge"), "species_id", "left_semi")
    return named.select(F.concat(F.lit("reg_"), F.replace("species", F.lit(" "), F.lit(".")), F.lit("_reg_covariate_ensemble.tif")).alias("file"))


def named_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trait rows in which names repeat with other groups, habitats and dispersal: parts of one name and brand."""
    p = table(spark, sf_dir, "part").select("*", *_traits())
    return p.select("species_id", F.concat_ws(" ", "p_name", "p_brand").alias("species"), "grp", "habitat", "dispersal_km")


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species_id, file): parts that reach 100 % somewhere have a raster file, so a name has none, one or several."""
    whole = observations(spark, sf_dir).where("pct >= 100").select("species_id").distinct()
    file = F.concat(F.lit("p"), F.col("species_id").cast("string"), F.lit("_"), F.replace("species", F.lit(" "), F.lit(".")), F.lit("_reg_covariate_ensemble.tif"))
    return named_species(spark, sf_dir).join(whole.hint("merge"), "species_id", "left_semi").select("species_id", file.alias("file"))


def file_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, row, col, pct) of all raster files."""
    return observations(spark, sf_dir).join(named_files(spark, sf_dir).hint("merge"), "species_id").select("file", "row", "col", "pct")


#: Vector layers of the frame (metres): closed rings, and lines.
POLYGONS = {
    "country": [[(60, 40), (740, 60), (770, 400), (700, 760), (120, 740), (30, 380)]],
    "lake": [[(150, 150), (300, 140), (310, 260), (170, 280)], [(480, 500), (620, 520), (600, 640), (500, 620)]],
}
LINES = {"river": [[(0, 700), (200, 520), (380, 430), (560, 300), (800, 120)]]}
POINTS = {"barrier": [(200, 520), (560, 300)], "hydropower": [(620, 180)]}
#: Attribute of each layer's features, in order.
CODES = {"country": ["CH"], "canton": ["A", "B"]}
CANTON_SPLIT = 400.0


def _part(ring: list[tuple[float, float]], x: float, west: bool) -> list[tuple[float, float]]:
    """What of a ring lies west or east of x."""
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[0] <= x) == west or a[0] == x:
            out.append(a)
        if (a[0] - x) * (b[0] - x) < 0:
            out.append((x, a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0])))
    return out


POLYGONS["canton"] = [_part(POLYGONS["country"][0], CANTON_SPLIT, west) for west in (True, False)]


def edge_rows() -> list[tuple[str, int, float, float, float, float]]:
    """(layer, geom_id, x1, y1, x2, y2) of all layers; a point is an edge of no length."""
    out = []
    for layer, rings in POLYGONS.items():
        for g, ring in enumerate(rings):
            out += [(layer, g, *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    for layer, lines in LINES.items():
        for g, line in enumerate(lines):
            out += [(layer, g, *map(float, a), *map(float, b)) for a, b in zip(line, line[1:], strict=False)]
    for layer, points in POINTS.items():
        out += [(layer, g, *map(float, p), *map(float, p)) for g, p in enumerate(points)]
    return out


def edges(spark: SparkSession, *layers: str) -> DataFrame:
    rows = [r for r in edge_rows() if r[0] in layers]
    return spark.createDataFrame(rows, "layer string, geom_id int, x1 double, y1 double, x2 double, y2 double")
