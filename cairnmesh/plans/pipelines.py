"""Composite plans: group suitability, elasticity, importance scores, the metadata report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EUCLIDEAN, FRAME, HABITATS, Config, Grid
from ..functions.columns import log_shift, quality_floor
from ..operators import connectivity, mapalgebra, regrid, spatial, traits
from ..sources import rasters, tiles
from ..sources.tables import cut

KEYS = ("habitat", "grp")


def require_species(species: DataFrame, available: DataFrame, groups: Sequence[str]) -> None:
    """Raises where a group has no species, or none of its species has a raster. Both tables have a column grp."""
    named = {r[0] for r in species.where(F.col("grp").isin(*groups)).select("grp").distinct().collect()}  # one row a group
    found = {r[0] for r in available.where(F.col("grp").isin(*groups)).select("grp").distinct().collect()}
    for g in groups:
        if g not in named:
            raise LookupError(f"no species in group {g}")
        if g not in found:
            raise LookupError(f"no rasters of group {g}")


def available_species(species: DataFrame, files: DataFrame) -> DataFrame:
    """(habitat, grp, species, dispersal_km, file) of each group's species that have exactly one file; habitat and dispersal are those of the species' first row."""
    first = traits.first_rows(species).select("species", "habitat", "dispersal_km").where(F.col("habitat").isin(*HABITATS))
    named = species.select("grp", "species").distinct().join(first, "species")
    matched = traits.match_files(first.select(F.col("species").alias("species_id"), "species"), files)
    return named.join(traits.available(matched).select("species", "file"), "species").select(*KEYS, "species", "dispersal_km", "file")


def suitability_metadata(available: DataFrame) -> DataFrame:
    """(habitat, grp, d_m, d_m_std, n_species, species) of the species that go into each raster."""
    return traits.dispersal_stats(available).join(traits.species_list(available), list(KEYS)).select(*KEYS, "d_m", "d_m_std", "n_species", "species")


def guarded_cells(pixels: DataFrame, available: DataFrame) -> DataFrame:
    """Mean, deviation and count of each group's cells from percents (file, row, col, pct), written to the shared folder.

    The available rasters' pixels are computed once, into the shared folder. Each
    raster's range is one row of an aggregate over them: an available raster that
    has no value above 1 or none below 100, or no pixel, stops the job by name
    before anything is made of the cells. At most ten names come to the driver,
    and without any available raster there are no cells.
    """
    used = cut(pixels.join(available.select(*KEYS, "file"), "file"))
    fine = used.groupBy("file").agg(F.max("pct").alias("high"), F.min("pct").alias("low")).where("high > 1 and low < 100")
    wrong = available.select("file").distinct().join(fine, "file", "left_anti").orderBy("file").limit(10).collect()
    if wrong:
        raise ValueError(f"raster values are not percents: {', '.join(r[0] for r in wrong)}")
    return cut(mapalgebra.cell_stats(used.withColumn("value", F.col("pct") / 100), KEYS))


def group_suitability(cells: DataFrame, stats: DataFrame, masks: DataFrame, border: DataFrame | None = None, grid: Grid = FRAME, config: Config = DEFAULT) -> DataFrame:
    """(habitat, grp, row, col, mean_suitability, std_suitability) of every group and habitat of stats, from their cells' mean and deviation.

    Rasters are padded to the border's bounds and `reach` dispersal distances
    more, holes inside the habitat's mask (habitat, row, col) are filled from
    the nearest cell, and cells that the border widened by that distance doesn't
    touch go. stats has a row with d_m for each raster; without a border rasters
    stay on the grid. All groups go through one plan; nothing loops over them.
    Only the rectangle of grid and cells is filled: the padding has no holes that
    a mask names.
    """
    bands = ["mean_suitability", "std_suitability"]
    known = stats.select(*KEYS, (F.col("d_m") * config.reach).alias("reach"))
    own = F.broadcast(mapalgebra.extents(cells, KEYS))  # one row a raster
    low, high = lambda c: F.least(F.lit(0), c), lambda c, size: F.greatest(F.lit(size), c)
    held = known.join(own, list(KEYS)).select(
        *KEYS, low(F.col("top")).alias("top"), low(F.col("left")).alias("left"),
        (high(F.col("top") + F.col("height"), grid.height) - low(F.col("top"))).alias("height"), (high(F.col("left") + F.col("width"), grid.width) - low(F.col("left"))).alias("width"),
    )
    inside = masks.select("habitat", "row", "col").distinct().withColumn("inside", F.lit(True))
    full = mapalgebra.frames(held, KEYS).join(cells.select(*KEYS, "row", "col", *bands), [*KEYS, "row", "col"], "left").join(inside, ["habitat", "row", "col"], "left")
    filled = mapalgebra.fill_nearest(full, KEYS, bands, F.col("inside"))
    if border is None:
        return filled
    most = known.agg(F.max("reach")).first()[0] or 0.0  # of the statistics, not of the pixels
    at = lambda origin, edge: (F.lit(origin) - F.col(edge)) if edge.endswith("y") else (F.col(edge) - F.lit(origin))
    boxed = known.crossJoin(F.broadcast(spatial.total_bounds(border)))  # one row
    side = lambda low, high, size: (
        F.least(F.lit(0), F.floor((low - F.col("reach")) / grid.resolution)).cast("int"), F.greatest(F.lit(size), F.ceil((high + F.col("reach")) / grid.resolution)).cast("int")
    )
    top, bottom = side(at(grid.y0, "maxy"), at(grid.y0, "miny"), grid.height)
    left, right = side(at(grid.x0, "minx"), at(grid.x0, "maxx"), grid.width)
    rectangles = boxed.select(*KEYS, "reach", top.alias("top"), left.alias("left"), (bottom - top).alias("height"), (right - left).alias("width"))
    padded = mapalgebra.frames(rectangles, KEYS).join(spatial.distances(border, grid, most), ["row", "col"]).join(F.broadcast(known), list(KEYS))  # one row a raster
    return padded.where("d2 <= reach * reach").select(*KEYS, "row", "col").join(filled, [*KEYS, "row", "col"], "left")


def suitability_job(species: DataFrame, files: DataFrame, pixels: DataFrame, masks: DataFrame, border: DataFrame | None = None, grid: Grid = FRAME, config: Config = DEFAULT, jobs: Sequence[tuple[str, str]] | None = None, tags: DataFrame | None = None, source: Grid | None = None) -> tuple[DataFrame, DataFrame]:
    """(suitability, metadata) from traits, file names and percents (file, row, col, pct).

    Pixels of another grid, `source`, are reprojected or matched to the grid's
    cells first, all rasters by one table.

    A species counts if exactly one file bears its name, in the habitat and with
    the dispersal of its first row; dispersal statistics are of these species.
    Guards raise by name before any result is there: `jobs` (habitat, group)
    without species or rasters, rasters that aren't percents or have no values,
    and rasters whose `tags` (file, crs, resolution) aren't the grid's.
    """
    available = cut(available_species(species, files))
    if jobs is not None:
        for habitat in sorted({h for h, _ in jobs}):
            require_species(species, available.where(F.col("habitat") == habitat), [g for h, g in jobs if h == habitat])
        wanted = species.sparkSession.createDataFrame([tuple(j) for j in jobs], "habitat string, grp string")
        available = available.join(F.broadcast(wanted), list(KEYS), "left_semi")  # a row a job
    if tags is not None:
        for r in tags.join(available, "file", "left_semi").groupBy("crs", "resolution").agg(F.min("file").alias("file")).collect():  # a row a kind of raster
            try:
                (source or grid).require(r.crs, r.resolution)
            except ValueError as e:
                raise ValueError(f"{r.file}: {e}") from None
    metadata = cut(suitability_metadata(available))
    pixels = pixels if source is None else regrid.regrid(pixels, source, grid, ("file",), ("pct",))
    return group_suitability(guarded_cells(pixels, available), metadata, masks, border, grid, config), metadata


def write_suitability(suitability: DataFrame, metadata: DataFrame, path: str, grid: Grid = FRAME, **options) -> None:
    """Both bands of every raster as tiled 32-bit files, under the names habitat/group; the metadata goes into the manifest, committed with them."""
    told = {f"{r.habitat}/{r.grp}": {"D_m": r.d_m, "D_m_std": r.d_m_std, "habitat": r.habitat, "group": r.grp, "species": list(r.species), "N_species": r.n_species} for r in metadata.collect()}  # a row a raster
    tiles.write_tiles(suitability.where("mean_suitability is not null"), path, grid, ["mean_suitability", "std_suitability"], F.concat_ws("/", *KEYS), parameters=told, **options)


def read_suitability(spark: SparkSession, path: str) -> DataFrame:
    """(habitat, grp, row, col, mean_suitability, std_suitability) of written rasters."""
    keys = [F.split("raster", "/")[n].alias(k) for n, k in enumerate(KEYS)]
    return tiles.read_tiles(spark, path).select(*keys, "row", "col", "mean_suitability", "std_suitability")


def prepared(suitability: DataFrame, stats: DataFrame, distances: DataFrame, grid: Grid = FRAME, config: Config = DEFAULT) -> DataFrame:
    """Coarse quality rasters with their analysis parameters: (habitat, grp, distance, factor, top, left, radius, d_m, alpha, row, col, q).

    A raster is its cells' rectangle; the mean quality is that of the whole
    rectangle, missing and floored cells included. Blocks begin at its corner.
    """
    shape = mapalgebra.extents(suitability, KEYS)
    params = connectivity.analysis_params(stats.select(*KEYS, "d_m"), config, grid).join(F.broadcast(distances), "grp").join(shape, list(KEYS))  # one row a group
    dense = mapalgebra.frames(shape, KEYS).join(suitability.select(*KEYS, "row", "col", "value"), [*KEYS, "row", "col"], "left")
    coarse = mapalgebra.coarsen_by(dense.join(F.broadcast(params.select(*KEYS, "factor", "top", "left", "height", "width")), list(KEYS)), "factor", KEYS)
    coarse = coarse.withColumn("q", quality_floor(F.col("value"), config.floor)).drop("value")
    mean = coarse.groupBy(*KEYS).agg(F.avg("q").alias("mean_q"))
    known = params.join(mean, list(KEYS)).withColumn("alpha", F.when(F.col("distance") == EUCLIDEAN, F.col("coarse_resolution")).otherwise(F.col("coarse_resolution") * F.col("mean_q")))
    return coarse.join(F.broadcast(known.select(*KEYS, "distance", "factor", "top", "left", "height", "width", "radius", "d_m", "alpha")), list(KEYS))


def group_elasticity(suitability: DataFrame, stats: DataFrame, distances: DataFrame, border: DataFrame, grid: Grid = FRAME, config: Config = DEFAULT, sens: tuple[str, ...] = ("quality", "permeability"), kernel: connectivity.Proximity = connectivity.EXPONENTIAL, metrics: dict[str, connectivity.Distance] | None = None) -> DataFrame:
    """(habitat, grp, sens, row, col, elasticity) on the fine grid; straight-line groups have no permeability elasticity.

    metrics: by the names in `distances`, what each is computed with; a distance of one's own has a name of its own.

    Fine cells take the sensitivity of the nearest coarse centre; beyond the
    outermost centres there is none.
    """
    ready = cut(prepared(suitability, stats, distances, grid, config))
    metrics = connectivity.DISTANCES if metrics is None else metrics
    parts = []
    for name, distance in metrics.items():
        some = ready.where(F.col("distance") == name)
        parts += [connectivity.sensitivity(some, KEYS, s, distance, kernel=kernel).withColumn("sens", F.lit(s)) for s in sens if s == "quality" or distance.moves]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    at = F.broadcast(ready.select(*KEYS, "factor", "top", "left", "height", "width").distinct())  # one row a group and habitat
    fine = spatial.clip(suitability, border).join(at, list(KEYS))
    for c, start, size in (("row", "top", "height"), ("col", "left", "width")):
        nth, half = F.col(c) - F.col(start), (F.col("factor") - 1) / 2
        fine = fine.where((nth >= half) & (nth <= F.col(size) - F.col(size) % F.col("factor") - 1 - half)).withColumn(f"__{c}", F.floor(nth / F.col("factor")).cast("int"))
    out = out.withColumnRenamed("row", "__row").withColumnRenamed("col", "__col")
    joined = fine.join(out, [*KEYS, "__row", "__col"])
    return joined.select(*KEYS, "sens", "row", "col", (F.col("sensitivity") * F.col("value")).alias("elasticity"))


def sum_sensitivities(elasticity: DataFrame) -> DataFrame:
    """Quality and permeability of a group together. Where a group has both rasters, a cell missing in either is missing."""
    kinds = elasticity.groupBy(*KEYS).agg(F.count_distinct("sens").alias("kinds"), F.max((F.col("sens") == "quality").cast("int")).alias("has_quality"))
    cells = elasticity.groupBy(*KEYS, "row", "col").agg(F.sum("elasticity").alias("value"), F.count("elasticity").alias("n"))
    joined = cells.join(kinds, list(KEYS))
    value = F.when(F.col("has_quality") == 0, F.raise_error(F.lit("a group has no quality elasticity")).cast("double")).when(F.col("n") == F.col("kinds"), F.col("value"))
    return joined.select(*KEYS, "row", "col", value.alias("value"))


def importance(summed: DataFrame, how: str = "max", config: Config = DEFAULT) -> DataFrame:
    """(habitat, row, col, value): each group's log elasticity to 0-1, groups combined per habitat, to 0-1 again."""
    logs = summed.withColumn("value", log_shift(F.col("value"), config.floor))
    groups = mapalgebra.rescale(logs, KEYS)
    return mapalgebra.rescale(mapalgebra.combine(groups, how, ("habitat",)), ("habitat",))


def combined(scores: DataFrame, how: str = "max") -> DataFrame:
    """(row, col, value): the habitats' scores combined and brought to 0-1."""
    return mapalgebra.rescale(mapalgebra.combine(scores, how))


def importance_scores(elasticity: DataFrame, how: str = "max", grid: Grid = FRAME, config: Config = DEFAULT, source: Grid | None = None) -> DataFrame:
    """(habitat, row, col, value) from elasticities: each habitat's score on the grid's cells, and both combined under habitat aquatic_terrestrial.

    Scores of another grid, `source`, are matched to the cells by nearest centre, in whatever system it is.
    """
    scores = importance(cut(sum_sensitivities(elasticity)), how, config)
    scores = cut(scores if source is None else regrid.regrid(scores, source, grid, ("habitat",)))
    scores = scores.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    both = combined(scores, how).select(F.lit("aquatic_terrestrial").alias("habitat"), "row", "col", "value")
    return scores.unionByName(both)


def run_analysis(spark: SparkSession, suitability: DataFrame, stats: DataFrame, distances: DataFrame, border: DataFrame, path: str, how: str = "max", grid: Grid = FRAME, config: Config = DEFAULT) -> DataFrame:
    """Every job of an analysis: elasticities are written under the run's name and read back, each habitat's score and the combined one are written; returns the scores as read back."""
    rasters.write_elasticity(group_elasticity(suitability, stats, distances, border, grid, config), f"{path}/elasticities", config.run_id)
    scores = importance_scores(rasters.read_elasticity(spark, f"{path}/elasticities", config.run_id), how, grid, config)
    rasters.write_scores(scores, f"{path}/scores", config.run_id, how)
    return rasters.read_scores(spark, f"{path}/scores", config.run_id, how)


def metadata_report(species: DataFrame, distances: DataFrame) -> DataFrame:
    stats = traits.dispersal_stats(species).join(F.broadcast(distances), "grp")  # one row a group
    return stats.select(
        "grp", "habitat", F.col("n_species").alias("species_number"), "distance",
        F.round(F.col("d_m") / 1000, 3).alias("median_dispersal_km"), F.round(F.col("d_m_std") / 1000, 2).alias("std_dispersal_km"),
    )
