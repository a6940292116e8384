"""Registered queries over the given tables, and their DuckDB SQL (written from the definitions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, DISPLAY_NAMES, FRAME, LEAST_COST, Grid
from ..functions.columns import NUDGE, quality_floor, r6
from ..operators import connectivity, mapalgebra, overlay, regrid, spatial, traits
from ..sources import adapters, tiles
from ..sources.tables import cut, scratch
from . import oracle as sql
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Whole jobs that SQL is too slow for: they are what is registered under the name, without SQL. QUERIES holds the part that SQL can check.
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEYS = pipelines.KEYS
#: Window of the least-cost queries that SQL checks.
RADIUS = 3
BUFFER = 100.0


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle.replace(", 6)", f" + {NUDGE}, 6)")
        return f

    return add


def whole(name: str):
    def add(f):
        WHOLE[name] = f
        return f

    return add


def _means(spark, d) -> DataFrame:
    return mapalgebra.cell_stats(adapters.suitability_pixels(spark, d), KEYS)


def _clipped(spark, d) -> DataFrame:
    """Mean rasters on the whole frame, missing beyond the border."""
    means = spatial.clip(_means(spark, d), _border(spark)).select(*KEYS, "row", "col", F.col("mean_suitability").alias("value"))
    rasters = _means(spark, d).select(*KEYS).distinct()  # a raster that lies beyond the border is there too, all missing
    return rasters.crossJoin(mapalgebra.cells(spark, FRAME)).join(means, [*KEYS, "row", "col"], "left")


def _dense_grid(spark, d) -> Grid:
    rows = adapters.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    return Grid(int(rows) + 1, 64)


# --- traits and species ------------------------------------------------------------------------


@query(sql.TRAITS_CLEAN)
def traits_clean(spark, d):
    raw = adapters.species(spark, d).withColumn("note", F.when(F.col("dispersal_km") >= 0.1, F.concat(F.col("grp"), F.lit("/"), F.col("habitat"))))
    return traits.clean_strings(raw)


@query(sql.GROUP_SPECIES)
def group_species(spark, d):
    return traits.group_species(adapters.species(spark, d), "PROMO")


def _repeated(spark, d) -> DataFrame:
    """Traits in which names repeat with other values (the name without its number)."""
    p = adapters.table(spark, d, "part").select(F.col("p_partkey").alias("species_id"), F.col("p_name").alias("species"))
    return p.join(adapters.species(spark, d).drop("species").hint("merge"), "species_id")


@query(sql.TRAIT_FIRST_VALUE)
def trait_first_value(spark, d):
    return traits.first_rows(_repeated(spark, d)).select("species", "habitat", "dispersal_km", "grp")


@query(sql.SPECIES_IN_HABITAT)
def species_in_habitat(spark, d):
    return traits.species_in_habitat(_repeated(spark, d))


@query(sql.SPECIES_FILE_MATCH)
def species_file_match(spark, d):
    return traits.match_files(adapters.species(spark, d), adapters.file_names(spark, d))


@query(sql.AVAILABLE_SPECIES)
def available_species(spark, d):
    """Species with exactly one file, of bare names and of names with their number in front."""
    files = adapters.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("_reg_covariate_ensemble.tif")).alias("file"))
    bare = _repeated(spark, d).select("species_id", "species")
    numbered = adapters.species(spark, d).select("species_id", F.concat(F.lit("p"), "species_id", F.lit("_"), F.regexp_replace("species", r" \d+$", "")).alias("species"))
    return traits.available(traits.match_files(bare.unionByName(numbered), files)).select("species_id", "species", "file")


@query(sql.AVAILABLE_REPORT)
def available_report(spark, d):
    return traits.available_report(adapters.species(spark, d), adapters.file_names(spark, d))


@query(sql.display_values(DISPLAY_NAMES))
def display_names(spark, d):
    """The tables' groups under the names they are shown with; one without a name of its own keeps its key."""
    groups = adapters.species(spark, d).select("grp").distinct()
    return groups.join(F.broadcast(traits.display_names(spark)), "grp", "left").select("grp", F.coalesce("display_name", "grp").alias("display_name"))  # a fixed few rows


@query(sql.DISPERSAL_STATS)
def dispersal_stats(spark, d):
    s = traits.dispersal_stats(adapters.species(spark, d))
    return s.select(*KEYS, "n_species", r6("d_m").alias("d_m"), r6("d_m_std").alias("d_m_std"))


@query(sql.GROUP_DIM)
def group_dim(spark, d):
    return adapters.group_distance(spark, d)


@query(sql.JOB_MATRIX)
def job_matrix(spark, d):
    return traits.job_matrix(adapters.group_distance(spark, d))


@query(sql.TASK_FILTER)
def task_filter(spark, d):
    return traits.tasks(traits.job_matrix(adapters.group_distance(spark, d)))


@query(sql.METADATA_REPORT)
def metadata_report(spark, d):
    return pipelines.metadata_report(adapters.species(spark, d), adapters.group_distance(spark, d))


@query(sql.SPECIES_LIST)
def species_list(spark, d):
    s = traits.species_list(adapters.species(spark, d))
    return s.select(*KEYS, F.concat_ws("|", "species").alias("species"))


# --- map algebra ---------------------------------------------------------------------------------


@query(sql.RASTER_LOAD_SCALED)
def raster_load_scaled(spark, d):
    return mapalgebra.scale_percent(adapters.observations(spark, d), ["species_id"], strict=False).select("species_id", "row", "col", r6("value").alias("value"))


@query(sql.SUITABILITY.format(what="round(avg(value), 6) as mean_suitability"))
def suitability_mean(spark, d):
    return _means(spark, d).select(*KEYS, "row", "col", r6("mean_suitability").alias("mean_suitability"))


@query(sql.SUITABILITY.format(what="round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 6) as std_suitability"))
def suitability_std(spark, d):
    return _means(spark, d).select(*KEYS, "row", "col", r6("std_suitability").alias("std_suitability"))


@query(sql.SUITABILITY.format(what="count(value) as valid_count"))
def cell_valid_count(spark, d):
    return _means(spark, d).select(*KEYS, "row", "col", "valid_count")


@query(sql.SUITABILITY.format(what="round(avg(value), 6) as mean_suitability, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 6) as std_suitability, count(value) as valid_count"))
def suitability_fold(spark, d):
    """Cheap parts' rasters as a kept state, into which the dear ones are folded later."""
    pixels = adapters.suitability_pixels(spark, d)
    cheap = adapters.table(spark, d, "part").where("p_retailprice < 1500").select(F.col("p_partkey").alias("species_id"))
    kept = cut(mapalgebra.cell_state(pixels.join(cheap, "species_id", "left_semi"), KEYS))
    more = mapalgebra.cell_state(pixels.join(cheap, "species_id", "left_anti"), KEYS)
    out = mapalgebra.state_stats(mapalgebra.merged_states(kept, more, KEYS))
    return out.select(*KEYS, "row", "col", r6("mean_suitability").alias("mean_suitability"), r6("std_suitability").alias("std_suitability"), "valid_count")


@query(sql.QUALITY_FLOOR)
def quality_floor_(spark, d):
    return _clipped(spark, d).select(*KEYS, "row", "col", r6(quality_floor(F.col("value"), DEFAULT.floor)).alias("quality"))


QUERIES["quality_floor"], ORACLES["quality_floor"] = QUERIES.pop("quality_floor_"), ORACLES.pop("quality_floor_")


@query(sql.COARSEN.format(f=3))
def coarsen_mean(spark, d):
    g = _dense_grid(spark, d)
    return mapalgebra.coarsen(adapters.dense(spark, d), 3, g.height, g.width).select("row", "col", r6("value").alias("value"))


@query(sql.COARSEN.format(f=5))
def upscale(spark, d):
    return mapalgebra.upscale(adapters.dense(spark, d), 110.0, _dense_grid(spark, d)).select("row", "col", r6("value").alias("value"))


@query(sql.COARSEN.format(f=10))
def plot_coarsen(spark, d):
    g = _dense_grid(spark, d)
    return mapalgebra.coarsen(adapters.dense(spark, d), 10, g.height, g.width).select("row", "col", r6("value").alias("value"))


@query(sql.GRID_RESOLUTION)
def grid_resolution(spark, d):
    xy = mapalgebra.with_xy(adapters.dense(spark, d).drop("value"), _dense_grid(spark, d))
    return mapalgebra.resolution(xy, "y").select(r6("resolution").alias("lat")).crossJoin(mapalgebra.resolution(xy, "x").select(r6("resolution").alias("lon")))  # one row each


@query(sql.GRID_ALIGN)
def grid_align(spark, d):
    o = adapters.observations(spark, d).withColumn("x", (F.col("col") + 0.5) * 25 + 7 - 60).withColumn("y", (31.5 - F.col("row")) * 25 - 5 + 40)
    snapped = mapalgebra.align(o.drop("row", "col"), FRAME).groupBy("row", "col").agg(F.avg("pct").alias("value"))
    return mapalgebra.pad(spark, snapped, FRAME).select("row", "col", r6("value").alias("value"))


@query(sql.PAD_GRID)
def pad_grid(spark, d):
    means = _means(spark, d).select(*KEYS, "row", "col", F.col("mean_suitability").alias("value"))
    return mapalgebra.pad(spark, means, FRAME, 3, KEYS).select(*KEYS, "row", "col", r6("value").alias("value"))


@query(sql.BAND_UNPIVOT)
def band_unpivot(spark, d):
    bands = ["mean_suitability", "std_suitability"]
    return mapalgebra.unpivot_bands(_means(spark, d).select(*KEYS, "row", "col", *[r6(b).alias(b) for b in bands]), bands, KEYS)


@query(sql.BAND_PIVOT)
def band_pivot(spark, d):
    return mapalgebra.pivot_bands(band_unpivot(spark, d), ["mean_suitability", "std_suitability"], KEYS)


@query(sql.INT16_PACK)
def int16_pack(spark, d):
    packed = mapalgebra.pack_int16(adapters.dense(spark, d), 0.001)
    return packed.select("row", "col", F.col("packed").cast("int").alias("packed"), r6("decoded").alias("decoded"))


@query(sql.RESCALE)
def rescale(spark, d):
    m = _means(spark, d).select(*KEYS, "row", "col", F.col("mean_suitability").alias("value"))
    return mapalgebra.rescale(m, KEYS).select(*KEYS, "row", "col", r6("value").alias("value"))


@query(sql.LCP_ALPHA)
def lcp_alpha(spark, d):
    q = _clipped(spark, d).withColumn("q", quality_floor(F.col("value"), DEFAULT.floor))
    return q.groupBy(*KEYS).agg(r6(1 / F.avg("q")).alias("mean_step"), r6(F.avg("q") * DEFAULT.resolution).alias("alpha"))


@query(sql.DOWNSCALE)
def downscale_nearest(spark, d):
    g = _dense_grid(spark, d)
    fine = adapters.dense(spark, d)
    coarse = mapalgebra.coarsen(fine, 3, g.height, g.width)
    return mapalgebra.downscale(coarse, fine.select("row", "col"), 3, (g.height // 3, g.width // 3)).select("row", "col", r6("value").alias("value"))


@query(sql.FILL_NEAREST)
def fill_nearest(spark, d):
    return mapalgebra.fill_nearest(_clipped(spark, d), KEYS).select(*KEYS, "row", "col", r6("value").alias("value"))


def _placed(spark, d) -> Grid:
    """The dense raster's grid in the Swiss system, north-west corner at its origin."""
    g = _dense_grid(spark, d)
    return Grid(g.height, g.width, 25.0, sql.EAST, sql.NORTH, crs="EPSG:2056")


def _on(df, grid: Grid) -> DataFrame:
    xy = mapalgebra.with_xy(df, grid)
    return xy.select("x", "y", r6("value").alias("value"))


@query(sql.REPROJECT)
def reproject_nearest(spark, d):
    source = _placed(spark, d)
    target = regrid.projected_grid(source, "EPSG:3857", sql.MERCATOR_CELL)
    return _on(regrid.regrid(adapters.dense(spark, d), source, target), target)


@query(sql.GRID_MATCH.format(r=sql.FINE, x0=7.5, y0=-3.5))
def grid_match_fine(spark, d):
    source = _placed(spark, d)
    target = Grid(int(source.height * 25 / sql.FINE), int(source.width * 25 / sql.FINE), sql.FINE, sql.EAST + 7.5, sql.NORTH - 3.5)
    return _on(regrid.regrid(adapters.dense(spark, d), source, target), target)


@query(sql.GRID_MATCH.format(r=sql.COARSE, x0=-100.0, y0=130.0))
def grid_match_coarse(spark, d):
    source = _placed(spark, d)
    target = Grid(int(source.height * 25 / sql.COARSE), int(source.width * 25 / sql.COARSE), sql.COARSE, sql.EAST - 100.0, sql.NORTH + 130.0)
    return _on(regrid.regrid(adapters.dense(spark, d), source, target), target)


@query(sql.GRID_BILINEAR)
def grid_match_bilinear(spark, d):
    source = _placed(spark, d)
    target = Grid(int(source.height * 25 / sql.COARSE), int(source.width * 25 / sql.COARSE), sql.COARSE, sql.EAST + 5.0, sql.NORTH - 5.0)
    return _on(regrid.regrid(adapters.dense(spark, d), source, target, method="bilinear"), target)


@query(sql.LABEL_MATCH)
def label_match(spark, d):
    """The dense raster at the nearest labels of two irregular axes (balances of suppliers)."""
    balance = adapters.table(spark, d, "supplier").select("s_acctbal")
    x, y = (balance.select((F.abs(F.col("s_acctbal")) % m).alias("label")).distinct() for m in (64, 150))
    raster = adapters.dense(spark, d).select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), r6("value").alias("value"))
    return regrid.match_labels(raster, x, y, shown=r6)  # rounded by label and cell: the rows are their product


@query(sql.TILED_BOX)
def tiled_box(spark, d):
    """The dense raster as 16-bit tiles in two bands (value, its square), and a box of it read back: only tiles that meet the box are read."""
    path = scratch(spark, "dense")
    bands = adapters.dense(spark, d).select("row", "col", F.col("value").alias("v"), (F.col("value") * F.col("value")).alias("square"))
    tiles.write_tiles(bands, path, _placed(spark, d), ["v", "square"], tile=16, block=64, kind="i4", scale=0.0001, nodata=-2147483648)
    return tiles.read_tiles(spark, path, box=(10, 75, 5, 40)).select("row", "col", "x", "y", F.round("v", 4).alias("v"), F.round("square", 4).alias("square"))


@query(sql.DENSE_ALL)
def tiled_round_trip(spark, d):
    """The whole dense raster through 32-bit tiles."""
    path = scratch(spark, "dense")
    tiles.write_tiles(adapters.dense(spark, d), path, _placed(spark, d), ["value"], tile=32, block=128)
    return tiles.read_tiles(spark, path).select("row", "col", F.round("value", 5).alias("value"))


# --- vector masks ----------------------------------------------------------------------------------


def _edges(spark, *layers):
    return adapters.edges(spark, *layers)


def _border(spark) -> DataFrame:
    return spatial.cells_of(spatial.fill(_edges(spark, "country"), FRAME))


def _observed(spark, d, cells: DataFrame) -> DataFrame:
    """Mean percent of each observed cell among `cells`."""
    means = adapters.observations(spark, d).groupBy("row", "col").agg(F.avg("pct").alias("value"))
    return spatial.clip(means, cells).select("row", "col", r6("value").alias("value"))


def _aquatic(spark) -> DataFrame:
    return spatial.aquatic_mask(_edges(spark, "lake"), _edges(spark, "river"), FRAME)


def _terrestrial(spark) -> DataFrame:
    return spatial.terrestrial_mask(_edges(spark, "lake"), FRAME)


@query(sql.within("select row, col from filled where layer = 'country'"))
def border_filter(spark, d):
    codes = spark.createDataFrame([(g, c) for g, c in enumerate(adapters.CODES["country"])], "geom_id int, icc string")
    one = _edges(spark, "country").join(codes, "geom_id").where("icc = 'CH'").drop("icc")
    return _observed(spark, d, spatial.fill(one, FRAME))


@query(sql.within(f"select row, col from border where (col + 0.5) * 25 < {adapters.CANTON_SPLIT}"))
def canton_filter(spark, d):
    names = spark.createDataFrame([(g, c) for g, c in enumerate(adapters.CODES["canton"])], "geom_id int, name string")
    one = _edges(spark, "canton").join(F.broadcast(names), "geom_id").where("name = 'A'").drop("name")  # one row a canton
    return _observed(spark, d, spatial.fill(one, FRAME))


@query(sql.TOTAL_BOUNDS)
def total_bounds(spark, d):
    """The lakes' box and how many pixels lie in it."""
    xy = mapalgebra.with_xy(adapters.observations(spark, d), FRAME).crossJoin(F.broadcast(spatial.total_bounds(_edges(spark, "lake"))))  # one row
    return xy.where("x between minx and maxx and y between miny and maxy").groupBy("minx", "miny", "maxx", "maxy").agg(F.count("*").alias("pixels"))


@query(sql.within("select row, col from aquatic"))
def mask_aquatic(spark, d):
    return _observed(spark, d, _aquatic(spark))


@query(sql.within("select row, col from terrestrial"))
def mask_terrestrial(spark, d):
    return _observed(spark, d, _terrestrial(spark))


@query(sql.within("select row, col from border except select row, col from filled where layer = 'lake'"))
def mask_overlay(spark, d):
    """Country and cantons dissolved, lakes taken out as shapes, what is left as cells."""
    edges = _edges(spark, "country", "canton", "lake")
    land = overlay.outlines(overlay.overlay(edges, ["country", "canton"], ["lake"]), "land")
    return _observed(spark, d, spatial.cells_of(spatial.fill(land, FRAME)))


@query(sql.MASK_SEMI)
def mask_semi(spark, d):
    return spatial.clip(_means(spark, d), spatial.fill(_edges(spark, "lake"), FRAME)).select(*KEYS, "row", "col", r6("mean_suitability").alias("value"))


@query(sql.within("select row, col from lake_touched"))
def mask_all_touched(spark, d):
    return _observed(spark, d, spatial.polygon_all_touched(_edges(spark, "lake"), FRAME))


@query(sql.CROP_BORDER)
def crop_border(spark, d):
    return spatial.clip(_means(spark, d), _border(spark)).select(*KEYS, "row", "col", r6("mean_suitability").alias("value"))


@query(sql.within(sql.BUFFER.format(layers="'country'", r=60.0)))
def border_buffer(spark, d):
    return _observed(spark, d, spatial.polygon_buffer(_edges(spark, "country"), FRAME, 60.0))


@query(sql.within(sql.BUFFER.format(layers="'barrier', 'hydropower'", r=BUFFER)))
def barrier_buffer(spark, d):
    return _observed(spark, d, spatial.polygon_buffer(_edges(spark, "barrier", "hydropower"), FRAME, BUFFER))


@query(sql.MASK_FILL)
def mask_fill(spark, d):
    means = _clipped(spark, d)
    filled = mapalgebra.fill_nearest(means, KEYS)
    return mapalgebra.fill_in_mask(means, filled, _aquatic(spark), KEYS).select(*KEYS, "row", "col", r6("value").alias("value"))


# --- connectivity ------------------------------------------------------------------------------------


@query(sql.PROXIMITY)
def proximity_kernel(spark, d):
    stats = traits.dispersal_stats(adapters.species(spark, d)).select(*KEYS, "d_m")
    steps = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("distance")).withColumn("alpha", F.lit(DEFAULT.resolution))
    return connectivity.kernel(steps).select(*KEYS, "distance", r6("proximity").alias("proximity"))


@query(sql.ANALYSIS_PARAMS)
def analysis_params(spark, d):
    p = connectivity.analysis_params(traits.dispersal_stats(adapters.species(spark, d)))
    return p.select(*KEYS, r6("coarse_resolution").alias("coarse_resolution"), "factor", "radius")


def _small(spark, d, group: str) -> DataFrame:
    """One group's mean raster with fixed parameters: one cell a block, RADIUS cells around."""
    m = _means(spark, d).where((F.col("habitat") == "aquatic") & (F.col("grp") == group))
    return m.select("row", "col", F.col("mean_suitability").alias("q"), F.lit(RADIUS).alias("radius"), F.lit(20.0).alias("alpha"), F.lit(100.0).alias("d_m"))


@query(sql.SENSITIVITY_EUCLID)
def sensitivity_euclid(spark, d):
    q = adapters.dense(spark, d).select("row", "col", F.col("value").alias("q"), F.lit(15).alias("radius"), F.lit(25.0).alias("alpha"), F.lit(125.0).alias("d_m"))
    return connectivity.sensitivity(q, [], "quality", connectivity.STRAIGHT).select("row", "col", r6("sensitivity").alias("sensitivity"))


@query(sql.LCP_DISTANCE)
def lcp_distance(spark, d):
    s = connectivity.distance_sums(_small(spark, d, "PROMO"), [], tile=16)
    return s.select("row", "col", "reached", r6("distance_sum").alias("distance_sum"))


@query(sql.SENSITIVITY_LCP_QUALITY)
def sensitivity_lcp_quality(spark, d):
    return connectivity.sensitivity(_small(spark, d, "PROMO"), [], "quality", tile=16).select("row", "col", r6("sensitivity").alias("sensitivity"))


@query(sql.SENSITIVITY_LCP_PERMEABILITY)
def sensitivity_lcp_permeability(spark, d):
    return connectivity.sensitivity(_small(spark, d, "PROMO"), [], "permeability", tile=16).select("row", "col", r6("sensitivity").alias("sensitivity"))


def _full(spark, d) -> DataFrame:
    """Every group's and habitat's mean raster on the whole frame."""
    m = _means(spark, d).select(*KEYS, "row", "col", F.col("mean_suitability").alias("value"))
    return mapalgebra.pad(spark, m, FRAME, keys=KEYS)


def _paths(spark, d) -> DataFrame:
    """The coarse quality rasters of all least-cost groups and habitats, each with its own radius, alpha and distance."""
    ready = pipelines.prepared(_full(spark, d), traits.dispersal_stats(adapters.species(spark, d)), adapters.group_distance(spark, d))
    return ready.where(F.col("distance") == LEAST_COST).select(*KEYS, "row", "col", "q", "radius", "alpha", "d_m")


@whole("lcp_distance")
def lcp_distance_whole(spark, d):
    s = connectivity.distance_sums(_paths(spark, d), KEYS)
    return s.select(*KEYS, "row", "col", "reached", r6("distance_sum").alias("distance_sum"))


@whole("sensitivity_lcp_quality")
def sensitivity_lcp_quality_whole(spark, d):
    return connectivity.sensitivity(_paths(spark, d), KEYS, "quality").select(*KEYS, "row", "col", r6("sensitivity").alias("sensitivity"))


@whole("sensitivity_lcp_permeability")
def sensitivity_lcp_permeability_whole(spark, d):
    return connectivity.sensitivity(_paths(spark, d), KEYS, "permeability").select(*KEYS, "row", "col", r6("sensitivity").alias("sensitivity"))


# --- composites -----------------------------------------------------------------------------------------


@query(sql.ELASTICITY_PRODUCT)
def elasticity_product(spark, d):
    m = _means(spark, d)
    sens = m.select(*KEYS, "row", "col", (F.col("std_suitability") * 2).alias("sensitivity"))
    fine = spatial.clip(m, _border(spark)).select(*KEYS, "row", "col", F.col("mean_suitability").alias("value"))
    return connectivity.elasticity(sens, fine, KEYS).select(*KEYS, "row", "col", r6("elasticity").alias("elasticity"))


def _summed(spark, d) -> DataFrame:
    """Stand-in elasticities: the mean as quality's, for least-cost groups the deviation (missing where a cell has one species only) as permeability's."""
    m = _means(spark, d)
    lcp = adapters.group_distance(spark, d).where("distance = 'LCPDistance'").select("grp")
    quality = m.select(*KEYS, F.lit("quality").alias("sens"), "row", "col", F.col("mean_suitability").alias("elasticity"))
    holes = F.when(F.col("valid_count") > 1, F.col("std_suitability"))
    perm = m.join(F.broadcast(lcp), "grp", "left_semi").select(*KEYS, F.lit("permeability").alias("sens"), "row", "col", holes.alias("elasticity"))  # one row a group
    return pipelines.sum_sensitivities(quality.unionByName(perm))


@query(sql.GROUP_SUM)
def group_sum_elasticity(spark, d):
    return _summed(spark, d).select(*KEYS, "row", "col", r6("value").alias("value"))


@query(sql.ECIS.format(agg="max"))
def ecis_max(spark, d):
    return pipelines.importance(_summed(spark, d), "max").select("habitat", "row", "col", r6("value").alias("value"))


@query(sql.ECIS.format(agg="sum"))
def ecis_mean(spark, d):
    return pipelines.importance(_summed(spark, d), "mean").select("habitat", "row", "col", r6("value").alias("value"))


@query(sql.COMBINED.format(agg="max"))
def combined_max(spark, d):
    return pipelines.combined(pipelines.importance(_summed(spark, d), "max"), "max").select("row", "col", r6("value").alias("value"))


@query(sql.COMBINED.format(agg="sum"))
def combined_mean(spark, d):
    return pipelines.combined(pipelines.importance(_summed(spark, d), "mean"), "mean").select("row", "col", r6("value").alias("value"))


def _suitability(spark, d) -> tuple[DataFrame, DataFrame]:
    masks = _aquatic(spark).withColumn("habitat", F.lit("aquatic")).unionByName(_terrestrial(spark).withColumn("habitat", F.lit("terrestrial")))
    return pipelines.suitability_job(adapters.named_species(spark, d), adapters.named_files(spark, d).select("file"), adapters.file_pixels(spark, d), masks, _edges(spark, "country"))


@query(sql.GROUP_SUITABILITY)
def group_suitability(spark, d):
    return _suitability(spark, d)[0].select(*KEYS, "row", "col", r6("mean_suitability").alias("mean_suitability"), r6("std_suitability").alias("std_suitability"))


@query(sql.SUITABILITY_METADATA)
def suitability_metadata(spark, d):
    available = pipelines.available_species(adapters.named_species(spark, d), adapters.named_files(spark, d).select("file"))
    m = pipelines.suitability_metadata(available)
    return m.select(*KEYS, r6("d_m").alias("d_m"), r6("d_m_std").alias("d_m_std"), "n_species", F.concat_ws("|", "species").alias("species"))


@query(sql.SUITABILITY_TILES)
def suitability_tiles(spark, d):
    """The job's rasters written as tiled 32-bit files with their metadata, and read back."""
    path = scratch(spark, "suitability")
    pipelines.write_suitability(*_suitability(spark, d), path, tile=16, block=64)
    return pipelines.read_suitability(spark, path).select(*KEYS, "row", "col", F.round("mean_suitability", 5).alias("mean_suitability"))


@query(sql.GROUP_ELASTICITY)
def group_elasticity(spark, d):
    m = _means(spark, d).select(*KEYS, "row", "col", F.col("mean_suitability").alias("value"))
    distances = adapters.group_distance(spark, d)
    straight = distances.where("distance = 'EuclideanDistance'")
    m = m.join(F.broadcast(straight), "grp", "left_semi")  # one row a group
    rasters = m.select(*KEYS).distinct()
    full = rasters.crossJoin(mapalgebra.cells(spark, FRAME)).join(m, [*KEYS, "row", "col"], "left")
    stats = traits.dispersal_stats(adapters.species(spark, d))
    out = pipelines.group_elasticity(full, stats, straight, _border(spark), sens=("quality",))
    return out.where("elasticity is not null").select(*KEYS, "sens", "row", "col", r6("elasticity").alias("elasticity"))


def _elasticity(spark, d) -> DataFrame:
    """Elasticities of all groups' suitability rasters, with every sensitivity that their distance has."""
    suitability, metadata = _suitability(spark, d)
    suitability = cut(suitability.select(*KEYS, "row", "col", F.col("mean_suitability").alias("value")))
    return pipelines.group_elasticity(suitability, metadata, adapters.group_distance(spark, d), _border(spark))


@whole("group_elasticity")
def group_elasticity_whole(spark, d):
    return _elasticity(spark, d).where("elasticity is not null").select(*KEYS, "sens", "row", "col", r6("elasticity").alias("elasticity"))


@whole("importance_scores")
def importance_scores(spark, d):
    """Pixels to scores: suitability, elasticities, each habitat's score and the combined one."""
    return pipelines.importance_scores(cut(_elasticity(spark, d)), "max").select("habitat", "row", "col", r6("value").alias("value"))
