"""The suitability job: which species count, what stops it, what is written."""

import statistics

import pytest
from pyspark.sql import functions as F

from cairnmesh.config import Grid
from cairnmesh.operators import mapalgebra, regrid
from cairnmesh.plans import pipelines
from cairnmesh.sources import tiles

GRID = Grid(6, 6)
TRAITS = [
    (1, "red moss", "bees", "aquatic", 0.2), (2, "red moss", "birds", "terrestrial", 0.9),  # a second row: another group, but the first row's habitat and dispersal
    (3, "blue fern", "bees", "aquatic", 0.6), (4, "old fern", "bees", "terrestrial", 0.3), (5, "tall oak", "bees", "aquatic", 0.5),  # two files; another habitat; no file
    (6, "grey ash", "bees", "aquatic", 0.4), (7, "odd one", "bees", "nowhere", 0.4),
]
FILES = ["x_red.moss", "a_blue.fern", "b_blue.fern", "old.fern", "grey.ash", "odd.one", "unrelated"]
SUFFIX = "_reg_covariate_ensemble.tif"


def tables(spark, pixels=None):
    species = spark.createDataFrame(TRAITS, "species_id long, species string, grp string, habitat string, dispersal_km double")
    files = spark.createDataFrame([(f + SUFFIX,) for f in FILES], "file string")
    pixels = PIXELS if pixels is None else pixels
    px = spark.createDataFrame([(f + SUFFIX, *r) for f, *r in pixels], "file string, row int, col int, pct double")
    masks = spark.createDataFrame([("aquatic", r, c) for r in range(6) for c in range(3)], "habitat string, row int, col int")
    return species, files, px, masks


PIXELS = [("x_red.moss", 0, 0, 40.0), ("x_red.moss", 5, 5, 80.0), ("grey.ash", 0, 0, 60.0), ("grey.ash", 1, 1, None), ("old.fern", 2, 2, 10.0), ("a_blue.fern", 0, 0, 100.0), ("odd.one", 0, 0, 100.0), ("unrelated", 0, 0, 1.0)]


def test_which_species_count(spark):
    species, files, px, masks = tables(spark)
    cells, metadata = pipelines.suitability_job(species, files, px, masks, grid=GRID)
    told = {(r.habitat, r.grp): (r.d_m, r.n_species, list(r.species)) for r in metadata.collect()}
    assert told == {("aquatic", "bees"): (pytest.approx(300.0), 2, ["grey ash", "red moss"]), ("aquatic", "birds"): (200.0, 1, ["red moss"]), ("terrestrial", "bees"): (300.0, 1, ["old fern"])}
    assert metadata.where("grp = 'bees' and habitat = 'aquatic'").first().d_m_std == pytest.approx(statistics.stdev([200.0, 400.0]))
    got = {(r.habitat, r.grp, r.row, r.col): (r.mean_suitability, r.std_suitability) for r in cells.collect()}
    assert got["aquatic", "bees", 0, 0] == (pytest.approx(0.5), pytest.approx(0.1)) and got["aquatic", "birds", 0, 0] == (pytest.approx(0.4), 0.0)
    assert got["aquatic", "bees", 0, 1][0] == pytest.approx(0.5)  # a hole of the mask
    assert got["aquatic", "bees", 0, 3][0] is None  # a hole outside of it
    assert got["terrestrial", "bees", 2, 2][0] == pytest.approx(0.1) and got["terrestrial", "bees", 0, 0][0] is None
    assert len(got) == 3 * 36


@pytest.mark.parametrize("pixels,name", [
    ([("x_red.moss", 0, 0, 0.4), *PIXELS[2:]], "x_red.moss"),  # fractions already
    ([*PIXELS[:2], ("grey.ash", 0, 0, 250.0), *PIXELS[4:]], "grey.ash"),  # beyond percents
    ([("x_red.moss", 0, 0, None), *PIXELS[2:]], "x_red.moss"),  # nothing but missing values
    (PIXELS[:4], "old.fern"),  # no pixels at all
])
def test_bad_rasters_stop_the_job_by_name(spark, pixels, name):
    species, files, px, masks = tables(spark, pixels)
    with pytest.raises(ValueError, match=f"not percents: {name}"):
        pipelines.suitability_job(species, files, px, masks, grid=GRID)


def test_jobs_and_tags(spark):
    species, files, px, masks = tables(spark)
    one, metadata = pipelines.suitability_job(species, files, px, masks, grid=GRID, jobs=[("aquatic", "bees")])
    assert {tuple(r) for r in one.select("habitat", "grp").distinct().collect()} == {("aquatic", "bees")} and metadata.count() == 1
    with pytest.raises(LookupError, match="no species in group fishes"):
        pipelines.suitability_job(species, files, px, masks, grid=GRID, jobs=[("aquatic", "fishes")])
    with pytest.raises(LookupError, match="no rasters of group birds"):
        pipelines.suitability_job(species, files, px, masks, grid=GRID, jobs=[("aquatic", "birds"), ("terrestrial", "birds")])
    tags = [(f + SUFFIX, "EPSG:2056", 25.0) for f in FILES]
    tagged = lambda some: spark.createDataFrame(some, "file string, crs string, resolution double")
    assert pipelines.suitability_job(species, files, px, masks, grid=GRID, tags=tagged(tags))[1].count() == 3
    with pytest.raises(ValueError, match="grey.ash.*cells of 100"):
        pipelines.suitability_job(species, files, px, masks, grid=GRID, tags=tagged([(f, c, 100.0 if "ash" in f else r) for f, c, r in tags]))
    with pytest.raises(ValueError, match="x_red.moss.*EPSG:4326"):
        pipelines.suitability_job(species, files, px, masks, grid=GRID, tags=tagged([(f, "EPSG:4326" if "moss" in f else c, r) for f, c, r in tags]))
    # a raster that nobody uses may be anything
    assert pipelines.suitability_job(species, files, px, masks, grid=GRID, tags=tagged([(f, c, 9.0 if "blue" in f else r) for f, c, r in tags]))[1].count() == 3


def test_written_with_metadata(spark, tmp_path):
    species, files, px, masks = tables(spark)
    cells, metadata = pipelines.suitability_job(species, files, px, masks, grid=GRID)
    path = str(tmp_path / "s")
    pipelines.write_suitability(cells, metadata, path, GRID)
    got = {tuple(r)[:4]: r.mean_suitability for r in pipelines.read_suitability(spark, path).collect()}
    want = {tuple(r)[:4]: r.mean_suitability for r in cells.where("mean_suitability is not null").collect()}
    assert got == pytest.approx(want, rel=1e-6) and got[("aquatic", "bees", 0, 0)] == 0.5
    told = tiles.read_manifest(path)["parameters"]["aquatic/bees"]
    assert (told["D_m"], told["N_species"], told["species"], told["group"]) == (pytest.approx(300.0), 2, ["grey ash", "red moss"], "bees")


def test_cells_beyond_the_grid_count(spark):
    """A raster may reach over the grid: its cells stay and are near ones for the fill."""
    cells = spark.createDataFrame([("aquatic", "bees", 2, -3, 0.5, 0.0, 1)], "habitat string, grp string, row int, col int, mean_suitability double, std_suitability double, valid_count long")
    stats = spark.createDataFrame([("aquatic", "bees", 100.0)], "habitat string, grp string, d_m double")
    masks = spark.createDataFrame([("aquatic", 4, 1)], "habitat string, row int, col int")
    got = {(r.row, r.col): r.mean_suitability for r in pipelines.group_suitability(cells, stats, masks, grid=GRID).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(2, -3): 0.5, (4, 1): 0.5} and len(got) == 6 * 9


def test_fill_only(spark):
    df = spark.createDataFrame([(0, c, 1.0 if c == 0 else None, c % 2 == 0) for c in range(6)], "row int, col int, value double, here boolean")
    got = {r.col: r.value for r in mapalgebra.fill_nearest(df, only=F.col("here")).collect()}
    assert got == {0: 1.0, 1: None, 2: 1.0, 3: None, 4: 1.0, 5: None}


def test_pixels_of_another_system(spark):
    """Rasters in longitude and latitude come out on the Swiss grid, filled like its own."""
    grid = Grid(6, 6, 25.0, 2_600_000.0, 1_200_000.0)
    source = regrid.projected_grid(grid, "EPSG:4326", 0.0001)
    px = spark.createDataFrame([(f + SUFFIX, r, c, 10.0 + r) for f in ("x_red.moss", "grey.ash", "old.fern") for r in range(source.height) for c in range(source.width)], "file string, row int, col int, pct double")
    species, files, _, masks = tables(spark)
    tags = spark.createDataFrame([(f + SUFFIX, "EPSG:4326", 0.0001) for f in FILES], "file string, crs string, resolution double")
    cells, _ = pipelines.suitability_job(species, files, px, masks, grid=grid, tags=tags, source=source)
    got = {(r.row, r.col): r.mean_suitability for r in cells.where("grp = 'birds'").collect()}
    assert len(got) == 36 and None not in got.values()
    assert all(got[r, c] < got[r + 2, c] for r in range(4) for c in range(6))  # rows go south in both
    scores = spark.createDataFrame([("aquatic", "bees", "quality", r, c, float(r + 1)) for r in range(source.height) for c in range(source.width)], "habitat string, grp string, sens string, row int, col int, elasticity double")
    moved = pipelines.importance_scores(scores, grid=grid, source=source).where("habitat = 'aquatic_terrestrial'").collect()
    assert {(r.row, r.col) for r in moved} == set(got) and max(r.value for r in moved) == 1.0
