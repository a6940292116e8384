"""Hand-computed grids and properties of the operators."""

import heapq
import importlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnmesh.config import Config, Grid
from cairnmesh.functions import columns
from cairnmesh.operators import connectivity, mapalgebra, spatial, traits
from cairnmesh.plans import catalog, pipelines
from cairnmesh.sources import adapters, rasters
from cairnmesh.sources.tables import cut

SMOKE = "/root/testdata/sf0.001"


def raster(spark, values):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(values) for c, v in enumerate(row)], "row int, col int, value double")


def grid_of(df, value="value"):
    return {(r["row"], r["col"]): r[value] for r in df.collect()}


def test_coarsen_trims_and_skips_missing(spark):
    got = grid_of(mapalgebra.coarsen(raster(spark, [[1.0, 3.0, 9.0], [None, 5.0, 9.0], [9.0, 9.0, 9.0]]), 2, 3, 3))
    assert got == {(0, 0): 3.0}


def test_rescale_constant_is_null_and_range_is_unit(spark):
    assert set(grid_of(mapalgebra.rescale(raster(spark, [[2.0, 2.0]]))).values()) == {None}
    assert grid_of(mapalgebra.rescale(raster(spark, [[2.0, 4.0, 3.0, None]]))) == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 0.5, (0, 3): None}


def test_fill_nearest_ties_and_empty(spark):
    got = grid_of(mapalgebra.fill_nearest(raster(spark, [[1.0, None, 2.0], [None, None, None], [3.0, None, 4.0]])))
    assert got[0, 1] == 1.0 and got[1, 0] == 1.0 and got[1, 1] == 1.0 and got[2, 1] == 3.0
    assert set(grid_of(mapalgebra.fill_nearest(raster(spark, [[None, None]]))).values()) == {None}


@pytest.mark.parametrize(("seed", "share"), [(3, 30), (4, 3), (5, 1), (6, 70)])
def test_fill_nearest_against_brute_force(spark, seed, share):
    r = np.random.default_rng(seed)
    v = [[float(x) if x < share else None for x in row] for row in r.integers(0, 100, (17, 23))]
    got = grid_of(mapalgebra.fill_nearest(raster(spark, v)))
    both = mapalgebra.fill_nearest(raster(spark, v).withColumn("other", F.col("value") * 2), (), ["value", "other"])
    assert all(r.other == 2 * r.value == 2 * got[r.row, r.col] for r in both.collect())
    known = [(i, j, x) for i, row in enumerate(v) for j, x in enumerate(row) if x is not None]
    for (i, j), x in got.items():
        want = v[i][j] if v[i][j] is not None else min(((a - i) ** 2 + (b - j) ** 2, a, b, y) for a, b, y in known)[3]
        assert x == want


def test_scale_percent_guards_range(spark):
    df = spark.createDataFrame([(1, 0, 0, 50.0), (1, 0, 1, 2.0)], "id int, row int, col int, pct double")
    assert sorted(r.value for r in mapalgebra.scale_percent(df, ["id"]).collect()) == [0.02, 0.5]
    with pytest.raises(Exception, match="percents"):
        mapalgebra.scale_percent(df.withColumn("pct", F.col("pct") / 100), ["id"]).collect()
    assert [r.value for r in mapalgebra.scale_percent(df.withColumn("pct", F.col("pct") / 100), ["id"], strict=False).collect()] == [None, None]


def test_combine_modes(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 3.0), ("a", 0, 1, None), ("b", 0, 1, 2.0), ("a", 0, 2, None)], "k string, row int, col int, value double")
    assert grid_of(mapalgebra.combine(df, "max")) == {(0, 0): 3.0, (0, 1): 2.0, (0, 2): None}
    assert grid_of(mapalgebra.combine(df, "mean")) == {(0, 0): 4.0, (0, 1): 2.0, (0, 2): None}


def test_nan_becomes_null_and_safe_add(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    got = columns.nans_to_null(df, "a").select(columns.safe_add(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [1.0, 2.0, None, 3.0]


def test_downscale_strict_drops_the_edge(spark):
    coarse = raster(spark, [[1.0, 2.0]])
    fine = raster(spark, [[0.0] * 7] * 3).select("row", "col")
    loose, strict = grid_of(mapalgebra.downscale(coarse, fine, 3)), grid_of(mapalgebra.downscale(coarse, fine, 3, (1, 2)))
    assert loose[0, 0] == 1.0 and loose[0, 6] is None and strict[0, 0] is None and strict[1, 1] == 1.0


def test_bands_round_trip(spark, tmp_path):
    n = 20
    rows = [(i, j, math.sin(i / 3) * math.cos(j / 3), 20 + 10 * math.sin(i / 3) * math.cos(j / 3)) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "row int, col int, elevation double, temperature double")
    rasters.write_bands(df, str(tmp_path / "b"), ["elevation", "temperature"])
    back = rasters.read_bands(spark, str(tmp_path / "b"), ["elevation", "temperature"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-30, 30), min_size=1, max_size=8))
def test_int16_error_is_half_a_step(spark, values):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "row int, col int, value double")
    assert all(abs(r.decoded - r.value) <= 0.0005 + 1e-9 for r in mapalgebra.pack_int16(df, 0.001).collect())


def test_traits(spark):
    df = spark.createDataFrame([(1, "a b", "x/y", "aquatic", 1.0), (2, "a b", "x/y", "terrestrial", 9.0), (3, "c", None, "aquatic", 3.0)], "species_id long, species string, grp string, habitat string, dispersal_km double")
    clean = traits.clean_strings(df)
    assert [r.grp for r in clean.orderBy("species_id").collect()] == ["x_y", "x_y", "nan"]
    assert traits.lookup(df, "a b", "dispersal_km") == 1.0
    with pytest.raises(LookupError):
        traits.lookup(df, "z", "dispersal_km")
    with pytest.raises(KeyError):
        traits.lookup(df, "c", "colour")
    assert {(r.habitat, r.species_id) for r in traits.species_in_habitat(df).collect()} == {("aquatic", 1), ("aquatic", 2), ("aquatic", 3)}
    stats = {r.grp: r for r in traits.dispersal_stats(df.where("habitat = 'aquatic'")).collect()}
    assert stats["x/y"].d_m == 1000.0 and stats["x/y"].d_m_std is None


def test_file_match_needs_exactly_one(spark):
    t = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "species_id long, species string")
    files = spark.createDataFrame([("reg_a.b_reg_covariate_ensemble.tif",), ("x_c_reg_covariate_ensemble.tif",), ("y_c_reg_covariate_ensemble.tif",), ("c.txt",)], "file string")
    got = {r.species_id: (r.n_files, r.file is not None) for r in traits.match_files(t, files).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (0, False)}


def test_job_counts(spark):
    jobs = traits.job_matrix(traits.group_dimension(spark))
    assert jobs.count() == 34 and traits.tasks(jobs).count() == 56
    assert traits.progress(jobs).agg(F.max("batch"), F.max("percent")).first()[:] == (5, 100)


def test_fill_square_and_touch(spark):
    g = Grid(4, 4, 1.0, 0.0, 4.0)
    rows = [("sq", 0, 1.0, 1.0, 3.0, 1.0), ("sq", 0, 3.0, 1.0, 3.0, 3.0), ("sq", 0, 3.0, 3.0, 1.0, 3.0), ("sq", 0, 1.0, 3.0, 1.0, 1.0)]
    e = spark.createDataFrame(rows, "layer string, geom_id int, x1 double, y1 double, x2 double, y2 double")
    assert {(r.row, r.col) for r in spatial.fill(e, g).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert spatial.polygon_all_touched(e, g).count() == 16  # closed cells touch the square's sides
    point = spark.createDataFrame([("p", 0, 2.0, 2.0, 2.0, 2.0)], e.schema)
    assert spatial.buffered(point, g, 0.8).count() == 4


def test_mask_registry(spark, tmp_path):
    masks = spatial.Masks(spark, str(tmp_path))
    made = []
    masks.register("aquatic", lambda s: made.append(1) or s.createDataFrame([(0, 0)], "row int, col int"))
    assert masks["aquatic"].count() == 1 and masks["aquatic"].count() == 1 and made == [1]
    with pytest.raises(KeyError):
        masks["road"]


def window_total(q, radius, scale, how):
    """K of the definition, by Dijkstra or straight lines over an n x m array."""
    import heapq

    n, m = q.shape
    total = 0.0
    for s in np.ndindex(n, m):
        if isinstance(how, str):
            d = {t: math.hypot(t[0] - s[0], t[1] - s[1]) for t in np.ndindex(n, m)}
        else:
            d, heap = {}, [(0.0, s)]
            while heap:
                x, u = heapq.heappop(heap)
                if u in d:
                    continue
                d[u] = x
                for a, b in connectivity._STEPS:
                    v = (u[0] + a, u[1] + b)
                    if 0 <= v[0] < n and 0 <= v[1] < m and v not in d:
                        heapq.heappush(heap, (x + math.hypot(a, b) * 2 / (how[u] + how[v]), v))
        total += sum(q[s] * q[t] * math.exp(-d[t] * scale) for t in d if abs(t[0] - s[0]) <= radius and abs(t[1] - s[1]) <= radius)
    return total


@pytest.mark.parametrize("how", ["euclid", "lcp_quality", "lcp_permeability"])
def test_sensitivity_is_the_derivative(how):
    r = np.random.default_rng(5)
    q, p, radius, scale, h = r.uniform(0.2, 1, (5, 5)), r.uniform(0.2, 1, (5, 5)), 4, 0.3, 1e-6
    if how == "euclid":
        got = connectivity.quality_sensitivity(q, p, radius, 10, 3, connectivity.STRAIGHT)
    elif how == "lcp_quality":
        got = connectivity.quality_sensitivity(q, p, radius, 10, 3, connectivity.PATHS)
    else:
        got = connectivity.permeability_sensitivity(q, p, radius, 10, 3, connectivity.PATHS)
    for x in [(0, 0), (2, 2), (4, 1)]:
        ends = []
        for sign in (1, -1):
            q2, p2 = q.copy(), p.copy()
            (p2 if how == "lcp_permeability" else q2)[x] += sign * h
            ends.append(window_total(q2, radius, scale, "euclid" if how == "euclid" else p2))
        assert got[x] == pytest.approx((ends[0] - ends[1]) / (2 * h), rel=1e-5)


def test_tiles_give_what_one_array_gives(spark):
    r = np.random.default_rng(9)
    q = r.uniform(0.1, 1, (20, 20))
    q[3:5, 4:9] = np.nan
    df = raster(spark, q.tolist()).where(~F.isnan("value")).select("row", "col", F.col("value").alias("q"), F.lit(3).alias("radius"), F.lit(20.0).alias("alpha"), F.lit(100.0).alias("d_m"))
    for sens, distance, f in (("quality", connectivity.STRAIGHT, connectivity.quality_sensitivity), ("quality", connectivity.PATHS, connectivity.quality_sensitivity), ("permeability", connectivity.PATHS, connectivity.permeability_sensitivity)):
        whole = f(q, q, 3, 100.0, 20.0, distance)
        got = grid_of(connectivity.sensitivity(df, [], sens, distance, tile=7), "sensitivity")
        assert set(got) == {(i, j) for i in range(20) for j in range(20) if not np.isnan(q[i, j])}
        assert max(abs(x - whole[at]) for at, x in got.items()) < 1e-9


def test_a_kernel_of_ones_own(spark):
    """1 / (1 + d): sensitivities are the derivatives of that kernel's K, also where its slope is taken by differences."""
    r = np.random.default_rng(2)
    q, p, h = r.uniform(0.2, 1, (4, 5)), r.uniform(0.2, 1, (4, 5)), 1e-6
    own = connectivity.Proximity(lambda d, dispersal, alpha: 1 / (1 + d * alpha / dispersal))

    def total(q, p):
        return sum(q[s] * q[t] / (1 + 0.5 * d) for (s, t), d in brute_paths({x: p[x] for x in np.ndindex(p.shape)}, 4).items())

    quality, permeability = connectivity.quality_sensitivity(q, p, 4, 4.0, 2.0, connectivity.PATHS, own), connectivity.permeability_sensitivity(q, p, 4, 4.0, 2.0, connectivity.PATHS, own)
    for x in [(0, 0), (2, 3)]:
        for got, which in ((quality, 0), (permeability, 1)):
            ends = []
            for sign in (1, -1):
                both = [q.copy(), p.copy()]
                both[which][x] += sign * h
                ends.append(total(*both))
            assert got[x] == pytest.approx((ends[0] - ends[1]) / (2 * h), rel=1e-5)
    df = raster(spark, p.tolist()).select("row", "col", F.col("value").alias("q"), F.lit(4).alias("radius"), F.lit(2.0).alias("alpha"), F.lit(4.0).alias("d_m"))
    got = grid_of(connectivity.sensitivity(df, [], "quality", kernel=own), "sensitivity")
    want = connectivity.quality_sensitivity(p, p, 4, 4.0, 2.0, connectivity.PATHS, own)
    assert all(x == pytest.approx(want[at]) for at, x in got.items())


def end_to_end():
    class EndToEnd:
        """A distance of one's own: a straight line, the longer the less permeable its two ends are."""

        moves = True

        def distances(self, p, w):
            ends = w.of(p, np.nan) + p[w.rows, w.cols][:, None, None]
            return np.where(np.isnan(ends), np.inf, connectivity.STRAIGHT.offsets(w.radius) * 2 / ends)

        def spread(self, p, w, d, carried):
            ends = w.of(p, np.nan) + p[w.rows, w.cols][:, None, None]
            falls = np.nan_to_num(carried * connectivity.STRAIGHT.offsets(w.radius) * 2 / ends**2)
            gains = falls.copy()
            gains[:, w.radius, w.radius] += falls.sum(axis=(1, 2))
            return gains

    return EndToEnd()


def test_a_distance_of_ones_own(spark):
    """Both sensitivities of a third distance are the derivatives of its K, on one array and in tiles, and a group can be analysed with it."""
    r = np.random.default_rng(3)
    q, p, radius, h = r.uniform(0.2, 1, (6, 5)), r.uniform(0.2, 1, (6, 5)), 3, 1e-6

    def total(q, p):
        far = lambda s, t: math.hypot(s[0] - t[0], s[1] - t[1]) * 2 / (p[s] + p[t])
        cells = list(np.ndindex(p.shape))
        return sum(q[s] * q[t] * math.exp(-far(s, t) * 0.3) for s in cells for t in cells if max(abs(s[0] - t[0]), abs(s[1] - t[1])) <= radius)

    args = (radius, 10.0, 3.0, end_to_end())
    got = connectivity.quality_sensitivity(q, p, *args), connectivity.permeability_sensitivity(q, p, *args)
    for x in [(0, 0), (2, 3), (5, 1)]:
        for which in (0, 1):
            ends = []
            for sign in (1, -1):
                both = [q.copy(), p.copy()]
                both[which][x] += sign * h
                ends.append(total(*both))
            assert got[which][x] == pytest.approx((ends[0] - ends[1]) / (2 * h), rel=1e-5)
    df = raster(spark, p.tolist()).select("row", "col", F.col("value").alias("q"), F.lit(radius).alias("radius"), F.lit(3.0).alias("alpha"), F.lit(10.0).alias("d_m"))
    for sens, of in (("quality", connectivity.quality_sensitivity), ("permeability", connectivity.permeability_sensitivity)):
        tiled = grid_of(connectivity.sensitivity(df, [], sens, end_to_end(), tile=4), "sensitivity")
        assert all(x == pytest.approx(of(p, p, *args)[at]) for at, x in tiled.items()) and len(tiled) == 30
    with pytest.raises(ValueError, match="permeability"):
        connectivity.sensitivity(df, [], "permeability", connectivity.STRAIGHT)
    own = df.select(F.lit("aquatic").alias("habitat"), F.lit("bees").alias("grp"), "row", "col", F.col("q").alias("value"))
    stats, named = spark.createDataFrame([("aquatic", "bees", 25.0)], "habitat string, grp string, d_m double"), spark.createDataFrame([("bees", "ends")], "grp string, distance string")
    out = pipelines.group_elasticity(own, stats, named, mapalgebra.cells(spark, Grid(6, 5)), metrics={"ends": end_to_end()})
    assert {r.sens: r.n for r in out.groupBy("sens").agg(F.count("*").alias("n")).collect()} == {"quality": 30, "permeability": 30}


def test_straight_lines_cost_nothing_more_for_wide_windows():
    """Sums by spectra are those of shifted copies, also where windows are wider than the array, with a kernel of one's own."""
    r = np.random.default_rng(6)
    q = r.uniform(0, 1, (23, 9))
    q[4:6, 2:7] = np.nan
    own = connectivity.Proximity(lambda d, dispersal, alpha: 1 / (1 + d * alpha / dispersal) ** 2)
    for radius in (1, 5, 30):
        got = connectivity.quality_sensitivity(q, q, radius, 10.0, 3.0, connectivity.STRAIGHT, own)
        for s in [(0, 0), (11, 4), (22, 8), (5, 3)]:
            want = 2 * sum(q[t] / (1 + 0.3 * math.hypot(s[0] - t[0], s[1] - t[1])) ** 2 for t in np.ndindex(q.shape) if not np.isnan(q[t]) and max(abs(s[0] - t[0]), abs(s[1] - t[1])) <= radius)
            assert got[s] == pytest.approx(want, rel=1e-9)


def test_tied_paths_share_what_they_carry():
    """On a plain of equal cells the corners' paths are many; each adds its share, so steps carry whole pairs in total."""
    p = np.full((3, 3), 0.5)
    got = connectivity.permeability_sensitivity(p, p, 2, 1.0, 0.1, connectivity.PATHS)
    assert np.allclose(got, got.T) and np.allclose(got, got[::-1]) and got[1, 1] == got.max()
    d = {(s, t): x for (s, t), x in brute_paths({x: 0.5 for x in np.ndindex(3, 3)}, 2).items() if s != t}
    # every step's slope is cost**2 / (2 len) = cost: each pair gives its distance, twice (both ends), whatever way it takes
    assert got.sum() == pytest.approx(sum(2 * 0.25 * 0.1 * math.exp(-0.1 * x) * x for x in d.values()))


def test_window_of_sixteen_cells_in_bounded_memory():
    """The reference radius on a whole tile: within its window every distance is Dijkstra's, and arrays don't grow with the tile."""
    r = np.random.default_rng(4)
    p = r.uniform(0.05, 1, (40, 40))
    some = np.zeros(p.shape, bool)
    some[[0, 20, 39], [0, 17, 39]] = True
    for w in connectivity._windows(p.shape, 16, some):
        d = connectivity.PATHS.distances(p, w)
        assert d.nbytes == len(w.rows) * 33 * 33 * 8
        for i, s in enumerate(zip(w.rows.tolist(), w.cols.tolist(), strict=True)):
            for (_, t), x in brute_paths({x: p[x] for x in np.ndindex(p.shape)}, 16, [s]).items():
                assert d[i, t[0] - s[0] + 16, t[1] - s[1] + 16] == pytest.approx(x, rel=1e-12)


def test_elasticity_of_least_cost_groups(spark):
    sf = "/root/testdata/sf0.001"
    m = mapalgebra.cell_stats(adapters.suitability_pixels(spark, sf), pipelines.KEYS).select("habitat", "grp", "row", "col", F.col("mean_suitability").alias("value"))
    m = m.where("grp = 'STANDARD'")
    full = m.select("habitat", "grp").distinct().crossJoin(mapalgebra.cells(spark, Grid(32, 32))).join(m, ["habitat", "grp", "row", "col"], "left")
    stats = traits.dispersal_stats(adapters.species(spark, sf)).withColumn("d_m", F.lit(25.0))
    out = pipelines.group_elasticity(full, stats, adapters.group_distance(spark, sf), mapalgebra.cells(spark, Grid(32, 32)))
    assert {r.sens for r in out.select("sens").distinct().collect()} == {"quality", "permeability"}
    assert out.where("elasticity < 0").count() == 0
    scores = pipelines.importance(pipelines.sum_sensitivities(out))
    low, high = scores.agg(F.min("value"), F.max("value")).first()
    assert low == 0.0 and high == 1.0


def test_trait_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,species,Dispersal_km,CH3Div.group,CH3Div.scheme\n0,a b,1.5,g/h,aquatic\n")
    assert rasters.read_traits(spark, str(tmp_path / "t.csv")).first().asDict() == {"species_id": 0, "species": "a b", "dispersal_km": 1.5, "grp": "g/h", "habitat": "aquatic"}


def brute_paths(q, radius, sources=None):
    """{(s, t): least cost} by Dijkstra from each cell, inside its window."""
    out, steps = {}, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    for s in sources or q:
        heap, done = [(0.0, s)], {}
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = d
            for a, b in steps:
                v = (u[0] + a, u[1] + b)
                if v in q and v not in done and max(abs(v[0] - s[0]), abs(v[1] - s[1])) <= radius:
                    heapq.heappush(heap, (d + math.hypot(a, b) * 2 / (q[u] + q[v]), v))
        out.update({(s, t): d for t, d in done.items()})
    return out


def brute_permeability(q, radius, scale):
    """Each pair's path walked back from its end, by the source's own distances; quality here has no tied paths."""
    total = dict.fromkeys(q, 0.0)
    for s in q:
        far = {t: d for (_, t), d in brute_paths(q, radius, [s]).items()}
        before = {}
        for v in far:
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    u = (v[0] + a, v[1] + b)
                    if u != v and u in far and abs(far[u] + math.hypot(a, b) * 2 / (q[u] + q[v]) - far[v]) < 1e-9:
                        before.setdefault(v, []).append(u)
        for t, d in far.items():
            share = {t: q[s] * q[t] * math.exp(-d * scale) * scale}
            while t != s and share:
                v = max(share, key=far.get)
                carried = share.pop(v)
                if v == s:
                    continue
                paths = {u: count_paths(u, s, before) for u in before[v]}
                for u in before[v]:
                    part = carried * paths[u] / sum(paths.values())
                    gain = part * 2 * math.hypot(u[0] - v[0], u[1] - v[1]) / (q[u] + q[v]) ** 2
                    total[u] += gain
                    total[v] += gain
                    share[u] = share.get(u, 0.0) + part
    return total


def count_paths(u, s, before):
    return 1 if u == s else sum(count_paths(x, s, before) for x in before[u])


def test_whole_least_cost_queries_against_brute_force(spark):
    """Every least-cost raster is there, with its own radius and paths of any number of steps."""
    queries = importlib.import_module("__spark_entry__").queries()
    got = {n: {(r.habitat, r.grp, r.row, r.col): r for r in queries[n](spark, SMOKE).collect()} for n in ("lcp_distance", "sensitivity_lcp_quality", "sensitivity_lcp_permeability")}
    rasters = {}
    for r in catalog._paths(spark, SMOKE).collect():
        rasters.setdefault((r.habitat, r.grp), (r.radius, r.alpha / r.d_m, {}))[2][r.row, r.col] = r.q
    assert {g for _, g in rasters} == {"LARGE", "MEDIUM", "SMALL", "STANDARD"} and len(rasters) == 8 and {r for r, _, _ in rasters.values()} <= {15, 16}
    assert all(len(rows) == sum(len(q) for _, _, q in rasters.values()) for rows in got.values())
    small = min(rasters, key=lambda k: len(rasters[k][2]))
    for key, (radius, scale, q) in rasters.items():
        some = sorted(q)[::37]
        of = {s: [] for s in some}
        for (s, t), d in brute_paths(q, radius, some).items():
            of[s].append((t, d))
        for s in some:
            assert got["lcp_distance"][*key, *s].reached == len(of[s])
            assert got["lcp_distance"][*key, *s].distance_sum == pytest.approx(sum(d for _, d in of[s]), rel=1e-9, abs=1e-5)
            assert got["sensitivity_lcp_quality"][*key, *s].sensitivity == pytest.approx(2 * sum(q[t] * math.exp(-d * scale) for t, d in of[s]), abs=1e-5)
        if key == small:
            for s, v in brute_permeability(q, radius, scale).items():
                assert got["sensitivity_lcp_permeability"][*key, *s].sensitivity == pytest.approx(v, rel=1e-7, abs=1e-5)


def test_whole_group_elasticity(spark):
    """Every group and sensitivity is there, from padded suitability rasters: one straight-line and one least-cost raster against brute force."""
    whole = importlib.import_module("__spark_entry__").queries()["group_elasticity"](spark, SMOKE).collect()
    kinds = {(r.grp, r.sens) for r in whole}
    assert kinds == {(g, "quality") for g in ("ECONOMY", "PROMO", "LARGE", "MEDIUM", "SMALL", "STANDARD")} | {(g, "permeability") for g in ("LARGE", "MEDIUM", "SMALL", "STANDARD")}
    pixels = {}
    suitability, metadata = catalog._suitability(spark, SMOKE)
    for r in suitability.collect():
        pixels.setdefault((r.habitat, r.grp), {})[r.row, r.col] = r.mean_suitability
    stats = {(r.habitat, r.grp): r.d_m for r in metadata.collect()}
    border = {(r.row, r.col) for r in catalog._border(spark).collect()}
    size = lambda k: len(pixels[k]) / max(1, math.ceil(stats[k] * 0.2 / 25)) ** 2
    for key, straight in ((min((k for k in pixels if k[1] == "PROMO"), key=size), True), (min((k for k in pixels if k[1] == "SMALL"), key=size), False)):
        cells, d_m = pixels[key], stats[key]
        resolution = max(25.0, d_m * 0.2)
        f, radius = math.ceil(resolution / 25), math.ceil(3.0 * d_m / resolution)
        top, left = min(r for r, _ in cells), min(c for _, c in cells)
        height, width = max(r for r, _ in cells) - top + 1, max(c for _, c in cells) - left + 1
        q = {}
        for i in range(height // f):
            for j in range(width // f):
                some = [v for a in range(f) for b in range(f) if (v := cells.get((top + i * f + a, left + j * f + b))) is not None]
                q[i, j] = sum(some) / len(some) if some and sum(some) else 1e-5
        alpha = resolution if straight else resolution * sum(q.values()) / len(q)
        some = sorted(q)[:: 1 if straight else 29]
        far = {(s, t): math.hypot(s[0] - t[0], s[1] - t[1]) for s in some for t in q if max(abs(s[0] - t[0]), abs(s[1] - t[1])) <= radius} if straight else brute_paths(q, radius, some)
        want = dict.fromkeys(some, 0.0)
        for (s, t), d in far.items():
            want[s] += 2 * q[t] * math.exp(-d * alpha / d_m)
        got = {(r.row, r.col): r.elasticity for r in whole if (r.habitat, r.grp, r.sens) == (*key, "quality")}
        half, checked = (f - 1) / 2, 0
        for (r, c), v in cells.items():
            i, j = r - top, c - left
            inside = half <= i <= height - height % f - 1 - half and half <= j <= width - width % f - 1 - half
            if v is None or (r, c) not in border or not inside:
                assert (r, c) not in got
            elif (i // f, j // f) in want:
                assert got[r, c] == pytest.approx(v * want[i // f, j // f], rel=1e-6, abs=1e-5)
                checked += 1
        assert checked > 10


def test_importance_scores_end_to_end(spark):
    """Scores are those of the written and re-read elasticities: log, 0-1 by group, maximum, 0-1, then both habitats."""
    got = importlib.import_module("__spark_entry__").queries()["importance_scores"](spark, SMOKE).collect()
    summed = {}
    for r in catalog._elasticity(spark, SMOKE).collect():
        cell = summed.setdefault((r.habitat, r.grp), {}).setdefault((r.row, r.col), [])
        cell.append(r.elasticity)
    least = lambda g: 1 if g in ("ECONOMY", "PROMO") else 2
    unit = lambda x: {k: (v - min(x.values())) / (max(x.values()) - min(x.values())) for k, v in x.items()}
    habitats = {}
    for (h, g), cells in summed.items():
        logs = {k: math.log(sum(v) + 1e-5) for k, v in cells.items() if len(v) == least(g) and None not in v}
        for k, v in unit(logs).items():
            best = habitats.setdefault(h, {})
            best[k] = max(v, best.get(k, 0.0))
    habitats = {h: unit(x) for h, x in habitats.items()}
    both = {}
    for x in habitats.values():
        for k, v in x.items():
            both[k] = max(v, both.get(k, 0.0))
    want = habitats | {"aquatic_terrestrial": unit(both)}
    have = {}
    for r in got:
        if r.value is not None:
            have.setdefault(r.habitat, {})[r.row, r.col] = r.value
    assert {h: len(x) for h, x in have.items()} == {h: len(x) for h, x in want.items()}
    assert all(have[h][k] == pytest.approx(v, abs=2e-6) for h, x in want.items() for k, v in x.items())


def test_an_analysis_run_is_written_and_read_back(spark, tmp_path):
    """Two groups' rasters through elasticities on disk to scores on disk; metadata beside them."""
    m = cut(catalog._means(spark, SMOKE).where("grp in ('PROMO', 'SMALL')").select("habitat", "grp", "row", "col", F.col("mean_suitability").alias("value")))
    stats = traits.dispersal_stats(adapters.species(spark, SMOKE)).withColumn("d_m", F.lit(50.0))
    distances, border, config = adapters.group_distance(spark, SMOKE), catalog._border(spark), Config(run_id="abc", results_root=str(tmp_path))
    got = pipelines.run_analysis(spark, m, stats, distances, border, str(tmp_path), config=config)
    want = pipelines.importance_scores(cut(pipelines.group_elasticity(m, stats, distances, border, config=config)), config=config)
    values = lambda df: {(r.habitat, r.row, r.col): r.value for r in df.collect()}
    have, wanted = values(got), values(want)
    assert set(have) == set(wanted) and {h for h, _, _ in have} == {"aquatic", "terrestrial", "aquatic_terrestrial"}
    assert all(x == pytest.approx(wanted[k], abs=1e-6) for k, x in have.items())
    rasters.write_report(pipelines.metadata_report(adapters.species(spark, SMOKE), distances), str(tmp_path / "metadata"))
    assert spark.read.csv(str(tmp_path / "metadata"), header=True).columns == ["grp", "habitat", "species_number", "distance", "median_dispersal_km", "std_dispersal_km"]


def test_scores_are_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("aquatic", 0, 0, 0.1), ("aquatic", 0, 1, None), ("aquatic_terrestrial", 0, 0, 1.0)], "habitat string, row int, col int, value double")
    rasters.write_scores(df, str(tmp_path / "s"), "abc", "max")
    back = {(r.habitat, r.row, r.col): r.value for r in rasters.read_scores(spark, str(tmp_path / "s"), "abc", "max").collect()}
    assert back["aquatic", 0, 1] is None and back["aquatic", 0, 0] == pytest.approx(0.1, rel=1e-6) and len(back) == 3
    assert rasters.read_scores(spark, str(tmp_path / "s"), "abc", "mean").count() == 0
    joined = mapalgebra.elementwise([df.where("habitat = 'aquatic'"), df.where("habitat <> 'aquatic'")], columns.safe_add, how="full")
    assert grid_of(joined) == {(0, 0): 1.1, (0, 1): None}
    assert mapalgebra.single_band(df.withColumn("band", F.lit(1))).columns == df.columns
    assert "band" in mapalgebra.single_band(df.withColumn("band", F.col("col"))).columns
    report = spark.createDataFrame([("a b", 1.5)], "species string, dispersal_range_km double")
    rasters.write_report(report, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).collect()[0][:] == ("a b", "1.5")


def test_plain_text_grids(spark, tmp_path):
    (tmp_path / "reg_a.asc").write_text("ncols 3\nnrows 2\nxllcorner 100\nyllcorner 50\ncellsize 25\nNODATA_value -9999\n10 20 -9999\n40 x 60\n\n")
    got = rasters.read_grids(spark, str(tmp_path), 0.1, 1.0).collect()
    assert {(r.row, r.col): r.value for r in got} == {(0, 0): 2.0, (0, 1): 3.0, (0, 2): None, (1, 0): 5.0, (1, 1): None, (1, 2): 7.0}
    assert {(r.file, r.xll, r.yll, r.cellsize) for r in got} == {("reg_a.asc", 100.0, 50.0, 25.0)}


def test_guards():
    with pytest.raises(ValueError, match="square"):
        Grid(2, 2, 25.0, resolution_y=30.0).square()
    Grid(2, 2).require("EPSG:2056", 25.0)
    with pytest.raises(ValueError, match="EPSG"):
        Grid(2, 2).require("EPSG:4326", 25.0)
    with pytest.raises(ValueError, match="cells"):
        Grid(2, 2).require("EPSG:2056", 100.0)
    assert Config(results_root="/r", run_id="x").path("a", results=True) == "/r/x/a"
    with pytest.raises(ValueError, match="data_root"):
        Config().path("a")


def test_groups_without_species_or_rasters_stop(spark):
    species = spark.createDataFrame([("a", "bees"), ("b", "birds")], "species string, grp string")
    pipelines.require_species(species, species, ["bees", "birds"])
    with pytest.raises(LookupError, match="no species"):
        pipelines.require_species(species, species, ["bees", "fishes"])
    with pytest.raises(LookupError, match="no rasters"):
        pipelines.require_species(species, species.where("grp = 'bees'"), ["birds"])


def test_whole_available_species_against_brute_force(spark, tmp_path):
    """Bare names of every id are matched, also those that only one file ends in."""
    names = ["red moss", "red moss", "blue fern", "tall oak", "old tall oak", "grey ash", "grey ash"]
    rows = [(i, n, "SMALL", 10) for i, n in enumerate(names, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in importlib.import_module("__spark_entry__").queries()["available_species"](spark, str(tmp_path)).collect()}
    files = [f"p{i}_{n.replace(' ', '.')}_reg_covariate_ensemble.tif" for i, n in enumerate(names, 1)]
    want = set()
    for i, n in enumerate(names, 1):
        for name in (n, f"p{i}_{n}"):
            fits = [f for f in files if f.endswith(name.replace(" ", ".") + "_reg_covariate_ensemble.tif")]
            if len(fits) == 1:
                want.add((i, name, fits[0]))
    assert got == want and (5, "old tall oak", files[4]) in got and (4, "tall oak") not in {r[:2] for r in got}


def test_states_merge(spark):
    """Halves, in either order, and three parts give what all pixels give; tiny deviations around a large mean are kept; missing values and cells of one part only."""
    r = np.random.default_rng(8)
    rows = [(int(i % 3), int(r.integers(0, 4)), int(r.integers(0, 4)), None if r.random() < 0.1 else 1e6 + float(r.normal()) * 1e-3, int(r.integers(0, 3))) for i in range(300)]
    rows += [(0, 9, 9, None, 0), (0, 9, 9, None, 1), (1, 8, 8, 5.0, 2)]
    df = spark.createDataFrame(rows, "k int, row int, col int, value double, part int")
    part = [mapalgebra.cell_state(df.where(f"part = {n}"), ["k"]) for n in range(3)]
    want = {}
    for k, i, j, v, _ in rows:
        want.setdefault((k, i, j), []).extend([] if v is None else [v])
    for order in ((0, 1, 2), (2, 1, 0)):
        a, b, c = (part[n] for n in order)
        got = mapalgebra.state_stats(mapalgebra.merged_states(mapalgebra.merged_states(a, b, ["k"]), c, ["k"])).collect()
        assert len(got) == len(want)
        for x in got:
            some = want[x.k, x.row, x.col]
            assert x.valid_count == len(some)
            assert x.mean_suitability == (pytest.approx(np.mean(some), rel=1e-12) if some else None)
            assert x.std_suitability == (pytest.approx(np.std(some), rel=1e-6, abs=1e-12) if some else None)
    empty = mapalgebra.cell_state(df.limit(0), ["k"])
    assert mapalgebra.merged_states(empty, part[0], ["k"]).count() == part[0].count()
