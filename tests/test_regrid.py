"""Projections against an independent plain-Python one, reprojection and grid matching against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairnmesh.config import Grid
from cairnmesh.functions import projections
from cairnmesh.operators import regrid


def isometric(lat, e):
    return math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))


def geodetic(x, y, z, a, e2):
    """Longitude and latitude of a point in space, by iteration until nothing changes."""
    p, lat = math.hypot(x, y), math.atan2(z, math.hypot(x, y))
    for _ in range(50):
        n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
        h = p / math.cos(lat) - n
        lat = math.atan2(z, p * (1 - e2 * n / (n + h)))
    return math.atan2(y, x), lat


def swiss(lon, lat):
    """Degrees of WGS 84 to the Swiss system, by vectors: the sphere is turned so that the origin lies on the equator."""
    lon, lat = math.radians(lon), math.radians(lat)
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    lon, lat = geodetic(n * math.cos(lat) * math.cos(lon) - 674.374, n * math.cos(lat) * math.sin(lon) - 15.056, n * (1 - e2) * math.sin(lat) - 405.346, 6377397.155, 0.006674372230614)
    return bessel(lon, lat)


def bessel(lon, lat):
    a, e2 = 6377397.155, 0.006674372230614
    e, lat0, lon0 = math.sqrt(e2), math.radians(46 + 57 / 60 + 8.66 / 3600), math.radians(7 + 26 / 60 + 22.5 / 3600)
    r = a * math.sqrt(1 - e2) / (1 - e2 * math.sin(lat0) ** 2)
    alpha = math.sqrt(1 + e2 / (1 - e2) * math.cos(lat0) ** 4)
    b0 = math.asin(math.sin(lat0) / alpha)
    b = math.asin(math.tanh(alpha * (isometric(lat, e) - isometric(lat0, e)) + math.atanh(math.sin(b0))))
    turn = alpha * (lon - lon0)
    x, y, z = math.cos(b) * math.cos(turn), math.cos(b) * math.sin(turn), math.sin(b)
    u, w = x * math.cos(b0) + z * math.sin(b0), z * math.cos(b0) - x * math.sin(b0)
    return 2600000 + r * math.atan2(y, u), 1200000 + r * math.atanh(w)


def points(n=200):
    r = random.Random(5)
    return [(r.uniform(5.5, 11.0), r.uniform(45.5, 48.2)) for _ in range(n)]


def test_swiss_to_a_millimetre(spark):
    some = points()
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(some)], "i int, x double, y double")
    there = projections.converted(df, "EPSG:4326", "EPSG:2056")
    back = {r.i: (r.x, r.y) for r in projections.converted(there, "EPSG:2056", "EPSG:4326").collect()}
    for r in there.collect():
        want = swiss(*some[r.i])
        assert (r.x, r.y) == (pytest.approx(want[0], abs=1e-3), pytest.approx(want[1], abs=1e-3))
        assert projections.convert(*some[r.i], "EPSG:4326", "EPSG:2056") == (pytest.approx(r.x, abs=1e-6), pytest.approx(r.y, abs=1e-6))
        # heights are 0 on either ellipsoid, which moves a point by some tenths of a millimetre on the way back
        assert back[r.i] == (pytest.approx(some[r.i][0], abs=2e-8), pytest.approx(some[r.i][1], abs=2e-8))


def test_published_point():
    """The Rigi's published coordinates on the Bessel ellipsoid and on the map."""
    at = projections.PROJECTIONS["EPSG:2056"]
    lon, lat = math.radians(8 + 29 / 60 + 11.11127 / 3600), math.radians(47 + 3 / 60 + 28.95659 / 3600)
    got = projections.taken(lon, lat, at.mapped())
    assert got == (pytest.approx(2679520.05, abs=0.01), pytest.approx(1212273.44, abs=0.01))
    assert projections.taken(*got, at.unmapped()) == (pytest.approx(lon, abs=1e-13), pytest.approx(lat, abs=1e-13))
    assert projections.convert(2679520.05, 1212273.44, "EPSG:2056", "EPSG:21781") == (pytest.approx(679520.05, abs=1e-3), pytest.approx(212273.44, abs=1e-3))


def test_web_mercator():
    for lon, lat in points(20):
        x, y = projections.convert(lon, lat, "EPSG:4326", "EPSG:3857")
        assert (x, y) == (pytest.approx(math.radians(lon) * 6378137.0), pytest.approx(6378137.0 * math.asinh(math.tan(math.radians(lat)))))
        assert projections.convert(x, y, "EPSG:3857", "EPSG:4326") == (pytest.approx(lon), pytest.approx(lat))
    with pytest.raises(ValueError, match="EPSG:1"):
        projections.convert(0.0, 0.0, "EPSG:1", "EPSG:2056")


SOURCE = Grid(12, 9, 25.0, 2_600_000.0, 1_200_000.0)


def rasters(spark):
    rows = [(k, r, c, k * 1000.0 + r * 9 + c if (r, c) != (4, 4) else None) for k in (1, 2) for r in range(12) for c in range(9) if (r + c) % 11]
    return spark.createDataFrame(rows, "k int, row int, col int, value double"), {(k, r, c): v for k, r, c, v in rows}


def centre(grid, r, c):
    return grid.x0 + (c + 0.5) * grid.resolution, grid.y0 - (r + 0.5) * grid.resolution


@pytest.mark.parametrize("crs,resolution", [("EPSG:3857", 30.0), ("EPSG:3857", 9.0), ("EPSG:4326", 0.0002), ("EPSG:21781", 25.0)])
def test_reprojected(spark, crs, resolution):
    df, held = rasters(spark)
    target = regrid.projected_grid(SOURCE, crs, resolution)
    got = {(r.k, r.row, r.col): r.value for r in regrid.regrid(df, SOURCE, target, ["k"]).collect()}
    want = {}
    for r in range(target.height):
        for c in range(target.width):
            x, y = projections.convert(*centre(target, r, c), crs, "EPSG:2056")
            at = math.floor((SOURCE.y0 - y) / 25), math.floor((x - SOURCE.x0) / 25)
            want |= {(k, r, c): held[k, *at] for k in (1, 2) if (k, *at) in held}
    assert got == want and len(got) > 40
    # the outline is held whole
    for x, y in ((0, 0), (225, 0), (0, 300), (225, 300), (111, 0), (0, 137)):
        px, py = projections.convert(SOURCE.x0 + x, SOURCE.y0 - y, "EPSG:2056", crs)
        assert target.x0 <= px <= target.x0 + target.width * resolution and target.y0 - target.height * resolution <= py <= target.y0


@pytest.mark.parametrize("target", [Grid(40, 30, 7.0, 2_600_003.0, 1_199_999.0), Grid(5, 4, 61.0, 2_599_990.0, 1_200_020.0), Grid(12, 9, 25.0, 2_600_000.0, 1_200_000.0), Grid(3, 3, 25.0, 2_700_000.0, 1_200_000.0)])
def test_other_origin_and_resolution(spark, target):
    df, held = rasters(spark)
    got = {(r.k, r.row, r.col): r.value for r in regrid.regrid(df, SOURCE, target, ["k"]).collect()}
    want = {}
    for r in range(target.height):
        for c in range(target.width):
            x, y = centre(target, r, c)
            at = math.floor((SOURCE.y0 - y) / 25), math.floor((x - SOURCE.x0) / 25)
            want |= {(k, r, c): held[k, *at] for k in (1, 2) if (k, *at) in held}
    assert got == want


def test_bilinear(spark):
    df, held = rasters(spark)
    target = Grid(20, 20, 10.0, 2_600_000.0, 1_200_000.0)
    got = {(r.k, r.row, r.col): r.value for r in regrid.regrid(df, SOURCE, target, ["k"], method="bilinear").collect()}
    for (k, r, c), v in got.items():
        x, y = centre(target, r, c)
        u, w = (SOURCE.y0 - y) / 25 - 0.5, (x - SOURCE.x0) / 25 - 0.5
        near = [(1 - abs(i - u), 1 - abs(j - w), held.get((k, i, j))) for i in (math.floor(u), math.floor(u) + 1) for j in (math.floor(w), math.floor(w) + 1)]
        near = [(a * b, x) for a, b, x in near if x is not None and a * b > 0]
        assert v == (pytest.approx(sum(a * x for a, x in near) / sum(a for a, _ in near)) if near else None)
    assert len(got) > 600
    with pytest.raises(ValueError, match="cubic"):
        regrid.regrid(df, SOURCE, target, ["k"], method="cubic")


def test_labels(spark):
    """Irregular axes, labels out of range, ties and repeated labels."""
    xs, ys = [0.0, 1.0, 4.0, 10.0], [5.0, 3.0, -2.0]
    df = spark.createDataFrame([(x, y, x * 100 + y) for x in xs for y in ys], "x double, y double, value double")
    tx, ty = [-1.0, 0.5, 2.5, 2.6, 7.0, 9.9, 10.0, 10.1, 0.5], [5.0, 4.0, 0.5, 6.0]
    axis = lambda some: spark.createDataFrame([(v,) for v in some], "label double")
    got = {(r.x, r.y): r.value for r in regrid.match_labels(df, axis(tx), axis(ty)).collect()}
    near = lambda v, some: min(some, key=lambda s: (abs(s - v), s))
    want = {(x, y): near(x, xs) * 100 + near(y, ys) for x in set(tx) for y in ty if 0 <= x <= 10 and -2 <= y <= 5}
    assert got == want
    assert regrid.match_labels(df.limit(0), axis(tx), axis(ty)).count() == 0


def test_no_python_in_the_plan(spark):
    df, _ = rasters(spark)
    plan = regrid.regrid(df, SOURCE, regrid.projected_grid(SOURCE, "EPSG:3857", 30.0), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_converted_keeps_other_columns(spark):
    df = spark.createDataFrame([(7.4, 46.9, "a")], "x double, y double, name string")
    got = projections.converted(df.select("name", "x", "y"), "EPSG:4326", "EPSG:2056")
    assert got.columns == ["name", "x", "y"] and got.where(F.col("x") > 2_000_000).count() == 1
