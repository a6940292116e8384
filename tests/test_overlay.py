"""Overlay of polygons against plain Python in exact numbers."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cairnmesh.config import Grid
from cairnmesh.operators import overlay, spatial
from cairnmesh.sources import adapters

EDGES = "layer string, geom_id int, x1 double, y1 double, x2 double, y2 double"


def ring(layer, geom, points):
    return [(layer, geom, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1], strict=True)]


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def exact_area(rows, keep, drop):
    """Slabs between all ends and crossings of all edges, in fractions."""
    e = [(layer, geom, *[Fraction(v) for v in c]) for layer, geom, *c in rows if layer in keep | drop]
    e = [(layer, geom, x1, y1, x2, y2) if y1 < y2 else (layer, geom, x2, y2, x1, y1) for layer, geom, x1, y1, x2, y2 in e if y1 != y2]
    ys = {y for r in e for y in (r[3], r[5])}
    for i, a in enumerate(e):
        for b in e[:i]:
            sa, sb = (a[4] - a[2]) / (a[5] - a[3]), (b[4] - b[2]) / (b[5] - b[3])
            if sa != sb:
                y = ((b[2] - sb * b[3]) - (a[2] - sa * a[3])) / (sa - sb)
                if max(a[3], b[3]) < y < min(a[5], b[5]):
                    ys.add(y)
    total, ys = Fraction(0), sorted(ys)
    for y0, y1 in zip(ys, ys[1:], strict=False):
        mid = (y0 + y1) / 2
        at = sorted((r[2] + (mid - r[3]) / (r[5] - r[3]) * (r[4] - r[2]), r[0], r[1]) for r in e if r[3] <= y0 and r[5] >= y1)
        inside = set()
        for (x, *own), (to, *_) in zip(at, at[1:], strict=False):
            inside ^= {tuple(own)}
            if any(o[0] in keep for o in inside) and not any(o[0] in drop for o in inside):
                total += (to - x) * (y1 - y0)
    return float(total)


SHAPES = {
    "overlapping": ring("a", 0, square(0, 0, 100)) + ring("a", 1, square(50, 50, 100)) + ring("b", 0, square(80, 80, 40)),
    "holed": ring("a", 0, square(0, 0, 300)) + ring("a", 0, square(100, 100, 100)) + ring("a", 1, square(120, 120, 30)) + ring("b", 0, [(0, 0), (300, 0), (0, 300)]),
    "same twice": ring("a", 0, square(10, 10, 50)) + ring("a", 1, square(10, 10, 50)) + ring("b", 0, square(10, 10, 50)),
    "touching": ring("a", 0, square(0, 0, 50)) + ring("a", 1, square(50, 0, 50)) + ring("b", 0, square(0, 50, 50)),
    "star": ring("a", 0, [(0, 0), (200, 90), (-50, 90), (150, 0), (75, 150)]) + ring("b", 5, [(20, 20), (90, 30), (60, 140)]),
}


def random_shapes(seed):
    r = random.Random(seed)
    rows = []
    for layer in ("a", "b"):
        for g in range(6):
            x, y = r.uniform(-300, 300), r.uniform(-300, 300)
            rows += ring(layer, g, [(x + r.uniform(-150, 150), y + r.uniform(-150, 150)) for _ in range(r.randrange(3, 8))])
    return rows


@pytest.mark.parametrize("name", [*SHAPES, 1, 2, 3])
def test_areas(spark, name):
    rows = SHAPES[name] if name in SHAPES else random_shapes(name)
    df = spark.createDataFrame(rows, EDGES)
    for keep, drop in (({"a"}, set()), ({"a", "b"}, set()), ({"a"}, {"b"})):
        want = exact_area(rows, keep, drop)
        for height in (37.0, 1000.0):
            got = overlay.area(overlay.overlay(df, sorted(keep), sorted(drop), height)).first().area
            assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_masks_at_two_resolutions(spark):
    """Country without lakes, as edges again: cells by their centres are those of the country less those of the lakes, at any resolution."""
    edges = adapters.edges(spark, "country", "lake")
    land = overlay.outlines(overlay.overlay(edges, ["country"], ["lake"], 60.0), "land")
    for grid in (Grid(32, 32), Grid(80, 80, 10.0)):
        cells = {(r.row, r.col) for r in spatial.fill(land, grid).collect()}
        of = lambda layer: {(r.row, r.col) for r in spatial.fill(edges.where(F.col("layer") == layer), grid).collect()}
        assert cells == of("country") - of("lake") and len(cells) > 500


def test_empty_and_level(spark):
    none = spark.createDataFrame([], EDGES)
    assert overlay.overlay(none, ["a"]).count() == 0 and overlay.area(overlay.overlay(none, ["a"])).first().area == 0.0
    flat = spark.createDataFrame(ring("a", 0, [(0, 5), (10, 5), (20, 5)]), EDGES)
    assert overlay.overlay(flat, ["a"]).count() == 0
