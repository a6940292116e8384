"""Map projections in closed form, on tables of points or on plain numbers.

Every projection maps (longitude, latitude) in degrees of WGS 84 to metres and
back. It is a list of steps, each of which makes a few values of those before
it; steps are written once over a small set of functions (`Maths`), of which
there is one for Spark columns and one for Python's floats, for bounds and
tests. Heights are 0 on the source's ellipsoid. Latitudes that have no closed
form are found by a fixed number of steps, each of which gains more than two digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Maths:
    sin: Any
    cos: Any
    tan: Any
    asin: Any
    atan: Any
    atan2: Any
    log: Any
    exp: Any
    sqrt: Any


COLUMNS = Maths(F.sin, F.cos, F.tan, F.asin, F.atan, F.atan2, F.log, F.exp, F.sqrt)
FLOATS = Maths(math.sin, math.cos, math.tan, math.asin, math.atan, math.atan2, math.log, math.exp, math.sqrt)

#: Values by name (x and y are the point) and functions -> new values.
Step = Callable[[Any, Maths], dict[str, Any]]

RAD = math.pi / 180
#: Steps of the latitude of the conformal sphere: the error falls by e**2 (0.0067) each time, from 0.2 degrees to below a nanometre.
STEPS = 6


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    e2: float


# Ellipsoids, the datum shift from WGS 84 (metres), and the constants of the Swiss projection.
WGS84 = Ellipsoid(6378137.0, 2 / 298.257223563 - (1 / 298.257223563) ** 2)
BESSEL = Ellipsoid(6377397.155, 0.006674372230614)
SWISS_SHIFT = (674.374, 15.056, 405.346)
SWISS_LAT, SWISS_LON = (46 + 57 / 60 + 8.66 / 3600) * RAD, (7 + 26 / 60 + 22.50 / 3600) * RAD


def shifted(source: Ellipsoid, target: Ellipsoid, shift: tuple[float, float, float]) -> list[Step]:
    """Radians on one ellipsoid to those on another whose centre lies `shift` metres away (coordinates there are less by the shift)."""
    b, e2 = target.a * math.sqrt(1 - target.e2), target.e2

    def normal(v, m):
        sin = m.sin(v["y"])
        return {"__n": source.a / m.sqrt(1 - source.e2 * sin * sin)}

    def space(v, m):
        flat = v["__n"] * m.cos(v["y"])
        return {"__gx": flat * m.cos(v["x"]) - shift[0], "__gy": flat * m.sin(v["x"]) - shift[1], "__gz": v["__n"] * (1 - source.e2) * m.sin(v["y"]) - shift[2]}

    def axis(v, m):
        return {"__p": m.sqrt(v["__gx"] * v["__gx"] + v["__gy"] * v["__gy"])}

    def tilt(v, m):
        angle = m.atan2(v["__gz"] * target.a, v["__p"] * b)
        return {"__up": m.sin(angle), "__down": m.cos(angle)}

    def back(v, m):
        up, down = v["__up"], v["__down"]
        return {"x": m.atan2(v["__gy"], v["__gx"]), "y": m.atan2(v["__gz"] + e2 / (1 - e2) * b * up * up * up, v["__p"] - e2 * target.a * down * down * down)}

    return [normal, space, axis, tilt, back]


class Geographic:
    """Longitude and latitude themselves."""

    forward: list[Step] = []
    inverse: list[Step] = []


class WebMercator:
    """The sphere of WGS 84's greater axis on Mercator's map."""

    forward: list[Step] = [lambda v, m: {"x": v["x"] * (RAD * WGS84.a), "y": m.log(m.tan(v["y"] * (RAD / 2) + math.pi / 4)) * WGS84.a}]
    inverse: list[Step] = [lambda v, m: {"x": v["x"] / (RAD * WGS84.a), "y": (m.atan(m.exp(v["y"] / WGS84.a)) - math.pi / 4) * (2 / RAD)}]


class SwissOblique:
    """The Bessel ellipsoid conformally on a sphere, that on an oblique cylinder; `east` and `north` are the origin's coordinates."""

    def __init__(self, east: float, north: float):
        self.east, self.north = east, north
        e2, sin, cos = BESSEL.e2, math.sin(SWISS_LAT), math.cos(SWISS_LAT)
        self.e = math.sqrt(e2)
        self.radius = BESSEL.a * math.sqrt(1 - e2) / (1 - e2 * sin * sin)
        self.alpha = math.sqrt(1 + e2 / (1 - e2) * cos**4)
        self.b0 = math.asin(sin / self.alpha)
        grow = math.log((1 + self.e * sin) / (1 - self.e * sin))
        self.k = math.log(math.tan(math.pi / 4 + self.b0 / 2)) - self.alpha * math.log(math.tan(math.pi / 4 + SWISS_LAT / 2)) + self.alpha * self.e / 2 * grow
        radians: Step = lambda v, m: {"x": v["x"] * RAD, "y": v["y"] * RAD}
        degrees: Step = lambda v, m: {"x": v["x"] / RAD, "y": v["y"] / RAD}
        self.forward = [radians, *shifted(WGS84, BESSEL, SWISS_SHIFT), *self.mapped()]
        self.inverse = [*self.unmapped(), *shifted(BESSEL, WGS84, tuple(-s for s in SWISS_SHIFT)), degrees]

    def mapped(self) -> list[Step]:
        """Radians on the Bessel ellipsoid to metres."""
        sin0, cos0 = math.sin(self.b0), math.cos(self.b0)

        def sphere(v, m):
            es = m.sin(v["y"]) * self.e
            s = m.log(m.tan(v["y"] / 2 + math.pi / 4)) * self.alpha - m.log((1 + es) / (1 - es)) * (self.alpha * self.e / 2) + self.k
            return {"__b": (m.atan(m.exp(s)) - math.pi / 4) * 2, "__l": (v["x"] - SWISS_LON) * self.alpha}

        def oblique(v, m):
            across = m.atan2(m.sin(v["__l"]), m.tan(v["__b"]) * sin0 + m.cos(v["__l"]) * cos0)
            return {"__a": across, "__s": m.sin(v["__b"]) * cos0 - m.cos(v["__b"]) * m.cos(v["__l"]) * sin0}

        return [sphere, oblique, lambda v, m: {"x": v["__a"] * self.radius + self.east, "y": m.log((1 + v["__s"]) / (1 - v["__s"])) * (self.radius / 2) + self.north}]

    def unmapped(self) -> list[Step]:
        """Metres to radians on the Bessel ellipsoid."""
        sin0, cos0 = math.sin(self.b0), math.cos(self.b0)

        def cylinder(v, m):
            return {"__a": (v["x"] - self.east) / self.radius, "__u": (m.atan(m.exp((v["y"] - self.north) / self.radius)) - math.pi / 4) * 2}

        def upright(v, m):
            turn = m.atan2(m.sin(v["__a"]), m.cos(v["__a"]) * cos0 - m.tan(v["__u"]) * sin0)
            return {"y": m.asin(m.sin(v["__u"]) * cos0 + m.cos(v["__u"]) * m.cos(v["__a"]) * sin0), "x": turn / self.alpha + SWISS_LON}

        def level(v, m):
            return {"__q": (m.log(m.tan(v["y"] / 2 + math.pi / 4)) - self.k) / self.alpha}

        def nearer(v, m):
            return {"y": m.atan(m.exp(v["__q"] + m.log(m.tan(m.asin(m.sin(v["y"]) * self.e) / 2 + math.pi / 4)) * self.e)) * 2 - math.pi / 2}

        return [cylinder, upright, level, *[nearer] * STEPS]


#: By the tags that rasters bear.
PROJECTIONS = {"EPSG:4326": Geographic(), "EPSG:3857": WebMercator(), "EPSG:2056": SwissOblique(2_600_000.0, 1_200_000.0), "EPSG:21781": SwissOblique(600_000.0, 200_000.0)}


def steps(source: str, target: str) -> list[Step]:
    """From one system to another; none where they are the same."""
    for crs in (source, target):
        if crs not in PROJECTIONS:
            raise ValueError(f"no projection for {crs}")
    a, b = PROJECTIONS[source], PROJECTIONS[target]
    if isinstance(a, SwissOblique) and isinstance(b, SwissOblique):  # one datum, another origin
        return [] if a is b else [lambda v, m: {"x": v["x"] + (b.east - a.east), "y": v["y"] + (b.north - a.north)}]
    return [] if a is b else [*a.inverse, *b.forward]


def taken(x: float, y: float, some: list[Step]) -> tuple[float, float]:
    """A point after some steps."""
    v = {"x": x, "y": y}
    for step in some:
        v |= step(v, FLOATS)
    return v["x"], v["y"]


def convert(x: float, y: float, source: str, target: str) -> tuple[float, float]:
    return taken(x, y, steps(source, target))


def converted(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with its columns x and y in another system.

    A step's values are used several times by the next: each step is a struct of
    its own (`inline` of one), so the planner doesn't put one into the other.
    """
    columns = df.columns
    for step in steps(source, target):
        new = step({c: F.col(c) for c in df.columns}, COLUMNS)
        df = df.select(*[c for c in df.columns if c not in new], F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()]))))
    return df.select(*columns)
