"""Sensitivity of landscape connectivity to a cell's quality or permeability.

    K = sum over i, j of q_i k(d_ij) q_j            |row| and |col| offsets up to R
    dK/dq_i = sum over j of (k_ij + k_ji) q_j
    dK/dp_x = sum over s, t of q_s q_t (-k'(d_st)) times the sum of
              2 len / (p_u + p_v)**2 over steps (u, v) on the shortest s-t path with x an end

A step between neighbours (8 of them) costs len * 2 / (p_u + p_v); paths stay
inside the source's window. Where several paths are shortest, each counts its
share. Self-pairs count and the factor 2 is kept. k is exp(-d alpha / D), or any
`Proximity`. These are choices of this engine.

The raster is cut into tiles; a tile's task gets its cells and a halo of R.
Straight-line sums are one convolution by spectra. Least-cost distances are found
for SOURCES cells at a time, each with its window of (2 R + 1) squared cells, by
sweeps over all windows at once until nothing improves, and what paths carry is
added up backwards along the shortest-path graphs in order of distance: the
memory of a task doesn't depend on the tile. Any `Distance` can take their place.
A tile of permeability adds to the cells around it, so tiles' sums are added by a
shuffle of one row a cell and tile. Rows shuffled are cells times (1 + 2 R / tile) squared, not cells times
(2 R + 1) squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EUCLIDEAN, LEAST_COST, SENSITIVITIES, Config, Grid
from ..functions.columns import Kernel, proximity

TILE = 32
#: Cells whose windows are held at once.
SOURCES = 128
_STEPS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


@dataclass(frozen=True)
class Proximity:
    """How close cells at a distance are: functions of (distances, dispersal, alpha) on arrays. Without a slope it is taken by differences."""

    value: Callable[[np.ndarray, float, float], np.ndarray]
    slope: Callable[[np.ndarray, float, float], np.ndarray] | None = None

    def at(self, d: np.ndarray, dispersal: float, alpha: float) -> np.ndarray:
        far = ~np.isfinite(d)
        return np.where(far, 0.0, self.value(np.where(far, 0.0, d), dispersal, alpha))

    def falling(self, d: np.ndarray, dispersal: float, alpha: float) -> np.ndarray:
        """How much closer cells get for each unit of distance less."""
        far = ~np.isfinite(d)
        d = np.where(far, 1.0, d)
        if self.slope:
            fall = -self.slope(d, dispersal, alpha)
        else:
            h = 1e-6 * np.maximum(1.0, d)
            fall = (self.value(d - h, dispersal, alpha) - self.value(d + h, dispersal, alpha)) / (2 * h)
        return np.where(far, 0.0, fall)


EXPONENTIAL = Proximity(lambda d, dispersal, alpha: np.exp(-d * alpha / dispersal), lambda d, dispersal, alpha: -alpha / dispersal * np.exp(-d * alpha / dispersal))


def analysis_params(stats: DataFrame, config: Config = DEFAULT, grid: Grid | None = None) -> DataFrame:
    """Coarse resolution, block factor and window radius of each row with d_m."""
    fine = grid.resolution if grid else config.resolution
    coarse = F.greatest(F.lit(fine), F.col("d_m") * config.precision)
    out = stats.withColumn("coarse_resolution", coarse).withColumn("factor", F.ceil(F.col("coarse_resolution") / fine).cast("int"))
    return out.withColumn("radius", F.ceil(config.reach * F.col("d_m") / F.col("coarse_resolution")).cast("int"))


def alpha(distance: str, coarse_resolution: float, mean_quality: float) -> float:
    """Metres of one unit of distance: a cell, for least-cost paths divided by the mean cost of a step."""
    return coarse_resolution * mean_quality if distance == LEAST_COST else coarse_resolution


def kernel(df: DataFrame, shape: Kernel = proximity) -> DataFrame:
    return df.withColumn("proximity", shape(F.col("distance"), F.col("d_m"), F.col("alpha")))


def _tiled(df: DataFrame, halo: str | int, tile: int) -> DataFrame:
    """Each cell once for every tile whose halo holds it: (tr, tc) added."""
    h = F.col(halo) if isinstance(halo, str) else F.lit(halo)
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - h) / tile).cast("int"), F.floor((F.col(c) + h) / tile).cast("int")))
    return df.select("*", span("row").alias("tr")).select("*", span("col").alias("tc"))


def _by_tile(tiles: DataFrame, names: Sequence[str]):
    """Tiles grouped; few rows are much work, so they are spread by number and not put together by size."""
    return tiles.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "tr", "tc").groupBy(*names, "tr", "tc")


def _own(pdf: pd.DataFrame, tile: int) -> pd.DataFrame:
    """The tile's own cells, without its halo."""
    return pdf[(pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])]


def _arrays(pdf: pd.DataFrame, columns: Sequence[str]):
    """Arrays over the smallest rectangle that holds the rows, and its first row and column; beyond it all is missing."""
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    out = []
    for c in columns:
        a = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        a[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf[c].to_numpy()
        out.append(a)
    return out, r0, c0


def _shift(a: np.ndarray, dr: int, dc: int, fill: float) -> np.ndarray:
    """out[i, j] = a[i + dr, j + dc], `fill` beyond the array."""
    out = np.full_like(a, fill)
    n, m = a.shape
    if abs(dr) >= n or abs(dc) >= m:
        return out
    out[max(0, -dr) : n - max(0, dr), max(0, -dc) : m - max(0, dc)] = a[max(0, dr) : n + min(0, dr), max(0, dc) : m + min(0, dc)]
    return out


def step_costs(p: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Cost from each cell to its neighbour at (dr, dc); infinite where either is missing."""
    out = {}
    for dr, dc in _STEPS:
        c = math.hypot(dr, dc) * 2 / (p + _shift(p, dr, dc, np.nan))
        out[dr, dc] = np.where(np.isfinite(c), c, np.inf)
    return out


class Windows:
    """The windows around some cells of arrays with one shape; what lies beyond the arrays is missing."""

    def __init__(self, radius: int, rows: np.ndarray, cols: np.ndarray):
        self.radius, self.width, self.rows, self.cols = radius, 2 * radius + 1, rows, cols

    def of(self, a: np.ndarray, fill: float) -> np.ndarray:
        padded = np.pad(a, self.radius, constant_values=fill)
        return np.lib.stride_tricks.sliding_window_view(padded, (self.width, self.width))[self.rows, self.cols]

    def add(self, total: np.ndarray, gains: np.ndarray) -> None:
        """Add each window's gains to the cells of total that it covers."""
        r = self.radius
        padded = np.zeros((total.shape[0] + 2 * r, total.shape[1] + 2 * r))
        for i, j, g in zip(self.rows, self.cols, gains, strict=True):
            padded[i : i + self.width, j : j + self.width] += g
        total += padded[r : r + total.shape[0], r : r + total.shape[1]]


class Distance(Protocol):
    """A distance from cells to those of their windows, on arrays: implement it to analyse landscapes with one of your own.

    `moves`: it depends on permeability, so there is a sensitivity to it. A
    distance that depends on the offset alone may say so by `offsets`.
    """

    moves: bool

    def distances(self, p: np.ndarray, w: Windows) -> np.ndarray:
        """(windows, width, width): from each window's centre to its cells, infinite where there is no way."""

    def spread(self, p: np.ndarray, w: Windows, d: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """(windows, width, width): the sum over a window's cells t of carried[t] times how much d[t] falls for each unit more of a cell's permeability."""


class StraightLine:
    """Cells in a straight line, whatever lies between."""

    moves = False

    def offsets(self, radius: int) -> np.ndarray:
        span = np.arange(-radius, radius + 1)
        return np.hypot(span[:, None], span[None, :])

    def distances(self, p: np.ndarray, w: Windows) -> np.ndarray:
        return np.broadcast_to(self.offsets(w.radius), (len(w.rows), w.width, w.width))

    def spread(self, p: np.ndarray, w: Windows, d: np.ndarray, carried: np.ndarray) -> np.ndarray:
        return np.zeros(carried.shape)


class LeastCostPath:
    """The cheapest way by steps to 8 neighbours that stays inside the window; paths equal within eps share what they carry."""

    moves = True

    def __init__(self, eps: float = 1e-9):
        self.eps = eps

    def distances(self, p: np.ndarray, w: Windows) -> np.ndarray:
        """Sweeps down, up, right and left over all windows at once; each is a relaxation in order, so straight runs settle in one sweep, and settled windows leave."""
        costs = step_costs(p)
        e, s, se, sw = (np.ascontiguousarray(w.of(costs[n], np.inf).transpose(1, 2, 0)) for n in ((0, 1), (1, 0), (1, 1), (1, -1)))
        d = np.full(e.shape, np.inf)
        d[w.radius, w.radius] = np.where(np.isnan(p[w.rows, w.cols]), np.inf, 0.0)
        out, left = np.empty(d.shape), np.arange(len(w.rows))
        while len(left):
            before = d.copy()
            _sweep(d, e, s, se, sw)
            moved = (before != d).any(axis=(0, 1))
            if not moved.all():
                out[:, :, left[~moved]] = d[:, :, ~moved]
                d, e, s, se, sw = (np.ascontiguousarray(a[:, :, moved]) for a in (d, e, s, se, sw))
                left = left[moved]
        return out.transpose(2, 0, 1)

    def spread(self, p: np.ndarray, w: Windows, d: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """The steps on shortest paths are a graph without circles: its cells are taken in levels, path counts outwards and what is carried inwards, every step once."""
        many, d = len(w.rows), np.ascontiguousarray(d.transpose(1, 2, 0))
        at = np.arange(d.size).reshape(d.shape)
        steps = []
        for n, cost in step_costs(p).items():
            begin, end = _ends(n, w.width)
            c = w.of(cost, np.inf).transpose(1, 2, 0)[begin]
            with np.errstate(invalid="ignore"):  # no path less no path
                on = np.isfinite(d[begin]) & (np.abs(d[begin] + c - d[end]) < self.eps)
            steps.append((at[begin][on], at[end][on], c[on] ** 2 / (2 * math.hypot(*n))))
        u, v, slope = (np.concatenate(x) for x in zip(*steps, strict=True))
        by = np.argsort(u, kind="stable")
        u, v, slope = u[by], v[by], slope[by]
        out, into = np.bincount(u, minlength=d.size), np.bincount(v, minlength=d.size)
        first, level, paths = np.cumsum(out) - out, np.zeros(d.size, np.int64), np.zeros(d.size)
        front = at[w.radius, w.radius][d[w.radius, w.radius] == 0]
        paths[front] = 1.0
        depth = 0
        while len(front):
            depth, n = depth + 1, out[front]
            some = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.add.at(paths, v[some], paths[u[some]])
            np.subtract.at(into, v[some], 1)
            front = np.unique(v[some][into[v[some]] == 0])
            level[front] = depth
        share = paths[u] / paths[v]
        through = np.ascontiguousarray(carried.transpose(1, 2, 0)).reshape(-1)
        down = np.argsort(-level[v], kind="stable")
        ends = np.flatnonzero(np.diff(level[v[down]], prepend=-1))
        for some in np.split(down, ends[1:]):
            np.add.at(through, u[some], share[some] * through[v[some]])
        gain = share * through[v] * slope
        gains = np.bincount(u, gain, d.size) + np.bincount(v, gain, d.size)
        return gains.reshape(d.shape).transpose(2, 0, 1)


def _ends(n: tuple[int, int], width: int) -> tuple[tuple, tuple]:
    """Places, in windows of this width, of the beginnings and the ends of all steps n that stay inside."""
    spans = [(slice(max(0, -x), width - max(0, x)), slice(max(0, x), width - max(0, -x))) for x in n]
    return (spans[0][0], spans[1][0]), (spans[0][1], spans[1][1])


def _sweep(d: np.ndarray, e: np.ndarray, s: np.ndarray, se: np.ndarray, sw: np.ndarray) -> None:
    """Relax all steps of windows (width, width, windows) in four orders. e, s, se and sw are the costs of each cell's step east, south, south-east and south-west."""
    last = len(d) - 1
    row, col = np.empty(d.shape[1:]), np.empty((len(d), d.shape[2]))

    def least(to, start, cost, held):
        np.minimum(to, np.add(start, cost, out=held[: len(to)]), out=to)

    for i in range(1, last + 1):
        least(d[i], d[i - 1], s[i - 1], row)
        least(d[i, 1:], d[i - 1, :-1], se[i - 1, :-1], row)
        least(d[i, :-1], d[i - 1, 1:], sw[i - 1, 1:], row)
    for i in range(last - 1, -1, -1):
        least(d[i], d[i + 1], s[i], row)
        least(d[i, :-1], d[i + 1, 1:], se[i, :-1], row)
        least(d[i, 1:], d[i + 1, :-1], sw[i, 1:], row)
    for j in range(1, last + 1):
        least(d[:, j], d[:, j - 1], e[:, j - 1], col)
        least(d[1:, j], d[:-1, j - 1], se[:-1, j - 1], col)
        least(d[:-1, j], d[1:, j - 1], sw[:-1, j], col)
    for j in range(last - 1, -1, -1):
        least(d[:, j], d[:, j + 1], e[:, j], col)
        least(d[:-1, j], d[1:, j + 1], se[:-1, j], col)
        least(d[1:, j], d[:-1, j + 1], sw[:-1, j + 1], col)


STRAIGHT, PATHS = StraightLine(), LeastCostPath()
#: By the names that groups are analysed under.
DISTANCES: dict[str, Distance] = {EUCLIDEAN: STRAIGHT, LEAST_COST: PATHS}


def _windows(shape: tuple[int, int], radius: int, sources: np.ndarray | None) -> Iterator[Windows]:
    """Windows of all cells, or of the marked ones, SOURCES at a time. A window no wider than the array needs."""
    rows, cols = np.nonzero(np.ones(shape, bool) if sources is None else sources)
    for at in range(0, len(rows), SOURCES):
        yield Windows(min(radius, max(shape) - 1), rows[at : at + SOURCES], cols[at : at + SOURCES])


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """out[i, j] = the sum over offsets of kernel[r + dr, r + dc] * a[i + dr, j + dc]: one product of spectra, whatever the kernel's width."""
    n, m = (x + y - 1 for x, y in zip(a.shape, kernel.shape, strict=True))
    full = np.fft.irfft2(np.fft.rfft2(a, (n, m)) * np.fft.rfft2(kernel[::-1, ::-1], (n, m)), (n, m))
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    return full[r : r + a.shape[0], c : c + a.shape[1]]


def quality_sensitivity(q: np.ndarray, p: np.ndarray, radius: int, dispersal: float, alpha: float, distance: Distance, kernel: Proximity = EXPONENTIAL, sources: np.ndarray | None = None) -> np.ndarray:
    """2 * sum of q_t k(d_st) over each source's window; missing cells give nothing."""
    q0 = np.nan_to_num(q)
    if hasattr(distance, "offsets"):
        return 2 * convolved(q0, kernel.at(distance.offsets(radius), dispersal, alpha))
    out = np.zeros(q.shape)
    for w in _windows(q.shape, radius, sources):
        out[w.rows, w.cols] = 2 * (w.of(q0, 0.0) * kernel.at(distance.distances(p, w), dispersal, alpha)).sum(axis=(1, 2))
    return out


def permeability_sensitivity(q: np.ndarray, p: np.ndarray, radius: int, dispersal: float, alpha: float, distance: Distance, kernel: Proximity = EXPONENTIAL, sources: np.ndarray | None = None) -> np.ndarray:
    """What the marked sources' pairs give each cell."""
    q0, total = np.nan_to_num(q), np.zeros(q.shape)
    for w in _windows(q.shape, radius, sources):
        d = distance.distances(p, w)
        carried = w.of(q0, 0.0) * q0[w.rows, w.cols][:, None, None] * kernel.falling(d, dispersal, alpha)
        carried[:, w.radius, w.radius] = 0.0
        w.add(total, distance.spread(p, w, d, carried))
    return total


def sensitivity(df: DataFrame, keys: Sequence[str], sens: str, distance: Distance = PATHS, tile: int = TILE, kernel: Proximity = EXPONENTIAL) -> DataFrame:
    """(keys..., row, col, sensitivity) of rasters (keys..., row, col, q, radius, alpha, d_m).

    sens: quality or permeability; the permeability is q.
    """
    if sens not in SENSITIVITIES or sens == "permeability" and not distance.moves:
        raise ValueError(f"no sensitivity to {sens} with this distance")
    names = [f.name for f in df.schema.fields if f.name in keys]
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)
    schema = f"{fields + ', ' if fields else ''}row int, col int, sensitivity double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = _own(pdf, tile)
        got = (pdf if sens == "permeability" else own)[[*names, "row", "col"]].copy()
        if own.empty:  # a tile that is nothing but halo
            return got[:0].assign(sensitivity=0.0)
        radius, dispersal, alpha_ = int(pdf["radius"].iloc[0]), float(pdf["d_m"].iloc[0]), float(pdf["alpha"].iloc[0])
        (q,), r0, c0 = _arrays(pdf, ["q"])
        sources = np.zeros(q.shape, bool)
        sources[own["row"].to_numpy() - r0, own["col"].to_numpy() - c0] = True
        of = permeability_sensitivity if sens == "permeability" else quality_sensitivity
        out = of(q, q, radius, dispersal, alpha_, distance, kernel, sources)
        got["sensitivity"] = out[got["row"].to_numpy() - r0, got["col"].to_numpy() - c0]
        return got

    out = _by_tile(_tiled(df, "radius", tile), names).applyInPandas(run, schema)
    return out.groupBy(*names, "row", "col").agg(F.sum("sensitivity").alias("sensitivity")) if sens == "permeability" else out


def distance_sums(df: DataFrame, keys: Sequence[str], distance: Distance = PATHS, tile: int = TILE) -> DataFrame:
    """(keys..., row, col, reached, distance_sum): cells in the window that a way leads to, and their distances."""
    names = list(keys)
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)
    schema = f"{fields + ', ' if fields else ''}row int, col int, reached long, distance_sum double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = _own(pdf, tile)
        got = own[[*names, "row", "col"]].copy()
        if got.empty:
            return got.assign(reached=0, distance_sum=0.0)
        (p,), r0, c0 = _arrays(pdf, ["q"])
        at = own["row"].to_numpy() - r0, own["col"].to_numpy() - c0
        sources, count, total = np.zeros(p.shape, bool), np.zeros(p.shape, np.int64), np.zeros(p.shape)
        sources[at] = True
        for w in _windows(p.shape, int(pdf["radius"].iloc[0]), sources):
            d = distance.distances(p, w)
            count[w.rows, w.cols] = np.isfinite(d).sum(axis=(1, 2))
            total[w.rows, w.cols] = np.where(np.isfinite(d), d, 0.0).sum(axis=(1, 2))
        got["reached"], got["distance_sum"] = count[at], total[at]
        return got

    return _by_tile(_tiled(df, "radius", tile), names).applyInPandas(run, schema)


def elasticity(sens: DataFrame, fine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sensitivity times suitability, on the cells that both have."""
    return sens.join(fine, [*keys, "row", "col"]).withColumn("elasticity", F.col("sensitivity") * F.col("value"))
