"""Overlay of polygon layers: dissolve and subtract, whatever overlaps or has holes.

Edges are cut into horizontal strips by columns, so a strip's task holds the
edges that pass through it and nothing else. In a strip, lines through all ends
and crossings of its edges make slabs in which no edges meet; from west to east
along a slab every polygon is inside between an odd and an even edge of its own
(rings within a polygon are holes by that), which gives the trapezoids where
some polygon of the one set and none of the other is. Trapezoids don't overlap:
areas add up, and their sides are edges again for every operator on layers, at
any resolution.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A part of the strip between y0 (below) and y1: from x `west` to `east` at either line.
TRAPEZOID = "strip long, y0 double, y1 double, west0 double, east0 double, west1 double, east1 double"
#: Edges that are compared with all others at once, in rows of the strip's matrix.
BLOCK = 512


def stripped(edges: DataFrame, height: float) -> DataFrame:
    """Edges (layer, geom_id, x1, y1, x2, y2) by strip: cut at the strips' lines, from south to north; level ones bound nothing and go."""
    up = F.col("y1") <= F.col("y2")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    e = edges.where("y1 <> y2").select("layer", "geom_id", pick("x1", "x2").alias("xa"), pick("y1", "y2").alias("ya"), pick("x2", "x1").alias("xb"), pick("y2", "y1").alias("yb"))
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("ya") / height), F.ceil(F.col("yb") / height) - 1)))
    low, high = F.greatest(F.col("ya"), F.col("strip") * height), F.least(F.col("yb"), (F.col("strip") + 1) * height)
    at = lambda y: F.when(y == F.col("ya"), F.col("xa")).when(y == F.col("yb"), F.col("xb")).otherwise(F.col("xa") + (y - F.col("ya")) / (F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa")))
    return e.select("strip", "layer", "geom_id", at(low).alias("xa"), low.alias("ya"), at(high).alias("xb"), high.alias("yb")).where("ya < yb")


def _crossings(xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray) -> np.ndarray:
    """y of every place where two edges cross, some edges against all others at a time."""
    slope, out = (xb - xa) / (yb - ya), []
    for k in range(0, len(xa), BLOCK):
        s = slice(k, k + BLOCK)
        turn = slope[s, None] - slope[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):  # lines that run alike don't cross
            y = ((xa - slope * ya)[None, :] - (xa - slope * ya)[s, None]) / turn
        low, high = np.maximum(ya[s, None], ya[None, :]), np.minimum(yb[s, None], yb[None, :])
        out.append(y[(turn != 0) & (y > low) & (y < high)])
    return np.concatenate(out)


def trapezoids(pdf: pd.DataFrame, keep: set[str], drop: set[str]) -> list[tuple]:
    """(y0, y1, west0, east0, west1, east1) of a strip's edges (layer, geom_id, xa, ya, xb, yb)."""
    xa, ya, xb, yb = (pdf[c].to_numpy(float) for c in ("xa", "ya", "xb", "yb"))
    owner = pd.factorize(pd.MultiIndex.from_frame(pdf[["layer", "geom_id"]]))[0]
    add = np.where(pdf["layer"].isin(keep), 1, 0)
    lines = np.unique(np.concatenate([ya, yb, _crossings(xa, ya, xb, yb)]))
    out = []
    for y0, y1 in zip(lines, lines[1:], strict=False):
        here = np.flatnonzero((ya <= y0) & (yb >= y1))
        if not len(here):
            continue
        share0, share1 = ((y - ya[here]) / (yb[here] - ya[here]) for y in (y0, y1))
        at0, at1 = (xa[here] + s * (xb[here] - xa[here]) for s in (share0, share1))
        inside: set[int] = set()
        ins = outs = 0
        begun = None
        for k in np.lexsort((at1, at0 + at1)):
            own = owner[here[k]]
            step = -1 if own in inside else 1
            inside ^= {own}
            ins, outs = (ins + step, outs) if add[here[k]] else (ins, outs + step)
            if begun is None and ins and not outs:
                begun = k
            elif begun is not None and not (ins and not outs):
                if at0[k] > at0[begun] or at1[k] > at1[begun]:
                    out.append((y0, y1, at0[begun], at0[k], at1[begun], at1[k]))
                begun = None
    return out


def overlay(edges: DataFrame, keep: list[str], drop: list[str] | tuple = (), height: float = 100.0) -> DataFrame:
    """TRAPEZOID of where a polygon of the layers `keep` and none of the layers `drop` is; strips are `height` metres high."""
    some, without = set(keep), set(drop)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = trapezoids(pdf, some, without)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["strip", "y0", "y1", "west0", "east0", "west1", "east1"]).astype({"strip": "int64"} | dict.fromkeys(("y0", "y1", "west0", "east0", "west1", "east1"), float))

    cut = stripped(edges.where(F.col("layer").isin(*some, *without)), height)
    return cut.groupBy("strip").applyInPandas(run, TRAPEZOID)


def area(parts: DataFrame) -> DataFrame:
    """(area): of all trapezoids together."""
    return parts.agg(F.coalesce(F.sum((F.col("y1") - F.col("y0")) * (F.col("east0") - F.col("west0") + F.col("east1") - F.col("west1")) / 2), F.lit(0.0)).alias("area"))


def outlines(parts: DataFrame, layer: str) -> DataFrame:
    """Trapezoids as polygons of a layer: (layer, geom_id, x1, y1, x2, y2) of their sides, which fills, buffers and masks take."""
    named = parts.select(F.lit(layer).alias("layer"), F.xxhash64("strip", "y0", "west0", "west1").alias("geom_id"), "*")
    corner = lambda x, y: (F.col(x), F.col(y))
    ring = [corner("west0", "y0"), corner("east0", "y0"), corner("east1", "y1"), corner("west1", "y1")]
    sides = [F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return named.select("layer", "geom_id", F.inline(F.array(*sides)))
