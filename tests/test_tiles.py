"""Tiled files: coding, headers of other writers, pruning, commits that break off, the cache."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmesh.config import Grid
from cairnmesh.sources import tiff, tiles

GRID = Grid(100, 80, 25.0, 1000.0, 9000.0)


def opened(raw):
    return lambda at, size: raw[at : at + size]


def image(raw):
    """All bands of a file as arrays."""
    h = tiff.read_header(opened(raw))
    out = np.full((len(h.bands), h.down * h.tile[0], h.across * h.tile[1]), np.nan)
    for p in range(1 if h.chunky else len(h.bands)):
        for n in range(h.down * h.across):
            at, size = h.places[p * h.down * h.across + n]
            r, c = divmod(n, h.across)
            rows = min(h.tile[0], h.height - r * h.tile[0])
            got = tiff.decode(h, raw[at : at + size], rows)
            out[slice(None) if h.chunky else slice(p, p + 1), r * h.tile[0] : r * h.tile[0] + rows, c * h.tile[1] : (c + 1) * h.tile[1]] = got
    return h, out[:, : h.height, : h.width] * np.array(h.scales).reshape(-1, 1, 1) + np.array(h.offsets).reshape(-1, 1, 1)


@pytest.mark.parametrize("kind,scale,nodata", [("f4", 1.0, None), ("f8", 1.0, -1.0), ("i2", 0.01, -9999.0), ("u1", 0.5, 255.0)])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.DEFLATE, tiff.ZSTD])
def test_round_trip(kind, scale, nodata, compression):
    values = np.random.default_rng(1).random((2, 37, 53)) * 100
    values[:, 5:9, 40:] = np.nan
    h = tiff.Header(37, 53, ("mean <a>", "std"), kind, (16, 16), compression, nodata=nodata, scales=(scale,) * 2, offsets=(0.0,) * 2, resolution=(25.0, 25.0), x0=100.0, y0=900.0, crs="EPSG:2056")
    got, back = image(tiff.encode(values, h))
    assert (got.bands, got.x0, got.y0, got.resolution, got.crs, got.kind, got.nodata) == (h.bands, 100.0, 900.0, (25.0, 25.0), "EPSG:2056", kind, nodata)
    assert np.array_equal(np.isnan(back), np.isnan(values))
    want = values.astype(kind).astype(float) if kind[0] == "f" else np.round(values / scale) * scale
    assert np.allclose(back, want, rtol=1e-12, equal_nan=True)


def test_values_beyond_the_kind():
    h = tiff.Header(1, 1, ("v",), "i2", (16, 16), nodata=-1.0)
    with pytest.raises(ValueError, match="beyond"):
        tiff.encode(np.full((1, 1, 1), 1e6), h)
    with pytest.raises(ValueError, match="nodata"):
        tiff.encode(np.full((1, 1, 1), np.nan), tiff.Header(1, 1, ("v",), "i2", (16, 16)))


def by_hand(order, big, values, predictor, rows_per_strip):
    """A striped file of interleaved bands, as other writers make it."""
    bands, height, width = values.shape
    kind = np.dtype(order + "f4" if predictor == 3 else order + "u2")
    strips = []
    for at in range(0, height, rows_per_strip):
        part = np.ascontiguousarray(values[:, at : at + rows_per_strip].transpose(1, 2, 0)).astype(kind)
        if predictor == 2:
            part[:, 1:] = np.diff(part.astype("i8"), axis=1).astype(kind)
            raw = part.tobytes()
        elif predictor == 3:
            planes = part.astype(">f4").reshape(len(part), -1).view("u1").reshape(len(part), -1, 4).transpose(0, 2, 1).reshape(len(part), -1, bands)
            planes[:, 1:] = np.diff(planes.astype("i2"), axis=1).astype("u1")
            raw = planes.tobytes()
        else:
            raw = part.tobytes()
        strips.append(zlib.compress(raw))
    xml = b'<GDALMetadata><Item name="band_names">[\'p\', \'q\']</Item></GDALMetadata>\0'
    body, places = b"", []
    head = 16 if big else 8
    for s in strips:
        places.append(head + len(body))
        body += s
    word = "Q" if big else "I"
    tags = [(256, "H", [width]), (257, "H", [height]), (258, "H", [kind.itemsize * 8] * bands), (259, "H", [8]), (273, word, places), (277, "H", [bands]), (278, "H", [rows_per_strip]), (279, word, [len(s) for s in strips]),
            (284, "H", [1]), (317, "H", [predictor]), (339, "H", [3 if predictor == 3 else 1] * bands), (33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [1.0, 1.0, 0.0, 12.0, 97.0, 0.0]), (42112, "s", xml)]
    codes, inline = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}, 8 if big else 4
    at = head + len(body)
    far, entries = b"", b""
    after = at + (8 if big else 2) + len(tags) * (20 if big else 12) + (8 if big else 4)
    for tag, k, v in tags:
        raw = v if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
        held = raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(order + word, after + len(far))
        far += b"" if len(raw) <= inline else raw
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, codes[k], len(v)) + held
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return start + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + word, 0) + far


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_other_writers(order, big, predictor):
    values = np.random.default_rng(2).integers(0, 60000, (2, 23, 17)).astype(float)
    h, got = image(by_hand(order, big, values, predictor, 5))
    assert np.array_equal(got, values) and h.bands == ("p", "q") and h.chunky
    assert (h.x0, h.y0, h.resolution) == (10.0, 100.0, (2.0, 3.0))


def rasters(spark):
    cells = spark.range(100 * 80).select(F.floor(F.col("id") / 80).cast("int").alias("row"), (F.col("id") % 80).cast("int").alias("col"))
    one = cells.where("(row + col) % 7 <> 0").select(F.lit("north/a").alias("name"), (F.col("row") - 30).alias("row"), "col", (F.col("row") * 100 + F.col("col") + 0.25).alias("m"), F.when(F.col("col") > 3, F.col("col") / 8).alias("s"))
    return one.unionByName(one.where("row between 0 and 20 and col between 50 and 60").withColumn("name", F.lit("b")))


def rows(df):
    return sorted(tuple(r) for r in df.select("raster", "row", "col", "m", "s").collect())


def test_folder(spark, tmp_path):
    df = rasters(spark)
    path = str(tmp_path / "out")
    tiles.write_tiles(df, path, GRID, ["m", "s"], F.col("name"), tile=16, block=32, parameters={"step": 1})
    got = tiles.read_tiles(spark, path)
    want = sorted((r.name, r.row, r.col, r.m, r.s) for r in df.collect())
    assert rows(got) == want and not os.listdir(f"{path}/_temporary")
    r = got.where("row = -3 and col = 40 and raster = 'north/a'").first()
    assert (r.x, r.y) == (1000 + 40.5 * 25, 9000 + 2.5 * 25)
    # a box reads the tiles that meet it, and no other raster's files are opened; filters hold for their own query alone
    part, one = tiles.read_tiles(spark, path, box=(0, 10, 50, 70)), tiles.read_tiles(spark, path, rasters=["b"])
    assert rows(part) == [x for x in want if 0 <= x[1] < 10 and 50 <= x[2] < 70] == rows(got.where("row >= 0 and row < 10 and col > 49 and col <= 69"))
    assert rows(one) == [x for x in want if x[0] == "b"] == rows(got.where("raster = 'b'")) and rows(got) == want
    assert (got.rdd.getNumPartitions(), part.rdd.getNumPartitions(), one.rdd.getNumPartitions()) == (13, 3, 1)
    # appended rasters are added, overwritten ones replaced and their files gone
    tiles.write_tiles(df.where("name = 'b'").withColumn("name", F.lit("c")), path, GRID, ["m", "s"], F.col("name"), mode="append", tile=16, block=32)
    assert {x[0] for x in rows(tiles.read_tiles(spark, path))} == {"north/a", "b", "c"}
    tiles.write_tiles(df.where("name = 'b'"), path, GRID, ["m", "s"], F.col("name"))
    assert {x[0] for x in rows(tiles.read_tiles(spark, path))} == {"b"} and len([f for f in os.listdir(path) if f.endswith(".tif")]) == 1
    assert tiles.grid_of(path).resolution == 25.0 and tiles.grid_of(path).crs == "EPSG:2056"


def test_partitions_are_runs_of_tiles(spark, tmp_path):
    h = tiff.Header(64, 64, ("value",), "f4", (16, 16))
    (tmp_path / "x.tif").write_bytes(tiff.encode(np.arange(4096.0).reshape(1, 64, 64), h))
    reader = tiles.TiledRaster({"path": str(tmp_path / "x.tif"), "cells": "512"}).reader(spark.createDataFrame([], "raster string, row int, col int, x double, y double, value double").schema)
    assert len(reader.partitions()) == 8
    reader.box = [0, 16, 0, 64]
    assert [t[:2] for p in reader.partitions() for t in p.tiles] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    got = tiles.read_tiles(spark, str(tmp_path / "x.tif"), box=(10, 20, 3, 5))
    assert sorted((r.row, r.col, r.value) for r in got.collect()) == [(r, c, 64.0 * r + c) for r in range(10, 20) for c in (3, 4)]


def test_broken_jobs_leave_nothing(spark, tmp_path):
    df, path = rasters(spark), str(tmp_path / "out")
    twice = df.where("name = 'b'")
    with pytest.raises(Exception, match="a cell twice"):
        tiles.write_tiles(twice.unionByName(twice.limit(1)), path, GRID, ["m", "s"], F.col("name"))
    with pytest.raises(Exception, match="no rasters"):
        tiles.read_tiles(spark, path)
    tiles.write_tiles(twice, path, GRID, ["m", "s"], F.col("name"))
    before = rows(tiles.read_tiles(spark, path))
    with pytest.raises(Exception, match="broken"):  # a task fails after others have written their files
        tiles.write_tiles(df.withColumn("m", F.when((F.col("row") == 60) & (F.col("col") == 70), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("m"))), path, GRID, ["m", "s"], F.col("name"), block=16)
    assert rows(tiles.read_tiles(spark, path)) == before
    # a writer whose commit never came: its files are there, but not in the manifest
    writer = tiles.Writer({"path": path, "grid": json.dumps({"resolution": 25.0, "x0": 0.0, "y0": 0.0, "crs": ""})}, tiles.read_tiles(spark, path).schema, False)
    written = writer.write(iter(tiles.read_tiles(spark, path).toArrow().to_batches()))
    assert written.blocks and rows(tiles.read_tiles(spark, path)) == before
    writer.abort([written])
    assert not os.listdir(f"{path}/_temporary")


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    tiles.write_tiles(rasters(spark).limit(0), path, GRID, ["m", "s"], F.col("name"))
    assert rows(tiles.read_tiles(spark, path)) == []


def test_cache(spark, tmp_path):
    df, path, made = rasters(spark), str(tmp_path / "cache"), []

    def make():
        made.append(1)
        return df.where("name = 'b'")

    ask = lambda grid=GRID, **p: rows(tiles.cached_tiles(spark, path, grid, ["m", "s"], p, make, F.col("name")))
    first = ask(how="max")
    assert ask(how="max") == first and len(made) == 1
    assert ask(how="mean") == first and len(made) == 2  # another parameter
    assert ask(Grid(100, 80, 50.0), how="mean") == first and len(made) == 3  # another resolution
    os.remove(f"{path}/{tiles.MANIFEST}")  # a torn write has no manifest
    assert ask(Grid(100, 80, 50.0), how="mean") == first and len(made) == 4
