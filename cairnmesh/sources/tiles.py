"""Tiled rasters as a Spark data source: GeoTIFF files, and folders of them with a manifest.

Reading: a partition is a run of a file's tiles, and only tiles that meet the
asked box of rows and columns become one; other rasters' files aren't opened.
Box and rasters are given to ``read_tiles`` (options of the format): Spark 4.1
keeps a Python source's partitions for all queries of one DataFrame, so filters
pushed by the first of them would hold for the others as well. Headers are read
by the planner, of the files that the manifest shows to meet the box.

Writing: rows are dealt by block (a square of BLOCK cells of one raster), each
block becomes a file of tiles under `_temporary`, and the commit renames the
files and then puts the manifest in place by one rename. What the manifest
doesn't name isn't read: a killed task or a broken commit leaves no half raster.
A task holds one block.

Paths are whatever pyarrow's file systems open (local and shared folders, object
stores, HDFS), as tiles are read by byte ranges, which Spark's own readers don't offer.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..config import Grid
from . import tiff

MANIFEST = "_manifest.json"
#: Cells along a side of a tile and of a block (a file).
TILE, BLOCK = 256, 1024
#: Cells of a partition, about.
CELLS = 1 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it. file:/x, as Hadoop writes it, is file:///x."""
    return pafs.FileSystem.from_uri("file:///" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path if "://" in path else os.path.abspath(path))


def _reads(stream) -> tiff.Read:
    return lambda at, size: bytes(stream.read_at(size, at))


@dataclass
class Part(InputPartition):
    """Tiles of one file: its header without places, and (tile row, tile column, [(offset, bytes) of each plane]) of each."""

    file: str
    raster: str
    header: tiff.Header
    top: int
    left: int
    tiles: list
    box: tuple


def read_manifest(path: str) -> dict | None:
    """The manifest of a folder, or None: a folder without one holds nothing that is finished."""
    fs, root = _open(path)
    at = posixpath.join(root, MANIFEST)
    if fs.get_file_info(at).type != pafs.FileType.File:
        return None
    with fs.open_input_file(at) as f:
        return json.loads(f.read())


def _files(path: str) -> list[tuple[str, str, int, int, tuple[int, int] | None]]:
    """(file, raster, top, left, size if known) of a file, of a folder's manifest, or of a folder's .tif files (each a raster of its own)."""
    fs, root = _open(path)
    manifest = read_manifest(path)
    if manifest is not None:
        return [(posixpath.join(root, b["file"]), b["raster"], b["top"], b["left"], (b["height"], b["width"])) for b in manifest["blocks"]]
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, posixpath.basename(root).rsplit(".", 1)[0], 0, 0, None)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    some = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.lower().endswith((".tif", ".tiff")) and "/_temporary/" not in f.path)
    return [(p, posixpath.basename(p).rsplit(".", 1)[0], 0, 0, None) for p in some]


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.bands = [f.name for f in schema.fields][5:]
        whole = lambda name, plain: int(options.get(name, plain))
        far = 1 << 31
        self.box = [whole("top", -far), whole("bottom", far), whole("left", -far), whole("right", far)]  # rows and columns, ends exclusive
        self.rasters = set(json.loads(options["rasters"])) if "rasters" in options else None
        self.cells = whole("cells", CELLS)

    def partitions(self) -> list[Part]:
        fs, _ = _open(self.path)
        out = []
        a, b, c, d = self.box
        for file, raster, top, left, size in _files(self.path):
            if self.rasters is not None and raster not in self.rasters or size and not (top < b and top + size[0] > a and left < d and left + size[1] > c):
                continue
            with fs.open_input_file(file) as f:
                h = tiff.read_header(_reads(f))
            if len(h.bands) != len(self.bands):
                raise ValueError(f"{file} has {len(h.bands)} bands, not {len(self.bands)}")
            span = lambda low, high, start, size, most: range(max(0, (low - start) // size), min(most, -(-(high - start) // size)))
            rows, cols = span(self.box[0], self.box[1], top, h.tile[0], h.down), span(self.box[2], self.box[3], left, h.tile[1], h.across)
            planes = 1 if h.chunky else len(h.bands)
            each = h.down * h.across
            tiles = [(i, j, [h.places[p * each + i * h.across + j] for p in range(planes)]) for i in rows for j in cols]
            tiles.sort(key=lambda t: t[2][0])  # as they lie in the file
            step = max(1, self.cells // (h.tile[0] * h.tile[1]))
            slim = h.without_places()
            out += [Part(file, raster, slim, top, left, tiles[k : k + step], tuple(self.box)) for k in range(0, len(tiles), step)]
        for n, p in enumerate(out):
            p.value = n
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark asks where there are none
            return
        h, p = partition.header, partition
        fs, _ = _open(self.path)
        names = ["raster", "row", "col", "x", "y", *self.bands]
        with fs.open_input_file(p.file) as f:
            for r, c, places in p.tiles:
                rows = min(h.tile[0], h.height - r * h.tile[0])
                cols = min(h.tile[1], h.width - c * h.tile[1])
                planes = [tiff.decode(h, bytes(f.read_at(size, at)), rows) if size else np.full((len(h.bands) if h.chunky else 1, rows, h.tile[1]), np.nan) for at, size in places]
                values = np.concatenate(planes)[:, :, :cols]
                values = values * np.array(h.scales).reshape(-1, 1, 1) + np.array(h.offsets).reshape(-1, 1, 1)
                some = ~np.isnan(values).all(axis=0)
                y, x = np.nonzero(some)
                row, col = y + r * h.tile[0] + p.top, x + c * h.tile[1] + p.left
                inside = (row >= p.box[0]) & (row < p.box[1]) & (col >= p.box[2]) & (col < p.box[3])
                row, col, y, x = row[inside], col[inside], y[inside], x[inside]
                if not len(row):
                    continue
                found = values[:, y, x]
                px = h.x0 + (x + c * h.tile[1] + 0.5) * h.resolution[0]
                py = h.y0 - (y + r * h.tile[0] + 0.5) * h.resolution[1]
                columns = [pa.array([p.raster] * len(row), pa.string()), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(px), pa.array(py)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, pa.float64(), mask=np.isnan(v)) for v in found]], names=names)


@dataclass
class Written(WriterCommitMessage):
    blocks: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.bands = [f.name for f in schema.fields][5:]
        self.grid = json.loads(options["grid"])
        self.tile, self.block = int(options.get("tile", TILE)), int(options.get("block", BLOCK))
        self.kind, self.scale = options.get("kind", "f4"), float(options.get("scale", 1.0))
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.compression = {"none": tiff.NONE, "deflate": tiff.DEFLATE, "zstd": tiff.ZSTD}[options.get("compression", "zstd")]
        self.parameters = json.loads(options.get("parameters", "{}"))
        self.job = uuid.uuid4().hex

    def _block(self, fs, folder: str, key: tuple, values: np.ndarray) -> dict:
        """Write the smallest rectangle of a block that holds its values."""
        raster, br, bc = key
        held = ~np.isnan(values).all(axis=0)
        y, x = np.flatnonzero(held.any(axis=1)), np.flatnonzero(held.any(axis=0))
        if not len(y):
            y = x = np.zeros(1, int)
        cut = values[:, y[0] : y[-1] + 1, x[0] : x[-1] + 1]
        top, left, res = int(br) * self.block + int(y[0]), int(bc) * self.block + int(x[0]), self.grid["resolution"]
        header = tiff.Header(
            cut.shape[1], cut.shape[2], tuple(self.bands), self.kind, (self.tile, self.tile), self.compression, nodata=self.nodata, scales=(self.scale,) * len(self.bands), offsets=(0.0,) * len(self.bands),
            resolution=(res, res), x0=self.grid["x0"] + left * res, y0=self.grid["y0"] - top * res, crs=self.grid["crs"],
        )
        raw = tiff.encode(cut, header)
        name = f"{quote(raster, safe='')}-{br}_{bc}-{uuid.uuid4().hex[:12]}.tif"
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(raw)
        return {"file": name, "raster": raster, "top": top, "left": left, "height": cut.shape[1], "width": cut.shape[2], "cells": int(held.sum()), "sha256": hashlib.sha256(raw).hexdigest()}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        folder = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        key, values, seen, blocks = None, None, None, []

        for batch in iterator:
            raster, row, col = (batch.column(n) for n in ("raster", "row", "col"))
            names, row, col = np.array(raster.to_pylist(), object), row.to_numpy(), col.to_numpy()
            br, bc = row // self.block, col // self.block
            data = np.stack([batch.column(b).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in self.bands])
            change = np.flatnonzero((names[1:] != names[:-1]) | (br[1:] != br[:-1]) | (bc[1:] != bc[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(row)], strict=True):
                if a == b:
                    continue
                here = (names[a], int(br[a]), int(bc[a]))
                if here != key:
                    if key is not None:
                        blocks.append(self._block(fs, folder, key, values))
                    key, values, seen = here, np.full((len(self.bands), self.block, self.block), np.nan), np.zeros((self.block, self.block), bool)
                y, x = row[a:b] % self.block, col[a:b] % self.block
                np_seen = seen[y, x]
                if np_seen.any() or len(np.unique(y.astype(np.int64) * self.block + x)) < b - a:
                    raise ValueError(f"raster {here[0]} has a cell twice")
                seen[y, x] = True
                values[:, y, x] = data[:, a:b]
        if key is not None:
            blocks.append(self._block(fs, folder, key, values))
        for b in blocks:
            b["from"] = folder[len(root) + 1 :]
        return Written(blocks)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        before = read_manifest(self.path)
        blocks = [] if self.overwrite or before is None else before["blocks"]
        for m in messages:
            for b in m.blocks if m is not None else ():
                fs.move(f"{root}/{b['from']}/{b['file']}", f"{root}/{b['file']}")
                blocks.append({k: v for k, v in b.items() if k != "from"})
        blocks.sort(key=lambda b: (b["raster"], b["top"], b["left"]))
        digest = hashlib.sha256("".join(b["sha256"] for b in blocks).encode()).hexdigest()
        manifest = {"grid": self.grid, "bands": self.bands, "parameters": self.parameters, "content": digest, "blocks": blocks}
        with fs.open_output_stream(f"{root}/_temporary/{self.job}.json") as f:
            f.write(json.dumps(manifest).encode())
        fs.move(f"{root}/_temporary/{self.job}.json", f"{root}/{MANIFEST}")
        if self.overwrite and before is not None:
            for b in before["blocks"]:
                fs.delete_file(f"{root}/{b['file']}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary/{self.job}")


class TiledRaster(DataSource):
    """spark.read.format("tiles"): (raster, row, col, x, y, a column a band) of the cells that have a value."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files:
            manifest = read_manifest(self.options["path"])
            if manifest is None:
                raise FileNotFoundError(f"no rasters in {self.options['path']}")
            bands = manifest["bands"]
        else:
            fs, _ = _open(self.options["path"])
            with fs.open_input_file(files[0][0]) as f:
                bands = tiff.read_header(_reads(f)).bands
        return "raster string, row int, col int, x double, y double, " + ", ".join(f"`{b}` double" for b in bands)

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("tiles") known to the session."""
    spark.dataSource.register(TiledRaster)


def read_tiles(spark: SparkSession, path: str, rasters: Sequence[str] | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(raster, row, col, x, y, bands...) of a GeoTIFF file, a folder of them, or a written folder; box is (top, bottom, left, right), ends exclusive."""
    register(spark)
    reader = spark.read.format("tiles")
    if rasters is not None:
        reader = reader.option("rasters", json.dumps(sorted(rasters)))
    for name, value in zip(("top", "bottom", "left", "right"), box or (), strict=False):
        reader = reader.option(name, str(value))
    return reader.load(path)


def _morton(row: Column, col: Column, bits: int = 20) -> Column:
    """Place on the Z curve of block numbers from -2**(bits - 1) on."""
    half = 1 << (bits - 1)
    out = F.lit(0).cast("long")
    for b in range(bits):
        for n, c in enumerate((col, row)):
            bit = F.shiftright(c.cast("long") + half, b).bitwiseAND(F.lit(1))
            out = out + F.shiftleft(bit, 2 * b + n)
    return out


def write_tiles(df: DataFrame, path: str, grid: Grid, bands: Sequence[str], raster: Column | None = None, mode: str = "overwrite", parameters: dict | None = None, **options) -> None:
    """Write rasters (row, col, bands...) as tiled files; `raster` names each row's raster.

    options: tile and block (cells along a side), kind (f4, or i2 and others with
    scale and nodata), compression (zstd, deflate, none). A cell that a raster
    has twice stops the job.
    """
    register(df.sparkSession)
    block = int(options.get("block", BLOCK))
    rows = df.select((raster if raster is not None else F.lit("raster")).cast("string").alias("raster"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), *[F.col(b).cast("double").alias(b) for b in bands])
    br, bc = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    dealt = rows.repartition("raster", br, bc).sortWithinPartitions("raster", _morton(br, bc), "row", "col")
    out = dealt.write.format("tiles").mode(mode).option("grid", json.dumps({"resolution": grid.square(), "x0": grid.x0, "y0": grid.y0, "crs": grid.crs})).option("parameters", json.dumps(parameters or {}, sort_keys=True))
    for name, value in options.items():
        out = out.option(name, str(value))
    out.save(path)


def cached_tiles(spark: SparkSession, path: str, grid: Grid, bands: Sequence[str], parameters: dict, make: Callable[[], DataFrame], raster: Column | None = None, **options) -> DataFrame:
    """The rasters written at path if its manifest tells of this grid, these bands and parameters, else made, written and read back. Only the manifest is looked at."""
    found = read_manifest(path)
    asked = {"grid": {"resolution": grid.square(), "x0": grid.x0, "y0": grid.y0, "crs": grid.crs}, "bands": list(bands), "parameters": json.loads(json.dumps(parameters, sort_keys=True))}
    if found is None or any(found[k] != v for k, v in asked.items()):
        write_tiles(make(), path, grid, bands, raster, parameters=parameters, **options)
    return read_tiles(spark, path)


def grid_of(path: str) -> Grid:
    """The grid of a written folder, or of a file: origin, resolution and tag; its size where it is a file."""
    manifest = read_manifest(path)
    if manifest is not None:
        g, b = manifest["grid"], manifest["blocks"]
        return Grid(max((x["top"] + x["height"] for x in b), default=0), max((x["left"] + x["width"] for x in b), default=0), g["resolution"], g["x0"], g["y0"], crs=g["crs"])
    fs, _ = _open(path)
    with fs.open_input_file(_files(path)[0][0]) as f:
        h = tiff.read_header(_reads(f))
    return Grid(h.height, h.width, h.resolution[0], h.x0, h.y0, h.resolution[1], h.crs)
