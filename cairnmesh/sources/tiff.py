"""Tagged image files of gridded data: headers, tiles and their coding, by the public TIFF 6, BigTIFF and GeoTIFF layouts.

A header is read by a few ranged reads; tiles (or strips) are decoded one by
one, so nothing needs the whole file.
"""

from __future__ import annotations

import ast
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Tag numbers, field types and codes of the formats.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
NONE, DEFLATE, OLD_DEFLATE, ZSTD = 1, 8, 32946, 50000

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Header:
    """What a file says of its raster. Bands are numbered from 0; (x0, y0) is the north-west corner."""

    height: int
    width: int
    bands: tuple[str, ...]
    kind: str
    tile: tuple[int, int]
    compression: int = DEFLATE
    predictor: int = 1
    #: Bands of a pixel stand together (else every band has its own tiles).
    chunky: bool = False
    order: str = "<"
    nodata: float | None = None
    scales: tuple[float, ...] = ()
    offsets: tuple[float, ...] = ()
    resolution: tuple[float, float] = (1.0, 1.0)
    x0: float = 0.0
    y0: float = 0.0
    crs: str = ""
    #: (offset, bytes) of each tile, band after band where they are apart.
    places: tuple[tuple[int, int], ...] = field(default=(), repr=False)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.tile[0])

    def without_places(self) -> Header:
        return Header(**(self.__dict__ | {"places": ()}))


def _names(xml: str, count: int) -> tuple[list[str], list[float], list[float]]:
    """Band names, scales and offsets of the metadata tag."""
    names, scales, offsets = [f"band_{i + 1}" for i in range(count)] if count > 1 else ["value"], [1.0] * count, [0.0] * count
    if xml.strip():
        for item in ET.fromstring(xml).iter("Item"):
            at, text = int(item.get("sample", -1)), (item.text or "").strip()
            if item.get("name") == "band_names":
                listed = ast.literal_eval(text)
                if len(listed) == count:
                    names = [str(x) for x in listed]
            elif 0 <= at < count:
                role = item.get("role")
                if role == "description":
                    names[at] = text
                elif role in ("scale", "offset"):
                    (scales if role == "scale" else offsets)[at] = float(text)
    return names, scales, offsets


def read_header(read: Read) -> Header:
    """The header of the first image of a file that read(offset, size) reads from."""
    begin = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(begin[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", begin[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), begin[8:16] if big else begin[4:8])[0]
    count_kind, entry, inline = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    n = struct.unpack(order + count_kind, read(at, struct.calcsize(order + count_kind)))[0]
    size = struct.calcsize(order + entry) + inline
    raw = read(at + struct.calcsize(order + count_kind), n * size)
    tags: dict[int, tuple] = {}
    for i in range(n):
        one = raw[i * size : (i + 1) * size]
        tag, kind, count = struct.unpack(order + entry, one[:-inline])
        if kind not in FIELD:
            continue
        width = struct.calcsize(order + FIELD[kind])
        value = one[-inline:] if count * width <= inline else read(struct.unpack(order + ("Q" if big else "I"), one[-inline:])[0], count * width)
        value = value[: count * width]
        tags[tag] = (value.split(b"\0")[0].decode("utf-8", "replace"),) if kind == 2 else struct.unpack(f"{order}{count}{FIELD[kind]}", value)

    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    samples = one(SAMPLES, 1)
    kinds = set(zip(tags.get(SAMPLE_FORMAT, (1,) * samples), tags.get(BITS, (1,) * samples), strict=False))
    if len(kinds) != 1 or (kind := KINDS.get(next(iter(kinds)))) is None:
        raise ValueError(f"bands of {sorted(kinds)} (format, bits) are not read")
    height, width = one(LENGTH), one(WIDTH)
    tiled = TILE_AT in tags
    tile = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    places = tuple(zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    names, scales, offsets = _names(one(METADATA, ""), samples)
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0)), tags.get(TIE_POINT, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    nodata = one(NODATA)
    return Header(
        height, width, tuple(names), kind, tile, one(COMPRESSION, NONE), one(PREDICTOR, 1), samples > 1 and one(PLANAR, 1) == 1, order, float(nodata) if nodata else None,
        tuple(scales), tuple(offsets), (scale[0], scale[1]), tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], f"EPSG:{code}" if code else "", places,
    )


def _unpacked(raw: bytes, compression: int) -> bytes:
    if compression == NONE:
        return raw
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(raw)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"compression {compression} is not read")


def decode(header: Header, raw: bytes, rows: int) -> np.ndarray:
    """(bands of the tile, rows, tile width) as doubles; missing cells are NaN, scales and offsets aren't applied."""
    each = len(header.bands) if header.chunky else 1
    kind = np.dtype(header.order + header.kind)
    flat = np.frombuffer(_unpacked(raw, header.compression), np.uint8)
    wide = header.tile[1] * each
    if header.predictor == 3:  # bytes of a row lie apart by significance, as differences
        planes = np.cumsum(flat.reshape(-1, wide * kind.itemsize), axis=1, dtype=np.uint8) if each == 1 else _steps(flat, wide * kind.itemsize, each)
        planes = planes.reshape(-1, kind.itemsize, wide).transpose(0, 2, 1)
        a = np.ascontiguousarray(planes).view(np.dtype(">" + header.kind)).reshape(-1, wide)
    else:
        a = flat.view(kind).reshape(-1, wide)
        if header.predictor == 2:
            a = np.cumsum(a.reshape(len(a), header.tile[1], each), axis=1, dtype=kind.newbyteorder("=")).reshape(-1, wide)
    a = a[:rows].astype(float)
    if header.nodata is not None:
        a[a == np.dtype(header.kind).type(header.nodata).astype(float)] = np.nan
    return a.reshape(len(a), header.tile[1], each).transpose(2, 0, 1)


def _steps(flat: np.ndarray, width: int, each: int) -> np.ndarray:
    """Sums of every each-th byte of rows of `width` bytes."""
    return np.cumsum(flat.reshape(-1, width // each, each), axis=1, dtype=np.uint8).reshape(-1, width)


def morton(row: int, col: int, bits: int = 16) -> int:
    """Place on the Z curve: the bits of row and column in turn."""
    return sum(((row >> b & 1) << (2 * b + 1)) | ((col >> b & 1) << (2 * b)) for b in range(bits))


def encode(values: np.ndarray, header: Header) -> bytes:
    """A tiled file of (bands, height, width) values, NaN where missing; tiles lie in the order of the Z curve, so near cells are near in the file."""
    if header.order != "<" or header.predictor != 1 or header.chunky or header.compression not in (NONE, DEFLATE, ZSTD):
        raise ValueError("written are little-endian files of one plane a band, without predictor")
    kind = np.dtype("<" + header.kind)
    if header.nodata is None and kind.kind != "f" and np.isnan(values).any():
        raise ValueError("missing values need a nodata value in whole numbers")
    scales, offsets = (np.array(x or (d,) * len(header.bands)).reshape(-1, 1, 1) for x, d in ((header.scales, 1.0), (header.offsets, 0.0)))
    coded = (values - offsets) / scales
    if kind.kind != "f":
        coded = np.round(coded)
        with np.errstate(invalid="ignore"):
            if (coded < np.iinfo(kind).min).any() or (coded > np.iinfo(kind).max).any():
                raise ValueError(f"values beyond {header.kind}")
    coded = np.where(np.isnan(coded), np.nan if header.nodata is None else header.nodata, coded).astype(kind)
    th, tw = header.tile
    padded = np.full((len(header.bands), header.down * th, header.across * tw), coded.dtype.type(0 if header.nodata is None else header.nodata), kind)
    padded[:, : header.height, : header.width] = coded
    body, places = bytearray(), {}
    head = 8
    for r, c in sorted(((r, c) for r in range(header.down) for c in range(header.across)), key=lambda x: morton(*x)):
        for b in range(len(header.bands)):
            raw = padded[b, r * th : (r + 1) * th, c * tw : (c + 1) * tw].tobytes()
            if header.compression == DEFLATE:
                raw = zlib.compress(raw)
            elif header.compression == ZSTD:
                import zstandard

                raw = zstandard.ZstdCompressor().compress(raw)
            places[b, r, c] = (head + len(body), len(raw))
            body += raw + b"\0" * (len(raw) % 2)
    listed = [places[b, r, c] for b in range(len(header.bands)) for r in range(header.down) for c in range(header.across)]
    items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{_escaped(n)}</Item>' for i, n in enumerate(header.bands))
    for name, some, plain in (("scale", header.scales, 1.0), ("offset", header.offsets, 0.0)):
        items += "".join(f'<Item name="{name.upper()}" sample="{i}" role="{name}">{x!r}</Item>' for i, x in enumerate(some) if x != plain)
    code = header.crs.removeprefix("EPSG:")
    n = len(header.bands)
    tags = {
        WIDTH: (4, [header.width]), LENGTH: (4, [header.height]), BITS: (3, [kind.itemsize * 8] * n), COMPRESSION: (3, [header.compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [n]), PLANAR: (3, [2 if n > 1 else 1]),
        TILE_WIDTH: (4, [tw]), TILE_LENGTH: (4, [th]), TILE_AT: (4, [p for p, _ in listed]), TILE_BYTES: (4, [s for _, s in listed]), SAMPLE_FORMAT: (3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n),
        PIXEL_SCALE: (12, [*map(float, header.resolution), 0.0]), TIE_POINT: (12, [0.0, 0.0, 0.0, float(header.x0), float(header.y0), 0.0]), METADATA: (2, f"<GDALMetadata>{items}</GDALMetadata>".encode()),
    }
    if code.isdigit():
        tags[GEO_KEYS] = (3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, PROJECTED, 0, 1, int(code)])
    if header.nodata is not None:
        tags[NODATA] = (2, repr(float(header.nodata)).encode())
    at = head + len(body)
    far, entries = bytearray(), bytearray()
    after = at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        field_kind, value = tags[tag]
        raw = value + b"\0" if field_kind == 2 else struct.pack(f"<{len(value)}{FIELD[field_kind]}", *value)
        count = len(raw) if field_kind == 2 else len(value)
        if len(raw) <= 4:
            held = raw.ljust(4, b"\0")
        else:
            held = struct.pack("<I", after + len(far))
            far += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, field_kind, count) + held
    return b"II" + struct.pack("<HI", 42, at) + bytes(body) + struct.pack("<H", len(tags)) + bytes(entries) + struct.pack("<I", 0) + bytes(far)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
