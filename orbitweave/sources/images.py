"""Raster files as pixel tables: detached-label binaries, PNG, PGM and GeoTIFF, by the standard
library and numpy; writing PNG. Files come through Spark's binaryFile reader, so any store that
Spark reads will do; a file is one row and is decoded in one task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave import workers

TILES = "path string, tile_row int, tile_col int, y0 int, x0 int, height int, width int, data binary"
TILE = 256


def decode_raw(raw: bytes, lines: int, samples: int, dtype: str, offset: int = 0, bands: int = 1, band: int = 0) -> np.ndarray:
    """A band of a binary raster; ValueError if the file is too short."""
    kind = np.dtype(dtype)
    need = offset + bands * lines * samples * kind.itemsize
    if len(raw) < need:
        raise ValueError(f"raster has {len(raw)} bytes, its label asks for {need}")
    start = offset + band * lines * samples * kind.itemsize
    return np.frombuffer(raw, kind, lines * samples, start).reshape(lines, samples)


def decode_png(raw: bytes) -> np.ndarray:
    """Gray values of a PNG of 8 or 16 bits without interlace; colours become luminance."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette = 8, [], None
    while at < len(raw):
        size, name = struct.unpack(">I4s", raw[at : at + 8])
        chunk = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(chunk)
        elif name == b"IEND":
            break
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or interlace:
        raise ValueError("unsupported PNG layout")
    step, stride = channels * depth // 8, width * channels * depth // 8
    packed, out = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, stride + 1), np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for i in range(height):
        kind, row = packed[i, 0], packed[i, 1:].astype(np.int64)
        if kind == 2:
            row = (row + above) & 255
        elif kind == 1:
            row = (row.reshape(-1, step).cumsum(0) & 255).ravel()
        elif kind in (3, 4):
            for k in range(stride):
                left, up, corner = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    d = sorted(((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner)))
                    guess = d[0][2]
                row[k] = (row[k] + guess) & 255
        out[i] = row
        above = row
    image = out.view(">u2" if depth == 16 else np.uint8).reshape(height, width, channels).astype(float)
    if palette is not None and colour == 3:
        image = palette[image[..., 0].astype(int)].astype(float)
        channels = 3
    return image[..., 0] if channels < 3 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit gray PNG of values 0 to 255."""
    a = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.concatenate((np.zeros((a.shape[0], 1), np.uint8), a), 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def decode_pgm(raw: bytes) -> np.ndarray:
    """A binary (P5) gray map."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while end < len(raw) and raw[end] not in b" \t\r\n":
            end += 1
        if raw[at:at + 1] == b"#":
            end = raw.index(b"\n", at)
        elif end > at:
            fields.append(raw[at:end])
        at = end + 1
    if fields[0] != b"P5":
        raise ValueError("not a binary PGM")
    width, height, top = (int(x) for x in fields[1:])
    return np.frombuffer(raw, np.uint8 if top < 256 else ">u2", width * height, at).reshape(height, width).astype(float)


def decode_tiff(raw: bytes) -> tuple[np.ndarray, dict[int, tuple]]:
    """The first image of an uncompressed or deflated striped TIFF with one sample per pixel, and
    its tags (33550 pixel scale, 33922 tie point)."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", raw[4:8])[0]
    sizes = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind in sizes and kind != 2:
            code, size = sizes[kind]
            start = at + 10 + 12 * k if n * size <= 4 else struct.unpack(order + "I", entry[8:])[0]
            tags[tag] = struct.unpack(f"{order}{n}{code}", raw[start : start + n * size])
    width, height, bits, packing, kind = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(259, (1,))[0], tags.get(339, (1,))[0]
    if packing not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1 or 273 not in tags:
        raise ValueError("unsupported TIFF layout")
    strips = [raw[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    data = b"".join(strips if packing == 1 else [zlib.decompress(s) for s in strips])
    return np.frombuffer(data, np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}"), width * height).reshape(height, width), tags


def decode(path: str, raw: bytes, layout: dict | None = None) -> np.ndarray:
    """An image by its suffix, or a binary by its label's layout."""
    if layout:
        return decode_raw(raw, int(layout["lines"]), int(layout["samples"]), layout["dtype"], int(layout.get("byte_offset") or 0))
    low = path.lower()
    if low.endswith(".png"):
        return decode_png(raw)
    if low.endswith(".pgm"):
        return decode_pgm(raw)
    if low.endswith((".tif", ".tiff")):
        return decode_tiff(raw)[0]
    raise ValueError(f"{path} has no label and no known image format")


def read_tiles(spark: SparkSession, path: str, layouts: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Tiles of TILES of all rasters of a path: float64 values, row-major. layouts: (stem, lines,
    samples, dtype) of rasters that have labels; a raster that can't be read gives no tile."""
    workers.prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if layouts is not None:
        own = layouts.select("stem", F.struct("lines", "samples", "dtype").alias("layout"))
        files = files.withColumn("stem", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.[^.]*$", "")).join(own, "stem", "left").select("path", "content", "layout")
    else:
        files = files.withColumn("layout", F.lit(None).cast("struct<lines:int,samples:int,dtype:string>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for p, raw, layout in zip(rows["path"], rows["content"], rows["layout"], strict=True):
                try:
                    a = decode(p, bytes(raw), dict(layout) if layout is not None and layout["lines"] == layout["lines"] and layout["lines"] is not None else None).astype(float)
                except (ValueError, KeyError, zlib.error, struct.error):
                    continue
                for i in range(0, a.shape[0], tile):
                    part = [(p, i // tile, j // tile, i, j, *(b := a[i : i + tile, j : j + tile]).shape, b.tobytes()) for j in range(0, a.shape[1], tile)]
                    yield pd.DataFrame(part, columns=["path", "tile_row", "tile_col", "y0", "x0", "height", "width", "data"])

    return files.mapInPandas(run, TILES)


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """(path, y, x, v) of tiles; NaN becomes null."""
    workers.prepare(tiles.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.itertuples():
                a = np.frombuffer(r.data, float).reshape(r.height, r.width)
                y, x = np.mgrid[r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width]
                yield pd.DataFrame({"path": r.path, "y": y.ravel(), "x": x.ravel(), "v": a.ravel()})

    return tiles.mapInPandas(run, "path string, y long, x long, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
