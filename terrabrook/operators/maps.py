"""Coloured maps as PNG tiles.

Cells with colours (r, g, b, a from 0 to 255) go to the output tiles that they weigh on, one shuffle of little more than the cells. A tile is resampled with a sinc of three
lobes windowed by another, along rows and then along columns, on colours multiplied by their opacity, so that what is transparent lends no colour; a reduction widens the kernel by
its factor. The tile is then written as PNG: each line under the filter that makes it smallest in sum, deflated, in chunks with checksums. Without a change of size the colours are kept
to the bit. Missing cells are transparent.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a tile's side, lobes of the kernel.
SIDE, LOBES = 256, 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def weights(first: int, n: int, scale: float, low: int, high: int, of: int) -> np.ndarray:
    """What the cells low..high-1 of an axis of `of` cells give to the pixels first..first+n-1, each of `scale` cells."""
    wide = max(1.0, scale)
    x = (np.arange(low, high) + 0.5 - ((np.arange(first, first + n) + 0.5) * scale)[:, None]) / wide
    k = np.where((np.abs(x) < LOBES) & (np.arange(low, high) >= 0) & (np.arange(low, high) < of), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return k / k.sum(1, keepdims=True)


def resampled(rgba: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Colours (h, w, 4) under weights of rows and columns, as whole numbers."""
    alpha = rgba[..., 3:] / 255.0
    flat = np.concatenate([rgba[..., :3] * alpha, rgba[..., 3:]], 2)
    out = np.einsum("ih,hwc->iwc", rows, flat)
    out = np.einsum("jw,iwc->ijc", cols, out)
    a = np.clip(out[..., 3:], 0, 255)
    return np.clip(np.rint(np.concatenate([np.where(a > 0, out[..., :3] * 255.0 / np.maximum(a, 1e-9), 0), a], 2)), 0, 255).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predicted(lines: np.ndarray) -> list[np.ndarray]:
    """lines (h, bytes) under each of the five filters."""
    x = lines.astype(np.int16)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, 4:], up[1:] = x[:, :-4], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 4:] = x[:-1, :-4]
    p = left + up - corner
    far = [np.abs(p - c) for c in (left, up, corner)]
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
    return [((x - by) & 255).astype(np.uint8) for by in (np.zeros_like(x), left, up, (left + up) >> 1, paeth)]


def write_png(rgba: np.ndarray) -> bytes:
    """An image (h, w, 4) of bytes as PNG."""
    h, w = rgba.shape[:2]
    each = np.stack(_predicted(rgba.reshape(h, w * 4)))
    best = np.abs(each.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    lines = np.concatenate([best[:, None].astype(np.uint8), each[best, np.arange(h)]], 1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The image (h, w, 4) of a PNG of write_png's kind; a wrong checksum or another kind is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, h, w = 8, b"", 0, 0
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            w, h, *rest = struct.unpack(">IIBBBBB", part)
            if rest != [8, 6, 0, 0, 0]:
                raise ValueError("not eight bits of red, green, blue and opacity")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * 4 + 1)
    out = np.zeros((h + 1, w + 1, 4), np.int64)  # with a line and a pixel of zeros before
    for i in range(h):
        kind, line, up = lines[i, 0], lines[i, 1:].reshape(w, 4).astype(np.int64), out[i]
        if kind == 1:
            out[i + 1, 1:] = np.cumsum(line, 0) & 255
        elif kind in (0, 2):
            out[i + 1, 1:] = (line + (up[1:] if kind else 0)) & 255
        else:
            left = np.zeros(4, np.int64)
            for j in range(w):
                a, b, c = left, up[j + 1], up[j]
                if kind == 3:
                    by = (a + b) >> 1
                else:
                    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    by = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                left = (line[j] + by) & 255
                out[i + 1, j + 1] = left
    return out[1:, 1:].astype(np.uint8)


def map_tiles(cells: DataFrame, h: int, w: int, rows: int | None = None, cols: int | None = None, keys: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """(*keys, tile_row, tile_col, height, width, png) of maps of h x w cells (*keys, row, col, r, g, b, a) at rows x cols pixels. Tiles without cells have no row: they are transparent."""
    rows, cols = rows or h, cols or w
    down, across = h / rows, w / cols

    def to(axis: str, scale: float, pixels: int) -> Column:
        reach = LOBES * max(1.0, scale) + 1
        tile = lambda x: F.greatest(F.lit(0), F.least(F.lit((pixels - 1) // side), F.floor(x / scale / side)))
        return F.explode(F.sequence(tile(F.col(axis) - reach), tile(F.col(axis) + reach)))

    kinds = dict(cells.dtypes)
    dealt = cells.where(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1)).select(*keys, "row", "col", "r", "g", "b", "a", to("row", down, rows).alias("tile_row")).withColumn("tile_col", to("col", across, cols))
    shape = [*((k, kinds[k]) for k in keys), ("tile_row", "bigint"), ("tile_col", "bigint"), ("height", "int"), ("width", "int"), ("png", "binary")]

    def paint(table: pa.Table) -> pa.Table:
        i, j = table.column("tile_row")[0].as_py() * side, table.column("tile_col")[0].as_py() * side
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("row", "col"))
        low, left, high, right = r.min(), c.min(), r.max() + 1, c.max() + 1
        edge = lambda first, pixels, scale, of: (max(0, int(np.floor(first * scale - LOBES * max(1.0, scale))) - 1), min(of, int(np.ceil((first + pixels) * scale + LOBES * max(1.0, scale))) + 1))
        high_px, wide_px = min(side, rows - i), min(side, cols - j)
        (low, high), (left, right) = edge(i, high_px, down, h), edge(j, wide_px, across, w)
        rgba = np.zeros((high - low, right - left, 4))
        inside = (r >= low) & (r < high) & (c >= left) & (c < right)
        for k, n in enumerate("rgba"):
            rgba[r[inside] - low, c[inside] - left, k] = table.column(n).to_numpy()[inside]
        image = resampled(rgba, weights(i, high_px, down, low, high, h), weights(j, wide_px, across, left, right, w))
        own = [table.column(n).slice(0, 1).combine_chunks() for n in (*keys, "tile_row", "tile_col")]
        return pa.table([*own, pa.array([high_px], pa.int32()), pa.array([wide_px], pa.int32()), pa.array([write_png(image)], pa.binary())], names=[n for n, _ in shape])

    return dealt.groupBy(*keys, "tile_row", "tile_col").applyInArrow(paint, ", ".join(f"`{n}` {t}" for n, t in shape))


def pixels_of(tiles: DataFrame, keys: Sequence[str] = (), side: int = SIDE) -> DataFrame:
    """(*keys, row, col, r, g, b, a) of the pixels of map_tiles."""
    kinds = dict(tiles.dtypes)
    shape = [*((k, kinds[k]) for k in keys), ("row", "bigint"), ("col", "int"), *((c, "int") for c in "rgba")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                image = read_png(batch.column(len(keys) + 2)[n].as_py())
                h, w = image.shape[:2]
                row, col = batch.column(len(keys))[n].as_py() * side + np.repeat(np.arange(h), w), batch.column(len(keys) + 1)[n].as_py() * side + np.tile(np.arange(w), h)
                own = [pa.array([batch.column(k)[n].as_py()] * (h * w), batch.schema.field(k).type) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(row), pa.array(col.astype(np.int32)), *(pa.array(image[..., k].ravel().astype(np.int32)) for k in range(4))], [n for n, _ in shape])

    return tiles.select(*keys, "tile_row", "tile_col", "png").mapInArrow(read, ", ".join(f"`{n}` {t}" for n, t in shape))
