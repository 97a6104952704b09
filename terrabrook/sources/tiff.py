"""Raster files: tiled TIFF as a Spark data source, with pruning by row and column.

    tiff.write_raster(cells, path, frame)          # cells (row, col, v) as files of BLOCK x BLOCK cells
    tiff.read_raster(spark, path).where("row < 100 and col between 20 and 40")

A file holds one band of 64-bit numbers in tiles, deflated under the predictor for floating point numbers (the bytes of a line by significance, each the difference to the one before),
and the keys that place it in a UTM zone. Missing cells are NaN. Written by one task each, files appear whole, under their final name, or not at all. The reader opens only the
directories of the files to plan; a partition is a run of tiles of a file. Comparisons of row and col with numbers are pushed to it: tiles that they rule out are neither
planned nor read. Paths are those that pyarrow's file systems know: a folder mounted on all machines, or an object store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.warp import Frame

#: Cells of a file's side and of a tile's side, tiles of a partition.
BLOCK, TILE, RUN = 1024, 128, 16
NAME = "terrabrook_tiff"
#: Tags of the format and the sizes of its types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 277, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735
_SHORT, _LONG, _DOUBLE = 3, 4, 12
_SIZES = {_SHORT: ("H", 2), _LONG: ("I", 4), _DOUBLE: ("d", 8)}


def _packed(tile: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(tile.astype(">f8")).view(np.uint8).reshape(*tile.shape, 8).transpose(0, 2, 1).reshape(tile.shape[0], -1)
    out = planes.copy()
    out[:, 1:] -= planes[:, :-1]
    return zlib.compress(out.tobytes(), 6)


def _unpacked(data: bytes, side: int) -> np.ndarray:
    planes = np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(side, side * 8), 1, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(side, 8, side).transpose(0, 2, 1)).view(">f8")[..., 0].astype(np.float64)


def encode(grid: np.ndarray, x0: float, y0: float, res_m: float, epsg: int, side: int = TILE) -> bytes:
    """A grid (h, w) as a file; (x0, y0): its upper left corner."""
    h, w = grid.shape
    down, across = -(-h // side), -(-w // side)
    whole = np.full((down * side, across * side), np.nan)
    whole[:h, :w] = grid
    tiles = [_packed(whole[i * side : (i + 1) * side, j * side : (j + 1) * side]) for i in range(down) for j in range(across)]
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]
    entries: list[tuple[int, int, Sequence]] = [(WIDTH, _LONG, [w]), (LENGTH, _LONG, [h]), (BITS, _SHORT, [64]), (COMPRESSION, _SHORT, [8]), (PHOTOMETRIC, _SHORT, [1]), (SAMPLES, _SHORT, [1]), (PREDICTOR, _SHORT, [3]), (TILE_WIDTH, _LONG, [side]), (TILE_LENGTH, _LONG, [side]), (TILE_OFFSETS, _LONG, [0] * len(tiles)), (TILE_BYTES, _LONG, [len(t) for t in tiles]), (SAMPLE_FORMAT, _SHORT, [3]), (PIXEL_SCALE, _DOUBLE, [res_m, res_m, 0.0]), (TIE_POINT, _DOUBLE, [0.0, 0.0, 0.0, x0, y0, 0.0]), (GEO_KEYS, _SHORT, keys)]
    after = 8 + 2 + 12 * len(entries) + 4
    sizes = [len(v) * _SIZES[t][1] for _, t, v in entries]
    first = after + sum(s for s in sizes if s > 4)
    entries[9] = (TILE_OFFSETS, _LONG, [first + sum(len(t) for t in tiles[:k]) for k in range(len(tiles))])
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for (tag, kind, values), size in zip(entries, sizes, strict=True):
        data = struct.pack(f"<{len(values)}{_SIZES[kind][0]}", *values)
        head += struct.pack("<HHI", tag, kind, len(values)) + (data.ljust(4, b"\0") if size <= 4 else struct.pack("<I", after + len(extra)))
        extra += data if size > 4 else b""
    return head + struct.pack("<I", 0) + extra + b"".join(tiles)


def directory(file: pa.NativeFile) -> dict[int, tuple]:
    """The tags of a file and their values; nothing else of it is read."""
    order, magic, at = struct.unpack("<2sHI", file.read_at(8, 0))
    if order != b"II" or magic != 42:
        raise ValueError("not a little-endian TIFF")
    (n,) = struct.unpack("<H", file.read_at(2, at))
    raw, out = file.read_at(12 * n, at + 2), {}
    for k in range(n):
        tag, kind, count = struct.unpack("<HHI", raw[12 * k : 12 * k + 8])
        if kind not in _SIZES:
            continue
        letter, size = _SIZES[kind]
        data = raw[12 * k + 8 : 12 * k + 8 + count * size] if count * size <= 4 else file.read_at(count * size, struct.unpack("<I", raw[12 * k + 8 : 12 * k + 12])[0])
        out[tag] = struct.unpack(f"<{count}{letter}", data)
    if out[COMPRESSION] != (8,) or out[PREDICTOR] != (3,) or out[BITS] != (64,) or out[TILE_WIDTH] != out[TILE_LENGTH]:
        raise ValueError("another kind of TIFF")
    return out


def _store(path: str) -> tuple[stores.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return stores.LocalFileSystem(), path
    return stores.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Tiles(InputPartition):
    """A run of tiles of a file: (place in the file, bytes, first row, first column) of each, and the cells that the file has."""

    path: str
    side: int
    row: int
    col: int
    h: int
    w: int
    tiles: list[tuple[int, int, int, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str, run: int) -> None:
        self.path, self.run = path, run
        self.low, self.high = {"row": -(1 << 62), "col": -(1 << 62)}, {"row": 1 << 62, "col": 1 << 62}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            axis, value = (f.attribute[0], getattr(f, "value", None)) if hasattr(f, "attribute") and len(f.attribute) == 1 else (None, None)
            if axis in self.low and isinstance(value, (int, float)) and not isinstance(value, bool):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[axis] = max(self.low[axis], value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[axis] = min(self.high[axis], value)
            yield f  # tiles are ruled out, cells are Spark's to filter

    def partitions(self) -> Sequence[InputPartition]:
        store, at = _store(self.path)
        out = []
        for info in sorted(store.get_file_info(stores.FileSelector(at)), key=lambda i: i.path):
            if not info.path.endswith(".tif"):
                continue
            row, col = (int(x) for x in info.base_name.removesuffix(".tif").split("_")[1:3])
            if row > self.high["row"] or col > self.high["col"]:
                continue
            with store.open_input_file(info.path) as file:
                tags = directory(file)
            side, h, w = tags[TILE_WIDTH][0], tags[LENGTH][0], tags[WIDTH][0]
            across = -(-w // side)
            kept = []
            for k, (place, size) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_BYTES], strict=True)):
                r, c = row + k // across * side, col + k % across * side
                if r <= self.high["row"] and r + side > self.low["row"] and c <= self.high["col"] and c + side > self.low["col"]:
                    kept.append((place, size, r, c))
            out += [Tiles(info.path, side, row, col, h, w, kept[a : a + self.run]) for a in range(0, len(kept), self.run)]
        return out or [Tiles("", 0, 0, 0, 0, 0, [])]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        if not partition.tiles:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file:
            for place, size, row, col in partition.tiles:
                tile = _unpacked(file.read_at(size, place), partition.side)
                tile = tile[: partition.row + partition.h - row, : partition.col + partition.w - col]
                r, c = np.indices(tile.shape)
                yield pa.RecordBatch.from_arrays([pa.array((r + row).ravel()), pa.array((c + col).ravel().astype(np.int32)), pa.array(tile.ravel(), from_pandas=True)], ["row", "col", "v"])


class Tiff(DataSource):
    """spark.read.format(NAME).load(path): (row, col, v) of the files of write_raster."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "row long, col int, v double"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("run", RUN)))


def write_raster(cells: DataFrame, path: str, frame: Frame, block: int = BLOCK, tile: int = TILE) -> int:
    """Writes cells (row, col, v) as files of block x block cells, one task a file. Returns how many files."""

    def write(table: pa.Table) -> pa.Table:
        i, j = table.column("_i")[0].as_py() * block, table.column("_j")[0].as_py() * block
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("row", "col"))
        grid = np.full((min(block, frame.h - i), min(block, frame.w - j)), np.nan)
        grid[r - i, c - j] = table.column("v").to_numpy(zero_copy_only=False)
        store, at = _store(path)
        store.create_dir(at, recursive=True)
        name = f"{at}/block_{i}_{j}.tif"
        temporary = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(encode(grid, frame.x0 + j * frame.res_m, frame.y0 - i * frame.res_m, frame.res_m, frame.epsg, tile))
        store.move(temporary, name)
        return pa.table({"name": [name]})

    inside = cells.where(F.col("row").between(0, frame.h - 1) & F.col("col").between(0, frame.w - 1))
    dealt = inside.select("row", "col", F.col("v").cast("double").alias("v"), F.floor(F.col("row") / block).alias("_i"), F.floor(F.col("col") / block).alias("_j"))
    return dealt.groupBy("_i", "_j").applyInArrow(write, "name string").count()


def read_raster(spark: SparkSession, path: str, run: int = RUN) -> DataFrame:
    """(row, col, v) of the files under path; comparisons of row and col reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tiff)
    return spark.read.format(NAME).option("run", run).load(path)
