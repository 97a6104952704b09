"""Cells kept in Morton order, so that a window is read without the rest.

The bits of row and column take turns in a cell's key: cells that are near have near keys, and a square whose side is a power of two is one range of keys. A table is
written in ranges of keys, sorted, with many small row groups, whose least and largest keys Parquet keeps. A window is taken apart into ranges, gaps closed until they are few;
as a filter on the key they reach the scan, which skips files, row groups and pages outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, ranges of a window at most.
GROUP, RANGES = 256 << 10, 32
#: Shifts and masks that spread the lower 31 bits of a number over every other bit.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(n: Column) -> Column:
    n = n.cast("long")
    for by, mask in _SPREAD:
        n = n.bitwiseOR(F.shiftleft(n, by)).bitwiseAND(F.lit(mask))
    return n


def morton(row: Column, col: Column) -> Column:
    """The key of a cell, for rows and columns from 0 to 2^31 - 1."""
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def write_clustered(cells: DataFrame, path: str, files: int | None = None) -> None:
    """Writes cells (row, col, ...) in Morton order, with their `key`."""
    keyed = cells.withColumn("key", morton(F.col("row"), F.col("col")))
    dealt = keyed.repartitionByRange(files, "key") if files else keyed.repartitionByRange("key")
    dealt.sortWithinPartitions("key").write.option("parquet.block.size", GROUP).option("parquet.page.size", GROUP // 16).option("parquet.page.row.count.limit", 1024).parquet(path)


def window_ranges(row: int, col: int, rows: int, cols: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, first and last, that hold all cells of a window: exact ones, then the smallest gaps between them closed until at most `most` are left."""
    out: list[list[int]] = []
    bits = max(1, max(row + rows, col + cols).bit_length())

    def visit(r: int, c: int, k: int, first: int) -> None:
        side = 1 << k
        if r >= row + rows or c >= col + cols or r + side <= row or c + side <= col:
            return
        if (row <= r and r + side <= row + rows and col <= c and c + side <= col + cols) or k == 0:
            if out and out[-1][1] + 1 == first:
                out[-1][1] = first + side * side - 1
            else:
                out.append([first, first + side * side - 1])
            return
        half = side >> 1
        for i, (a, b) in enumerate(((0, 0), (0, half), (half, 0), (half, half))):
            visit(r + a, c + b, k - 1, first + i * half * half)

    if rows > 0 and cols > 0:
        visit(0, 0, bits, 0)
    gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
    kept = set(gaps[len(gaps) - most + 1 :]) if len(out) > most else set(gaps)
    merged: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(out):
        if merged and i not in kept:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def read_window(spark: SparkSession, path: str, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """The cells of a window of a table of write_clustered, counted from its corner."""
    row, col, rows, cols = max(row, 0), max(col, 0), rows + min(row, 0), cols + min(col, 0)
    inside = F.lit(False)
    for a, b in window_ranges(row, col, rows, cols):
        inside = inside | F.col("key").between(a, b)
    exact = F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1)
    read = spark.read.parquet(path)
    kinds = dict(read.dtypes)
    return read.where(inside).where(exact).drop("key").withColumns({"row": (F.col("row") - row).cast(kinds["row"]), "col": (F.col("col") - col).cast(kinds["col"])})
