"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors become whole numbers, floor(scale * x). A bounded number of pivots is drawn by hash; every vector belongs to the cell of
its nearest pivot. The summaries of the cells (pivot, radius, largest norm, the smallest distances to the pivot) bound what a group of
queries can score: for q in the cell of p with radius r and norms up to N, and x at distance d from its pivot o,

    p.o - r|o| - N d  <=  q.x  <=  p.o + r|o| + N d.

With one lower bound for each identifier, its largest, the (k+1)-th largest is a score that every query of the group reaches with k other
identifiers, however many vectors one of them has, so x is copied to the group only if its upper bound does. Cells of near pivots share a copy where that costs less: a
copy saved against products made in vain. A group's data are dealt in slices and its queries in chunks of bounded size, each unit is solved by matrix
products on exact numbers, and a window merges the slices. Of equal vectors only the k + 1 smallest identifiers can win, so a vector that many
rows share is reduced, before it is shuffled, to those.

Vectors that are null, hold null or non-finite components or none take no part, nor do rows without identifier; equal rows count once. Vectors of
different lengths never meet: each length is searched by itself. An identifier with several vectors: its pairs are those of any of its vectors with
the rows of other identifiers. Ties go to the smaller identifier. Scores are longs; components saturate at a long, and products beyond it wrap as longs
do. Fewer than k candidates: all. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, saved

#: Pivots at most (their table of bounds has the square of that), rows of a slice, queries of a chunk, queries multiplied at once.
PIVOTS, SLICE, CHUNK, BLOCK = 1024, 20_000, 50_000, 256
#: Products that cost as much as a copy of a row.
COPY = 2000


def _packed(v: np.ndarray) -> list[bytes]:
    """Rows as bytes: 16-bit numbers if they fit, else 64-bit."""
    small = (v.min(1, initial=0) >= -(1 << 15)) & (v.max(1, initial=0) < 1 << 15)  # the least long has no absolute value
    return [r.astype("<i2").tobytes() if s else r.tobytes() for r, s in zip(v, small, strict=True)]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<i8") for r in rows], np.int64).reshape(-1, dim)


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v, dim): whole-number vectors, packed, of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                ids, rows = batch.column(0).slice(a, 5000), batch.column(1).slice(a, 5000)
                sizes = np.diff(rows.offsets.to_numpy())
                flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.concatenate(([0], np.cumsum(sizes)))
                bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[at]
                keep = np.flatnonzero((np.diff(bad) == 0) & (sizes > 0))
                out: list[bytes] = [b""] * len(keep)
                for dim in np.unique(sizes[keep]):
                    these = np.flatnonzero(sizes[keep] == dim)
                    x = flat[at[keep[these]][:, None] + np.arange(dim)]
                    v = np.clip(np.floor(scale * x), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                    for i, b in zip(these, _packed(v), strict=True):
                        out[i] = b
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(out, pa.binary()), pa.array(sizes[keep].astype(np.int32))], ["id", "v", "dim"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null and not exists(v, x -> x is null)").mapInArrow(run, "id long, v binary, dim int").distinct()


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with their cell, the distance to its pivot and the norm."""
    dim = pivots.shape[1]
    p = pivots.astype(np.float64)
    half = (p * p).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                v = _unpacked(part.column(1).to_pylist(), dim).astype(np.float64)
                cell = (half - v @ p.T).argmin(1)
                d = np.sqrt(((v - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(d), pa.array(np.sqrt((v * v).sum(1)))], ["id", "v", "cell", "d", "norm"])

    return rows.select("id", "v").mapInArrow(run, "id long, v binary, cell int, d double, norm double")


def _top(q: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores of the queries, and for each the positions of its k best, the earlier of equals first."""
    bound = float(np.sqrt((q.astype(np.float64) ** 2).sum(1).max()) * np.sqrt((data.astype(np.float64) ** 2).sum(1).max()))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # partial sums are exact
    scores = q.astype(kind) @ data.astype(kind).T
    k = min(k, len(data))
    least = np.partition(scores, len(data) - k, 1)[:, len(data) - k]
    out = []
    for row, low in zip(scores, least, strict=True):
        near = np.flatnonzero(row >= low)
        out.append(near[np.argsort(-row[near], kind="stable")[:k]])
    return scores, out


def _solved(units: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, other, score): the k best of each unit for its queries, rows of their own identifier left out. A unit's data come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, data, ids = None, [], None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            asked = batch.column(3).to_numpy(zero_copy_only=False)
            number, vectors = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_pylist()
            a = 0
            while a < len(keys):
                b = a + 1
                while b < len(keys) and keys[b] == keys[a] and asked[b] == asked[a]:
                    b += 1
                if keys[a] != unit:
                    unit, parts, data = keys[a], [], None
                if not asked[a]:
                    parts.append((number[a:b], _unpacked(vectors[a:b], dim)))
                elif parts:
                    if data is None:
                        ids, data = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                        order = np.argsort(ids, kind="stable")
                        ids, data = ids[order], data[order]
                    for x in range(a, b, BLOCK):
                        y = min(b, x + BLOCK)
                        which: dict[bytes, int] = {}
                        place = [which.setdefault(v, len(which)) for v in vectors[x:y]]
                        own = np.searchsorted(ids, number[x:y], "right") - np.searchsorted(ids, number[x:y])
                        scores, best = _top(_unpacked(list(which), dim), data, k + int(own.max()))
                        q_out, id_out, s_out = [], [], []
                        for query, i in zip(number[x:y], place, strict=True):
                            near = best[i][ids[best[i]] != query][:k]
                            q_out.append(np.full(len(near), query))
                            id_out.append(ids[near])
                            s_out.append(scores[i, near].astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (q_out, id_out, s_out)], ["query_id", "other", "score"])
                a = b

    return units.mapInArrow(run, "query_id long, other long, score long")


def grouped(cells: dict[int, tuple[int, np.ndarray]], far: np.ndarray, copied) -> list[list[int]]:
    """Cells as groups that share a copy of the data. cells: queries and distances from which vectors must be copied; far: distances of pivots; copied: rows of such distances."""
    left, out = set(cells), []
    while left:
        seed = max(left, key=lambda i: (cells[i][0], -i))
        left.remove(seed)
        group, (queries, need) = [seed], cells[seed]
        rows = copied(need)
        for i in sorted(left, key=lambda i: (far[seed, i], i)):
            more, alone = cells[i][0], copied(cells[i][1])
            both = np.minimum(need, cells[i][1])
            together = copied(both)
            if queries + more > CHUNK or (COPY + queries + more) * together > (COPY + queries) * rows + (COPY + more) * alone:
                break
            group.append(i)
            left.remove(i)
            queries, need, rows = queries + more, both, together
        out.append(group)
    return out


def knn_join(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query with all other rows. is_query: a condition on column `id`."""
    rows = saved(quantised(vectors, key, vector, scale), "vectors")
    lengths = sorted(rows.groupBy("dim").agg(F.count("*").alias("n")).collect(), key=lambda r: r["dim"])
    best = rows.sparkSession.createDataFrame([], "query_id long, other long, score long")
    for r in lengths:
        best = best.unionByName(_of_length(rows.where(F.col("dim") == r["dim"]), r["dim"], r["n"], is_query, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("vec_id"), "score")


def _of_length(rows: DataFrame, dim: int, n: int, is_query: Column, k: int) -> DataFrame:
    """(query_id, other, score): candidates that hold the k best of every query among the n rows, which have `dim` components."""
    drawn = rows.groupBy("v").agg(F.min(F.xxhash64("id")).alias("h")).orderBy("h", "v").limit(int(min(PIVOTS, max(1, n**0.5 / 4)))).collect()
    pivots = _unpacked([bytes(r["v"]) for r in drawn], dim)
    cells = saved(_assigned(rows, pivots), "cells")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    data = saved(cells.withColumn("place", first).where(F.col("place") <= k + 1).drop("place"), "data")
    nearest = data.groupBy("cell", "id").agg(F.min("d").alias("d")).withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("d", "id")))
    near = sorted((r["id"], r["cell"], r["d"]) for r in nearest.where(F.col("place") <= k + 1).collect())  # so many rows a pivot
    held = {r["cell"]: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()}
    asked = {r["cell"]: r for r in cells.where(is_query).groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.max("norm").alias("norm")).collect()}
    p = pivots.astype(np.float64)
    dots, norms = p @ p.T, np.sqrt((p * p).sum(1))
    near_id, near_cell, near_d = np.array([r[0] for r in near], np.int64), np.array([r[1] for r in near], np.int64), np.array([r[2] for r in near])
    firsts = np.flatnonzero(np.concatenate(([True], near_id[1:] != near_id[:-1])))
    least = {}  # by cell of queries: the distance from its pivot at which a vector of each cell must be copied
    for i, g in asked.items():
        low = dots[i, near_cell] - g["r"] * norms[near_cell] - g["norm"] * near_d
        low = np.maximum.reduceat(low, firsts)
        reached = np.sort(low)[-k - 1] if len(low) > k else -np.inf
        slack = 1e-9 * (1 + abs(reached) + np.abs(dots[i]) + g["r"] * norms)
        room = reached - slack - dots[i] - g["r"] * norms
        least[i] = (g["n"], np.where(room <= 0, -1.0, room / max(g["norm"], 1e-300) * (1 - 1e-9)))
    sizes, radii = np.zeros(len(p), np.int64), np.full(len(p), -1.0)
    for j, c in held.items():
        sizes[j], radii[j] = c["n"], c["r"]
    square = (p * p).sum(1)
    groups = grouped(least, square[:, None] + square - 2 * dots, lambda need: int(sizes[need <= radii].sum()))
    n_groups, group_of = len(groups), np.zeros(len(p), np.int64)
    need = np.full((n_groups, len(p)), np.inf)
    slices, chunks = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
        need[g] = np.min([least[i][1] for i in members], axis=0)
        slices[g], chunks[g] = max(1, -(-int(sizes[need[g] <= radii].sum()) // SLICE)), -(-sum(least[i][0] for i in members) // CHUNK)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            part = mixed(batch.column(0).to_numpy().astype(np.uint64))  # identifiers may have a common stride
            for i in range(n_groups):
                to = np.flatnonzero(d >= need[i, cell])
                for c in range(chunks[i] if len(to) else 0):
                    fill = lambda x, m=len(to): pa.array(np.full(m, x, np.int32))
                    yield pa.RecordBatch.from_arrays([fill(i), pa.array((part[to] % np.uint64(slices[i])).astype(np.int32)), fill(c), pa.array(np.zeros(len(to), bool)), batch.column(0).take(pa.array(to)), batch.column(1).take(pa.array(to))], ["g", "slice", "chunk", "asked", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            group = group_of[cell]
            copies = slices[group]
            at = np.repeat(np.arange(len(ids)), copies)
            slice_ = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            chunk = ((ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(chunks[group[at]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(group[at].astype(np.int32)), pa.array(slice_.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(np.ones(len(at), bool)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["g", "slice", "chunk", "asked", "id", "v"])

    shape = "g int, slice int, chunk int, asked boolean, id long, v binary"
    units = data.select("id", "v", "cell", "d").mapInArrow(copy, shape).unionByName(cells.where(is_query).select("id", "v", "cell").mapInArrow(ask, shape))
    units = units.repartition("g", "slice", "chunk").sortWithinPartitions("g", "slice", "chunk", "asked")
    return _solved(units, dim, k)
