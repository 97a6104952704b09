"""Many polygons at once: polygons as a relation, joined with cells and with other polygons by equal joins on tiles.

A polygon is a row with an array of rings of points (x, y), in any coordinates; rings close by themselves, and a ring within another is a hole. Polygons that are null or
have fewer than three points in all meet nothing.

`cover` takes each polygon apart into the tiles of a quadtree: from tiles of SIDE << LEVELS down, a tile that no edge touches is inside or outside as a whole, the others are quartered.
Only tiles at the rim keep edges, and of those only the ones that a ray to the right from within the tile can cross. Cells meet polygons by the tile they lie in; the
parity of crossed edges is asked in rim tiles only.

`meeting` joins polygons with polygons: both go to the tiles that their boxes overlap, and a pair is reported in the one tile that holds the
lower left corner of the boxes' common part. Tiles with too many members on both sides are quartered, round by round, as long as that leaves fewer pairs to look at: tiles of about the
polygons' own size aren't, since each polygon would go to most quarters. What is crowded then is dealt into groups of at most GROUP keys a side, so no task gets all pairs of a crowded place.
Equal polygons are tested once: one of each goes to the tiles, with the keys of all that are equal. Polygons of up to CARRIED edges bring these to the tiles, so a pair
is tested where it is found, many at once in numpy; the edges of larger ones are joined to their pairs, as are the keys where more than KEYS polygons are equal. Else a pair
that is found isn't shuffled: a polygon is handed on with a list of all that it meets in a group, and only the result has a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .scratch import saved

#: Side of the smallest tiles, and how often the largest are quartered to get there.
SIDE, LEVELS = 16, 4
#: Pairs of a tile beyond which it is quartered, and quarterings at most.
PAIRS, ROUNDS = 1_000_000, 8
#: Copies of members, left times right, that quartering a tile may make of four, so that fewer pairs are left.
COPIES = 2.4
#: Edges that a polygon takes along to its tiles; those of one with more stay behind.
CARRIED = 64
#: Keys of equal polygons that go along with one of them, or in a row where they are more; keys that a row meets, as explode holds all pairs of a row at once; keys of either side in a group.
KEYS, MET, GROUP = 64, 256, 4096
TILE = ["_size", "_tx", "_ty"]
#: Pairs of boxes looked at, pairs of polygons collected, and those tested at once.
LOOKED, HELD, TESTED = 1 << 20, 1 << 17, 2048
NO_EDGES = "cast(array() as array<struct<x1:double,y1:double,x2:double,y2:double>>)"


def edges_of(rings: Column) -> Column:
    """The edges (x1, y1, x2, y2) of an array of rings."""
    edge = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    each = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p, i: edge(p, F.get(r, (i + 1) % F.size(r))))))
    return F.filter(each, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def crossings(edges: Column, x: Column, y: Column) -> Column:
    """How many edges a ray to the right of a point crosses; odd: the point is inside."""
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, crossed))


def _least(edges: Column, a: str, b: str) -> Column:
    return F.array_min(F.transform(edges, lambda e: F.least(e[a], e[b])))


def _most(edges: Column, a: str, b: str) -> Column:
    return F.array_max(F.transform(edges, lambda e: F.greatest(e[a], e[b])))


def box_of(edges: Column) -> Column:
    """(x1, x2, y1, y2) of an array of edges."""
    return F.struct(_least(edges, "x1", "x2").alias("x1"), _most(edges, "x1", "x2").alias("x2"), _least(edges, "y1", "y2").alias("y1"), _most(edges, "y1", "y2").alias("y2"))


def _ahead(edges: Column, tx: Column, ty: Column, size: Column) -> Column:
    """The edges that matter in a tile: they share heights with it and don't lie to its left."""
    low, high, left = ty * size, (ty + 1) * size, tx * size
    return F.filter(edges, lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["x1"], e["x2"]) >= left))


def _state(edges: Column, tx: Column, ty: Column, size: Column) -> Column:
    """Of a tile: null if an edge may touch it, else whether it is inside."""
    low, high, left, right = ty * size, (ty + 1) * size, tx * size, (tx + 1) * size

    def touches(e: Column) -> Column:
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = [side(x, y) for x in (left, right) for y in (low, high)]
        slack = 1e-9 * (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"]) + size) * (F.abs(left) + F.abs(low) + F.abs(e["x1"]) + F.abs(e["y1"]) + size)
        return (F.least(e["x1"], e["x2"]) <= right) & (F.least(*corners) <= slack) & (F.greatest(*corners) >= -slack)

    return F.when(~F.exists(edges, touches), crossings(edges, (left + right) / 2, (low + high) / 2) % 2 == 1)


def _judged(tiles: Column, edges: Column, size: Column) -> Column:
    """(x, y, e, inside) of those of an array of tiles (x, y) that aren't outside; e: the edges of tiles at the rim. As one expression, so that it is worked out once."""
    near = F.transform(tiles, lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), _ahead(edges, t["x"], t["y"], size).alias("e")))
    told = F.transform(near, lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["e"].alias("e"), _state(t["e"], t["x"], t["y"], size).alias("inside")))
    kept = F.filter(told, lambda t: t["inside"].isNull() | t["inside"])
    return F.transform(kept, lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), F.when(t["inside"].isNull(), t["e"]).otherwise(F.expr(NO_EDGES)).alias("e"), t["inside"].alias("inside")))


def cover(fields: DataFrame, keys: Sequence[str], rings: str, side: int = SIDE, levels: int = LEVELS) -> DataFrame:
    """(*keys, _tx, _ty, _inside, _edges): the tiles of `side` that a polygon covers; _inside is null at its rim, where _edges are the edges to test. A polygon starts from tiles of about its own size."""
    rows = fields.select(*keys, edges_of(F.col(rings)).alias("_edges")).where(F.size("_edges") > 2).withColumn("_box", box_of(F.col("_edges")))
    extent, size = F.greatest(F.col("_box.x2") - F.col("_box.x1"), F.col("_box.y2") - F.col("_box.y1")), F.lit(float(side << levels))
    for level in range(levels - 1, -1, -1):
        size = F.when(extent <= side << level, F.lit(float(side << level))).otherwise(size)
    span = lambda a, b: F.sequence(F.floor(F.col(f"_box.{a}") / F.col("_size")), F.floor(F.col(f"_box.{b}") / F.col("_size")))
    rows = rows.withColumn("_size", size).withColumn("_ty", F.explode(span("y1", "y2")))
    low, high = F.col("_ty") * F.col("_size"), (F.col("_ty") + 1) * F.col("_size")
    strip = F.filter("_edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high))  # a row of tiles first
    rows = rows.select(*keys, "_size", "_ty", strip.alias("_edges"), F.explode(span("x1", "x2")).alias("_tx")).repartition(*keys, "_tx", "_ty")  # the tiles of a large polygon part
    own = F.struct(F.col("_tx").alias("x"), F.col("_ty").alias("y"))
    rows = rows.select(*keys, "_size", F.explode(_judged(F.array(own), F.col("_edges"), F.col("_size"))).alias("_t"))
    for level in range(levels - 1, -1, -1):
        large = F.col("_size") > side << level
        quarters = F.array(*(F.struct((F.col("_t.x") * 2 + a).alias("x"), (F.col("_t.y") * 2 + b).alias("y")) for a in (0, 1) for b in (0, 1)))
        whole = F.transform(quarters, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.expr(NO_EDGES).alias("e"), F.lit(True).alias("inside")))
        next_ = F.when(~large, F.array("_t")).when(F.col("_t.inside"), whole).otherwise(_judged(quarters, F.col("_t.e"), F.col("_size") / 2))
        rows = rows.select(*keys, F.when(large, F.col("_size") / 2).otherwise(F.col("_size")).alias("_half"), F.explode(next_).alias("_part")).withColumnsRenamed({"_half": "_size", "_part": "_t"})
    return rows.select(*keys, F.col("_t.x").alias("_tx"), F.col("_t.y").alias("_ty"), F.col("_t.inside").alias("_inside"), F.col("_t.e").alias("_edges"))


def cells_of(cells: DataFrame, fields: DataFrame, keys: Sequence[str], rings: str, x: str | Column = "x", y: str | Column = "y", by: Sequence[str] = (), side: int = SIDE, levels: int = LEVELS) -> DataFrame:
    """cells with the keys of each polygon that they lie in: a row for each pair. x, y: a cell's centre; by: columns of both that must be equal as well, such as the grid."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    placed = cells.withColumns({"_x": x, "_y": y, "_tx": F.floor(x / side), "_ty": F.floor(y / side)})
    met = placed.join(cover(fields, [*by, *(k for k in keys if k not in by)], rings, side, levels), [*by, "_tx", "_ty"])
    inside = F.coalesce("_inside", crossings(F.col("_edges"), F.col("_x"), F.col("_y")) % 2 == 1)
    return met.where(inside).drop("_x", "_y", "_tx", "_ty", "_inside", "_edges")


def _cross(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common."""
    turn = lambda a, p, x, y: F.signum((a["x2"] - a["x1"]) * (p[y] - a["y1"]) - (a["y2"] - a["y1"]) * (p[x] - a["x1"]))
    apart = lambda a, b: (F.greatest(e[a], e[b]) < F.least(f[a], f[b])) | (F.greatest(f[a], f[b]) < F.least(e[a], e[b]))
    return ~apart("x1", "x2") & ~apart("y1", "y2") & (turn(e, f, "x1", "y1") * turn(e, f, "x2", "y2") <= 0) & (turn(f, e, "x1", "y1") * turn(f, e, "x2", "y2") <= 0)


def meet(a: Column, b: Column) -> Column:
    """Whether two polygons, as arrays of edges, have a point in common: their edges cross, or one lies in the other."""
    first = lambda e: (F.get(e, F.lit(0))["x1"], F.get(e, F.lit(0))["y1"])
    within = lambda e, f: crossings(f, *first(e)) % 2 == 1
    return F.exists(a, lambda e: F.exists(b, lambda f: _cross(e, f))) | within(a, b) | within(b, a)


def _boxes(polygons: DataFrame, key: str, rings: str, size: float) -> DataFrame:
    more = [c for c in polygons.columns if c not in (key, rings)]
    boxes = polygons.select(F.col(key).alias("_key"), *more, edges_of(F.col(rings)).alias("_e")).where(F.size("_e") > 2)
    odd = F.exists("_e", lambda e: (e["x1"] + e["x2"] + e["y1"] + e["y2"]).isNull() | F.isnan(e["x1"] + e["x2"] + e["y1"] + e["y2"]))
    boxes = boxes.select("_key", *more, box_of(F.col("_e")).alias("_box"), F.when((F.size("_e") <= CARRIED) & ~odd, F.col("_e")).alias("_e"))
    at = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"_box.{a}") / size), F.floor(F.col(f"_box.{b}") / size)))
    return boxes.withColumn("_tx", at("x1", "x2")).withColumn("_ty", at("y1", "y2")).withColumn("_size", F.lit(size))


def _quartered(members: DataFrame, crowded: DataFrame) -> DataFrame:
    """Members of crowded tiles go to those quarters that their box overlaps."""
    met = members.join(crowded.withColumn("_split", F.lit(True)), TILE, "left")
    quarters = F.array(*(F.struct((F.col("_size") / 2).alias("s"), (F.col("_tx") * 2 + a).alias("x"), (F.col("_ty") * 2 + b).alias("y")) for a in (0, 1) for b in (0, 1)))
    met = met.withColumn("_q", F.explode(F.when(F.col("_split"), quarters).otherwise(F.array(F.struct(F.col("_size").alias("s"), F.col("_tx").alias("x"), F.col("_ty").alias("y"))))))
    overlap = lambda a, b, t: (F.floor(F.col(f"_box.{a}") / F.col("_q.s")) <= F.col(f"_q.{t}")) & (F.floor(F.col(f"_box.{b}") / F.col("_q.s")) >= F.col(f"_q.{t}"))
    rest = [c for c in members.columns if c not in TILE]
    return met.where(overlap("x1", "x2", "x") & overlap("y1", "y2", "y")).select(*rest, F.col("_q.x").alias("_tx"), F.col("_q.y").alias("_ty"), F.col("_q.s").alias("_size"))


def _counted(members: DataFrame, n: str, copies: str) -> DataFrame:
    """(*TILE, n, copies): the members of each tile, and how many quarters one of them goes to on average."""
    half = F.col("_size") / 2
    to = lambda a, b, t: (F.floor(F.col(f"_box.{a}") / half) <= F.col(t) * 2).cast("int") + (F.floor(F.col(f"_box.{b}") / half) > F.col(t) * 2).cast("int")
    return members.groupBy(*TILE).agg(F.count("*").alias(n), F.avg(to("x1", "x2", "_tx") * to("y1", "y2", "_ty")).alias(copies))


def different(polygons: DataFrame, key: str, rings: str) -> tuple[DataFrame, DataFrame]:
    """(_key, _rings, _n) of each different polygon, by the least key that has it, and (_key, _one, _n) of all keys that have it; _n: how many these are. Polygons are equal if a digest of their points is."""
    rows = polygons.select(F.col(key).alias("_one"), F.col(rings).alias("_rings"), F.unhex(F.sha2(F.col(rings).cast("string"), 256)).alias("_same"))
    own = rows.groupBy("_same").agg(F.min("_one").alias("_key"), F.first("_rings").alias("_rings"), F.count("*").alias("_n"))
    own = saved(own.where(F.size(edges_of(F.col("_rings"))) > 2), "shapes")
    return own.select("_key", "_rings", "_n"), saved(rows.select("_one", "_same").join(own.select("_same", "_key", "_n"), "_same").select("_key", "_one", "_n"), "members")


def candidates(a: DataFrame, b: DataFrame, keys: tuple[str, str], rings: tuple[str, str], size: float = 64.0, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """The members (_key, _box, _e, _tx, _ty, _size) of tiles of both sides, with what other columns they have; crowded tiles are quartered as long as that leaves fewer pairs. _e is null
    where there are more edges than CARRIED, or one of them isn't of numbers."""
    left, right = (saved(_boxes(p, k, r, float(size)), "members") for p, k, r in ((a, keys[0], rings[0]), (b, keys[1], rings[1])))
    for _ in range(ROUNDS):
        counts = _counted(left, "_n", "_c").join(_counted(right, "_m", "_d"), TILE)
        crowded = saved(counts.where((F.col("_n") * F.col("_m") > pairs) & (F.col("_c") * F.col("_d") <= COPIES)).select(*TILE), "crowded")
        if crowded.isEmpty():
            break
        left, right = _quartered(left, crowded), _quartered(right, crowded)
    return left, right


def _packs(members: DataFrame) -> DataFrame:
    """(_key, _n, _pack, _keys): the keys of equal polygons, in one array if there are at most KEYS, else in arrays of about as many."""
    pack = F.pmod(F.xxhash64("_one"), F.ceil(F.col("_n") / KEYS))
    return saved(members.groupBy("_key", "_n", pack.alias("_pack")).agg(F.collect_list("_one").alias("_keys")), "packs")


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of tiles that both sides have, with (_i, _j), the group within their tile: those of the left are dealt by _i and copied to each _j, those of the right the other way round."""
    weight = lambda m, n: m.groupBy(*TILE).agg(F.ceil(F.sum(F.size("_keys")) / GROUP).alias(n))
    parts = saved(weight(left, "_p").join(weight(right, "_q"), TILE), "groups")
    left, right = left.join(parts, TILE), right.join(parts, TILE)
    part = lambda n: F.pmod(F.xxhash64("_key"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    return left.withColumn("_i", part("_p")).withColumn("_j", each("_q")), right.withColumn("_j", part("_q")).withColumn("_i", each("_p"))


class _Edges:
    """The edges of polygons, as arrays (edge, polygon) in which NaN stands for none."""

    def __init__(self, edges: pa.Array) -> None:
        self.n = edges.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, polygon = edges.flatten(), np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(polygon)) - np.repeat(np.cumsum(self.n) - self.n, self.n), polygon
        self.x1, self.y1, self.x2, self.y2 = (np.full((int(self.n.max(initial=0)), len(self.n)), np.nan) for _ in range(4))
        for name in ("x1", "y1", "x2", "y2"):
            getattr(self, name)[at] = flat.field(name).to_numpy(zero_copy_only=False)

    def of(self, i: np.ndarray) -> tuple[np.ndarray, ...]:
        most = int(self.n[i].max())
        return tuple(c[:most].take(i, axis=1) for c in (self.x1, self.y1, self.x2, self.y2))


def _odd(edges: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """crossings() of each polygon and its point, whether they are odd."""
    x1, y1, x2, y2 = edges
    return np.logical_xor.reduce(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), axis=0)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two turns differ, or one is none."""
    return (np.minimum(a, b) <= 0) & (np.maximum(a, b) >= 0)


def _tested(edges: _Edges, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """meet() of the polygons i and j, in the same arithmetic."""
    a, b = edges.of(i), edges.of(j)
    out = _odd(b, a[0][0], a[1][0]) | _odd(a, b[0][0], b[1][0])
    for k in range(len(a[0])):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        px, py, qx, qy = (c[k, left] for c in a)
        x1, y1, x2, y2 = (c.take(left, axis=1) for c in b)
        dx, dy = qx - px, qy - py
        e, f = np.nonzero(_between(dx * (y1 - py) - dy * (x1 - px), dx * (y2 - py) - dy * (x2 - px)))
        x1, y1, x2, y2, px, py, qx, qy = x1[e, f], y1[e, f], x2[e, f], y2[e, f], px[f], py[f], qx[f], qy[f]
        dx, dy = x2 - x1, y2 - y1
        crossed = _between(dx * (py - y1) - dy * (px - x1), dx * (qy - y1) - dy * (qx - x1))
        for p, q, u, v in ((px, qx, x1, x2), (py, qy, y1, y2)):
            crossed &= (np.maximum(p, q) >= np.minimum(u, v)) & (np.maximum(u, v) >= np.minimum(p, q))
        out[left[f[crossed]]] = True
    return out


def _alike(edges: _Edges, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_tested() of any number of pairs, those of about as many edges together."""
    out, kind = np.zeros(len(i), bool), np.frexp(edges.n)[1]
    kinds = kind[i] * 64 + kind[j]
    for one in np.unique(kinds):
        at = np.flatnonzero(kinds == one)
        for k in range(0, len(at), TESTED):
            part = at[k : k + TESTED]
            out[part] = _tested(edges, i[part], j[part])
    return out


def _near(rows: pa.Table, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left, right) of rows whose boxes overlap and that are reported in their tile; first: where the groups begin."""
    box = rows.column("_box").combine_chunks()
    x1, x2, y1, y2 = (box.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "x2", "y1", "y2"))
    size, tx, ty, right = (rows.column(c).to_numpy() for c in ("_size", "_tx", "_ty", "_right"))
    for start, end in zip(first, [*first[1:], len(rows)]):
        side = right[start:end]
        own, r = start + np.flatnonzero(~side), start + np.flatnonzero(side)
        step = max(1, LOOKED // max(1, len(r)))
        for k in range(0, len(own) if len(r) else 0, step):
            part = own[k : k + step]
            over = (x1[part, None] <= x2[r]) & (x2[part, None] >= x1[r]) & (y1[part, None] <= y2[r]) & (y2[part, None] >= y1[r])
            i, j = np.nonzero(over)
            i, j = part[i], r[j]
            here = (np.floor(np.maximum(x1[i], x1[j]) / size[start]) == tx[start]) & (np.floor(np.maximum(y1[i], y1[j]) / size[start]) == ty[start])
            yield i[here], j[here]


def _lists(keys: pa.Array, i: np.ndarray, first: np.ndarray) -> pa.Array:
    """The lists of keys at i put together in lists that begin at first, which are positions in i."""
    n = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = (np.cumsum(n) - n)[i]
    m = n[i]
    ends = np.cumsum(m)
    at = np.arange(ends[-1]) + np.repeat(of - (ends - m), m)
    return pa.ListArray.from_arrays(pa.array(np.append((ends - m)[first], ends[-1]), pa.int32()), keys.flatten().take(pa.array(at)))


def _runs(i: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where lists begin: at each new i, and after every MET keys or so; n: the keys at each position."""
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    before = np.cumsum(n) - n
    part = (before - np.repeat(before[first], np.diff(np.append(first, len(i))))) // MET
    return np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (part[1:] != part[:-1])))


def _found(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(_a, _b) of whole groups: all keys of a list _a meet all of the list _b."""
    edges = _Edges(rows.column("_e").combine_chunks())
    a, b = rows.column("_a").combine_chunks(), rows.column("_b").combine_chunks()
    n, held = b.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), []

    def tested() -> Iterator[pa.RecordBatch]:
        i, j = (np.concatenate(c) for c in zip(*held))
        met = _alike(edges, i, j)
        i, j = i[met], j[met]
        if len(i):
            runs = _runs(i, n[j])
            yield pa.RecordBatch.from_arrays([_lists(a, i[runs], np.arange(len(runs))), _lists(b, j, runs)], ["_a", "_b"])

    for pair in _near(rows, first):
        held.append(pair)
        if sum(len(i) for i, _ in held) >= HELD:
            yield from tested()
            held.clear()
    if held:
        yield from tested()


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_found() of rows that come in the order of their groups; the last group of a batch waits for the next one."""
    waiting: pa.Table | None = None
    with np.errstate(all="ignore"):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            other = np.zeros(max(0, len(rows) - 1), bool)
            for c in (*TILE, "_i", "_j"):
                v = rows.column(c).to_numpy()
                other |= v[1:] != v[:-1]
            first = np.append(0, np.flatnonzero(other) + 1)
            if first[-1]:
                yield from _found(rows.slice(0, first[-1]), first[:-1])
            waiting = rows.slice(first[-1])
        if waiting is not None and len(waiting):
            yield from _found(waiting, np.zeros(1, int))


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_a, _b): lists of keys of the members of both sides, of which each of one list meets each of the other."""
    kind = lambda m: m.schema["_keys"].dataType.simpleString()
    a, b = kind(left), kind(right)
    left, right = _dealt(left, right)
    row = lambda m, side, x, y: m.select(*TILE, "_i", "_j", F.lit(side).alias("_right"), x.alias("_a"), y.alias("_b"), "_box", "_e")
    rows = row(left, False, F.col("_keys"), F.lit(None).cast(b)).unionByName(row(right, True, F.lit(None).cast(a), F.col("_keys")))
    order = [*TILE, "_i", "_j"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_by_group, f"_a {a}, _b {b}")


def _far(left: DataFrame, right: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(_key, _other) of members that meet where either doesn't carry its edges, which are those of a and b."""
    right = right.withColumnsRenamed({"_key": "_other", "_box": "_at", "_e": "_f"}).drop("_keys")
    x, y = F.greatest("_box.x1", "_at.x1"), F.greatest("_box.y1", "_at.y1")
    both = (x <= F.least("_box.x2", "_at.x2")) & (y <= F.least("_box.y2", "_at.y2"))
    here = (F.floor(x / F.col("_size")) == F.col("_tx")) & (F.floor(y / F.col("_size")) == F.col("_ty"))
    near = lambda p, q: p.join(q, TILE).where(both & here).select("_key", "_other")
    pairs = near(left.where("_e is null"), right).unionByName(near(left.where("_e is not null"), right.where("_f is null")))
    pairs = pairs.join(a.select("_key", edges_of(F.col("_rings")).alias("_e")), "_key").join(b.select(F.col("_key").alias("_other"), edges_of(F.col("_rings")).alias("_f")), "_other")
    return pairs.where(meet(F.col("_e"), F.col("_f"))).select("_key", "_other")


def meeting(a: DataFrame, b: DataFrame, keys: tuple[str, str], rings: tuple[str, str], size: float = 64.0, pairs: int = PAIRS) -> DataFrame:
    """(*keys) of the polygons of a and b that have a point in common, each pair once. Keys name rows of their side and differ in name; size: of the tiles at first, about that of the polygons or larger."""
    (a, of_a), (b, of_b) = (different(p, k, r) for p, k, r in ((a, keys[0], rings[0]), (b, keys[1], rings[1])))
    of_a, of_b = _packs(of_a), _packs(of_b)
    few, many = F.col("_n") <= KEYS, F.col("_n") > KEYS
    left, right = candidates(*(p.select("_key", "_rings").join(of.where(few).select("_key", "_keys"), "_key", "left") for p, of in ((a, of_a), (b, of_b))), ("_key", "_key"), ("_rings", "_rings"), size, pairs)
    along, alone = "_e is not null and _keys is not null", "_e is not null and _keys is null"
    own = lambda m: m.where(alone).withColumn("_keys", F.array("_key"))
    spread = lambda met: met.select(F.explode("_a").alias(keys[0]), "_b").select(keys[0], F.explode("_b").alias(keys[1]))
    dealt = lambda met: met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # noqa: E731  # rows stand for many pairs each
    rows_of = lambda of, key, name: of.select(F.col("_key").alias(key), F.col("_keys").alias(name))
    found = spread(_pairs(left.where(along), right.where(along)))
    of = []
    if more_a := not of_a.where(many).isEmpty():
        met = _pairs(own(left), right.where(along)).select(F.explode("_a").alias("_key"), "_b")
        found = found.unionByName(spread(dealt(met.join(rows_of(of_a.where(many), "_key", "_a"), "_key"))))
    if more_b := not of_b.where(many).isEmpty():
        met = _pairs(own(right), left.where(along)).select(F.explode("_a").alias("_other"), F.col("_b").alias("_a"))
        found = found.unionByName(spread(dealt(met.join(rows_of(of_b.where(many), "_other", "_b"), "_other"))))
    if more_a and more_b:
        of.append(_pairs(own(left), own(right)).select(F.explode("_a").alias("_key"), "_b").select("_key", F.explode("_b").alias("_other")))
    if not (left.where("_e is null").isEmpty() and right.where("_e is null").isEmpty()):
        of.append(_far(left, right, a, b))
    for met in of:
        found = found.unionByName(spread(dealt(met.join(rows_of(of_a, "_key", "_a"), "_key").join(rows_of(of_b, "_other", "_b"), "_other"))))
    return found
