"""N-gram Jaccard join: rare-first prefix filtering, joined on prefix n-grams and verified once per pair.

A document's set holds its distinct shingles of `WORDS` words (64-bit hashes; fewer words: the whole sequence as
one), words being what ASCII white space separates, A-Z lower-cased. Two documents link when the Jaccard similarity is
at least `percent` / 100. All sets are ordered alike, rare shingles first: the `COMMON` commonest, counted over all documents in
parts within which they repeat, come last by count, the others by hash. Any common order gives all links; a rarer-first one gives
fewer candidates. Two linked sets of n and m shingles share one among the first n - ceil(percent * n / 100) + 1 of each (prefix), n and m
differ by no more than that share (length), and enough shared shingles follow the first one in both prefixes (position).

Of equal sets one document stands for all. Prefix shingles are shuffled once, those of very many documents in parts, and those that no other
prefix has go; shingles that the same documents share make one group, at the place of their first. In each group documents first meet one hub,
so a group of near copies costs as many pairs as members; what is linked then is one component, and groups within one component are done. That is
repeated with other hubs while it finds links, `ROUNDS` times at most. The documents that are left meet within blocks of a group: those of like lengths, and
of them only documents that have enough shared shingles left for a partner of such a length. No link between components is lost.
A pair is verified once: the suffix filter cuts both sets at the same pivots, which are fixed, so that a set's counts between
pivots are a sketch of a few bytes; counts that differ bound the overlap. What it leaves is intersected, on whole texts. The texts of
a hub's partners are dealt in parts, so a hub of very many partners isn't one task's.

Null or empty text, or only white space: an empty set, linked with nothing, its own component. Equal texts link. Rows that repeat a doc_id
are one document with the links of all their texts, and are returned each with its own count; null doc_id: no links, component
null. A text longer than a step is a step of its own, taken whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, mixed, saved, steps, stepwise, utf8
from .components import components

WORDS = 5
#: Bytes of text that one numpy step works on.
STEP = 1 << 18
#: Shingles counted together for the order, the count from which one is reported, and how many of the commonest are ordered by count.
COUNTED, REPEATED, COMMON = 2_000_000, 3, 131_072
#: Documents of a shingle from which its prefix rows are dealt in parts of about so many.
HOT = 1000
#: Partners of a hub that are verified together; texts of whose sets a task remembers that it has sent them.
PART, SENT = 1000, 50_000
#: Bits of the filter that keeps texts without candidates from being shuffled: at least and at most (8 MB); doc_ids beyond share bits.
MARKS, MOST_MARKS = 1 << 22, 1 << 26
#: Hub rounds at most, before what is left meets in blocks.
ROUNDS = 2
#: Lengths of a block differ by this factor at most.
BLOCK = 1.1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all rows, and the words before each row (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
    white = _SPACE[data]
    first, last = ~white, ~white
    first[1:] &= white[:-1]
    last[:-1] &= white[1:]
    edge = at[(at > 0) & (at < len(data))]
    first[edge], last[edge - 1] = ~white[edge], ~white[edge - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = np.full(len(data), _BASE)
    powers[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lower * np.cumprod(powers))))
    powers[1:] = _INVERSE
    words = (sums[b] - sums[a]) * np.cumprod(powers)[a] + (b - a).astype(np.uint64)
    return mixed(words), np.searchsorted(a, at)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each row of a large_binary column."""
    out: list[np.ndarray] = []
    at, data = buffers(texts)
    for i, j in steps(at, STEP):
        words, before = word_hashes(at[i : j + 1] - at[i], data[at[i] : at[j]])
        n = len(words) - WORDS + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(WORDS if n > 0 else 0):
            grams += words[k : k + n] * _MIX[k]
        grams = mixed(grams)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(grams[a : b - WORDS + 1]))
            else:
                out.append(mixed((words[a:b] * _MIX[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of linked sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    n, m = len(x), len(y)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    need = _overlap(n, m, percent)
    place = np.minimum(np.searchsorted(y, x), m - 1)
    return int((y[place] == x).sum()) >= need


def sketch(s: np.ndarray) -> bytes:
    """How many shingles lie between each two of about n / 4 pivots, which divide all hashes evenly; empty if a count doesn't fit a byte."""
    bits = max(0, (len(s) - 1).bit_length() - 2)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if len(s) and counts.max() < 256 else b""


def may_overlap(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """The suffix filter: False if the sketches of sets of n and m shingles show that they don't link, since each unit that counts between pivots differ by is a shingle in one set only."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(a), len(b))
    differ = int(np.abs(a.reshape(size, -1).sum(1) - b.reshape(size, -1).sum(1)).sum())
    return n + m - differ >= 2 * _overlap(n, m, percent)


def _summaries(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, digest, sketch) of every document, and rows (h, c) of shingles that repeat within a part of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen, pool, size = ["doc_id", "n", "digest", "sketch", "h", "c"], set(), [], 0

        def common() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(pool) if pool else np.zeros(0, np.uint64), return_counts=True)
            keep = counts >= REPEATED
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], names)

        for part in stepwise(batches, "text", STEP):
            sets = shingle_sets(utf8(part.column(1)))
            digests = [hashlib.md5(s.tobytes()).digest() for s in sets]
            k = len(sets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
            for s, d in zip(sets, digests, strict=True):
                if d not in seen:
                    seen.add(d)
                    pool.append(s)
                    size += len(s)
                if size >= COUNTED:
                    yield common()
                    seen, pool, size = set(), [], 0
        yield common()

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sketch binary, h long, c long")


def _prefixes(docs: DataFrame, common: np.ndarray, counts: np.ndarray, percent: int) -> DataFrame:
    """(h, part, doc): the prefix shingles of docs. Copies within a task count once. common: rarest first; part: -1, or of a shingle of very many documents the part that doc is dealt to."""
    order = np.argsort(common)
    values = common[order]
    parts = np.where(counts > HOT, 1 << np.ceil(np.log2(np.maximum(counts / HOT, 1))).astype(np.int64), 0)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in stepwise(batches, "text", STEP):
            hashes, dealt, docs_ = [], [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(utf8(batch.column(1))), strict=True):
                digest = hashlib.md5(s.tobytes()).digest()
                if not len(s) or digest in seen:
                    continue
                if len(seen) >= SENT:
                    seen.clear()
                seen.add(digest)
                p = len(s) - -(-percent * len(s) // 100) + 1
                part = np.full(p, -1, np.int32)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    rank = np.where(values[at] == s, order[at] + 1, 0)
                    if rank.any():
                        first = np.argsort(rank, kind="stable")[:p]
                        s, of = s[first], np.where(rank[first] > 0, parts[at[first]], 0)
                        number = int(mixed(np.array([doc & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] >> np.uint64(32))
                        part = np.where(of > 0, number % np.maximum(of, 1), -1).astype(np.int32)
                hashes.append(s[:p])
                dealt.append(part)
                docs_.append(np.full(p, doc))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(dealt)), pa.array(np.concatenate(docs_).astype(np.int64))], ["h", "part", "doc"])

    return docs.where("doc_id is not null").mapInArrow(run, "h long, part int, doc long")


def _groups(prefixes: DataFrame) -> DataFrame:
    """(h, doc, k, g): prefix rows of shingles that k > 1 documents have; g: alike for shingles of the same documents. A shingle's parts are summed up apart."""
    group = Window.partitionBy("h", "part")
    same = F.xxhash64(F.count("*").over(group), F.bit_xor(F.xxhash64("doc")).over(group), F.bit_xor(F.xxhash64("doc", F.lit(1))).over(group))
    rows = saved(prefixes.withColumns({"k": F.count("*").over(group), "g": same}).where("k > 1 or part >= 0"), "groups")
    parts = rows.where("part >= 0").groupBy("h", "part").agg(F.first("k").alias("k"), F.first("g").alias("g"))
    hot = parts.groupBy("h").agg(F.sum("k").alias("all_k"), F.xxhash64(F.bit_xor(F.xxhash64("part", "g")), F.count("*")).alias("all_g"))
    met = rows.join(F.broadcast(hot), "h", "left")  # COMMON rows at most
    return met.select("h", "doc", F.coalesce("all_k", "k").alias("k"), F.coalesce("all_g", "g").alias("g")).where("k > 1")


def _least(n: Column, m: Column, percent: int) -> Column:
    """How many shingles the shared lists of linked sets of n and m have in common at least: what such a pair shares lies in both prefixes, or behind the one that ends first."""
    return F.ceil((n + m) * percent / (100 + percent) - 1e-9) - F.ceil(F.greatest(n, m) * percent / 100 - 1e-9) + 1


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether rows {a}n, {a}r, {a}s and {b}n, {b}r, {b}s can be the first shingle that the prefixes of a linked pair share.

    The sets may differ in length by so much, and behind the first shared shingle there must be enough more in either list
    of shingles that occur in some other prefix too: s of them, of which this is number r.
    """
    n, m, i, j, x, y = (F.col(c).cast("long") for c in (f"{a}n", f"{b}n", f"{a}r", f"{b}r", f"{a}s", f"{b}s"))
    least = _least(n, m, percent)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (i <= x - least) & (j <= y - least)


def _hub_pairs(apart: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): of each group one document with all that are in other components."""
    order = F.struct(F.lit(0) if not turn else F.xxhash64("doc", F.lit(turn)), "doc", "n", "r", "s", "root")
    hubs = saved(apart.groupBy("h").agg(F.min(order).alias("hub")), "hubs")  # a table of its own, so that Spark may split the groups it is joined with
    met = apart.join(hubs, "h").where("root <> hub.root")
    pairs = met.select(*(F.col(f"hub.{c}").alias(f"a{k}") for c, k in (("doc", ""), ("n", "n"), ("r", "r"), ("s", "s"))), *(F.col(c).alias(f"b{k}") for c, k in (("doc", ""), ("n", "n"), ("r", "r"), ("s", "s"))))
    return pairs.where(_may_link("a", "b", percent)).select("a", "b")


def _block_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of a group in different components that may link. A document goes to the blocks (shorter, longer) of lengths that a partner may have, if its place leaves enough shared shingles for one."""
    level = F.floor(F.log(BLOCK, F.col("n") + 0.5)).cast("int")
    reach = math.floor(math.log(100 / percent, BLOCK)) + 1
    n, room = F.col("n").cast("long"), F.col("s") - F.col("r")
    edge = lambda k: F.pow(F.lit(BLOCK), k)
    rows = apart.withColumn("own", level).withColumn("other", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    # the partner that asks least: the longest of a longer block, up to 2 for rounding, the shortest of a shorter one
    longest = F.least(F.floor(edge(F.col("other") + 1)) + 1, F.floor(n * 100 / percent))
    shortest = F.greatest(F.floor(edge(F.col("other"))) - 1, F.ceil(n * percent / 100 - 1e-9), F.lit(1))
    ask = F.when(F.col("other") > F.col("own"), _least(n, longest, percent)).when(F.col("other") < F.col("own"), _least(n, shortest, percent)).otherwise(F.least(_least(n, F.greatest(longest, n), percent), _least(n, F.least(shortest, n), percent)))
    rows = rows.where(room >= ask - 2).select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("short"), (F.col("own") >= F.col("other")).alias("long"), "doc", "n", "r", "s", "root")
    side = lambda k: rows.select("h", "lo", "hi", *(F.col(c).alias(f"{k}{x}") for c, x in (("doc", ""), ("n", "n"), ("r", "r"), ("s", "s"), ("root", "root"), ("short", "short"), ("long", "long"))))
    met = side("a").where("ashort").join(side("b").where("blong"), ["h", "lo", "hi"]).where("aroot <> broot and (lo < hi or a < b)").where(_may_link("a", "b", percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _unlike_left_out(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            keep = pa.array([may_overlap(n, x, m, y, percent) for n, x, m, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    one = base.where("doc_id is not null").select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("x"))
    two = one.toDF("b", "bn", "y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "an", "x", "bn", "y").mapInArrow(run, "a long, b long").distinct()


def _marked(ids: DataFrame, of: int) -> Column:
    """A condition on doc_id that holds for all of ids, and for others only where they share a bit of a filter whose size is bounded. of: documents in all."""
    bits = min(MOST_MARKS, max(MARKS, 1 << (8 * of).bit_length()))
    slot = F.pmod(F.col("doc_id"), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("doc_id"), F.lit(64)).cast("int"))
    words = ids.select(F.floor(slot / 64).alias("k"), bit.alias("w")).unionByName(ids.sparkSession.range(bits // 64).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("w")))
    words = words.groupBy("k").agg(F.bit_or("w").alias("w"))
    table = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("words"))
    word = F.element_at(table.scalar(), (F.floor(slot / 64) + 1).cast("int"))
    return F.call_function("shiftright", word, F.pmod(F.col("doc_id"), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, of: int) -> DataFrame:
    """The pairs (a, b) that link. a is the hub."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    asked = saved(dealt.unionByName(hubs), "asked")
    marked = _marked(asked.select(F.col("b").alias("doc_id")), of)
    texts = docs.where("doc_id is not null").where(marked).select(F.col("doc_id").alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    rows = asked.join(texts, "b").select("a", "part", (F.col("a") != F.col("b")).alias("late"), "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hubs_ = None, []
        for part in stepwise(batches, "text", STEP):
            keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            found = []
            for key, is_late, other, s in zip(keys, part.column(2).to_pylist(), part.column(3).to_pylist(), shingle_sets(utf8(part.column(4))), strict=True):
                if key != hub:
                    hub, hubs_ = key, []
                if not is_late:
                    hubs_.append(s)  # more than one where rows repeat a doc_id
                elif any(linked(h, s, percent) for h in hubs_):
                    found.append((key[0], other))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _across(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The groups that hold documents of different components, which become `root`."""
    rows = saved(shared.join(roots, shared["doc"] == roots["node"], "left").select("h", "doc", "n", "r", "s", F.coalesce("root", "doc").alias("root")), "rooted")
    ends = saved(rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h"), "ends")
    return rows.join(ends, "h", "left_semi")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = saved(_summaries(docs), "summaries")
    base = both.where("h is null").select("doc_id", "n", "digest", "sketch")
    of = base.count()
    rows = both.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(COMMON).collect()
    common, counts = np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64), np.array([r["c"] for r in reversed(rows)], np.int64)
    classes = base.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("v"), F.count("*").alias("k"))
    copies = saved(base.where("doc_id is not null").join(classes.where("k > 1"), "digest").select(F.col("doc_id").alias("u"), "v"), "copies")
    # of equal sets the first document stands for all; the filter may let others pass, which only costs
    firsts = docs.where(_marked(classes.select(F.col("v").alias("doc_id")), of))
    mine = Window.partitionBy("doc")
    places = {"r": (F.row_number().over(mine.orderBy("k", "h")) - 1).cast("long"), "s": F.count("*").over(mine)}
    groups = _groups(_prefixes(firsts, common, counts, percent)).withColumns(places).groupBy("doc", "g").agg(F.min("r").alias("r"), F.first("s").alias("s"))
    sizes = base.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "n").distinct()
    shared = saved(groups.join(sizes, "doc").select(F.col("g").alias("h"), "doc", "n", "r", "s"), "shared")
    roots = copies.select(F.col("u").alias("node"), F.col("v").alias("root"))  # stars already, unless texts share a doc_id
    tested, turn, closed = None, 0, False
    apart = shared.select("*", F.col("doc").alias("root"))
    while True:
        hubs = turn < ROUNDS
        pairs = (_hub_pairs(apart, turn, percent) if hubs else _block_pairs(apart, percent)).distinct()
        if tested is not None:
            old = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        close = saved(_unlike_left_out(pairs, base, percent), "close")
        found_any = False
        if not close.isEmpty():
            found = saved(_verified(docs, close, percent, of), "found")
            found_any = not found.isEmpty()
        if found_any:
            links = found.select(F.col("b").alias("u"), F.col("a").alias("v"))
            roots = saved(components(links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots")
            closed = True
        if not hubs:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        if found_any or not turn:
            apart = saved(_across(shared, roots), "apart")
        turn = turn + 1 if found_any else ROUNDS
    if not closed:
        roots = saved(components(copies), "roots")
    out = base.join(roots, base["doc_id"] == roots["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _told_apart(docs: DataFrame) -> DataFrame:
    """(_row, _id): the rows of docs, and doc_id, except that of the different texts of a doc_id all but one get numbers beyond all. Of rows with equal doc_id and text one stays, the least by its columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    named = docs.where("doc_id is not null").select(row, F.col("doc_id").cast("long").alias("_id"))
    several = named.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id")
    if several.isEmpty():
        return named
    texts = named.join(several, "_id", "left_semi").groupBy("_id", F.xxhash64("_row.text").alias("_h"), F.length("_row.text").alias("_n")).agg(F.min("_row").alias("_row"))
    texts = saved(texts.withColumn("_more", F.monotonically_increasing_id()), "texts")
    beyond = named.agg(F.max("_id")).first()[0] + 1
    first = texts.groupBy("_id").agg(F.min("_more").alias("_first"))
    texts = texts.join(first, "_id").select("_row", F.when(F.col("_more") == F.col("_first"), F.col("_id")).otherwise(F.lit(beyond) + F.col("_more")).alias("_id"))
    return named.join(several, "_id", "left_anti").select("_row", "_id").unionByName(texts)


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one document of each component left, the one with the smallest doc_id; rows without a doc_id stay. Different texts of one doc_id are documents of their own. All columns are kept."""
    rows = _told_apart(docs)
    kept = jaccard_components(rows.select(F.col("_id").alias("doc_id"), "_row.text"), percent).where("component_id = doc_id").select(F.col("doc_id").alias("_id"))
    names = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return rows.join(kept, "_id", "left_semi").select(*names).unionByName(docs.where("doc_id is null"))
