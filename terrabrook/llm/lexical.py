"""Ranked lexical search over an inverted index, with MaxScore on bounds of pairs of terms.

Terms are the longest runs of ASCII letters and digits and of all code points beyond ASCII, A-Z lower-cased. Documents are indexed in blocks of about BLOCK bytes of
text: a block is made within one task, without a shuffle, and holds its documents' identifiers and lengths and each term's list of documents and
occurrences. The score of a document for an item is the sum, over the item's distinct terms, of w * ((1000000000 * tf) div (1000 * tf + 8 * m)), where
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N) div L.

A search meets the index by an equal join on the items' terms and prepares each block: impacts, the largest impact of each term, and for
each two terms that follow one another in an item, ordered by weight, the list of documents that hold both with the largest joint impact. What the first i terms of an item can give is
bounded by B(i) = min(B(i-1) + U(i), B(i-2) + max(U(i-1), U(i), joint maximum)): pairs that hardly meet bound less than their sum. Preparing also scores
some documents, mostly those of the rarest pairs; the tenth best of all blocks is every block's threshold. With it a block is searched: terms whose bound stays below
the threshold open no document, and an opened document is followed only while its score and what is left for it (less where the pair's
list says that it doesn't hold both) reach the threshold. Nothing is cut that could be among the best, ties included.

A null text has no terms; documents without terms don't count; rows that repeat a doc_id, or have none, are documents of their own, those without one last among equal scores; rows that
repeat an item_id are one item, as are those without one; an empty table gives an empty result; other columns aren't read. Items are searched in groups of about TERMS
terms, so any number of them can be asked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, cut_words, give_back, saved, utf8

#: Bytes of text of a block; terms of the items that are searched together.
BLOCK, TERMS = 8 << 20, 1 << 16
#: The ASCII bytes of terms.
_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_LAST = np.iinfo(np.int64).max


def _block(parts: Sequence[tuple[pa.Array, pa.Array]], block: int) -> Iterator[pa.RecordBatch]:
    """The rows of the index of some (doc_id, text) arrays."""
    ids = pa.concat_arrays([i for i, _ in parts])
    cut = [buffers(t) for _, t in parts]
    data = np.concatenate([d for _, d in cut])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for o, _ in cut]))]).astype(np.int64)
    _, row, words = cut_words(data, at, _INSIDE)
    n = np.bincount(row, minlength=len(ids)).astype(np.int32)
    key, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + row, return_counts=True)
    term, where = key // len(ids), (key % len(ids)).astype(np.int32)
    ends = np.searchsorted(term, np.arange(len(words.dictionary) + 1)).astype(np.int32)
    lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    k = len(words.dictionary)
    one = np.array([0, len(ids)], np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int32())), lists(pa.array(n), one), lists(ids, one)], schema=_SCHEMA)
    if k:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), words.dictionary.cast(pa.binary()), lists(pa.array(where), ends), lists(pa.array(tf.astype(np.int32)), ends), pa.nulls(k, pa.list_(pa.int64()))], schema=_SCHEMA)


_SCHEMA = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])


def index_documents(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """(block, term, at, tf, ids) as a table: of each term of a block the places of its documents, ascending, and its occurrences in them; a row without term has the identifiers of the block's documents by place, and their lengths in tf."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, size, made = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            ends, a = buffers(texts)[0], 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + block_bytes - size, "right")) - 1)
                b = min(b, len(ids))
                parts.append((ids.slice(a, b - a), texts.slice(a, b - a)))
                size, a = size + int(ends[b] - ends[a]), b
                if size >= block_bytes or a < len(ids):
                    yield from _block(parts, first + made)
                    parts, size, made = [], 0, made + 1
        if parts:
            yield from _block(parts, first + made)
        give_back()

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "block long, term binary, at array<int>, tf array<int>, ids array<long>"), "index")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of the distinct terms of each item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(f"({_TERM})"), F.lit(1))).alias("term")).select("item_id", F.encode("term", "UTF-8").alias("term")).distinct()


class Lists:
    """A block's lists for a group of items: places and impacts of each term, and of each pair of terms the places that hold both."""

    def __init__(self, at: Sequence[np.ndarray], impact: Sequence[np.ndarray], pairs: dict[tuple[int, int], tuple[np.ndarray, int]], size: int) -> None:
        self.at, self.impact, self.pairs, self.size = at, impact, pairs, size
        self.most = [int(v.max()) if len(v) else 0 for v in impact]
        self.opened = 0

    def bounds(self, terms: Sequence[int]) -> list[int]:
        """B(i): what the first i terms can give at most."""
        out = [0]
        for i, t in enumerate(terms):
            b = out[i] + self.most[t]
            if i and (pair := self.pairs.get((terms[i - 1], t))) is not None:
                b = min(b, out[i - 1] + max(self.most[terms[i - 1]], self.most[t], pair[1]))
            out.append(b)
        return out

    def best(self, terms: Sequence[int], ids: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best documents with a score of `least` or more, ties by identifier and place. terms: ascending by weight."""
        bound, least = self.bounds(terms), max(1, least)
        if bound[-1] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e = max(i for i, b in enumerate(bound) if b < least)
        total, touched = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        for t in terms[e:]:
            total[self.at[t]] += self.impact[t]
            touched[self.at[t]] = True
        found = np.flatnonzero(touched)
        score = total[found]
        self.opened += len(found)
        for j in range(e, 0, -1):
            if len(found) > top:
                least = max(least, int(np.partition(score, len(score) - top)[len(score) - top]))
            left = np.full(len(found), bound[j], np.int64)
            t = terms[j - 1]
            if j > 1 and (pair := self.pairs.get((terms[j - 2], t))) is not None:
                apart = bound[j - 2] + max(self.most[terms[j - 2]], self.most[t])
                left = np.where(_within(pair[0], found), left, min(bound[j], apart))
            keep = score + left >= least
            found, score = found[keep], score[keep]
            place = np.searchsorted(self.at[t], found)
            place[place == len(self.at[t])] = 0
            if len(self.at[t]):
                score = score + np.where(self.at[t][place] == found, self.impact[t][place], 0)
        order = np.lexsort((found, ids[found], -score))
        order = order[score[order] >= least][:top]
        return found[order], score[order]

    def seeds(self, terms: Sequence[int], top: int) -> np.ndarray:
        """The best scores of some documents: those of pairs and terms of much weight, until there are several times as many as are asked for."""
        chosen, n = [], 0
        for i in range(len(terms) - 1, -1, -1):
            pair = self.pairs.get((terms[i - 1], terms[i])) if i else None
            chosen.append(pair[0] if pair is not None and len(pair[0]) >= top else self.at[terms[i]])
            n += len(chosen[-1])
            if n >= 8 * top:
                break
        found = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        score = np.zeros(len(found), np.int64)
        for t in terms:
            if len(self.at[t]) and len(found):
                place = np.searchsorted(self.at[t], found)
                place[place == len(self.at[t])] = 0
                score += np.where(self.at[t][place] == found, self.impact[t][place], 0)
        return np.sort(score[score > 0])[::-1][:top]


def _within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(of), bool)
    place = np.searchsorted(values, of)
    place[place == len(values)] = 0
    return values[place] == of


def joint(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int]:
    """(places in both, largest sum of their impacts) of two ascending lists."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return both, int((u[i] + v[j]).max()) if len(both) else 0


_PREPARED = "block long, part long, kind int, a int, b int, item long, named boolean, most long, at array<int>, v array<long>"
_KINDS = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("item", pa.int64()), ("named", pa.bool_()), ("most", pa.int64()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.int64()))])
_DOCS, _LIST, _PAIR, _ITEM = range(4)


def _prepare(n_docs: int, n_terms: int, top: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, part = table.column("block")[0].as_py(), table.column("part")[0].as_py()
        own = table.filter(pa.compute.is_null(table.column("term")))
        table = table.filter(pa.compute.is_valid(table.column("term"))).sort_by([("w", "ascending"), ("term", "ascending")])
        ids, n = own.column("ids")[0].values, own.column("tf")[0].values.to_numpy().astype(np.int64)
        m = 10 + (90 * n * n_docs) // max(1, n_terms)
        at, impact, of = [], [], {}
        weights, asked = table.column("w").to_pylist(), table.column("items").to_pylist()
        for t in range(table.num_rows):
            places, tf = table.column("at")[t].values.to_numpy(), table.column("tf")[t].values.to_numpy().astype(np.int64)
            at.append(places)
            impact.append(weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[places])))
            for item in asked[t]:
                of.setdefault(item, []).append(t)
        pairs: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        for terms in of.values():
            for a, b in zip(terms, terms[1:]):
                if (a, b) not in pairs:
                    pairs[a, b] = joint(at[a], impact[a], at[b], impact[b])
        lists = Lists(at, impact, pairs, len(ids))
        marks = [(_DOCS, None, None, None, True, None, None, None)]
        marks += [(_LIST, t, None, None, True, lists.most[t], at[t], impact[t]) for t in range(len(at))]
        marks += [(_PAIR, a, b, None, True, most, both, None) for (a, b), (both, most) in pairs.items()]
        marks += [(_ITEM, None, None, item, item is not None, None, np.array(terms, np.int32), lists.seeds(terms, top)) for item, terms in of.items()]
        columns = [list(c) for c in zip(*marks, strict=True)]
        columns[7][0] = ids  # by place
        arrays = [pa.array([block] * len(marks), pa.int64()), pa.array([part] * len(marks), pa.int64())]
        return pa.table(arrays + [pa.array(c, k.type) for c, k in zip(columns, list(_KINDS)[2:], strict=True)], schema=_KINDS)

    return run


def _search(top: int):
    schema = pa.schema([("item", pa.int64()), ("named", pa.bool_()), ("doc_id", pa.int64()), ("score", pa.int64()), ("opened", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kinds, first, second = (table.column(c).to_numpy() for c in ("kind", "a", "b"))
        row = lambda name, i, kind: table.column(name)[int(i)].values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
        named = table.column("v")[int(np.flatnonzero(kinds == _DOCS)[0])].values
        ids = named.fill_null(_LAST).to_numpy()
        at, impact = {}, {}
        for i in np.flatnonzero(kinds == _LIST):
            at[int(first[i])], impact[int(first[i])] = row("at", i, np.int64), row("v", i, np.int64)
        pairs = {(int(first[i]), int(second[i])): (row("at", i, np.int64), table.column("most")[int(i)].as_py()) for i in np.flatnonzero(kinds == _PAIR)}
        lists = Lists([at[k] for k in range(len(at))], [impact[k] for k in range(len(at))], pairs, len(ids))
        out: list[list] = [[], [], [], [], []]
        for i in np.flatnonzero(kinds == _ITEM):
            lists.opened = 0
            found, score = lists.best(row("at", i, np.int64).tolist(), ids, table.column("most")[int(i)].as_py() or 1, top)
            out[0] += [table.column("item")[int(i)].as_py()] * len(found)
            out[1] += [table.column("named")[int(i)].as_py()] * len(found)
            out[2] += named.take(pa.array(found)).to_pylist()
            out[3] += score.tolist()
            out[4] += [lists.opened] * len(found)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def search_index(index: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents of an index for each of the items."""
    if top < 1:
        raise ValueError("top must be 1 or more")
    lengths = index.where("term is null").select(F.explode("tf").alias("n"))
    n_docs, n_terms = lengths.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    terms = saved(item_terms(items), "terms")
    parts = max(1, -(-terms.count() // TERMS))
    asked = terms.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part"), "term").agg(F.collect_list(F.struct("item_id")).alias("items"))
    cut = saved(index.where("term is not null").drop("ids").join(asked, "term"), "cut")
    df = cut.groupBy("part", "term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * (n_docs or 0) + 2) / (2 * F.col("df") + 1))).cast("long")
    cut = cut.join(df.select("part", "term", weight.alias("w")), ["part", "term"]).select("block", "part", "term", "at", "tf", "w", F.col("items.item_id").alias("items"), F.lit(None).cast("array<long>").alias("ids"))
    present = cut.select("block", "part").distinct()
    own = index.where("term is null").join(present, "block").select("block", "part", "term", "at", "tf", F.lit(None).cast("long").alias("w"), F.lit(None).cast("array<long>").alias("items"), "ids")
    prepared = saved(cut.unionByName(own).groupBy("block", "part").applyInArrow(_prepare(n_docs or 0, n_terms or 0, top), _PREPARED), "prepared")
    entries = prepared.where(F.col("kind") == _ITEM)
    seeds = entries.select("item", "named", F.explode("v").alias("score"))
    at = F.row_number().over(Window.partitionBy("item", "named").orderBy(F.col("score").desc()))
    least = seeds.withColumn("_n", at).where(F.col("_n") <= top).groupBy(F.coalesce("item", F.lit(0)).alias("_i"), F.col("named").alias("_named")).agg(F.min("score").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") == top)
    entries = entries.join(least, (F.coalesce("item", F.lit(0)) == F.col("_i")) & (F.col("named") == F.col("_named")), "left").withColumn("most", F.coalesce("_least", F.lit(1))).drop("_i", "_named", "_least", "_n")
    rows = prepared.where(F.col("kind") != _ITEM).unionByName(entries)
    found = rows.groupBy("block", "part").applyInArrow(_search(top), "item long, named boolean, doc_id long, score long, opened long")
    rank = F.row_number().over(Window.partitionBy("item", "named").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())).cast("int")
    return found.select(F.col("item").alias("item_id"), rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents of docs (doc_id, text) for each of items (item_id, text)."""
    return search_index(index_documents(docs), items, top)
