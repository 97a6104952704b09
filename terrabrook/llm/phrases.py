"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass, scored by their weakest cut.

Texts, A-Z lower-cased, are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`; n-grams lie within a piece. A worker hashes the n-grams of
its rows with numpy, adds up equal ones, and passes (hash, count) on to the hash's partition, where a Misra-Gries summary takes them in. Hash partitions grow
with the bytes of the table, and a summary's capacity is twice the mass of a partition over the threshold. A subtraction of d takes d from more counters than the
capacity, so all subtractions together stay below the threshold and no n-gram that is as frequent is lost. Should a partition's mass be larger than expected, a summary
doubles its capacity before it subtracts as much as the threshold. N-grams of more than two words are looked at only where all their shorter parts survived (rounds: one and two words, three, four
and more); survivors are told apart by a filter of bits whose size grows with them up to MOST_BITS. Beyond that, and by clashes of hashes, more is counted, never less.
The second pass counts the words themselves of what survived, as texts, so all results are exact.

A phrase of k words has f occurrences, overlaps included. A candidate (2 words or more, f at least the threshold) is scored by floor(1000 a n / (l r)) in
decimals, n being all words of its language, for each cut into a first part and a rest; the lowest counts, the smallest cut of equals. A candidate within a longer one that is as
frequent goes; as counts never rise with length, it is enough to look at phrases of one word more.

Null text is empty; a null language is `und`, together with rows whose language is that; repeated rows count as often as they are there; doc_id isn't read; an
empty table gives an empty result; other columns aren't read. Long texts are worked on in steps of some megabytes, cut between pieces, or, within a piece that is longer, with an
overlap of words. Equal scores are ordered by f, then by the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_words, give_back, mixed, saved

#: Bytes of text of a step; distinct n-grams that a worker adds up before it passes them on.
STEP, HELD = 2 << 20, 1 << 20
#: Bytes of text for each hash partition; a byte has at most half an n-gram of each length.
SHARE = 50_000_000
#: Phrases that a hash partition adds up, about.
ENTRIES = 100_000
#: Bits of the filter for each survivor, and bits at most (as a power of two): 2^28 are 32 MB; bits that a survivor sets.
BITS_EACH, MOST_BITS, PROBES = 32, 28, 4
#: Parts of a language whose first rows are chosen apart.
PARTS = 64

#: 1 separates words, 2 separates pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Summary:
    """A Misra-Gries summary of (hash, count): holds at most `capacity` counters, each too low by `error` at most, and error stays below the threshold. A capacity of mass over
    threshold or more stays as it is; a smaller one doubles when it must."""

    def __init__(self, threshold: int, capacity: int) -> None:
        self.threshold, self.capacity, self.error = threshold, max(1, capacity), 0
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self._new.append((h, n))
        self._waiting += len(h)
        if self._waiting >= self.capacity:
            self.settle()

    def merge(self, other: Summary) -> None:
        """Takes in another summary, whose error is added to this one's; where both together would reach the threshold, it can't be taken."""
        other.settle()
        if self.error + other.error >= self.threshold:
            raise ValueError("the summaries' errors reach the threshold")
        self.error += other.error
        self.add(other.h, other.n)

    def settle(self) -> None:
        if self._new:
            self.h, self.n = summed(np.concatenate([self.h, *(h for h, _ in self._new)]), np.concatenate([self.n, *(n for _, n in self._new)]))
            self._new, self._waiting = [], 0
        while len(self.h) > self.capacity:
            at = len(self.h) - self.capacity - 1
            d = int(np.partition(self.n, at)[at])
            if self.error + d >= self.threshold:
                self.capacity *= 2
                continue
            self.error += d
            keep = self.n > d
            self.h, self.n = self.h[keep], self.n[keep] - d

    def survivors(self) -> np.ndarray:
        """The hashes whose counts may be as large as the threshold."""
        self.settle()
        return self.h[self.n + self.error >= self.threshold]


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct h, ascending, with the sums of their n."""
    if not len(h):
        return h, n
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first)


class Words:
    """The words of some stretches of text: hash, stretch and number of words left in the piece (itself included) of each, and the words themselves."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        starts, self.stretch, texts = cut_words(data, at, _KIND == 0)
        ends = _KIND[data] == 2
        ends[at[:-1][at[:-1] < len(data)]] = True
        piece = np.cumsum(ends, dtype=np.int32)[starts]
        self.codes = texts.indices.to_numpy(zero_copy_only=False)
        self.texts = texts.dictionary.to_pylist()
        known = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in self.texts), np.uint64, len(self.texts))
        self.hashes = known[self.codes] if len(known) else np.zeros(0, np.uint64)
        turn = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(piece)) if len(piece) else np.zeros(0, np.int64)
        self.left = np.repeat(turn, np.diff(turn, prepend=0)) - np.arange(len(piece))

    def grams(self, longest: int, salt: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(m, hashes of the m-grams that start at each word) for m up to longest; a hash means nothing where fewer than m words are left."""
        h = mixed(self.hashes ^ salt[self.stretch])
        yield 1, h
        for m in range(2, longest + 1):
            h = mixed(h[:-1] * _ODD + self.hashes[m - 1 :] + np.uint64(m)) if len(h) else h
            yield m, h


def _stretches(text: bytes, step: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, words to skip) of stretches of a text of at most about `step` bytes: cut behind the end of a piece, or else within it, where a stretch begins with `overlap` words that were in the one before."""
    a, skip = 0, 0
    while len(text) - a > step:
        kinds = _KIND[np.frombuffer(text, np.uint8, step, a)]
        ends = np.flatnonzero(kinds[step // 2 :] == 2)
        if len(ends):
            b = a + step // 2 + int(ends[-1]) + 1
            yield a, b, skip
            a, skip = b, 0
            continue
        b, word = a + step // 2, False
        while b < len(text):  # a word that is longer than a step is whole
            more = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, min(step, len(text) - b), b)] > 0)
            if len(more):
                b, word = b + int(more[0]), True
                break
            b += step
        if not word:
            break
        if _KIND[text[b]] == 2:
            yield a, b + 1, skip
            a, skip = b + 1, 0
            continue
        yield a, b, skip
        tail, back = np.frombuffer(text, np.uint8, b - a, a), b
        inside = _KIND[tail] == 0
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        breaks = np.flatnonzero(_KIND[tail] == 2)
        starts = starts[starts > (breaks[-1] if len(breaks) else -1)][-overlap:] if overlap else starts[:0]
        back = a + int(starts[0]) if len(starts) else b
        if back == a:  # no more than the overlap fits: the stretch grows instead
            step *= 2
        a, skip = back, len(starts)
    yield a, len(text), skip


def _steps(batches: Iterator[pa.RecordBatch], overlap: int, step: int) -> Iterator[tuple[Words, np.ndarray, list, np.ndarray]]:
    """(words, salt of each stretch, language of each stretch, words to skip of each stretch) of (lang, text) rows, in steps of bounded bytes."""
    parts, langs, skips, size = [], [], [], 0

    def done() -> tuple[Words, np.ndarray, list, np.ndarray]:
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        salts = {name: xxhash.xxh3_64_intdigest(name.encode(), seed=1) for name in set(langs)}
        return Words(np.frombuffer(b"".join(parts), np.uint8), at), np.array([salts[name] for name in langs], np.uint64), list(langs), np.array(skips, np.int64)

    for batch in batches:
        for i in range(batch.num_rows):
            text = (batch.column(1)[i].as_py() or "").encode("utf-8", "replace")
            if not text:
                continue
            lang = batch.column(0)[i].as_py()
            for a, b, skip in _stretches(text, step, overlap):
                parts.append(text[a:b])
                langs.append(lang)
                skips.append(skip)
                size += b - a
                if size >= step:
                    yield done()
                    parts, langs, skips, size = [], [], [], 0
    if parts:
        yield done()
    give_back()


def _placed(words: Words, skips: np.ndarray, m: int) -> np.ndarray:
    """The words at which an m-gram starts that wasn't in the stretch before."""
    at = words.left >= m
    if skips.any():
        first = np.searchsorted(words.stretch, np.arange(len(skips)))
        at &= np.arange(len(at)) - first[words.stretch] + m - 1 >= skips[words.stretch]
    return np.flatnonzero(at)


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter has h: PROBES bits of a 64-bit block."""
    block, out = bits[(h >> np.uint64(32)) % np.uint64(len(bits))], np.uint64(1)
    for k in range(PROBES):
        out = out & (block >> ((h >> np.uint64(6 * k)) & np.uint64(63)))
    return out == 1


def _candidates(words: Words, salt: np.ndarray, skips: np.ndarray, lengths: Sequence[int], known: int, bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, starts, hashes) of the m-grams of some lengths, all of whose parts of `known` words pass the filter."""
    passes = None
    for m, h in words.grams(max(*lengths, known), salt):
        if m == known and bits is not None:
            passes = _holds(bits, h)
        if m in lengths:
            at = _placed(words, skips, m)
            if passes is not None:
                ok = passes[at]
                for k in range(1, m - known + 1):
                    ok &= passes[at + k]
                at = at[ok]
            yield m, at, h[at]


def _filter(survivors: DataFrame, n: int) -> np.ndarray:
    """Blocks of 64 bits that hold the survivors' hashes; only the blocks, whose number is bounded, come to the driver."""
    blocks = 1 << min(MOST_BITS - 6, max(4, (n * BITS_EACH // 64).bit_length()))
    one = F.lit(1).cast("long")
    all_ = F.lit(0).cast("long")
    for k in range(PROBES):
        all_ = all_.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned("h", 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    held = survivors.groupBy(F.pmod(F.shiftrightunsigned("h", 32), F.lit(blocks)).alias("b")).agg(F.bit_or(all_).alias("v"))
    table, out = held.toArrow(), np.zeros(blocks, np.uint64)
    out[table.column("b").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
    return out


def frequent_hashes(rows: DataFrame, lengths: Sequence[int], threshold: int, size: int, known: int = 0, bits: np.ndarray | None = None) -> DataFrame:
    """(h) of all n-grams of `lengths` words of rows (lang, text), of `size` bytes, that may be as frequent as the threshold."""
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARE + 1)
    capacity = 1024 + size * len(lengths) // (partitions * threshold)  # twice the mass over the threshold
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # bounded by MOST_BITS
    overlap, kind = max(max(lengths), known) - 1, pa.schema([("h", pa.int64()), ("n", pa.int64())])
    batch_of = lambda h, n: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, new, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for words, salt, _, skips in _steps(batches, overlap, STEP):
            for _, _, found in _candidates(words, salt, skips, lengths, known, shared.value):
                new.append(found)
                waiting += len(found)
            if waiting >= HELD:
                h, n = summed(np.concatenate([h, *new]), np.concatenate([n, np.ones(waiting, np.int64)]))
                new, waiting = [], 0
                if len(h) >= HELD:
                    yield batch_of(h, n)
                    h, n = h[:0], n[:0]
        h, n = summed(np.concatenate([h, *new]), np.concatenate([n, np.ones(waiting, np.int64)]))
        if len(h):
            yield batch_of(h, n)
        give_back()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(threshold, capacity)
        for b in batches:
            summary.add(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy())
        h = summary.survivors()
        for a in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 16)].view(np.int64))], ["h"])
        give_back()

    return rows.mapInArrow(count, "h long, n long").repartition(partitions, "h").mapInArrow(summarise, "h long")


def exact_counts(rows: DataFrame, longest: int, threshold: int, bits: np.ndarray, survivors: int) -> DataFrame:
    """(lang, m, phrase, f) of the n-grams that pass the filter and occur `threshold` times, and one row of m = 0 for each language: all its words.

    A worker hands on one record of all its entries for each hash partition, in lists; a partition adds them up by the words themselves, and is one of so many that it has about ENTRIES of them."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # bounded by MOST_BITS
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), survivors // ENTRIES + 1)
    kinds = {"lang": pa.string(), "m": pa.int32(), "phrase": pa.string(), "f": pa.int64()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # (hash, m) or (language, 0): language, phrase, count

        def given() -> Iterator[pa.RecordBatch]:
            part = np.array([k[0] % parts if k[1] else xxhash.xxh3_64_intdigest(k[0].encode()) % parts for k in held], np.int64)
            order = np.argsort(part, kind="stable")
            chosen, firsts = np.unique(part[order], return_index=True)
            entries = [(v[0], k[1], v[1], v[2]) for k, v in held.items()]
            columns = list(zip(*(entries[i] for i in order.tolist()), strict=True)) or [[], [], [], []]
            ends = pa.array(np.append(firsts, len(part)), pa.int32())
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(chosen), *(pa.ListArray.from_arrays(ends, pa.array(c, t)) for c, t in zip(columns, kinds.values(), strict=True))], ["part", *kinds])

        for words, salt, langs, skips in _steps(batches, longest - 1, STEP):
            per = np.bincount(words.stretch[_placed(words, skips, 1)], minlength=len(langs))
            for name, n in zip(langs, per.tolist(), strict=True):
                held.setdefault((name, 0), [name, "", 0])[2] += n
            passes = np.ones(len(words.codes) + 1, bool)
            for m, h in words.grams(longest, salt):
                passes = _holds(shared.value, h) & passes[:-1] & passes[1:] if m > 1 else _holds(shared.value, h)  # both of its parts were frequent
                at = _placed(words, skips, m)
                at = at[passes[at]]
                if not len(at):
                    continue
                found, first, n = np.unique(h[at], return_index=True, return_counts=True)
                for x, i, k in zip(found.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    if (entry := held.get((x, m))) is None:
                        text = b" ".join([words.texts[c] for c in words.codes[i : i + m].tolist()])
                        held[x, m] = [langs[words.stretch[i]], text.decode("utf-8", "replace"), k]
                    else:
                        entry[2] += k
            if len(held) >= HELD // 4:
                yield from given()
        if held:
            yield from given()
        give_back()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(c)[i].values.to_pylist() for c in range(1, 5)]
                for lang, m, phrase, f in zip(*lists, strict=True):
                    sums[lang, m, phrase] = sums.get((lang, m, phrase), 0) + f
        out = [(*k, f) for k, f in sums.items() if f >= threshold or not k[1]]
        for a in range(0, len(out), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + (1 << 15)], strict=True), kinds.values(), strict=True)], list(kinds))
        give_back()

    lists = rows.mapInArrow(count, "part long, lang array<string>, m array<int>, phrase array<string>, f array<long>")
    return lists.repartition(parts, "part").mapInArrow(total, "lang string, m int, phrase string, f long")


def frequent_phrases(docs: DataFrame, threshold: int = 100, longest: int = 5) -> DataFrame:
    """(lang, m, phrase, f) of all phrases of at most `longest` words that occur at least `threshold` times in their language, and one row of m = 0 a language with all its words."""
    if threshold < 1 or longest < 2:
        raise ValueError("threshold must be 1 or more and longest 2 or more")
    rows = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = [(1, 2), *([(3,)] if longest > 2 else []), *([tuple(range(4, longest + 1))] if longest > 3 else [])]
    known, bits, all_ = 0, None, None
    for lengths in rounds:
        found = saved(frequent_hashes(rows, lengths, threshold, size, known, bits), "survivors")
        all_ = found if all_ is None else all_.unionByName(found)
        known, bits = lengths[-1], _filter(found, found.count())
    survivors = all_.count()
    return saved(exact_counts(rows, longest, threshold, _filter(all_, survivors), survivors), "phrases")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` candidates (None: all)."""
    counts = frequent_phrases(docs, threshold, longest)
    words = counts.where("m = 0").select("lang", F.col("f").alias("n"))
    counts = counts.where("m > 0")
    parts = F.split("phrase", " ")
    longer = counts.where("m > 2").select("lang", F.explode(F.array(F.concat_ws(" ", F.slice(parts, 1, F.col("m") - 1)), F.concat_ws(" ", F.slice(parts, 2, F.col("m") - 1)))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    asked = counts.where("m > 1").join(longer, ["lang", "phrase"], "left").where("most is null or most < f")
    cut = asked.select("lang", "phrase", F.col("f").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.withColumns({"first": F.concat_ws(" ", F.slice(parts, 1, F.col("k"))), "rest": F.concat_ws(" ", F.slice(parts, F.col("k") + 1, F.col("m") - F.col("k")))})
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(words, "lang")
    score = F.expr("(cast(a as decimal(16, 0)) * 1000 * cast(n as decimal(17, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # the first of each part of a language, then of the language
        at = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))
        best = best.withColumn("_at", at).where(F.col("_at") <= top).drop("_at")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    out = best.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return out if top is None else out.where(F.col("rank") <= top)
