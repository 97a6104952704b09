"""Mixing sources to target weights by subset-sum budget fitting.

Sources, in code point order with null last, weigh as `weights` repeats, and share `share` times all words;
a target stops at `cap` times its source's words and the excess is reshared by weight (a water level). Of a
source the mix takes whole passes, then part of one more: the documents are counted by exact length, most of
the budget is spread over the lengths in proportion, and a bounded-knapsack programme over the remaining counts
fits the rest of it to the word. Which documents of a length are taken follows a seeded hash of doc_id.

Only histograms (source, length, count) are gathered: by source, never documents. Documents of one source and length are ranked
in parts, whose number grows with the table. Null text and text without words have size 0 and take 0; null sources are a source;
rows repeating a doc_id, and rows without one, are rows like others, told apart by their texts, so only rows with equal
identifier, source and text may swap places; an empty table gives an empty result; other columns are not read. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: The rest of a budget that the programme fits, in words.
DP_WORDS = 1 << 16
#: Parts of the documents of one source and length that are ranked apart: so many at least, and so that a part of all documents would have PART.
SALTS, PART = 64, 250_000


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum to budget or as near below it as the rest allows."""
    lengths, counts = np.asarray(lengths, object), np.asarray(counts, object)
    total = int((lengths * counts).sum()) if len(lengths) else 0
    budget = max(0, min(int(budget), total))
    if not total or not budget:
        return np.zeros(len(lengths), np.int64)
    take = counts * budget // total
    take[lengths == 0] = 0
    rest, left = budget - int((lengths * take).sum()), counts - take
    share = [int(c) * budget % total for c in counts]
    for i in sorted((i for i in range(len(lengths)) if lengths[i] and left[i]), key=lambda i: (-share[i], -lengths[i])):
        if rest <= DP_WORDS:
            break
        if lengths[i] <= rest:
            take[i], left[i], rest = take[i] + 1, left[i] - 1, rest - int(lengths[i])
    for i in sorted((i for i in range(len(lengths)) if lengths[i] and left[i]), key=lambda i: -lengths[i]):
        if rest <= DP_WORDS:
            break
        n = min(int(left[i]), (rest - DP_WORDS) // int(lengths[i]) + 1, rest // int(lengths[i]))
        take[i], left[i], rest = take[i] + n, left[i] - n, rest - n * int(lengths[i])
    items: list[tuple[int, int]] = []  # (position, copies) with copies in powers of two
    first = np.full(rest + 1, -1, np.int64)
    reach, every = 1, (1 << (rest + 1)) - 1
    for i in sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= rest and left[i]), key=lambda i: -lengths[i]):
        have, part = min(int(left[i]), rest // int(lengths[i])), 1
        while have and not reach >> rest & 1:
            n = min(part, have)
            have, part = have - n, part * 2
            fresh = (reach << (n * int(lengths[i]))) & every & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(items)
                items.append((i, n))
                reach |= fresh
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, n = items[first[at]]
        take[i], at = take[i] + n, at - n * int(lengths[i])
    return take.astype(np.int64)


def ranked(df: DataFrame, key: str, at: str) -> DataFrame:
    """df, a small table of distinct keys, with the position of each in order: ranges are numbered apart and offset by the sizes of those before."""
    parts = saved(df.repartitionByRange(8, key).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # 8 rows
    before = F.lit(0).cast("long")
    for k in sizes:
        before = F.when(F.col("_part") == k, F.lit(sum(n for j, n in sizes.items() if j < k))).otherwise(before)
    return parts.withColumn(at, F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + before).drop("_part")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(_key, source_size, target) of every source."""
    sources = ranked(sized.groupBy("_key").agg(F.sum("size").alias("source_size")), "_key", "_rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = saved(sources.withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, done = 0.0, False
    while not done:  # the level only rises, and stays when no further source is full
        full = F.col("source_size") * cap <= F.col("weight") * level
        at_cap, free = sources.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = max(level, (total * share - (at_cap or 0)) / free) if free else level
        done, level = new == level, new
    return sources.select("_key", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * level).alias("target"))


def _sized(docs: DataFrame, seed: int, salts: int, *more: str | Column) -> DataFrame:
    """(_key, size, _salt, _order, *more): what a document is ranked by."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    order = F.struct(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", F.xxhash64("text"))
    return docs.select(key.alias("_key"), word_count("text").alias("size"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), F.lit(salts)).alias("_salt"), order.alias("_order"), *more)


def _shares(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(_key, size, _salt, source_size, target, _passes, _take): of the documents of a source, length and part, how many are taken once more than _passes."""
    targets = source_targets(sized, weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.round(F.col("target") - passes * F.col("source_size")).cast("long")
    targets = targets.withColumns({"_passes": passes.cast("long"), "_budget": budget})
    counts = sized.groupBy("_key", "size").agg(F.count("*").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        return rows.assign(_take=fit_lengths(rows["size"].tolist(), rows["n"].tolist(), int(rows["_budget"].iloc[0])))[["_key", "size", "_take", "source_size", "target", "_passes"]]

    chosen = counts.join(targets, "_key").groupBy("_key").applyInPandas(fit, "_key string, size long, _take long, source_size long, target double, _passes long")
    before = F.sum("n").over(Window.partitionBy("_key", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = sized.groupBy("_key", "size", "_salt").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    return parts.join(chosen, ["_key", "size"]).select("_key", "size", "_salt", "source_size", "target", "_passes", (F.col("_take") - F.col("_before")).alias("_take"))


def _mixed(docs: DataFrame, more: Sequence[str | Column], weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """(_key, size, source_size, target, copies, *more) of every row of docs. The rows with what they carry are shuffled once, by the keys of the ranking and the join."""
    salts = max(SALTS, -(-docs.count() // PART))
    narrow = saved(_sized(docs, seed, salts).drop("_order"), "sized")
    parts = _shares(narrow, weights, share, cap)
    place = F.row_number().over(Window.partitionBy("_key", "size", "_salt").orderBy("_order"))
    rows = _sized(docs, seed, salts, *more).withColumn("_place", place).drop("_order").join(parts, ["_key", "size", "_salt"])
    return rows.withColumn("copies", F.col("_passes") + (F.col("_place") <= F.col("_take")).cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of docs: how often the mix takes it."""
    rows = _mixed(docs, ["doc_id"], weights, share, cap, seed)
    source = F.when(F.col("_key").startswith("0"), F.substring("_key", 2, 1 << 30))
    return rows.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of the mix: docs, each as often as the mix takes it (0: left out), whatever its doc_id."""
    rows = _mixed(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")], weights, share, cap, seed).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
