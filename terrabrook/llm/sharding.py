"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; row k of n of a source stands at the fraction (k + u) / n of the whole, where u is
the source's own start between 0 and 1. All rows in order of that fraction are cut into shards whose numbers of rows differ by one at most, so
each shard, and each stretch of a shard, has every source's share to within two rows.

Both rankings are windows over parts: of a source by ranges of the hash, of the whole by ranges of the fraction. What lies before a part comes from counts. The
number of parts grows with the table, so none is larger than about PART rows, whatever share of the rows one source has. Rows that are equal in all that counts are one
row with a number of copies until they are placed, so a row that is repeated millions of times is ranked once.

Null text is of size 1 and checksum 0; null sources are a source; rows without doc_id and rows that repeat one are rows like others; equal rows may swap places;
an empty table gives an empty result. Columns that aren't named are only read by `write_shards`, which keeps them all; its own columns take a free name if the
table has one of theirs. Maps aren't comparable, so `write_shards` refuses columns that hold them. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, saved

#: Rows of a part, about, and parts at least (as a power of two).
PART, LEAST_BITS = 250_000, 8
#: Copies of a row that are placed by one task at once.
COPIES = 4096


def text_size(text: str | Column) -> Column:
    """Bytes of the text in UTF-8, plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: str | Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _before(counts: DataFrame, by: Sequence[str], part: str) -> Column:
    return F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def interleaved(rows: DataFrame, kept: Sequence[str], shards: int = 16, seed: int = 23) -> DataFrame:
    """(*kept, _shard, _slot) of every row of rows (_key, _h, *kept): _key names its stratum and isn't null, _h is its seeded hash. `kept` are narrow, comparable columns."""
    rows = saved(rows.groupBy("_key", "_h", *kept).agg(F.count("*").alias("_n")), "rows")
    total, most = rows.agg(F.sum("_n"), F.max("_n")).first()
    bits = max(LEAST_BITS, ((total or 0) // PART).bit_length())
    # rank within the stratum
    rows = rows.withColumn("_part", F.shiftright("_h", 64 - bits))
    counts = rows.groupBy("_key", "_part").agg(F.sum("_n").alias("_m"))
    counts = counts.select("_key", "_part", _before(counts, ["_key"], "_part").alias("_before"), F.sum("_m").over(Window.partitionBy("_key")).alias("_of"))
    order = Window.partitionBy("_key", "_part").orderBy("_h", *kept).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(order), F.lit(0))).join(counts, ["_key", "_part"])
    rows = rows.select("_key", *kept, "_of", "_n", (F.col("_before") + F.col("_in")).alias("_k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))).alias("_c"))
    if (most or 0) > COPIES:
        rows = rows.repartition("_key", "_k", "_c")
    last = F.least(F.col("_n") - 1, F.col("_c") + COPIES - 1)
    rows = rows.select("_key", *kept, "_of", "_k", F.explode(F.sequence("_c", last)).alias("_c")).withColumn("_k", F.col("_k") + F.col("_c"))
    # place in the whole
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "_key"), F.lit(1 << 32)) / float(1 << 32)
    rows = rows.withColumn("_f", (F.col("_k") + start) / F.col("_of"))
    rows = saved(rows.select("_key", "_k", *kept, "_f", F.least(F.floor(F.col("_f") * (1 << bits)), F.lit((1 << bits) - 1)).alias("_part")), "placed")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_m"))
    counts = counts.select("_part", _before(counts, [], "_part").alias("_before"))  # one row a part: a few hundred thousand for 10^11 rows
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_f", "_key", "_k")) - 1 + F.col("_before")
    rows = rows.join(counts, "_part").withColumn("_at", at)
    base, more = divmod(total or 0, shards)
    wide = more * (base + 1)  # the first `more` shards have one row more
    shard = F.when(F.col("_at") < wide, F.floor(F.col("_at") / (base + 1))).otherwise(more + F.floor((F.col("_at") - wide) / max(1, base))).cast("int")
    rows = rows.withColumn("_shard", shard)
    return rows.select(*kept, "_shard", (F.col("_at") - F.col("_shard") * base - F.least(F.col("_shard"), F.lit(more))).cast("long").alias("_slot"))


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 23) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row of docs."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = docs.select(_key("source").alias("_key"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"), "doc_id", "source", text_size("text").alias("size"), text_crc32("text").alias("text_crc32"))
    return interleaved(rows, ["doc_id", "source", "size", "text_crc32"], shards, seed).withColumnsRenamed({"_shard": "shard", "_slot": "slot"})


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 23, source: str = "source") -> list[str]:
    """Writes docs as Parquet, a folder a shard, whose files in order of name hold its rows in order of slot. Returns the names of the columns for shard and slot."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    names = docs.columns
    shard, slot = free_name("shard", names), free_name("slot", names)
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    keyed = docs.select(_key(f"`{source}`").alias("_key"), row.alias("_row")).withColumn("_h", F.xxhash64(F.lit(seed), "_row")).withColumn("_h2", F.xxhash64(F.lit(seed), F.lit("second"), "_row"))
    places = interleaved(keyed.select("_key", "_h", "_h2", F.col("_h").alias("_h1")), ["_h1", "_h2"], shards, seed)
    each = keyed.select(F.col("_h").alias("_h1"), "_h2", "_row").dropDuplicates(["_h1", "_h2"])  # equal rows: one, written as often as it has places
    out = places.join(each, ["_h1", "_h2"]).select(*(F.col(f"_row.`{c}`").alias(c) for c in names), F.col("_shard").alias(shard), F.col("_slot").alias(slot))
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return [shard, slot]
