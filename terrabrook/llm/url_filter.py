"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Rules (host, path prefix, verdict) decide first; where none fits, a URL is blocked when its canonical form is
listed. The Bloom filter of the list, built as an aggregate, holds 64-bit blocks: a URL's hash picks one block
and a few bits of it, so a test reads one word. Up to `FILTER_WORDS` words the filter goes to the tasks as one array; a longer
filter stays dealt by blocks, and the URLs that no rule decides meet it in an equal join on their block. Possible hits, and
only they, then meet the list in a shuffled hash join that removes false positives. DataFrame functions only.

Null URLs and those without `://` have empty host and path, fit no rule and are never listed: allowed. Repeated
URLs are judged each; an empty table or list is fine; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many 64-bit blocks are sent to the tasks (1 MB); listed URLs to a block; bits of each.
FILTER_WORDS = 1 << 17
PER_WORD = 6
BITS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// to / ? # or the end, A-Z lower-cased; path from there to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """Host without port and leading www. or m., path without index page, extension .html and closing slash; null for an empty host."""
    name = F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"^(?:www\.|m\.)+", "")
    place = F.regexp_replace(F.regexp_replace(path, r"(?:/index)?\.html?$", ""), r"/+$", "")
    return F.when(name != "", F.concat(name, place))


def _block(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key in its block."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom_blocks(listed: DataFrame, key: str, words: int) -> DataFrame:
    """(b, w): the filter's blocks that have bits, of `words` in all."""
    return listed.select(_block(F.col(key), words).alias("b"), _mask(F.col(key)).alias("w")).groupBy("b").agg(F.bit_or("w").alias("w"))


def bloom_array(blocks: DataFrame, words: int) -> DataFrame:
    """One row with all words of a filter as an array."""
    every = blocks.sparkSession.range(words).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("w"))
    whole = blocks.unionByName(every).groupBy("b").agg(F.bit_or("w").alias("w"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("words"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, canonical, rule, verdict) of every page. rules: (verdict, host, path); listed: one column `url`."""
    host, path = url_parts(F.col("_url"))
    parts = pages.select(key, F.col(url).alias("_url")).select(key, host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    parts = parts.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"), rule.alias("rule"), verdict.alias("_ruled"))
    names = listed.select(F.col(listed.columns[0]).alias("_url")).select(host.alias("host"), path.alias("path")).select(canonical(F.col("host"), F.col("path")).alias("canonical")).where("canonical is not null").distinct()
    words = max(64, -(-names.count() // PER_WORD))
    blocks, mask = bloom_blocks(names, "canonical", words), _mask(F.col("canonical"))
    open_ = F.col("_ruled").isNull() & F.col("canonical").isNotNull()
    if words <= FILTER_WORDS:
        hit = F.element_at(bloom_array(blocks, words).scalar(), _block(F.col("canonical"), words) + 1).bitwiseAND(mask) == mask
        parts = parts.withColumn("_possible", F.coalesce(open_ & hit, F.lit(False)))
    else:
        asked = parts.where(open_).withColumn("b", _block(F.col("canonical"), words)).join(blocks, "b", "left")
        asked = asked.withColumn("_possible", F.coalesce(F.col("w").bitwiseAND(mask) == mask, F.lit(False))).drop("b", "w")
        parts = parts.where(~F.coalesce(open_, F.lit(False))).withColumn("_possible", F.lit(False)).unionByName(asked)
    passed = parts.where(~F.col("_possible")).withColumn("verdict", F.coalesce("_ruled", F.lit("allow")))
    met = parts.where("_possible").join(names.hint("shuffle_hash").withColumn("_listed", F.lit(True)), "canonical", "left")
    met = met.withColumn("verdict", F.when(F.col("_listed"), "block").otherwise("allow"))
    columns = [key, "host", "path", "canonical", "rule", "verdict"]
    return passed.select(columns).unionByName(met.select(columns))
