"""A corpus pipeline of five stages over `documents`.

toxicity        rows that the tagger, fitted on this corpus's labels, scores 0.5 or more go;
ngram_jaccard   of each component of documents that are alike in their five-word shingles the one with the smallest doc_id stays;
pii             personal values become format-preserving pseudonyms;
mix             each document is there as often as the mix of its source takes it (0, 1 or 2 times);
bpe             every text as token ids, with the texts decoded from them as digests.

Each stage works on all rows of the one before, is written as Parquet in the shared folder, and read again. All but the last
return the columns of documents. Nulls, empty and repeated rows are treated as each operator's module says.

A stage bounds the rows of the batches that the session sends to its Python workers (`BATCH`), since a batch of texts is held on both sides of the pipe;
the setting stays, as the stage's plan runs later, until `run` ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabrook.llm import bpe, jaccard_join, mixing, pii, toxicity
from terrabrook.operators.scratch import run_folder, saved

#: Whoever runs this on real data passes their own secret.
PII_KEY = "terrabrook pipeline"

#: Rows of a batch at most; a smaller setting of the session holds.
BATCH, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return jaccard_join.one_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return pii.pseudonymise(docs, PII_KEY).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_bpe(docs.select("doc_id", "lang", "source", "text"), path, drop_text=True, decoded=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_each), ("pii", pseudonymise), ("mix", mix), ("bpe", encode)]

#: SQL can express neither the tagger nor the pseudonyms; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage saves on its way is removed when its rows are written."""
    docs, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            with run_folder(spark):
                docs = saved(stage(spark, docs, sf_dir), name, outside=True)
    finally:
        spark.conf.set(BATCH_SETTING, rows)
    return docs
