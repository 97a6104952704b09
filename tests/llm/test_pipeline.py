import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from terrabrook.llm import bpe, mixing
from tests.llm.test_jaccard import brute


def test_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("aeinorst", k=rng.randint(2, 7)))
    rows, marks = [], []
    for i in range(260):
        ws = [word() for _ in range(rng.randint(8, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            ws[3:3] = ["moron", "worthless"]
        if i % 9 == 0:
            ws.append("4111111111111111")
        rows.append((i, " ".join(ws), "en", ["b", "a", None, "c"][i % 4], len(ws)))
        marks.append((i, 1, toxic))
    rows += [(1000 + i, rows[i][1].upper(), "de", "b", 1) for i in range(0, 60, 2)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, "no identifier here at all", "en", "a", 5), (3, rows[3][1], "en", "c", rows[3][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, outs = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(outs)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(outs)}")
        outs.append([tuple(r) for r in docs.collect()])
        if len(outs) < 5:
            assert docs.columns == names
    calm = [r for r in outs[0] if r[0] is not None and r[0] < 1000]
    assert not any("moron" in (r[1] or "").lower() for r in outs[0])
    clean = {m[0] for m in marks if not m[2]}
    assert len({r[0] for r in calm}) == len(clean)
    want = {c for d, _, c in brute([(r[0], r[1]) for r in outs[0] if r[0] is not None])}
    assert Counter(r[0] for r in outs[1]) == Counter([*want, None])
    before = {r[0]: r for r in outs[1]}
    for r in outs[2]:
        old = before[r[0]]
        assert (r[0], *r[2:]) == (old[0], *old[2:])
        assert (r[1] == old[1]) == ("4111111111111111" not in (old[1] or ""))
    copies = Counter(r[0] for r in outs[3])
    planned = Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(spark.read.parquet(f"{tmp_path}/2")).collect() if r["copies"]})
    assert set(copies) <= {*want, None} and copies == planned and max(copies.values()) <= 2 and len(outs[4]) == len(outs[3])
    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    text = {r[0]: r[1] or "" for r in outs[2]}
    for doc, _, _, n, ids, digest in outs[4]:
        assert n * 4 == len(ids) and digest == hashlib.sha256(text[doc].encode()).hexdigest()
        assert b"".join(vocab.table[i] for i in np.frombuffer(bytes(ids), "<u4")) == text[doc].encode()


def test_run(spark, tmp_path):
    rows = [(i, f"a few words of text number {i}", "en", "s", 30) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 5
    empty = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_batches_are_bounded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words of a text", "en", "a", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    setting, stages = corpus_pipeline.BATCH_SETTING, dict(corpus_pipeline.STAGES)
    before = spark.conf.get(setting)
    try:
        for given, want in (("10000", corpus_pipeline.BATCH), ("0", corpus_pipeline.BATCH), ("7", 7)):
            for name in ("pii", "bpe"):
                spark.conf.set(setting, given)
                stages[name](spark, docs, str(tmp_path))
                assert int(spark.conf.get(setting)) == want
    finally:
        spark.conf.set(setting, before)
