import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terrabrook.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(library):
    rng = random.Random(5)
    alphabet = "abst'  \n\t\r　re ve ll d m S L12½é日.,!\"\x1c\x85​\U0001f600\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    texts += ["don't we'll they've 's ''s  's\n's it'll've", "x" * 5000, "'" * 99, " " * 99, "", "ab" * 40 + "é" * 300]
    vocab = bpe.vocabulary(PATH)
    ids, counts = bpe.encode_texts(texts, vocab)
    at = 0
    for t, n in zip(texts, counts):
        assert list(ids[at : at + n]) == library.encode_ordinary(t), repr(t)
        at += n


def test_long_text_is_cut_at_piece_boundaries(library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 50)
    text = "it's a  long \n text, 12 words' don't  " * 40
    assert len(bpe.cut(text, 50)) > 5 and "".join(bpe.cut(text, 50)) == text
    vocab = bpe.vocabulary(PATH)
    parts = bpe.cut(text, 50)
    assert list(np.concatenate([bpe.encode_texts([p], vocab)[0] for p in parts])) == library.encode_ordinary(text)
    assert bpe.cut("x" * 500, 50) == ["x" * 500]


def test_digest(spark, library):
    texts = [None, "", "same text", "same text", "é" * 3000, "word " * 300_000]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    for r in bpe.bpe_digest(docs, PATH).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = bpe.encode_bpe(docs, PATH)
    assert kept.columns == ["doc_id", "text", "n_tokens", "ids", "starts"]
    assert kept.limit(0).count() == 0
    apart = {r["doc_id"]: r["decoded"] for r in bpe.decode_bpe(kept, PATH).collect()}
    assert apart == {r["doc_id"]: r["decoded"] for r in bpe.encode_bpe(docs, PATH, decoded=True).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
