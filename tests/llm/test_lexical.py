import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrabrook.llm import lexical

DOCS = "doc_id long, text string, item_id string, term int, at int"
ITEMS = "item_id long, text string, block string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    counts = [(d, Counter(terms(t))) for d, t, *_ in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for (d, c), size in zip(counts, sizes):
            m = 10 + 90 * size * n // total if total else 0
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def made(rng, n):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["É", "日本", "x9"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    docs = [(i % (n - 20), text(rng.randint(0, 50)).replace(" ", rng.choice([" ", "-", "\n"])), "z", 1, 2) for i in range(n)]
    docs += [(None, docs[3][1], None, 1, 1), (None, None, None, 1, 1), (10**12, "", "q", 1, 1), (7, text(30_000), "", 1, 1)] + [(9000 + i, docs[5][1], "", 0, 0) for i in range(30)]
    items = [(i, text(rng.randint(1, 12)), "b") for i in range(25)] + [(3, "again W1 w2", ""), (None, text(5), None), (None, "x9", None), (90, None, ""), (91, "", ""), (92, "nowhere_at_all", ""), (93, docs[5][1], "")]
    return docs, items


@pytest.mark.parametrize(("block", "per", "top"), [(1 << 23, 1 << 16, 10), (600, 40, 10), (600, 7, 3)])
def test_against_brute_force(spark, monkeypatch, block, per, top):
    monkeypatch.setattr(lexical, "TERMS", per)
    docs, items = made(random.Random(block), 300)
    index = lexical.index_documents(spark.createDataFrame(docs, DOCS).repartition(4), block)
    got = lexical.search_index(index, spark.createDataFrame(items, ITEMS), top).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1])) == brute(docs, items, top)
    blocks = index.where("term is null").select(F.size("ids")).collect()
    assert sum(r[0] for r in blocks) == len(docs) and (block > 600 or len(blocks) > 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "")], ITEMS)
    assert lexical.rank_documents(docs, items).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, "a b", "", 1, 1)], DOCS), items.limit(0)).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, None, "", 1, 1)], DOCS), items).count() == 0
    assert lexical.rank_documents(docs, items).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_pairs_bound_tighter_than_terms_and_lose_nothing():
    rng = np.random.default_rng(4)
    size, k = 1200, 12
    at = [np.sort(rng.choice(size, 18 + k - t, replace=False)) for t in range(k)]
    impact = [rng.integers(80, 100, len(a)) for t, a in enumerate(at)]
    pairs = {(t, t + 1): lexical.joint(at[t], impact[t], at[t + 1], impact[t + 1]) for t in range(k - 1)}
    total = np.zeros(size, np.int64)
    for a, v in zip(at, impact):
        total[a] += v
    terms_, ids = list(range(k)), np.arange(size)[::-1].copy()
    with_pairs, without = lexical.Lists(at, impact, pairs, size), lexical.Lists(at, impact, {}, size)
    bound, plain = with_pairs.bounds(terms_), without.bounds(terms_)
    for i in range(k + 1):
        first = np.zeros(size, np.int64)
        for t in range(i):
            first[at[t]] += impact[t]
        assert first.max() <= bound[i] <= plain[i]
    assert bound[-1] < plain[-1]
    want = sorted(zip(-total, ids))[:10]
    least = int(-want[-1][0])
    for lists in (with_pairs, without):
        for at_least in (0, least):
            places, score = lists.best(terms_, ids, at_least, 10)
            assert list(zip(-score, ids[places])) == want
        assert len(lists.best(terms_, ids, plain[-1] + 1, 10)[0]) == 0
    assert with_pairs.opened < without.opened
