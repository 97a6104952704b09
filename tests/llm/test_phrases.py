import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrabrook.llm import phrases

KIND = "doc_id long, text string, lang string, m int, phrase string, h long"


def brute(rows, threshold, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang][tuple(ws[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        kept = {p: a for p, a in c.items() if a >= threshold and len(p) > 1}
        inside = set()
        for p, a in kept.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p) and a >= c[p[i:j]]:
                        inside.add(p[i:j])
        scored = []
        for p, a in kept.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(rng, n):
    vocabulary = ["a", "B", "Éa", "été", "x\x00y", "of", "the b", "zz"]
    sep = [" ", " ", " ", "\t ", ", ", ".", "\n", " ; ", "\x0b"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(rng.randint(0, 60)))
        out.append((i % 40, text, rng.choice(["en", "fr", None, "und"]), 1, "x", 2))
    return out + [(None, None, "en", 1, None, 1), (None, "", None, 1, None, 1), (1, " \t\n.,", "xx", 1, None, 1), (5, "a b " * 3000, "en", 0, "", 0)]


@pytest.mark.parametrize("threshold", [1, 7, 40])
def test_against_brute_force(spark, threshold):
    rows = rows_of(random.Random(3), 300)
    got = phrases.collocations(spark.createDataFrame(rows, KIND).repartition(5), threshold, 4, 60).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, threshold, 4, 60)


def test_ties_keep_the_order_of_bytes(spark):
    rows = [(i, f"{x} {y}", "en", 1, "", 1) for i, (x, y) in enumerate([("p", "q"), ("é", "q2"), ("z", "q3")] * 5)]
    got = phrases.collocations(spark.createDataFrame(rows, KIND), 5).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == ["p q", "z q3", "é q2"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    assert phrases.collocations(empty).count() == 0
    assert [n for n, _ in phrases.collocations(empty).dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        phrases.collocations(empty, 0)


@pytest.mark.parametrize("step", [40, 97, 1000])
def test_long_texts_in_steps(step):
    rng = random.Random(step)
    text = "".join(rng.choice(["ab", "c", "ddd" * 40, "é"]) + rng.choice([" ", " ", " ", " ", " \t", ". "]) for _ in range(700)).encode()
    want, got = Counter(), Counter()
    for piece in re.split(rb"[.]", text):
        ws = piece.split()
        for m in range(1, 6):
            want.update((m, *ws[i : i + m]) for i in range(len(ws) - m + 1))
    for a, b, skip in phrases._stretches(text, step, 4):
        words = phrases.Words(np.frombuffer(text[a:b], np.uint8), np.array([0, b - a]))
        for m in range(1, 6):
            got.update((m, *(words.texts[c] for c in words.codes[i : i + m])) for i in phrases._placed(words, np.array([skip]), m))
    assert got == want


@pytest.mark.parametrize("capacity", [1, 64, 641])
def test_summaries_lose_nothing_frequent(capacity):
    rng = np.random.default_rng(capacity)
    stream = np.concatenate([rng.integers(0, 4000, 30_000), np.repeat(np.arange(5000, 5040), 50)]).astype(np.uint64)
    rng.shuffle(stream)
    truth, whole = Counter(stream.tolist()), phrases.Summary(50, capacity)
    for part in np.array_split(stream, 30):
        whole.add(*phrases.summed(part, np.ones(len(part), np.int64)))
    assert {h for h, n in truth.items() if n >= 50} <= set(whole.survivors().tolist())
    assert 0 < whole.error < 50 and len(whole.h) <= whole.capacity
    assert all(truth[int(h)] - whole.error <= n <= truth[int(h)] for h, n in zip(whole.h, whole.n))
    if capacity * 50 > len(stream):
        assert whole.capacity == capacity


def test_merged_summaries():
    a, b = phrases.Summary(100, 8), phrases.Summary(100, 8)
    for s, seed in ((a, 1), (b, 2)):
        x = np.concatenate([np.random.default_rng(seed).integers(0, 200, 300), np.full(60, 999)]).astype(np.uint64)
        s.add(*phrases.summed(x, np.ones(len(x), np.int64)))
        s.settle()
    a.merge(b)
    assert 999 in a.survivors().tolist() and a.error < 100
    spent = phrases.Summary(2, 1)
    spent.error = 1
    with pytest.raises(ValueError):
        spent.merge(spent)
