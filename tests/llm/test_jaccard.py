import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from terrabrook.llm import jaccard_join
from terrabrook.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randint(0, 40))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(40):
        rows.append([word() for _ in range(rng.randint(0, 160))])
    for _ in range(30):  # chains of edits, so links aren't transitive
        base = list(rng.choice(rows))
        for _ in range(rng.randint(1, 5)):
            if base:
                base[rng.randrange(len(base))] = word()
            rows.append(list(base))
    for _ in range(20):
        rows.append(passage + [word() for _ in range(rng.randint(0, 60))])
    for _ in range(15):
        rows.append([word() for _ in range(rng.randint(0, 5))])
    rows += [list(r) for r in rng.sample(rows, 20)]
    rng.shuffle(rows)
    return [(i * 3 + 1, (" ".join(r), "\t".join(r).upper(), " \n".join(r) + "\x0b")[rng.randint(0, 2)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("seed", "rounds", "hot"), [(1, 0, 1000), (2, 3, 2), (3, 1, 1)])
def test_against_all_pairs(spark, seed, rounds, hot, monkeypatch):
    """With the blocks at once, after hubs, and with shingles dealt in parts."""
    monkeypatch.setattr(jaccard_join, "REPEATED", 2)
    monkeypatch.setattr(jaccard_join, "PART", 3)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rows = [*corpus(seed), (0, None), (2, "     "), (5, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(df.repartition(3)).collect()))
    assert got == brute(rows)


def test_star_of_near_copies(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for k in range(60):  # each links with the base alone
        rows.append((k, " ".join(w if not 6 * k <= i < 6 * k + 1 and (i + k) % 37 else f"z{k}_{i}" for i, w in enumerate(base))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "A B c d e f"), (8, "a b c"), (9, "a b c"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (7, 2, 1), (8, 1, 8), (9, 1, 8), (9, 0, 8)], key=str)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f"), (8, "a b c"), (9, None), (None, "a b c d e f")], key=str)


def test_different_texts_of_one_identifier_stay(spark):
    many = " ".join(f"w{i}" for i in range(100))
    rows = [(3, "one two three four five six", "a"), (3, "quite another text of some words", "b"), (3, many, "c"), (3, many + " more", "c"), (1, many + " more", "d"), (3, "one two three four five six", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = sorted(map(tuple, jaccard_join.one_of_each(df).collect()))
    assert first == sorted([rows[0], rows[1], rows[4]])
    assert first == sorted(map(tuple, jaccard_join.one_of_each(df.repartition(5)).collect()))


def test_suffix_filter_never_hides_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate((x[rng.random(len(x)) < rng.choice([0.8, 0.9, 1.0])], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64))))
        if jaccard_join.linked(x, y, 75):
            assert jaccard_join.may_overlap(len(x), jaccard_join.sketch(x), len(y), jaccard_join.sketch(y), 75)
    far = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    assert not jaccard_join.may_overlap(len(far), jaccard_join.sketch(far), len(far), jaccard_join.sketch(far + np.uint64(1 << 63)), 75)


def test_a_text_beyond_one_step(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5 w6")]
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 399_996, 1), (2, 399_997, 1), (3, 2, 3)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}


def test_steps_hold_little():
    """What a step makes of texts of some megabytes is small beside them."""
    texts = pa.array([" ".join(f"w{i}x{k}" for k in range(200)).encode() for i in range(2000)], pa.large_binary())
    tracemalloc.start()
    sets = jaccard_join.shingle_sets(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sets) == 2000 and all(len(s) == 196 for s in sets)
    assert most < 24e6
