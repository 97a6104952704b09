import itertools
import random
import zlib

import numpy as np
import pytest

from terrabrook.llm import queries, toxicity


def brute(model, at, evidence, n):
    """Marginals by summing over every labelling."""
    e = dict(zip(at, evidence))
    total, mass = 0.0, dict.fromkeys(at, 0.0)
    for tags in itertools.product((0, 1), repeat=n):
        score = model.start * tags[0] + sum(tags[i] * (model.bias + e.get(i, 0.0)) for i in range(n)) + sum(model.steps[a][b] for a, b in zip(tags, tags[1:]))
        p = np.exp(score)
        total += p
        for i in at:
            mass[i] += p * tags[i]
    return [mass[i] / total for i in at]


def test_marginals_are_exact():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(1, 9)
        at = sorted(rng.sample(range(n), rng.randint(1, n)))
        e = [rng.uniform(-2, 6) for _ in at]
        model = toxicity.Field({}, rng.uniform(-4, 0), ((0.0, rng.uniform(-2, 1)), (rng.uniform(-1, 1), rng.uniform(-1, 2))), rng.uniform(-2, 1))
        assert model.marginals(at, e, n) == pytest.approx(brute(model, at, e, n), abs=1e-9)
    assert model.marginals([5], [9.0], 2_000_000)[0] <= 1


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["moron", "scumbag", "worthless"]
    rows, marks = [], []
    for i in range(n):
        ws = ["".join(rng.choices("aeinorst", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randint(1, 4) if toxic else 0):
            ws.insert(rng.randint(0, len(ws)), rng.choice(bad) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(ws).upper() if rng.random() < 0.1 else " ".join(ws), "toxic"))
        marks.append((i, toxic))
    return rows, marks


def test_learns_tags_and_leaves_clean_rows(spark):
    rows, marks = corpus(900, 3)
    docs = spark.createDataFrame([*rows, (9001, None, "x"), (9002, "", "x"), (9003, "plain " * 200_000 + "moron", "x"), (9003, "plain " * 200_000 + "moron", "x"), (None, "you moron worthless", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([*marks, (0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 905
    truth = dict(marks)
    held = [r for r in got if r["doc_id"] in truth and r["doc_id"] is not None]
    assert np.mean([(r["toxicity"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.98
    texts = {r[0]: r[1] for r in rows}
    hits = [any(b in texts[r["doc_id"]][s["start"] : s["end"]].lower() for b in ("moron", "scumbag", "worthless")) for r in held for s in r["toxic_spans"]]
    assert len(hits) > 100 and np.mean(hits) > 0.95
    by = {r["doc_id"]: r["toxicity"] for r in got}
    assert by[9001] == by[9002] < 0.5 and 0 <= by[9001] and by[None] > 0.5 and by[9003] > 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 9002").count() == 1


def test_empty_tables_and_one_class(spark):
    rows, marks = corpus(30, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).where("toxicity < 0.5").count() == 30
    clean = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, clean)
    assert toxicity.score_toxicity(docs, model).where("toxicity < 0.5").count() == 30
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_likelihood_and_gradient_of_whole_rows():
    """Runs as powers give what forward over every token gives, and the gradient is that of the likelihood."""
    kept = {"wbad": 0.9, "wworse": 0.6, "pbad": 0.7}
    rng = random.Random(4)
    rows = [(1, 1, [0], ["bad"]), (0, 5, [], []), (0, 1, [], []), (1, 0, [], [])]
    for _ in range(12):
        n = rng.randint(1, 30)
        at = sorted(rng.sample(range(n), rng.randint(1, min(n, 6))))
        rows.append((rng.randint(0, 1), n, at, [rng.choice(["bad", "worse", "baddest"]) for _ in at]))
    rows.append((1, 400, [3, 350], ["bad", "bad"]))
    chains = toxicity.Rows(rows, kept)

    def whole(theta):
        weights, (bias, s01, s10, s11, start) = dict(zip(chains.names, theta)), theta[3:]
        move, log = np.array([[0.0, s01], [s10, s11]]), 0.0
        for label, n, at, ws in rows:
            e = np.full(n, bias)
            tags = np.zeros(n, int)
            for i, w in zip(at, ws):
                fs = [f for f in toxicity.features(w) if f in kept]
                e[i] += sum(weights[f] for f in fs)
                tags[i] = int(label and max(kept[f] for f in fs) >= toxicity.SURE)
            a = np.array([0.0, start + e[0]]) if n else None
            for t in range(1, n):
                a = np.logaddexp(a[0] + move[0], a[1] + move[1]) + [0, e[t]]
            if n:
                log += tags[0] * start + (tags * e).sum() + sum(move[p, q] for p, q in zip(tags, tags[1:])) - np.logaddexp(*a)
        return log

    for seed in range(3):
        theta = np.random.default_rng(seed).normal(size=8) - np.array([0, 0, 0, 2, 0, 0, 0, 0])
        value, slope = chains.slope(theta)
        assert value == pytest.approx(whole(theta), abs=1e-8)
        for i in range(8):
            h = np.zeros(8)
            h[i] = 1e-5
            assert slope[i] == pytest.approx((whole(theta + h) - whole(theta - h)) / 2e-5, abs=1e-5)


def test_field_learns_from_rows_of_any_length(spark, monkeypatch):
    """Only the longer toxic rows have "scumbag"; the field takes a part of the rows."""
    rng = random.Random(11)
    plain = lambda n: ["".join(rng.choices("aeinorst", k=5)) for _ in range(n)]
    rows, marks = [], []
    for i in range(400):
        toxic = int(i % 2 == 0)
        long = rng.random() < 0.5
        ws = plain(rng.randint(80, 120) if long else rng.randint(5, 20))
        if toxic:
            ws.insert(rng.randint(0, len(ws)), "scumbag" if long else "moron")
        rows.append((i, " ".join(ws), "x"))
        marks.append((i, toxic))
    monkeypatch.setattr(toxicity, "FIELD_ROWS", 80)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert model.evidence("moron") > 1 and model.evidence("scumbag") > 1


def test_score_against_every_labelling():
    """A text's score, worked out from marginals by summing over all labellings; spans are offsets into the text itself."""
    model = toxicity.Field({"wbad": 5.0, "pwor": 3.0}, -2.0, ((0.0, -0.5), (-0.2, 0.4)), -1.0, (-2.0, 0.3, 1.1, 2.0))
    known = toxicity.Evidence(model.evidence)
    for text in ("fine words", "BAD", "a bad, worst thing", "İİİİ bad", "İ bad İ İİ worse bad x", "bad " * 9):
        ws = toxicity.words(text)
        at = [i for i, w in enumerate(ws) if model.evidence(w)]
        p = brute(model, at, [model.evidence(ws[i]) for i in at], len(ws))
        score, spans = toxicity.score_text(text, known, model)
        assert score == pytest.approx(model.total(p), abs=1e-9)
        flagged = [ws[i] for i, q in zip(at, p) if q >= 0.5]
        assert [w for s in spans for w in toxicity.words(text[s["start"] : s["end"]])] == flagged
    assert [(s["start"], s["end"]) for s in toxicity.score_text("İİİİ bad", known, model)[1]] == [(5, 8)]


def test_registered_query(spark, tmp_path):
    """held_out by crc32, predicted from score; labels of held-out rows don't matter."""
    rows, marks = corpus(300, 8)
    rows.append((None, "no identifier", "x"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = zlib.crc32
    for name, flip in (("a", False), ("b", True)):
        labels = [(d, 1 - t if flip and out(str(d).encode()) % 5 == 0 else t, 0) for d, t in marks]
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    one, two = (sorted(map(tuple, queries.op7_toxicity(spark, f"{tmp_path}/{n}").collect()), key=str) for n in "ab")
    assert one == two and len(one) == 301
    for doc, held, score, predicted, _ in one:
        assert held is (doc is not None and out(str(doc).encode()) % 5 == 0) and predicted == (score >= 0.5) and 0 <= score <= 1


def test_score_fit_converges():
    """Summaries that one column separates are separated, however large another column gets."""
    rng = np.random.default_rng(3)
    clean = np.zeros((4000, 4))
    some = rng.random(4000) < 0.1
    clean[some, 1:] = np.stack((rng.uniform(8, 20, some.sum()), rng.uniform(0.05, 3, some.sum()), rng.uniform(0.05, 0.8, some.sum())), 1)
    toxic = np.stack((np.zeros(1700), rng.uniform(19.5, 20, 1700), rng.uniform(1, 5, 1700), rng.uniform(0.95, 1, 1700)), 1)
    x = np.concatenate((clean, toxic))
    x[:, 0] = 1
    y = np.repeat([0.0, 1.0], [4000, 1700])
    beta = np.array(toxicity.fit_score(x, y, (15000, 1700)))
    assert np.mean((x @ beta >= 0) == (y == 1)) > 0.999


def test_chance_isn_t_evidence(spark):
    """Rare words that a few toxic rows happen to have don't become features."""
    rng = random.Random(2)
    rows, marks = corpus(600, 12)
    rows = [(d, t + " " + " ".join(f"rare{rng.randint(0, 400)}" for _ in range(3)), s) for d, t, s in rows]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert model.evidence("moron") > 1 and not any(w.startswith("wrare") for w in model.weights)
