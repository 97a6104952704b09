"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals make document scores and spans.

Fitting. Of the labelled rows a bounded sample is drawn by hash (`TOXIC_ROWS` and `CLEAN_ROWS`). Features of a token are
the word in lower case, its beginnings and its endings. Those that mark toxic rows are found by counting the rows of all of them (an aggregate over
the sample, of which the `FEATURES` best leave Spark), and label the tokens: in toxic rows a token with a feature that nearly only toxic rows have is toxic, all
others are clean. On these token labels the field (weights of features, a bias, transitions) is fitted by its likelihood's
gradient from forward-backward, on whole rows of the sample drawn by hash whatever their length: `FIELD_ROWS` / 2 of either class with a feature and
`FIELD_ROWS` / 10 without. Runs of tokens without a feature are powers of a matrix there as well, with their derivatives, so a row costs what its few tokens with features do.
A small logistic model, fitted on all rows of the sample, whole, at the classes' true rates, turns a document's marginals into a score.

Scoring is one pass over whole texts without a shuffle. Most tokens have no feature that weighs: a run of n of them is the n-th power of
one 2 x 2 matrix, so forward-backward is exact on the few others. Labels, language, source and identifiers aren't inputs.

Null text is empty; a text without any evidence scores the rate of such rows. Without toxic or without clean labels the score is the
(smoothed) rate of what there is. A doc_id labelled more than once counts as toxic if any label says so; null labels don't count.
Repeated rows score alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, free_name, saved, stepwise

#: Bounds of what is fitted on: labelled rows of either class, features kept, rows of the field.
TOXIC_ROWS, CLEAN_ROWS, FEATURES, FIELD_ROWS = 2000, 4000, 4096, 1500
#: Toxic rows that must have a feature; share of toxic rows from which it is kept, and from which it labels tokens.
LEAST, KEPT, SURE = 3, 0.5, 0.8
#: Likelihood ratio (twice its logarithm) from which a feature isn't in toxic rows by chance: of half a million features two are.
CHANCE = 20.0
WORD = re.compile(r"[^\W_]+")
#: Words whose evidence a task keeps, each of LONGEST characters at most; features that a task counts before it hands them on; bytes of text in a step.
CACHE, LONGEST, COUNTED, STEP = 200_000, 64, 100_000, 1 << 20


def features(word: str) -> list[str]:
    """Of a lower-case word."""
    n = len(word)
    return ["w" + word, *("p" + word[:k] for k in range(3, min(n, 9))), *("s" + word[-k:] for k in range(3, min(n, 7)))]


def words(text: str) -> list[str]:
    """In lower case, each by itself: lower case may be longer than the text, and offsets are the text's."""
    return [w.lower() for w in WORD.findall(text)]


class Evidence(dict):
    """What `of` says about words as they stand, worked out once each; emptied when it is full."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        value = self.of(word.lower())
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


@dataclass
class Field:
    """A fitted model. Everything is plain numbers, so it travels with the tasks."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    steps: tuple[tuple[float, float], tuple[float, float]] = ((0.0, -1.0), (0.0, 0.0))
    start: float = -1.0
    score: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)

    def evidence(self, word: str) -> float:
        get = self.weights.get
        return sum(w for f in features(word) if (w := get(f)) is not None)

    def __post_init__(self) -> None:
        plain = np.exp(np.array(self.steps)) * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        self._ratio = float(values.real[order[1]] / values.real[order[0]])
        inverse = np.linalg.inv(vectors.real[:, order])
        self._parts = [np.outer(vectors.real[:, order[k]], inverse[k]) for k in (0, 1)]

    def run(self, n: int) -> np.ndarray:
        """n tokens without evidence, up to a factor."""
        return self._parts[0] + self._parts[1] * self._ratio**n

    def marginals(self, at: list[int], evidence: list[float], n: int) -> list[float]:
        """The probability of toxic of the tokens at `at`, of n tokens."""
        if not at:
            return []
        step, bias = np.exp(np.array(self.steps)), self.bias
        nodes = [np.array([1.0, np.exp(min(bias + e, 50.0))]) for e in evidence]
        gaps = [at[0], *(b - a - 1 for a, b in zip(at, at[1:])), n - 1 - at[-1]]
        ahead, begin = [], np.array([1.0, np.exp(self.start)])
        if gaps[0]:
            begin = (begin * np.array([1.0, np.exp(bias)])) @ self.run(gaps[0] - 1) @ step
        state = begin
        for k, node in enumerate(nodes):
            if k:
                state = (state @ self.run(gaps[k]) if gaps[k] else state) @ step
            state = state * node
            state = state / state.sum()
            ahead.append(state)
        back = self.run(gaps[-1]) @ np.ones(2) if gaps[-1] else np.ones(2)
        out = []
        for k in range(len(nodes) - 1, -1, -1):
            both = ahead[k] * back
            out.append(float(both[1] / both.sum()))
            back = step @ (nodes[k] * back)
            if k and gaps[k]:
                back = self.run(gaps[k]) @ back
            back = back / back.sum()
        return out[::-1]

    def summary(self, p: list[float]) -> np.ndarray:
        """What the score is made of: odds that any token is toxic, expected toxic tokens, and the surest one."""
        if not p:
            return np.array([1.0, 0.0, 0.0, 0.0])
        clean = sum(np.log1p(-min(x, 1 - 1e-9)) for x in p)
        return np.array([1.0, min(20.0, np.log(max(np.expm1(min(-clean, 50.0)), 1e-6)) + 14), np.log1p(sum(p)), max(p)])

    def total(self, p: list[float]) -> float:
        z = float(self.summary(p) @ np.array(self.score))
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))


class Rows:
    """Labelled rows as chains of their tokens with features, and the runs without between them, whose matrices are powers: likelihood and gradient are those of the whole rows."""

    def __init__(self, rows: list[tuple[int, int, list[int], list[str]]], kept: dict[str, float]) -> None:
        """rows: (label, tokens, places of those with a feature, these in lower case); kept: share of toxic rows by feature."""
        self.names = sorted(kept)
        number = {f: i for i, f in enumerate(self.names)}
        share = np.array([kept[f] for f in self.names])
        vocabulary = sorted({w for r in rows for w in r[3]})
        sets = [[number[f] for f in features(w) if f in number] for w in vocabulary]
        self.words = len(sets)
        self.owner, self.which = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([i for s in sets for i in s], np.int64)
        sure = np.array([max(share[s]) >= SURE for s in sets], bool)
        index = {w: i for i, w in enumerate(vocabulary)}
        self.count = sum(r[1] > 0 for r in rows)
        self.empty = np.array([r[1] for r in rows if r[1] and not r[2]], np.int64)
        chains = sorted((r for r in rows if r[2]), key=lambda r: -len(r[2]))
        size = np.array([len(r[2]) for r in chains], np.int64)
        self.live = [int((size > t).sum()) for t in range(int(size[0]) if len(size) else 0)]
        self.first = np.concatenate(([0], np.cumsum(self.live))).astype(np.int64)  # nodes by step, the longest chains first
        self.ids, self.tags, self.gaps = (np.zeros(self.first[-1], np.int64) for _ in range(3))
        self.ends = np.array([r[1] - 1 - r[2][-1] for r in chains], np.int64)
        pairs, begins = np.zeros((2, 2)), 0
        for k, (label, _, at, ws) in enumerate(chains):
            to = self.first[: len(at)] + k
            self.ids[to] = [index[w] for w in ws]
            tags = np.array([int(label and sure[index[w]]) for w in ws])
            gaps = np.diff(np.array([-1, *at])) - 1
            self.tags[to], self.gaps[to] = tags, gaps
            begins += int(gaps[0] == 0 and tags[0])
            before = np.concatenate(([0], np.where(gaps[1:] > 0, 0, tags[:-1])))
            some = np.ones(len(at), bool)
            some[0] = gaps[0] > 0
            np.add.at(pairs, (before[some], tags[some]), 1)
            pairs[1, 0] += tags[:-1][gaps[1:] > 0].sum() + (self.ends[k] > 0) * tags[-1]
        self.seen = np.array([self.tags.sum(), pairs[0, 1], pairs[1, 0], pairs[1, 1], begins], float)  # bias, clean-toxic, toxic-clean, toxic-toxic, start
        self.observed = np.bincount(self.ids, weights=self.tags, minlength=self.words)

    def slope(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """(logarithm of the likelihood, gradient) of weights, bias, steps and start."""
        n = len(self.names)
        weights, (bias, s01, s10, s11, start) = theta[:n], theta[n:]
        move, plain = np.exp(np.array([[0.0, s01], [s10, s11]])), np.array([1.0, np.exp(bias)])
        matrix = move * plain
        spread = np.sqrt((matrix[0, 0] - matrix[1, 1]) ** 2 + 4 * matrix[0, 1] * matrix[1, 0])
        top, low = (matrix[0, 0] + matrix[1, 1] + spread) / 2, (matrix[0, 0] + matrix[1, 1] - spread) / 2
        ratio, vectors = low / top, np.array([[matrix[0, 1], matrix[0, 1]], [top - matrix[0, 0], low - matrix[0, 0]]])
        inverse = np.linalg.inv(vectors)
        parts = [np.outer(vectors[:, k], inverse[k]) for k in (0, 1)]
        masks = np.array([[[0, 1], [0, 1]], [[0, 1], [0, 0]], [[0, 0], [1, 0]], [[0, 0], [0, 1]]], float)
        turned = np.einsum("ij,pjk,kl->pil", inverse, masks * matrix, vectors)

        def run(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(power, its derivatives) of runs of g tokens, over the largest eigenvalue to the power of g."""
            r = ratio**g
            both, last = (1 - r) / (1 - ratio) / top, np.where(g > 0, g * ratio ** np.maximum(g - 1, 0), 0.0) / top
            inner = turned[:, None] * np.stack([np.stack([g / top, both], 1), np.stack([both, last], 1)], 1)
            return parts[0] + r[:, None, None] * parts[1], vectors @ inner @ inverse

        step = masks * move
        step[0] = 0.0
        power, change = run(np.maximum(self.gaps - (np.arange(len(self.gaps)) < (self.live[0] if self.live else 0)), 0))
        across, varied = power @ move, change @ move + power @ step[:, None]
        after, varied_after = run(self.ends)
        node = np.exp(np.clip(bias + np.bincount(self.owner, weights=weights[self.which], minlength=self.words)[self.ids], -50, 50)) if len(self.ids) else np.zeros(0)
        psi = np.stack([np.ones(len(node)), node], 1)
        opening = np.array([1.0, np.exp(start + bias)])
        log, expected = 0.0, np.zeros(5)
        if len(self.empty):
            whole, varied_whole = run(self.empty - 1)
            right = whole.sum(2)
            z = right @ opening
            log += np.log(z).sum() + ((self.empty - 1) * np.log(top)).sum()
            begin = opening[1] * right[:, 1] / z
            expected[:4] += (np.einsum("a,pnab->pn", opening, varied_whole) / z).sum(1)
            expected[0] += begin.sum()
            expected[4] += begin.sum()
        marginal = np.zeros(len(node))
        if self.live:
            later = self.gaps[: self.live[0]] > 0
            ahead = np.zeros((len(node), 2))
            into = np.where(later[:, None], np.einsum("a,nab->nb", opening, across[: self.live[0]]), np.array([1.0, np.exp(start)]))
            for t, k in enumerate(self.live):
                at = slice(self.first[t], self.first[t] + k)
                state = (into if t == 0 else np.einsum("na,nab->nb", state[:k], across[at])) * psi[at]
                total = state.sum(1)
                log += np.log(total).sum()
                state = ahead[at] = state / total[:, None]
            log += (np.maximum(self.gaps - (np.arange(len(self.gaps)) < self.live[0]), 0).sum() + self.ends.sum()) * np.log(top)
            back = after.sum(2)
            for t in range(len(self.live) - 1, -1, -1):
                k, at = self.live[t], slice(self.first[t], self.first[t] + self.live[t])
                done = slice(self.live[t + 1] if t + 1 < len(self.live) else 0, k)  # chains whose last node this is
                z = (ahead[at][done] * back[done]).sum(1)
                log += np.log(z).sum()
                expected[:4] += (np.einsum("na,pnab->pn", ahead[at][done], varied_after[:, done]) / z).sum(1)
                both = ahead[at] * back[:k]
                marginal[at] = both[:, 1] / both.sum(1)
                right = psi[at] * back[:k]
                if t:
                    left = ahead[self.first[t - 1] : self.first[t - 1] + k]
                    z = np.einsum("na,nab,nb->n", left, across[at], right)
                    expected[:4] += (np.einsum("na,pnab,nb->pn", left, varied[:, at], right) / z).sum(1)
                    new = np.einsum("nab,nb->na", across[at], right)
                    back[:k] = new / new.sum(1, keepdims=True)
                else:
                    expected[4] += marginal[at][~later].sum()
                    right = right[later]
                    beyond = np.einsum("nab,nb->na", across[at][later], right)
                    z = beyond @ opening
                    begin = (opening[1] * beyond[:, 1] / z).sum()
                    expected[:4] += (np.einsum("a,pnab,nb->pn", opening, varied[:, at][:, later], right) / z).sum(1)
                    expected[0] += begin
                    expected[4] += begin
        expected[0] += marginal.sum()
        gone = np.bincount(self.ids, weights=marginal, minlength=self.words)
        out = np.zeros_like(theta)
        out[:n] = np.bincount(self.which, weights=(self.observed - gone)[self.owner], minlength=n)
        out[n:] = self.seen - expected
        found = float(theta[n:] @ self.seen + (np.bincount(self.owner, weights=weights[self.which], minlength=self.words) @ self.observed if self.words else 0.0))
        return found - float(log), out


def fit_field(rows: list[tuple[int, int, list[int], list[str]]], kept: dict[str, float]) -> Field:
    """rows as of Rows. The score isn't fitted yet."""
    chains = Rows(rows, kept)
    if not chains.count:
        return Field()
    n = len(chains.names)
    theta = np.concatenate((np.zeros(n), [-4.0, -1.0, 0.0, 0.0, -1.0]))
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, 81):
        slope = chains.slope(theta)[1] / chains.count - 0.001 * theta
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.15 * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    bias, step01, step10, step11, start = map(float, theta[n:])
    weights = {f: float(w) for f, w in zip(chains.names, theta[:n], strict=True) if abs(w) > 0.05}
    return Field(weights, bias, ((0.0, step01), (step10, step11)), start)


def fit_score(x: np.ndarray, y: np.ndarray, rates: tuple[int, int]) -> tuple[float, ...]:
    """Weights of what summary returns, from summaries and labels; rates: clean and toxic rows in all."""
    weight = np.where(y == 1, rates[1] / max(y.sum(), 1), rates[0] / max((1 - y).sum(), 1))
    weight /= weight.mean()
    ridge, beta = np.array([1e-6, 0.05, 0.05, 0.05]), np.zeros(4)

    def loss(b: np.ndarray) -> float:
        return float((weight * np.logaddexp(0.0, np.where(y == 1, -1.0, 1.0) * (x @ b))).sum() + (ridge * b * b).sum() / 2)

    for _ in range(100):  # Newton's method; a step that goes too far is halved
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        change = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        least, size = loss(beta), 1.0
        while size > 1e-6 and loss(beta + size * change) > least - 1e-4 * size * float(slope @ change):
            size /= 2
        if size <= 1e-6 or np.abs(size * change).max() < 1e-8:
            break
        beta += size * change
    return tuple(map(float, beta))


def _counted(rows: DataFrame) -> DataFrame:
    """(f, t, c): toxic and clean rows that have a feature, of those that LEAST toxic rows have. rows: (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(counts: Counter, toxic: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(np.full(len(counts), toxic, np.int32)), pa.array(list(counts.values()), pa.int64())], ["f", "toxic", "n"])

        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for part in stepwise(batches, "text", STEP):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts[toxic].update({f for w in set(words(text)) for f in features(w)})
                if len(counts[toxic]) > COUNTED:
                    yield made(counts[toxic], toxic)
                    counts[toxic].clear()
        for toxic in (0, 1):
            yield made(counts[toxic], toxic)

    each = [F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((1, "t"), (0, "c"))]
    return rows.select("text", "toxic").mapInArrow(run, "f string, toxic int, n long").groupBy("f").agg(*each).where(F.col("t") >= LEAST)


def held_out(doc_id: str | Column) -> Column:
    """Whether a row is kept from fitting: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Field:
    """A model from the rows of docs (doc_id, text) that labels (doc_id, toxic) marks and held_out leaves."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out("doc_id"))
    order = F.xxhash64("doc_id")
    drawn = [marks.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    sample = saved(drawn[0].unionByName(drawn[1]), "labels")  # 6,000 rows at most, so the broadcast is bounded
    rows = saved(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").repartition(12), "labelled")
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    have = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not have.get(0) or not have.get(1):
        n, k = have.get(0, 0) + have.get(1, 0), have.get(1, 0)
        return Field(score=(float(np.log((k + 0.5) / (n - k + 0.5))) if n else -4.0, 0.0, 0.0, 0.0))
    rate = totals[0] / have[0] * have[1] / totals[1]  # clean rows are drawn more thinly
    toxic = have[1] / (have[0] + have[1])
    both = F.col("t") + F.col("c")
    chance = 2 * (F.col("t") * F.log(F.col("t") / (both * toxic)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - toxic)))).otherwise(0.0))
    marking = _counted(rows).withColumns({"share": (F.col("t") + 0.5) / (F.col("t") + F.col("c") * rate + 1), "chance": chance}).where((F.col("share") >= KEPT) & (F.col("chance") >= CHANCE) & (F.col("t") > both * toxic))
    kept = {r["f"]: r["share"] for r in marking.orderBy(F.desc("chance"), "f").limit(FEATURES).collect()}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(lambda w: any(f in kept for f in features(w)))
        for part in stepwise(batches, "text", STEP):
            tokens, found, hits = [], [], []
            for text in part.column(0).to_pylist():
                raw = WORD.findall(text)
                found.append([i for i, w in enumerate(raw) if known[w]])
                hits.append([raw[i].lower() for i in found[-1]])
                tokens.append(len(raw))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(tokens, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.string()))], ["toxic", "place", "tie", "tokens", "at", "words"])

    placed = rows.select("text", "toxic", order.alias("place"), F.xxhash64("text").alias("tie"))
    found = saved(placed.mapInArrow(places, "toxic int, place long, tie long, tokens long, at array<long>, words array<string>"), "places")
    chains = []
    for only, n in (("size(at) > 0 and toxic = 1", FIELD_ROWS // 2), ("size(at) > 0 and toxic = 0", FIELD_ROWS // 2), ("size(at) = 0", FIELD_ROWS // 10)):
        chains += [(r["toxic"], r["tokens"], r["at"], r["words"]) for r in found.where(only).orderBy("place", "tie", "toxic").limit(n).collect()]
    model = fit_field(chains, kept)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(model.evidence)
        for part in stepwise(batches, "text", STEP):
            made = []
            for text in part.column(0).to_pylist():
                e = list(map(known.__getitem__, WORD.findall(text)))
                at = [i for i, v in enumerate(e) if v]
                made.append(list(map(float, model.summary(model.marginals(at, [e[i] for i in at], len(e))))))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (1, 2, 3)), pa.array(made, pa.list_(pa.float64()))], ["toxic", "place", "tie", "x"])

    x = placed.mapInArrow(summaries, "toxic int, place long, tie long, x array<double>")
    got = [r for k, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)) for r in x.where(F.col("toxic") == k).orderBy("place", "tie").limit(n).collect()]  # however many rows repeat a doc_id
    got = sorted((r["place"], r["tie"], r["toxic"], r["x"]) for r in got)
    model.score = fit_score(np.array([r[3] for r in got]), np.array([r[2] for r in got], float), (totals[0], totals[1]))
    return model


def score_text(text: str, known: Evidence, model: Field) -> tuple[float, list[dict]]:
    """The score of a text and its offending runs of tokens, as character offsets [start, end) in it and their surest probability."""
    e = list(map(known.__getitem__, WORD.findall(text)))
    at = [i for i, v in enumerate(e) if v]
    p = model.marginals(at, [e[i] for i in at], len(e))
    bad = {i: q for i, q in zip(at, p, strict=True) if q >= 0.5}
    found: list[dict] = []
    last = -1
    for i, m in enumerate(WORD.finditer(text)) if bad else ():
        if i in bad:
            if found and last == i - 1:
                found[-1]["end"], found[-1]["p"] = m.end(), max(found[-1]["p"], bad[i])
            else:
                found.append({"start": m.start(), "end": m.end(), "p": bad[i]})
            last = i
    return model.total(p), found


def score_toxicity(docs: DataFrame, model: Field, text: str = "text", names: tuple[str, str] = ("toxicity", "toxic_spans")) -> DataFrame:
    """docs with `toxicity` (0 to 1) and `toxic_spans`: character offsets [start, end) in the text of offending runs of tokens and their surest probability. Columns of just those names go, all others stay."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        known = Evidence(model.evidence)
        for part in stepwise(batches, at, STEP):
            rows = [score_text(raw or "", known, model) for raw in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], kind)], [*part.schema.names, *names])

    return extended(docs, text, run, {names[0]: "double", names[1]: "array<struct<start:int,end:int,p:double>>"})


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all columns as they are, without the rows that score 0.5 or more under a model fitted on their labels."""
    score, spans = free_name("toxicity", docs.columns), free_name("toxic_spans", docs.columns)
    scored = score_toxicity(docs, fit_toxicity(docs, labels), names=(score, spans))
    return scored.where(F.col(score) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
