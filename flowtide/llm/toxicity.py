"""Toxicity scores from a counterfactual-regularised classifier.

Features are words and word beginnings (3 to 8 letters, which catch abusive
stems inside longer words). One grouped count over the labelled rows gives each
feature's association with the label, and the strongest `vocabulary` features
are kept. A logistic model is fitted on them with a penalty on the change of its
logit when the identity terms of a text are swapped for other groups' terms, so
that naming a group does not raise a score by itself.

Fitting takes a bounded, documented sample of the labelled rows (`max_rows`);
scoring is one pass over every whole text.

Defined cases: a null or empty text gets the model's base score; rows without
id or label are not learnt from; an id labelled twice takes the larger label;
without labelled rows of both kinds every score is the share of label 1 (0.5 if
there is none); repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import map_text, unit_hash
from flowtide.session import materialize

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
CACHE = 300_000

# Terms naming groups of people, by kind; a swap replaces a term by the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"),
    ("old", "young", "elderly"),
)


def swaps(groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> dict[str, str]:
    return {term: kind[(i + 1) % len(kind)] for kind in groups for i, term in enumerate(kind)}


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by an asterisk."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


class Reader:
    """Feature counts of a text; what a token contributes is remembered up to a bound."""

    def __init__(self, index: dict[str, int] | None, swap: dict[str, str] | None = None):
        self.index, self.swap, self.cache = index, swap or {}, {}

    def token(self, token: str) -> tuple[int, list]:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            words = [self.swap.get(w, w) for w in WORD.findall(token)]
            names = [f for w in words for f in features(w)]
            found = (len(words), names if self.index is None else [self.index[f] for f in names if f in self.index])
            self.cache[token] = found
        return found

    def counts(self, text: str | None) -> tuple[int, Counter]:
        """Number of words, and occurrences by feature."""
        total, out = 0, Counter()
        for token, n in Counter((text or "").lower().split()).items():
            words, names = self.token(token)
            total += words * n
            for f in names:
                out[f] += n
        return total, out

    def vector(self, text: str | None) -> tuple[list[int], list[float]]:
        """Sparse values: occurrences against the text's length, damped."""
        total, counts = self.counts(text)
        ids = sorted(counts)
        return ids, [math.log1p(200.0 * counts[i] / (50 + total)) for i in ids]


def sample_labels(labels: DataFrame, learn_from: Column, label: str, doc_id: str, max_rows: int) -> DataFrame:
    """At most about `max_rows` labelled ids, chosen by hash: one row per id."""
    known = labels.where(learn_from & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(doc_id).agg(F.max(F.col(label).cast("double")).alias("_y"))
    n = known.count()
    return known.where(unit_hash(doc_id, seed=2) < max_rows / max(n, 1)).limit(2 * max_rows)


def _partial_counts(rows: int = 256, limit: int = 400_000):
    """Documents and label-1 documents by feature, summed within a task before they are shuffled."""
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n, pos = Reader(None), Counter(), Counter()

        def out():
            names = list(n)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64()), pa.array([pos[f] for f in names], pa.int64())], schema=schema)

        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                for text, y in zip(part.column("text").to_pylist(), part.column("_y").to_pylist(), strict=True):
                    found = reader.counts(text)[1].keys()
                    n.update(found)
                    if y:
                        pos.update(found)
                if len(n) > limit:
                    yield out()
                    n.clear()
                    pos.clear()
        yield out()

    return run


class Model:
    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def reader(self) -> Reader:
        return Reader({f: i for i, f in enumerate(self.vocabulary)})

    def score(self, reader: Reader, text: str | None) -> float:
        ids, values = reader.vector(text)
        z = self.bias + sum(float(self.weights[i]) * v for i, v in zip(ids, values, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def solve(x: np.ndarray, swapped: np.ndarray, y: np.ndarray, ridge: float, fairness: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps on log loss + ridge |w|^2 / 2 + fairness sum((w . (x - swapped))^2) / 2."""
    design = np.c_[x, np.ones(len(x))]
    delta = np.c_[x - swapped, np.zeros(len(x))]
    penalty = ridge * np.eye(design.shape[1]) + fairness * (delta.T @ delta)
    penalty[-1, -1] = 1e-6
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + penalty @ w
        move = np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + penalty, grad)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    label: str = "toxic",
    text: str = "text",
    doc_id: str = "doc_id",
    max_rows: int = 10_000,
    vocabulary: int = 512,
    ridge: float = 1.0,
    fairness: float = 10.0,
    groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Model:
    """Fits on the labelled rows that `learn_from` (a condition on the id) admits, at most about `max_rows` of them."""
    picked = sample_labels(labels, learn_from, label, doc_id, max_rows)
    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), doc_id).select("text", "_y")
    rows = materialize(rows, "labelled-sample")  # bounded by max_rows; read three times
    totals = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("pos")).first()
    n, pos = totals.n, totals.pos or 0.0
    share = pos / n if n else 0.5
    base = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if not n or pos in (0, n):
        return Model([], np.zeros(0), base)
    counts = rows.mapInArrow(_partial_counts(), "feature string, n bigint, pos bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    lift = F.log((F.col("pos") + 0.5) / (pos + 1) / ((F.col("n") - F.col("pos") + 0.5) / (n - pos + 1)))
    swap = swaps(groups)
    named = F.col("feature").isin(list(swap)) & (F.col("n") >= 3)  # group names always get a weight to be held in check
    gain = F.when(F.col("pos") >= 3, F.col("pos") * lift)
    best = counts.select("feature", gain.alias("gain"), named.alias("named")).where("gain > 0 OR named")
    chosen = best.orderBy(F.desc("named"), F.desc_nulls_last("gain"), "feature").limit(vocabulary + len(swap)).collect()
    names = sorted(r.feature for r in chosen)
    index = {f: i for i, f in enumerate(names)}

    def vectors():
        plain, other = Reader(index), Reader(index, swap)

        def work(texts):
            a, b = [plain.vector(t) for t in texts], [other.vector(t) for t in texts]
            return [[v[0] for v in a], [v[1] for v in a], [v[0] for v in b], [v[1] for v in b]]

        return work

    fields = "ids array<int>, vals array<double>, ids2 array<int>, vals2 array<double>"
    data = map_text(rows, vectors, fields, ("_y",)).collect()
    x, swapped = np.zeros((len(data), len(names))), np.zeros((len(data), len(names)))
    for i, r in enumerate(data):
        x[i, r.ids] = r.vals
        swapped[i, r.ids2] = r.vals2
    weights, bias = solve(x, swapped, np.array([r["_y"] for r in data]), ridge, fairness)
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """Kept columns plus the score of every whole text, in [0, 1]."""

    def build():
        reader = model.reader()
        return lambda texts: [[model.score(reader, t) for t in texts]]

    return map_text(docs, build, f"`{name}` double", keep, text)
