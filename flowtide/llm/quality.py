"""Quality scores: ridge regression on random Fourier features, then isotonic calibration.

Each whole text is reduced to a few statistics in one pass, written once. Random
Fourier features of the standardised statistics approximate a Gaussian kernel.
Every task adds up its rows' normal equations, one set per fold; the sums meet
by matrix row, so no task and not the driver holds more than the folds' small
matrices. Leaving a fold out is a subtraction, which gives out-of-fold scores
for the isotonic step (pool adjacent violators over fixed score bins).

All labelled rows outside the held-out part are used; nothing is sampled.

Defined cases: a null text counts as empty; an empty text has all-zero
statistics and a score; rows without id or label are not learnt from; an id
labelled twice takes the larger label; without any labelled row every score is
0.5; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import map_text
from flowtide.session import materialize

STATS = (
    "log_chars log_words letters upper digits symbols word_chars distinct_words top_word repeated_word "
    "short_words lone_symbols sentence_ends commas distinct_lines log_line_words distinct_pairs odd_ends"
).split()
FOLDS = 4
_SPACE, _OTHER, _DIGIT, _LOWER, _UPPER, _END, _COMMA = range(7)


def char_classes() -> np.ndarray:
    """Class of every code point."""

    def kind(c: str) -> int:
        if c.isspace():
            return _SPACE
        if c.isalpha():
            return _UPPER if c.isupper() else _LOWER
        if c.isdigit():
            return _DIGIT
        return _END if c in ".!?" else _COMMA if c == "," else _OTHER

    return np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def statistics(text: str | None, classes: np.ndarray) -> list[float]:
    """The statistics named in STATS, over the whole text."""
    text = text or ""
    kinds = classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    n = len(kinds)
    words = text.split()
    if not words:
        return [math.log1p(n)] + [0.0] * (len(STATS) - 1)
    count = np.bincount(kinds, minlength=7)
    space = np.concatenate([[True], kinds == _SPACE, [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    lengths, last = ends - starts, kinds[ends - 1]
    letters = count[_LOWER] + count[_UPPER]
    m = len(words)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = text.split("\n")
    lone = np.count_nonzero((lengths == 1) & (last == _OTHER))
    return [
        math.log1p(n),
        math.log1p(m),
        letters / n,
        count[_UPPER] / max(letters, 1),
        count[_DIGIT] / n,
        (count[_OTHER] + count[_END] + count[_COMMA]) / n,
        float(lengths.mean()),
        len(tally) / m,
        max(tally.values()) / m,
        sum(map(operator.eq, words, words[1:])) / m,
        np.count_nonzero(lengths <= 3) / m,
        lone / m,
        np.count_nonzero(last == _END) / m,
        np.count_nonzero(last == _COMMA) / m,
        len(set(lines)) / len(lines),
        math.log1p(m / len(lines)),
        len(set(zip(words, words[1:], strict=False))) / m,
        np.count_nonzero(last == _OTHER) / m,
    ]


def text_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns plus `stats`, one pass over the texts."""

    def build():
        classes = char_classes()
        return lambda texts: [[statistics(t, classes) for t in texts]]

    return map_text(docs, build, "stats array<double>", keep, text)


class Fourier:
    """Fixed random projection; the standardised statistics and a constant are appended."""

    def __init__(self, mean: Sequence[float], deviation: Sequence[float], features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = np.array(mean), np.maximum(np.array(deviation), 1e-9)
        self.w = rng.normal(size=(len(self.mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * math.sqrt(2 / len(self.b)), 0.1 * z, np.ones((len(z), 1))], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def normal_equations(rows: DataFrame, fourier: Fourier, folds: int = FOLDS) -> dict[int, np.ndarray]:
    """By fold the matrix [F'F, F'y] of rows (fold, stats, y).

    Tasks emit their partial sums as matrix rows; equal rows meet in one task of
    few and are added as they stream in.
    """
    schema = pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("values", pa.list_(pa.float64()))])

    def emit(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], schema=schema
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = fourier(_matrix(batch)) if batch.num_rows else None
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in np.unique(fold):
                part = x[fold == k]
                sums[int(k)] = sums.get(int(k), 0) + part.T @ np.c_[part, y[fold == k]]
        if sums:
            yield emit({(k, i): row for k, m in sums.items() for i, row in enumerate(m)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, v in zip(*[batch.column(c).to_pylist() for c in ("fold", "row")], _lists(batch.column("values")), strict=True):
                sums[k, i] = sums[k, i] + v if (k, i) in sums else v
        if sums:
            yield emit(sums)

    ddl = "fold int, row int, values array<double>"
    merged = rows.mapInArrow(partial, ddl).repartition(8, "fold", "row").mapInArrow(merge, ddl)
    found: dict[int, dict[int, list[float]]] = {}
    for r in merged.collect():
        found.setdefault(r.fold, {})[r.row] = r["values"]
    return {k: np.array([v[i] for i in sorted(v)]) for k, v in found.items()}


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def ridge(sums: np.ndarray, strength: float) -> np.ndarray:
    size = sums.shape[0]
    return np.linalg.solve(sums[:, :size] + strength * np.eye(size), sums[:, size])


def pool_adjacent(points: Sequence[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of (position, weight, mean) sorted by position: positions and non-decreasing values."""
    blocks: list[list[float]] = []  # weight, weighted mean, first, last
    for x, w, y in points:
        blocks.append([w, y, x, x])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, y2, _, end = blocks.pop()
            w1, y1, begin, _ = blocks.pop()
            blocks.append([w1 + w2, (w1 * y1 + w2 * y2) / (w1 + w2), begin, end])
    xs = [v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(xs), np.array(ys)


class Model:
    """Fourier features, ridge weights (total and without each fold) and the calibration curve."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, xs: np.ndarray, ys: np.ndarray):
        self.fourier, self.weights, self.xs, self.ys = fourier, weights, xs, ys

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.xs, self.ys), 0.0, 1.0)


def learn(
    stats: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    label: str = "quality",
    doc_id: str = "doc_id",
    features: int = 128,
    width: float = 3.0,
    strength: float = 0.1,
    bins: int = 1000,
    seed: int = 7,
) -> Model:
    """Fits on all labelled rows that `learn_from` (a condition on the id) admits."""
    known = labels.where(learn_from & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(F.col(label).cast("double")).alias("y"))
    rows = stats.select(doc_id, "stats").join(known, doc_id).select((F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(FOLDS))).cast("int").alias("fold"), "stats", "y")
    moments = rows.agg(F.count("*").alias("n"), *[f(F.get("stats", F.lit(i))).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments.n:
        return Model(None, None, np.zeros(1), np.full(1, 0.5))
    fourier = Fourier([moments[f"m{i}"] for i in range(len(STATS))], [moments[f"s{i}"] for i in range(len(STATS))], features, width, seed)
    sums = normal_equations(rows, fourier)
    total = sum(sums.values())
    weights = ridge(total, strength)
    without = {k: ridge(total - v, strength) if len(sums) > 1 else weights for k, v in sums.items()}

    def bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and label sums by score bin, summed within the task."""
        n, pos = np.zeros(2 * bins + 1), np.zeros(2 * bins + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold = fourier(_matrix(batch)), batch.column("fold").to_numpy(zero_copy_only=False)
            s = np.array([row @ without[int(k)] for row, k in zip(x, fold, strict=True)])
            at = np.clip(np.floor((s + 0.5) * bins), 0, 2 * bins).astype(int)
            np.add.at(n, at, 1)
            np.add.at(pos, at, batch.column("y").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(pos[at])], names=["bin", "n", "pos"])

    curve = rows.mapInArrow(bin_counts, "bin int, n double, pos double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).orderBy("bin").collect()
    xs, ys = pool_adjacent([((r.bin + 0.5) / bins - 0.5, r.n, r.pos / r.n) for r in curve])
    return Model(fourier, weights, xs, ys)


def score(stats: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """Kept columns plus the calibrated score of every row of `text_statistics`."""
    fields = [stats.schema[c] for c in keep if c != name]
    out = stats.select(*[f.name for f in fields], "stats")
    schema = out.select(*[f.name for f in fields]).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(values)], names=[*[f.name for f in fields], name])

    return out.mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id and score for every document; the statistics are computed once and written."""
    stats = materialize(text_statistics(docs, text, (doc_id,)), "text-statistics")
    return score(stats, learn(stats, labels, learn_from, label, doc_id), (doc_id,))
