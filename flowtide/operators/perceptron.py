"""Full-batch training of pyspark.ml's multilayer perceptron.

Rows are packed once into blocks of at most BLOCK_BYTES and written. One evaluation
of the loss is one job: every task adds up the gradient over its blocks, one matrix
product per layer and block, and what tasks hand on is one vector as long as the
weights. L-BFGS moves the weights on the driver. Neither the vectors nor a block grow
with the table. The result is the pyspark.ml model with the weights found.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import q
from flowtide.session import materialize

BLOCK_BYTES = 256 << 10
BLOCK_ROWS = 256  # what a block's layers take stays in a core's cache
ADD_ABOVE = 64  # tasks
MEMORY = 10  # steps that L-BFGS looks back, as in pyspark.ml
LOSSES = 20  # as many last losses must agree for an end, as there


def packed(df: DataFrame, features: str, label: str, inputs: int) -> DataFrame:
    """(x, y) blocks of rows: doubles row by row, and class numbers."""
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * inputs)))
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.zeros((0, inputs)), np.zeros(0, np.int8)
        for batch in batches:
            x = np.concatenate([x, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)])
            y = np.concatenate([y, batch.column("y").to_numpy(zero_copy_only=False).astype(np.int8)])
            while len(y) >= size:
                yield pa.RecordBatch.from_arrays([pa.array([x[:size].tobytes()], pa.binary()), pa.array([y[:size].tobytes()], pa.binary())], schema=schema)
                x, y = x[size:], y[size:]
        if len(y):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], schema=schema)

    rows = df.select(vector_to_array(q(features)).alias("x"), q(label).cast("int").alias("y"))
    return materialize(rows.mapInArrow(run, "x binary, y binary"), "perceptron-rows")


def unpacked(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix outputs x inputs, constants) per layer, in pyspark.ml's order: columns of the matrix, then constants."""
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((weights[at : at + n * m].reshape(n, m).T, weights[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def loss_and_gradient(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, inner: type = np.float32) -> tuple[float, np.ndarray]:
    """Sums over the rows: cross entropy of the softmax output after sigmoid layers, and its gradient.

    The features, the first layer's products with them, the loss and all sums over blocks are doubles;
    what sigmoids (between 0 and 1) go into is of the kind `inner`.
    """
    layers, seen = unpacked(weights, sizes), [x]
    layers = [layers[0], *[(matrix.astype(inner), constant.astype(inner)) for matrix, constant in layers[1:]]]
    for depth, (matrix, constant) in enumerate(layers):
        z = seen[-1] @ matrix.T
        z += constant
        z = z.astype(inner, copy=False)
        if depth < len(layers) - 1:  # 1 / (1 + exp(-z)) in place
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        seen.append(z)
    z = seen[-1].astype(float)
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    total = p.sum(1, keepdims=True)
    each = np.arange(len(y))
    loss = float((np.log(total[:, 0]) - z[each, y]).sum())
    d = p / total
    d[each, y] -= 1
    d, parts = d.astype(inner), []
    for depth in range(len(layers) - 1, -1, -1):
        if not depth:
            d = d.astype(float)
        parts.append((seen[depth].T @ d, d.sum(0)))
        if depth:
            h = seen[depth]
            d = d @ layers[depth][0]
            d *= h
            d *= 1 - h
    return loss, np.concatenate([v.ravel() for matrix, constant in reversed(parts) for v in (matrix, constant)])


def mean_loss(blocks: DataFrame, weights: np.ndarray, sizes: Sequence[int]) -> tuple[float, np.ndarray]:
    """Mean loss of all rows and its gradient, from one job."""
    shared = blocks.sparkSession.sparkContext.broadcast((weights, list(sizes)))
    schema = pa.schema([("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sizes = shared.value
        sums = np.zeros(len(weights) + 2)  # rows, loss, gradient
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                target = np.frombuffer(y.as_py(), np.int8).astype(int)
                loss, gradient = loss_and_gradient(weights, sizes, np.frombuffer(x.as_py()).reshape(len(target), sizes[0]), target)
                sums[0] += len(target)
                sums[1] += loss
                sums[2:] += gradient
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column("sums"):
                found = np.frombuffer(s.as_py())
                total = found.copy() if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    found = blocks.mapInArrow(run, "sums binary")
    if blocks.rdd.getNumPartitions() > ADD_ABOVE:
        found = found.repartition(ADD_ABOVE // 4).mapInArrow(add, "sums binary")
    sums = np.sum([np.frombuffer(r.sums) for r in found.collect()], axis=0)  # a vector per task
    shared.unpersist()
    return sums[1] / sums[0], sums[2:] / sums[0]


def between(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
    """Where the cubic through two points' values and slopes is least, kept away from both; their middle where there is none."""
    (a, f, g), (b, h, k) = low, high
    one = g + k - 3 * (f - h) / (a - b)
    root = one * one - g * k
    if not (np.isfinite(root) and root >= 0):
        return (a + b) / 2
    two = np.sqrt(root)
    step = b - (b - a) * (k + two - one) / (k - g + 2 * two) if k - g + 2 * two else (a + b) / 2
    return min(max(step, a + 0.1 * (b - a)), a + 0.9 * (b - a)) if np.isfinite(step) else (a + b) / 2


def lbfgs(ask: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, iterations: int, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory quasi-Newton steps; each ends where the loss has fallen enough and its slope is flatter (strong Wolfe)."""
    x = start
    loss, gradient = ask(x)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=MEMORY)
    first, losses = abs(loss), deque([loss], maxlen=LOSSES)
    for _ in range(iterations):
        if np.linalg.norm(gradient) <= max(tolerance * abs(loss), 1e-8):
            break
        d, kept = gradient.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            kept.append(a)
            d -= a * y
        if past:
            s, y, r = past[-1]
            d /= r * (y @ y)
        for (s, y, r), a in zip(past, reversed(kept)):
            d += (a - r * (y @ d)) * s
        d, slope = -d, -(gradient @ d)
        if slope >= 0:  # not a descent: forget the past
            past.clear()
            d, slope = -gradient, -(gradient @ gradient)
        step = 1.0 if past else 1 / max(np.linalg.norm(d), 1e-12)
        low, high = (0.0, loss, slope), None  # step, loss and slope there
        for _ in range(20):
            there = x + step * d
            new_loss, new_gradient = ask(there)
            new_slope = new_gradient @ d
            at = step, new_loss, new_slope
            if not new_loss <= min(loss + 1e-4 * step * slope, low[1]) or new_slope > -0.9 * slope:
                high = at
            elif new_slope < 0.9 * slope:
                low = at
            else:
                break
            step = 2 * step if high is None else between(low, high)
        if not new_loss < loss:
            break
        s, y = there - x, new_gradient - gradient
        if s @ y > 1e-12:
            past.append((s, y, 1 / (s @ y)))
        x, loss, gradient = there, new_loss, new_gradient
        losses.append(loss)
        if max(losses) - loss <= tolerance * first:
            break
    return x


def train(df: DataFrame, sizes: Sequence[int], label: str = "label", features: str = "features", iterations: int = 100, seed: int = 42):
    """pyspark.ml's perceptron model for the layer sizes; it starts from that library's own start weights for the seed."""
    spark, sizes = df.sparkSession, list(sizes)
    if df.isEmpty():
        raise ValueError("a network needs training rows")
    learner = MultilayerPerceptronClassifier(labelCol=label, featuresCol=features, layers=sizes, maxIter=0, seed=seed)
    one = spark.createDataFrame([(0.0, Vectors.dense([0.0] * sizes[0]))], [label, features])  # of no weight: no step is taken on it
    start = learner.fit(one).weights.toArray()
    blocks = packed(df.where(q(label).isNotNull()), features, label, sizes[0])
    found = lbfgs(lambda w: mean_loss(blocks, w, sizes), start, iterations)
    return learner.setInitialWeights(Vectors.dense(found)).fit(one)
