"""Feed-forward networks trained by summed gradients: classifiers, autoencoders, pooled or client by client.

One step is one job: every task runs its rows forward and backward in Arrow
batches and emits the sums of its gradient matrices, row by row of a matrix;
these are added up by (client, layer, row). Weights are broadcast, so what moves
does not depend on the number of rows. Several clients share a task and one
client's rows are worked on by all tasks; clients are taken in slices whose
weights stay below CLIENT_BYTES.

A step uses all rows or, with `batches` above 1, those of one slice by hash.
Dropout follows a hash of the row, the step and the unit, and normalisation acts
within a row, so results do not depend on partitioning or retries.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowtide.functions.columns import q
from flowtide.operators import explore
from flowtide.operators.averaging import choose_clients
from flowtide.session import materialize

CLIENT_BYTES = 64 << 20
EPS = 1e-5


@dataclass
class Layer:
    """Weights, then (all optional) normalisation of the row, ReLU, dropout."""

    units: int
    norm: bool = False
    relu: bool = False
    dropout: float = 0.0


def classifier_layers(hidden: Sequence[int] = (128, 64, 32), dropout: float = 0.0, norm: bool = False) -> list[Layer]:
    return [*[Layer(n, norm, True, dropout) for n in hidden], Layer(1)]


def autoencoder_layers(inputs: int, encoding: int = 32, hidden: Sequence[int] = (64,), dropout: float = 0.1, norm: bool = True) -> list[Layer]:
    """Encoder, bottleneck with ReLU, mirrored decoder, linear output."""
    return [*[Layer(n, norm, True, dropout) for n in hidden], Layer(encoding, relu=True), *[Layer(n, norm, True, dropout) for n in reversed(hidden)], Layer(inputs)]


def start_weights(inputs: int, layers: Sequence[Layer], seed: int = 42) -> list[np.ndarray]:
    """Per layer a matrix of units x (inputs + 1), the constant last, and for normalised layers a 2 x units matrix (scale, shift)."""
    rng, out = np.random.default_rng(seed), []
    for layer in layers:
        matrix = rng.normal(0, math.sqrt(2 / inputs), (layer.units, inputs + 1))
        matrix[:, -1] = 0
        out.append(matrix)
        if layer.norm:
            out.append(np.stack([np.ones(layer.units), np.zeros(layer.units)]))
        inputs = layer.units
    return out


def _mixed(key: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (wraps around)."""
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def dropout_mask(keys: np.ndarray, step: int, depth: int, units: int, rate: float) -> np.ndarray:
    """0 or 1 / (1 - rate) for every row and unit, the same wherever and whenever the row is read."""
    with np.errstate(over="ignore"):
        row = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(step * 1_000_003 + depth * 7_919 + 1))
        unit = _mixed(np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mixed = _mixed(row[:, None] ^ unit[None, :])
    return (mixed >> np.uint64(11)).astype(float) / float(1 << 53) >= rate


def forward(layers: Sequence[Layer], weights: Sequence[np.ndarray], x: np.ndarray, keys: np.ndarray | None = None, step: int = 0) -> tuple[np.ndarray, list]:
    """Outputs before the link function, and what the backward pass needs. Without keys nothing is dropped."""
    tape, at, h = [], 0, x
    for depth, layer in enumerate(layers):
        matrix = weights[at]
        z = h @ matrix[:, :-1].T + matrix[:, -1]
        entry = {"in": h, "at": at}
        at += 1
        if layer.norm:
            centred = z - z.mean(1, keepdims=True)
            spread = np.sqrt((centred**2).mean(1, keepdims=True) + EPS)
            entry["unit"], entry["spread"] = centred / spread, spread
            z = entry["unit"] * weights[at][0] + weights[at][1]
            at += 1
        if layer.relu:
            entry["on"] = z > 0
            z = np.where(entry["on"], z, 0.0)
        if layer.dropout and keys is not None:
            entry["mask"] = dropout_mask(keys, step, depth, layer.units, layer.dropout) / (1 - layer.dropout)
            z = z * entry["mask"]
        tape.append(entry)
        h = z
    return h, tape


def row_losses(out: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Loss per row: log loss of the single output's logistic, or mean squared error over the outputs."""
    if kind == "log":
        z = out[:, 0]
        return np.maximum(z, 0) - z * y[:, 0] + np.log1p(np.exp(-np.abs(z)))
    return ((out - y) ** 2).mean(1)


def gradients(layers: Sequence[Layer], weights: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str, keys: np.ndarray | None = None, step: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Outputs, and the gradient of sum(w * loss) by every weight matrix."""
    out, tape = forward(layers, weights, x, keys, step)
    if kind == "log":
        d = (1 / (1 + np.exp(-np.clip(out, -500, 500))) - y) * w[:, None]
    else:
        d = 2 * (out - y) / out.shape[1] * w[:, None]
    grads: list[np.ndarray] = [np.zeros(0)] * len(weights)
    for layer, entry in zip(reversed(layers), reversed(tape)):
        if "mask" in entry:
            d = d * entry["mask"]
        if layer.relu:
            d = d * entry["on"]
        at = entry["at"]
        if layer.norm:
            unit = entry["unit"]
            grads[at + 1] = np.stack([(d * unit).sum(0), d.sum(0)])
            d = d * weights[at + 1][0]
            d = (d - d.mean(1, keepdims=True) - unit * (d * unit).mean(1, keepdims=True)) / entry["spread"]
        grads[at] = np.concatenate([d.T @ entry["in"], d.sum(0)[:, None]], axis=1)
        d = d @ weights[at][:, :-1]
    return out, grads


class Descent:
    """Plain gradient steps."""

    def __init__(self, rate: float):
        self.rate = rate

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        return [w - self.rate * g for w, g in zip(weights, grads, strict=True)]


class Adam(Descent):
    """Steps scaled by running means of the gradient and its square."""

    def __init__(self, rate: float, keep: float = 0.9, keep_square: float = 0.999):
        super().__init__(rate)
        self.keep, self.keep_square, self.n, self.mean, self.square = keep, keep_square, 0, None, None

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        if self.mean is None:
            self.mean, self.square = [np.zeros_like(g) for g in grads], [np.zeros_like(g) for g in grads]
        self.n += 1
        a, b = self.keep, self.keep_square
        self.mean = [a * m + (1 - a) * g for m, g in zip(self.mean, grads)]
        self.square = [b * s + (1 - b) * g * g for s, g in zip(self.square, grads)]
        scale = math.sqrt(1 - b**self.n) / (1 - a**self.n)
        return [w - self.rate * scale * m / (np.sqrt(s) + 1e-8) for w, m, s in zip(weights, self.mean, self.square)]


OPTIMISERS = {"descent": Descent, "adam": Adam}


@dataclass
class Network:
    """Layers and weights; scores rows, can be saved and loaded."""

    inputs: int
    layers: list[Layer]
    kind: str
    weights: list[np.ndarray]
    history: list[dict] = field(default_factory=list)

    def _apply(self, df: DataFrame, features: str, how: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
        shared = df.sparkSession.sparkContext.broadcast((self.layers, self.weights))

        @F.pandas_udf("double")
        def run(rows: pd.Series) -> pd.Series:
            layers, weights = shared.value
            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, weights[0].shape[1] - 1))
            return pd.Series(how(x, forward(layers, weights, x)[0]))

        return run(_array(df, features))

    def predict(self, df: DataFrame, features: str = "features", score: str = "score") -> DataFrame:
        """Adds the probability and the 0.5-cut `prediction`."""
        p = self._apply(df, features, lambda x, out: 1 / (1 + np.exp(-np.clip(out[:, 0], -500, 500))))
        return df.withColumn(score, p).withColumn("prediction", (q(score) > 0.5).cast("int"))

    def reconstruction_error(self, df: DataFrame, features: str = "features", out: str = "error") -> DataFrame:
        """Adds the mean squared difference between a row and what the network makes of it."""
        return df.withColumn(out, self._apply(df, features, lambda x, y: ((x - y) ** 2).mean(1)))

    def save(self, spark: SparkSession, path: str) -> None:
        kept = {"inputs": self.inputs, "kind": self.kind, "layers": [vars(v) for v in self.layers], "weights": [w.tolist() for w in self.weights], "history": self.history}
        spark.createDataFrame([(json.dumps(kept),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        kept = json.loads(spark.read.text(path).first()[0])
        return cls(kept["inputs"], [Layer(**v) for v in kept["layers"]], kept["kind"], [np.array(w) for w in kept["weights"]], kept["history"])


def _array(df: DataFrame, features: str) -> Column:
    return q(features) if isinstance(df.schema[features].dataType, ArrayType) else vector_to_array(q(features))


def training_rows(df: DataFrame, features: str, target: Column | None, weight: Column, held: Column, client: Column, id_cols: Sequence[str] | None) -> DataFrame:
    """The narrow table that every step reads: client, key, held, w, x and (for a classifier) y."""
    key = F.xxhash64(*[q(c) for c in id_cols]) if id_cols else F.xxhash64(_array(df, features))
    y = target.cast("double") if target is not None else F.lit(None).cast("double")
    slim = df.select(client.cast("int").alias("client"), key.alias("key"), held.alias("held"), weight.cast("double").alias("w"), _array(df, features).alias("x"), y.alias("y"))
    return materialize(slim if target is None else slim.where("y IS NOT NULL"), "network-rows")


def summed_gradients(rows: DataFrame, layers: Sequence[Layer], weights: dict[int, list[np.ndarray]], kind: str, step: int) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """Per client (sums, gradients) at the client's own weights, over all its rows.

    Sums: rows, weight, weighted loss, right answers, held rows, their loss.
    """
    shared = rows.sparkSession.sparkContext.broadcast((list(layers), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, weights = shared.value
        totals: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for batch in batches:
            client, key, held, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("client", "key", "held", "w"))
            width = next(iter(weights.values()))[0].shape[1] - 1
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, width)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)[:, None] if kind == "log" else x
            for c in np.unique(client):
                mine, own = client == c, weights[int(c)]
                learn, test = mine & ~held, mine & held
                sums, grads = totals.setdefault(int(c), (np.zeros(6), [np.zeros_like(m) for m in own]))
                if learn.any():
                    out, found = gradients(layers, own, x[learn], y[learn], w[learn], kind, key[learn], step)
                    right = ((out[:, 0] > 0) == (y[learn][:, 0] > 0.5)).sum() if kind == "log" else 0
                    sums += [learn.sum(), w[learn].sum(), (w[learn] * row_losses(out, y[learn], kind)).sum(), right, 0, 0]
                    for g, f in zip(grads, found):
                        g += f
                if test.any():
                    sums[4:] += [test.sum(), row_losses(forward(layers, own, x[test])[0], y[test], kind).sum()]
        out = [(c, -1, 0, sums.tolist()) for c, (sums, _) in totals.items()]
        out += [(c, depth, i, row.tolist()) for c, (_, grads) in totals.items() for depth, g in enumerate(grads) for i, row in enumerate(g)]
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["client", "layer", "row", "sums"])

    def add(group: pa.Table) -> pa.Table:
        """One matrix row of one client, as every task has summed it."""
        total = np.sum([v.as_py() for v in group.column("sums")], axis=0)
        return group.slice(0, 1).set_column(3, "sums", pa.array([total.tolist()], pa.list_(pa.float64())))

    kind_ddl = "client int, layer int, row int, sums array<double>"
    found = rows.mapInArrow(run, kind_ddl).groupBy("client", "layer", "row").applyInArrow(add, kind_ddl).collect()  # as many rows as the weights have
    shared.unpersist()
    result = {c: (np.zeros(6), [np.zeros_like(m) for m in own]) for c, own in weights.items()}
    for r in found:
        if r.layer < 0:
            result[r.client][0][:] = r.sums
        else:
            result[r.client][1][r.layer][r.row] = r.sums
    return result


def _slice_of(rows: DataFrame, epoch: int, batch: int, batches: int) -> DataFrame:
    """The rows of one step; held rows are looked at with the epoch's first."""
    if batches == 1:
        return rows
    mine = F.pmod(F.xxhash64("key", F.lit(epoch)), F.lit(batches)) == batch
    return rows.where(F.when(F.col("held"), F.lit(batch == 0)).otherwise(mine))


def _fit(rows: DataFrame, layers, start, kind, epochs, batches, rate, optimiser, patience, has_held) -> tuple[list[np.ndarray], list[dict]]:
    weights, history, moves = start, [], OPTIMISERS[optimiser](rate)
    best, kept, waited = math.inf, start, 0
    for epoch in range(epochs + 1):
        loss = weight = right = n = 0.0
        stop = epoch == epochs  # one more look at the held rows
        if stop and not has_held:
            break
        for batch in range(1 if stop else batches):
            chosen = rows.where("held") if stop else _slice_of(rows, epoch, batch, batches)
            sums, grads = summed_gradients(chosen, layers, {0: weights}, kind, epoch * batches + batch)[0]
            if batch == 0 and has_held and epoch:
                history[-1]["val_loss"] = val = float(sums[5] / sums[4]) if sums[4] else math.inf
                waited = 0 if val < best else waited + 1
                if val < best:
                    best, kept = val, weights
                if waited >= patience:
                    stop = True
                    break
            if not stop and sums[1]:
                weights = moves.step(weights, [g / sums[1] for g in grads])
                n, weight, loss, right = n + sums[0], weight + sums[1], loss + sums[2], right + sums[3]
        if stop:
            break
        history.append({"epoch": epoch + 1, "train_loss": loss / weight if weight else None, "train_accuracy": right / n if n and kind == "log" else None})
    return (kept if has_held else weights), history


def _prepare(df: DataFrame, features: str, layers: Sequence[Layer], start, seed: int) -> tuple[int, list[np.ndarray]]:
    first = df.select(F.size(_array(df, features))).first()
    inputs = first[0] if first else (start[0].shape[1] - 1 if start else layers[-1].units)
    return inputs, [np.array(w, float) for w in start] if start else start_weights(inputs, layers, seed)


def train_classifier(
    df: DataFrame,
    features: str = "features",
    label: str = "label",
    layers: Sequence[Layer] | None = None,
    weight: str | None = "ratio",
    validation: str | None = None,
    epochs: int = 100,
    batches: int = 1,
    rate: float = 0.001,
    optimiser: str = "adam",
    patience: int = 10,
    id_cols: Sequence[str] | None = None,
    start: Sequence[np.ndarray] | None = None,
    seed: int = 42,
) -> Network:
    """A network with one logistic output under weighted log loss.

    `weight`: a class weight rule ('ratio', 'balanced'), the name of a column, or None. With `validation`, a 0/1
    column, training ends after `patience` epochs without a smaller loss there and the best weights are returned.
    """
    layers = list(layers or classifier_layers())
    if weight in ("ratio", "balanced"):
        df, weight = explore.class_weights(df, label, weight), "weight"
    inputs, first = _prepare(df, features, layers, start, seed)
    held = F.coalesce(q(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    rows = training_rows(df, features, q(label), q(weight) if weight else F.lit(1.0), held, F.lit(0), id_cols)
    weights, history = _fit(rows, layers, first, "log", epochs, batches, rate, optimiser, patience, validation is not None)
    return Network(inputs, layers, "log", weights, history)


def train_autoencoder(
    df: DataFrame,
    features: str = "features",
    label: str | None = "label",
    layers: Sequence[Layer] | None = None,
    validation: str | None = None,
    epochs: int = 50,
    batches: int = 1,
    rate: float = 0.001,
    optimiser: str = "adam",
    patience: int = 5,
    id_cols: Sequence[str] | None = None,
    start: Sequence[np.ndarray] | None = None,
    seed: int = 42,
) -> Network:
    """A network that reproduces normal rows (label 0, or all without a label) under squared error."""
    normal = df if label is None else df.where(q(label) == 0)
    if layers is None:
        width = normal.select(F.size(_array(df, features))).first()
        layers = autoencoder_layers(width[0] if width else 1)
    layers = list(layers)
    inputs, first = _prepare(normal, features, layers, start, seed)
    held = F.coalesce(q(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    rows = training_rows(normal, features, None, F.lit(1.0), held, F.lit(0), id_cols)
    weights, history = _fit(rows, layers, first, "square", epochs, batches, rate, optimiser, patience, validation is not None)
    return Network(inputs, layers, "square", weights, history)


def local_updates(rows: DataFrame, clients: Sequence[int], layers: Sequence[Layer], shared: list[np.ndarray], kind: str, epochs: int, batches: int, rate: float, optimiser: str, mu: float, first_step: int) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """Every client trains on its own rows from the shared weights: client -> (sums of the last epoch, weights).

    With `mu` each step is pulled back by mu * (w - shared), the proximal term.
    """
    mine = rows.where(F.col("client").isin(list(clients)))
    own = {c: [w.copy() for w in shared] for c in clients}
    moves = {c: OPTIMISERS[optimiser](rate) for c in clients}
    totals = {c: np.zeros(6) for c in clients}
    for epoch in range(epochs):
        totals = {c: np.zeros(6) for c in clients}
        for batch in range(batches):
            step = first_step + epoch * batches + batch
            for c, (sums, grads) in summed_gradients(_slice_of(mine, epoch, batch, batches), layers, own, kind, step).items():
                totals[c] += sums
                if sums[1]:
                    own[c] = moves[c].step(own[c], [g / sums[1] + mu * (w - s) for g, w, s in zip(grads, own[c], shared)])
    return {c: (totals[c], own[c]) for c in clients}


def average_networks(
    df: DataFrame,
    layers: Sequence[Layer],
    kind: str,
    features: str = "features",
    label: str | None = "label",
    client: str = "client_id",
    rounds: int = 5,
    epochs: int = 5,
    batches: int = 1,
    rate: float = 0.001,
    optimiser: str = "adam",
    mu: float = 0.0,
    fraction: float = 1.0,
    min_clients: int = 2,
    id_cols: Sequence[str] | None = None,
    start: Sequence[np.ndarray] | None = None,
    seed: int = 42,
) -> Network:
    """Rounds of local training and averaging by client row counts; `kind` is 'log' or 'square' (normal rows only).

    History: per round its clients, rows, and the row-weighted training loss and accuracy of the last local epoch.
    """
    layers = list(layers)
    used = df.where(q(label) == 0) if kind == "square" and label is not None else df
    inputs, weights = _prepare(used, features, layers, start, seed)
    rows = training_rows(used, features, q(label) if kind == "log" else None, F.lit(1.0), F.lit(False), q(client), id_cols)
    known = materialize(rows.where("client IS NOT NULL").select(F.col("client").alias("client_id")).distinct(), "clients")
    network = Network(inputs, layers, kind, weights)
    at_once = max(1, CLIENT_BYTES // (8 * sum(w.size for w in weights)))
    for r in range(rounds):
        chosen = sorted(c.client_id for c in choose_clients(known, fraction, min_clients, seed, r).toLocalIterator())  # ids only
        total, sums = [np.zeros_like(w) for w in weights], np.zeros(6)
        for i in range(0, len(chosen), at_once):
            done = local_updates(rows, chosen[i : i + at_once], layers, weights, kind, epochs, batches, rate, optimiser, mu, r * epochs * batches)
            for found, own in done.values():
                sums += found
                total = [t + found[0] * w for t, w in zip(total, own)]
        if sums[0]:
            weights = [t / sums[0] for t in total]
        network.history.append({"round": r + 1, "clients": len(chosen), "n": int(sums[0]), "train_loss": float(sums[2] / sums[1]) if sums[1] else None, "train_accuracy": float(sums[3] / sums[0]) if kind == "log" and sums[0] else None})
    network.weights = weights
    return network
