"""Training by averaging client weights: local updates, the averaging step and the rounds.

A client's local steps use the gradient over all its rows: a grouped sum of column
arithmetic. Client weights are a table with one row per client that is joined to the rows;
only the averaged weights (one number per feature) reach the driver between rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import q
from flowtide.operators.scale import small
from flowtide.session import materialize

CLIP = 1e-15


def _probability(features: Sequence[str], weight: Sequence[Column]) -> Column:
    """Logistic model as column arithmetic; the last weight is the constant."""
    margin = weight[len(features)]
    for f, w in zip(features, weight):
        margin = margin + q(f) * w
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(margin, F.lit(500.0)), F.lit(-500.0))))


def local_update(
    df: DataFrame,
    weights: Sequence[float],
    features: Sequence[str],
    label: str = "label",
    client: str = "client_id",
    epochs: int = 1,
    rate: float = 0.5,
    mu: float = 0.0,
) -> DataFrame:
    """Every client takes `epochs` gradient steps from the shared weights of a logistic model.

    With `mu` the step is pulled back by mu * (w - w_shared), the proximal term.
    One row per client: client_id, n, weights, train_accuracy, train_loss.
    """
    shared = [F.lit(float(w)) for w in weights]
    names = [f"_w{i}" for i in range(len(weights))]
    rows = df.select(q(client).cast("int").alias("client_id"), q(label).cast("double").alias("_y"), *[q(f) for f in features])
    state: DataFrame | None = None

    def with_state() -> tuple[DataFrame, list[Column]]:
        if state is None:
            return rows, shared
        return rows.join(small(state), "client_id"), [F.col(n) for n in names]

    for _ in range(epochs):
        table, own = with_state()
        off = _probability(features, own) - F.col("_y")
        slopes = [F.avg(off * x) for x in [*[q(f) for f in features], F.lit(1.0)]]
        moved = [F.first(w) - rate * (g + mu * (F.first(w) - s)) for w, g, s in zip(own, slopes, shared)]
        state = materialize(table.groupBy("client_id").agg(*[m.alias(n) for m, n in zip(moved, names)]), "client-weights")
    table, own = with_state()
    p, y = _probability(features, own), F.col("_y")
    safe = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return table.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.first(w) for w in own]).alias("weights"),
        F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("train_accuracy"),
        F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("train_loss"),
    )


def average_weights(updates: DataFrame, n: str = "n", weights: str = "weights") -> DataFrame:
    """Averaging step: (index, weight) with weight = sum(n * w) / sum(n)."""
    entries = updates.select(q(n).alias("n"), F.posexplode(q(weights)).alias("index", "w"))
    return entries.groupBy("index").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("weight"))


def choose_clients(clients: DataFrame, fraction: float, minimum: int, seed: int, round_no: int) -> DataFrame:
    """Seeded choice of max(minimum, fraction * clients) rows of a client table for a round."""
    there = clients.count()
    if there < minimum:
        raise ValueError(f"{there} clients available, {minimum} needed")
    size = min(there, max(minimum, int(fraction * there)))
    if size == there:
        return clients
    return clients.orderBy(F.xxhash64("client_id", F.lit(seed), F.lit(round_no)), "client_id").limit(size)


def fedavg(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    client: str = "client_id",
    rounds: int = 3,
    epochs: int = 1,
    rate: float = 0.5,
    mu: float = 0.0,
    fraction: float = 1.0,
    min_clients: int = 2,
    seed: int = 42,
) -> tuple[list[float], DataFrame]:
    """Rounds of local updates and averaging; returns the weights and one history row per round."""
    clients = materialize(df.select(q(client).cast("int").alias("client_id")).distinct(), "clients")
    slim = df.select(q(client).cast("int").alias("client_id"), q(label), *[q(f) for f in features])
    slim = materialize(slim, "client-rows")
    weights = [0.0] * (len(features) + 1)
    history = []
    for r in range(rounds):
        chosen = small(choose_clients(clients, fraction, min_clients, seed, r))
        updates = local_update(slim.join(chosen, "client_id", "left_semi"), weights, features, label, "client_id", epochs, rate, mu)
        entry = [F.sum(F.col("n") * F.get("weights", F.lit(i))) / F.sum("n") for i in range(len(weights))]
        mean = updates.agg(
            F.count(F.lit(1)).alias("clients"),
            F.sum("n").alias("n"),
            (F.sum(F.col("n") * F.col("train_accuracy")) / F.sum("n")).alias("a"),
            (F.sum(F.col("n") * F.col("train_loss")) / F.sum("n")).alias("l"),
            F.array(*entry).alias("w"),
        ).first()
        weights = list(mean["w"])
        history.append((r + 1, mean["clients"], mean["n"], mean["a"], mean["l"], weights))
    schema = "round int, clients int, n bigint, train_accuracy double, train_loss double, weights array<double>"
    return weights, df.sparkSession.createDataFrame(history, schema)


def fedprox(df: DataFrame, features: Sequence[str], mu: float = 0.1, **options) -> tuple[list[float], DataFrame]:
    """Averaging with the proximal term in every local step; mu = 0 is plain averaging."""
    return fedavg(df, features, mu=mu, **options)


def score_with(df: DataFrame, weights: Sequence[float], features: Sequence[str], score: str = "score") -> DataFrame:
    """Probability and 0.5-cut prediction of the averaged logistic model, as column arithmetic."""
    p = _probability(features, [F.lit(float(w)) for w in weights])
    return df.withColumn(score, p).withColumn("prediction", (p >= 0.5).cast("int"))
