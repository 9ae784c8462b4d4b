"""Network training queries, checked weight by weight against gradient steps written in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowtide.catalog.models import CLIENT_FEATURES, CLIENT_ROWS, clients
from flowtide.catalog.registry import SEED, final, query
from flowtide.functions.columns import q
from flowtide.operators import networks, rows

RATE = 0.5
# Starting weights of a network with two inputs and two hidden units; the output layer's rows are repeated as needed.
HIDDEN = [[0.5, -0.4, 0.1], [-0.3, 0.6, 0.2]]
OUTPUT = [[0.4, -0.5, 0.05], [-0.2, 0.7, 0.1]]


def start(outputs: int) -> list[np.ndarray]:
    return [np.array(HIDDEN), np.array(OUTPUT[:outputs])]


def layers(outputs: int) -> list[networks.Layer]:
    return [networks.Layer(2, relu=True), networks.Layer(outputs)]


def _names(outputs: int) -> list[str]:
    return [f"{m}{i}{j}" for m, n in (("a", 2), ("c", outputs)) for i in range(n) for j in range(3)]


def _network_sql(kind: str, rounds: int, epochs: int, select: str, weight: str = "1.0", client: str = "0", where: str = "") -> str:
    """Full-gradient steps of every client from shared weights, then the mean by rows; one client makes it plain training."""
    outputs = 1 if kind == "log" else 2
    names = _names(outputs)
    first = ", ".join(f"{v}::DOUBLE AS {n}" for n, v in zip(names, [v for m in (HIDDEN, OUTPUT[:outputs]) for row in m for v in row]))
    ctes = [CLIENT_ROWS, f"r AS (SELECT {client} AS client, label, x1, x2, {weight}::DOUBLE AS w FROM d {where})", f"s0 AS (SELECT {first})"]
    kept = ", ".join(names)
    for r in range(rounds):
        ctes.append(f"u{r}_0 AS (SELECT client, {kept} FROM (SELECT DISTINCT client FROM r), s{r})")
        for e in range(epochs):
            t, before = f"{r}_{e}", f"u{r}_{e}"
            out = ", ".join(f"c{o}0 * h0 + c{o}1 * h1 + c{o}2 AS o{o}" for o in range(outputs))
            ctes.append(f"z{t} AS (SELECT r.*, {kept}, a00 * x1 + a01 * x2 + a02 AS z0, a10 * x1 + a11 * x2 + a12 AS z1 FROM r JOIN {before} USING (client))")
            ctes.append(f"o{t} AS (SELECT *, {out} FROM (SELECT *, greatest(z0, 0) AS h0, greatest(z1, 0) AS h1 FROM z{t}))")
            if kind == "log":
                error, loss = ["(1 / (1 + exp(-o0)) - label) * w"], "greatest(o0, 0) - o0 * label + ln(1 + exp(-abs(o0)))"
            else:
                error, loss = ["(o0 - x1) * w", "(o1 - x2) * w"], "((o0 - x1) * (o0 - x1) + (o1 - x2) * (o1 - x2)) / 2"
            ctes.append(f"e{t} AS (SELECT *, {', '.join(f'{x} AS e{o}' for o, x in enumerate(error))}, w * ({loss}) AS loss FROM o{t})")
            back = {f"c{o}{j}": f"e{o} * {x}" for o in range(outputs) for j, x in enumerate(("h0", "h1", "1"))}
            for i in range(2):
                through = " + ".join(f"e{o} * c{o}{i}" for o in range(outputs))
                back |= {f"a{i}{j}": f"CASE WHEN z{i} > 0 THEN ({through}) * {x} ELSE 0 END" for j, x in enumerate(("x1", "x2", "1"))}
            moved = ", ".join(f"any_value({n}) - {RATE}::DOUBLE * sum({back[n]}) / sum(w) AS {n}" for n in names)
            ctes.append(f"u{r}_{e + 1} AS (SELECT client, count(*) AS n, sum(w) AS weight, sum(loss) AS loss, {moved} FROM e{t} GROUP BY client)")
        ctes.append(f"s{r + 1} AS (SELECT " + ", ".join(f"sum(n * {n}) / sum(n) AS {n}" for n in names) + f" FROM u{r}_{epochs})")
    return f"WITH {', '.join(ctes)} {select}"


def _entries(last: str, outputs: int) -> str:
    """One row per weight: matrix, row, column, value."""
    return " UNION ALL ".join(f"SELECT '{n[0]}' AS matrix, {n[1]}::BIGINT AS row, {n[2]}::BIGINT AS col, round({n}, 6) AS weight FROM {last}" for n in _names(outputs))


def entries(spark, network: networks.Network):
    cells = [(m, i, j, float(v)) for m, w in zip("ac", network.weights) for i, row in enumerate(w) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "matrix string, row bigint, col bigint, weight double")


def client_rows(spark, sf):
    return rows.assemble(clients(spark, sf), CLIENT_FEATURES).withColumn("w", F.when(q("label") == 1, 3.0).otherwise(1.0))


@query("j3_weighted_network", _network_sql("log", 1, 4, _entries("s1", 1), weight="CASE WHEN label = 1 THEN 3 ELSE 1 END"))
def _(spark, sf):
    """Four steps of a classifier whose positives weigh three times as much."""
    df = client_rows(spark, sf)
    return final(entries(spark, networks.train_classifier(df, layers=layers(1), weight="w", epochs=4, rate=RATE, optimiser="descent", start=start(1))))


@query("j4_reconstruction_network", _network_sql("square", 1, 4, _entries("s1", 2), where="WHERE label = 0"))
def _(spark, sf):
    """Four steps of an autoencoder on the normal rows."""
    df = client_rows(spark, sf)
    return final(entries(spark, networks.train_autoencoder(df, layers=layers(2), epochs=4, rate=RATE, optimiser="descent", start=start(2))))


_ROUNDS = " UNION ALL ".join(
    f"SELECT {r + 1}::BIGINT AS round, count(*) AS clients, CAST(sum(n) AS BIGINT) AS n, round(sum(loss) / sum(weight), 6) AS train_loss FROM u{r}_2" for r in range(3)
)


@query("j7_fedavg_network", _network_sql("square", 3, 2, _ROUNDS, client="client_id", where="WHERE label = 0"))
def _(spark, sf):
    """Three rounds of two local epochs: the autoencoder averaged over clients."""
    df = client_rows(spark, sf)
    network = networks.average_networks(df, layers(2), "square", rounds=3, epochs=2, rate=RATE, optimiser="descent", start=start(2), seed=SEED)
    return final(spark.createDataFrame([(h["round"], h["clients"], h["n"], h["train_loss"]) for h in network.history], "round bigint, clients bigint, n bigint, train_loss double"))


@query("j7_fedavg_classifier", _network_sql("log", 2, 2, _entries("s2", 1), client="client_id"))
def _(spark, sf):
    """Two rounds of two local epochs of a network classifier; the averaged weights."""
    df = client_rows(spark, sf)
    return final(entries(spark, networks.average_networks(df, layers(1), "log", rounds=2, epochs=2, rate=RATE, optimiser="descent", start=start(1), seed=SEED)))
