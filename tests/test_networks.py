"""Networks: gradients, row weights, averaging and a curved table that a linear detector cannot follow."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.operators import evaluate, models, networks, rows


def table(spark, x, **columns):
    data = [(i, [float(v) for v in r], *(c[i] for c in columns.values())) for i, r in enumerate(np.asarray(x))]
    kinds = {"client_id": "int", "label": "int", "w": "double", "held": "int"}
    return spark.createDataFrame(data, ", ".join(["id long", "features array<double>", *[f"{n} {kinds[n]}" for n in columns]])).repartition(4)


@pytest.mark.parametrize("kind", ["log", "square"])
def test_gradients_equal_differences(kind):
    rng = np.random.default_rng(1)
    layers = [networks.Layer(5, True, True, 0.4), networks.Layer(3, relu=True), networks.Layer(4, False, True, 0.2), networks.Layer(1 if kind == "log" else 3)]
    weights = [w + rng.normal(0, 0.1, w.shape) for w in networks.start_weights(3, layers, 2)]
    x, w, keys = rng.normal(size=(20, 3)), rng.random(20) + 0.5, rng.integers(-(2**62), 2**62, 20)
    y = rng.integers(0, 2, (20, 1)).astype(float) if kind == "log" else x

    def loss():
        return (w * networks.row_losses(networks.forward(layers, weights, x, keys, 3)[0], y, kind)).sum()

    _, grads = networks.gradients(layers, weights, x, y, w, kind, keys, 3)
    for m, g in zip(weights, grads):
        for at in np.ndindex(m.shape):
            m[at] += 1e-6
            up = loss()
            m[at] -= 2e-6
            down = loss()
            m[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_dropout_follows_rows_not_places():
    keys = np.arange(-500, 500)
    mask = networks.dropout_mask(keys, 4, 1, 30, 0.3)
    assert abs(mask.mean() - 0.7) < 0.02
    assert (networks.dropout_mask(keys[::-1], 4, 1, 30, 0.3) == mask[::-1]).all()
    assert (networks.dropout_mask(keys, 5, 1, 30, 0.3) != mask).any()


def test_a_weight_of_two_equals_a_row_twice(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 2)), [int(v) for v in rng.integers(0, 2, 60)]
    once = table(spark, x, label=y, w=[2.0 if i % 3 == 0 else 1.0 for i in range(60)])
    twice = once.unionByName(once.where("w = 2")).drop("w")
    options = dict(layers=networks.classifier_layers([4, 3], 0.25, True), epochs=3, rate=0.05, id_cols=["id"])
    a = networks.train_classifier(once, weight="w", **options)
    b = networks.train_classifier(twice, weight=None, **options)
    assert all(np.allclose(u, v, rtol=0, atol=1e-12) for u, v in zip(a.weights, b.weights))


def test_slices_validation_and_saving(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = [int(v) for v in (x[:, 0] * x[:, 1] > 0)]
    df = table(spark, x, label=y, held=[int(i % 4 == 0) for i in range(400)])
    model = networks.train_classifier(df, layers=networks.classifier_layers([12, 6]), validation="held", epochs=25, batches=3, rate=0.05, patience=4)
    assert len(model.history) <= 25 and all("val_loss" in h for h in model.history)
    scored = model.predict(df.where("held = 1"))
    assert evaluate.all_metrics(scored).first()["roc_auc"] > 0.9
    model.save(spark, f"{tmp_path}/net")
    again = networks.Network.load(spark, f"{tmp_path}/net")
    assert {(r.id, r.score) for r in again.predict(df).collect()} == {(r.id, r.score) for r in model.predict(df).collect()}


def plain_rounds(x, client, weights, rounds, epochs, rate, mu):
    """Averaging rounds of a network 2-3-2 under squared error, written out."""
    for _ in range(rounds):
        shared, parts = [w.copy() for w in weights], []
        for c in sorted(set(client)):
            a, b = (w.copy() for w in shared)
            mine = x[np.array(client) == c]
            ones = np.ones((len(mine), 1))
            for _ in range(epochs):
                z = np.hstack([mine, ones]) @ a.T
                h = np.hstack([np.maximum(z, 0), ones])
                e = (h @ b.T - mine) * 2 / mine.shape[1] / len(mine)
                gb, ga = e.T @ h, ((e @ b)[:, :-1] * (z > 0)).T @ np.hstack([mine, ones])
                a, b = a - rate * (ga + mu * (a - shared[0])), b - rate * (gb + mu * (b - shared[1]))
            parts.append((len(mine), a, b))
        n = sum(p[0] for p in parts)
        weights = [sum(p[0] * p[1] for p in parts) / n, sum(p[0] * p[2] for p in parts) / n]
    return weights


def test_two_averaging_rounds_equal_plain_numpy(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    client = [0 if i < 50 else 1 + i % 3 for i in range(90)]
    layers = [networks.Layer(3, relu=True), networks.Layer(2)]
    first = networks.start_weights(2, layers, 9)
    want = plain_rounds(x, client, first, 2, 2, 0.1, 0.05)
    for size in (networks.CLIENT_BYTES, 1):  # all clients at once, and one after the other
        monkeypatch.setattr(networks, "CLIENT_BYTES", size)
        got = networks.average_networks(table(spark, x, client_id=client), layers, "square", label=None, rounds=2, epochs=2, rate=0.1, optimiser="descent", mu=0.05, start=first)
        assert all(np.allclose(g, w, atol=1e-12) for g, w in zip(got.weights, want))
        assert [(h["clients"], h["n"]) for h in got.history] == [(4, 90)] * 2


def test_a_curved_table_needs_the_network(spark):
    rng = random.Random(7)
    t = [rng.uniform(-1, 1) for _ in range(500)]
    df = table(spark, [[v, v * v, v**3] for v in t], label=[0] * 500)
    layers = networks.autoencoder_layers(3, 2, [16], 0.0, False)
    network = networks.train_autoencoder(df, layers=layers, epochs=150, rate=0.02)
    mine = network.reconstruction_error(df).agg(F.avg("error")).first()[0]
    wide = rows.assemble(df.select("id", "label", *[F.col("features")[i].alias(f"x{i}") for i in range(3)]), ["x0", "x1", "x2"])
    scale = np.mean([np.var([v**p for v in t]) for p in (1, 2, 3)])
    linear = models.reconstruction_error(models.reconstruction_detector(wide, 1), wide).agg(F.avg("error")).first()[0] * scale
    assert mine < 0.5 * linear


def test_no_rows_keep_the_start(spark):
    df = table(spark, np.ones((4, 2)), label=[1] * 4).where("id < 0")
    first = networks.start_weights(2, [networks.Layer(1)])
    model = networks.train_classifier(df, layers=[networks.Layer(1)], weight=None, epochs=2, start=first)
    assert (model.weights[0] == first[0]).all()
