"""The perceptron's trainer against pyspark.ml's own and against differences."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from flowtide.operators import models, perceptron, rows

SIZES = [2, 4, 3, 2]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(700).selectExpr("CAST((id % 7 > 2) != (id % 5 > 1) AS INT) AS label", "id % 7 / 3.0D - 1 AS a", "id % 5 / 2.0D - 1 AS b").repartition(3)
    return rows.assemble(df, ["a", "b"]).localCheckpoint()


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 2)), rng.integers(0, 2, 9)
    w = rng.normal(size=sum(n * m + m for n, m in zip(SIZES, SIZES[1:])))
    found = perceptron.loss_and_gradient(w, SIZES, x, y, float)[1]
    assert np.allclose(perceptron.loss_and_gradient(w, SIZES, x, y)[1], found, atol=1e-5)
    for i in range(len(w)):
        step = np.eye(len(w))[i] * 1e-5
        want = (perceptron.loss_and_gradient(w + step, SIZES, x, y, float)[0] - perceptron.loss_and_gradient(w - step, SIZES, x, y, float)[0]) / 2e-5
        assert abs(found[i] - want) < 1e-6


def test_every_row_counts_and_scores_are_the_models(table, monkeypatch):
    """Blocks with rests, more tasks than are collected from: the same loss; and the loss is that of pyspark.ml's probabilities."""
    model = models.mlp(table, 2, hidden=(4, 3), iterations=5)
    blocks = perceptron.packed(table, "features", "label", 2)
    w = model.weights.toArray()
    loss, gradient = perceptron.mean_loss(blocks, w, SIZES)
    p = models.predict(model, table).select(F.avg(-F.log(F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))))).first()[0]
    assert loss == pytest.approx(p, abs=1e-6)
    monkeypatch.setattr(perceptron, "ADD_ABOVE", 4)
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 7)
    small = perceptron.packed(table.repartition(20), "features", "label", 2).repartition(6)
    assert small.rdd.getNumPartitions() > perceptron.ADD_ABOVE
    again = perceptron.mean_loss(small, w, SIZES)
    assert again[0] == pytest.approx(loss) and np.allclose(again[1], gradient, atol=1e-6)


def test_training_ends_as_low_as_pyspark_ml(table):
    old = MultilayerPerceptronClassifier(layers=SIZES, maxIter=60, seed=42).fit(table)
    new = models.mlp(table, 2, hidden=(4, 3), iterations=60)
    blocks = perceptron.packed(table, "features", "label", 2)
    start = MultilayerPerceptronClassifier(layers=SIZES, maxIter=0, seed=42).fit(table)
    first, there, here = (perceptron.mean_loss(blocks, m.weights.toArray(), SIZES)[0] for m in (start, old, new))
    assert here < first / 2 and here < there + 0.1


def test_rows_go_through_python_tasks_in_blocks(table, monkeypatch):
    """Each evaluation of the loss reads packed blocks; pyspark.ml's trainer, which took 28 us a row and core, gets one row only."""
    seen, real = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, df, *a: seen.append(df.count()) or real(self, df, *a))
    models.mlp(table, 2, hidden=(4, 3), iterations=2)
    assert seen == [1, 1]
