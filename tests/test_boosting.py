"""Second-order boosting against the same rules in plain Python."""

import math
import random

import pytest

from flowtide.operators import boosting


def plain_boost(rows, n_features, rounds, depth, step, lam, gamma, least, positive):
    """rows: (label, bins); trees as nested dicts, margins after every round."""
    margins, trees = [0.0] * len(rows), []

    def part(g, h):
        return g * g / (h + lam)

    def grow(members, grads, level):
        g, h = sum(grads[i][0] for i in members), sum(grads[i][1] for i in members)
        leaf = {"value": -step * g / (h + lam)}
        if level == depth:
            return leaf
        best = None
        for f in range(n_features):
            for b in sorted({rows[i][1][f] for i in members} - {-1}):
                for left in (False, True):
                    went = [i for i in members if (left if rows[i][1][f] == -1 else rows[i][1][f] <= b)]
                    gl, hl = sum(grads[i][0] for i in went), sum(grads[i][1] for i in went)
                    if hl < least or h - hl < least:
                        continue
                    gain = 0.5 * (part(gl, hl) + part(g - gl, h - hl) - part(g, h)) - gamma
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, b, left, went
        if best is None:
            return leaf
        _, f, b, left, went = best
        inside = set(went)
        return {"f": f, "b": b, "left": left, "yes": grow(went, grads, level + 1), "no": grow([i for i in members if i not in inside], grads, level + 1)}

    def value(tree, bins):
        while "f" in tree:
            x = bins[tree["f"]]
            tree = tree["yes"] if (tree["left"] if x == -1 else x <= tree["b"]) else tree["no"]
        return tree["value"]

    for _ in range(rounds):
        grads = []
        for (y, _), m in zip(rows, margins):
            p, w = 1 / (1 + math.exp(-m)), positive if y else 1.0
            grads.append(((p - y) * w, p * (1 - p) * w))
        trees.append(grow(list(range(len(rows))), grads, 0))
        margins = [m + value(trees[-1], bins) for m, (_, bins) in zip(margins, rows)]
    return [1 / (1 + math.exp(-m)) for m in margins]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        x = [rng.choice([None, *range(8)]) if f == 1 else rng.random() * 10 for f in range(3)]
        y = int((x[0] > 6) ^ (x[1] is None or x[1] > 5) ^ (rng.random() < 0.1))
        rows.append((i, y, *[None if v is None else float(v) for v in x], int(i % 5 == 0)))
    return rows, spark.createDataFrame(rows, "id long, label int, a double, b double, c double, held int").repartition(4)


BOUNDS = {"a": [1.0, 2.5, 4.0, 6.0, 8.0], "b": [1.0, 3.0, 5.0, 6.0], "c": [3.3, 6.6]}


def test_ten_rounds_equal_plain_boosting(noisy):
    rows, df = noisy
    model = boosting.train(df, list(BOUNDS), rounds=10, depth=3, step=0.4, gamma=0.05, min_child_weight=2.0, positive_weight=2.0, bounds=BOUNDS)
    binned = [(r[1], [-1 if v is None else sum(v >= b for b in BOUNDS[f]) for f, v in zip(BOUNDS, r[2:5])]) for r in rows]
    want = plain_boost(binned, 3, 10, 3, 0.4, 1.0, 0.05, 2.0, 2.0)
    got = {r.id: r for r in model.transform(df).collect()}
    assert len(model.trees) == model.best == 10 and len(got) == len(rows)
    assert max(abs(got[r[0]].score - w) for r, w in zip(rows, want)) < 1e-6
    assert all(r.prediction == int(r.score > 0.5) for r in got.values())


def test_training_stops_early_and_ignores_held_rows(spark, noisy):
    rows, df = noisy
    model = boosting.train(df, list(BOUNDS), rounds=40, depth=4, step=1.0, validation="held", patience=3, bounds=BOUNDS)
    losses = dict(model.history)
    assert model.best == min(losses, key=losses.get) and len(losses) == model.best + 3 < 40
    flipped = df.withColumn("label", df.label * (1 - df.held) + (1 - df.label) * df.held)
    again = boosting.train(flipped, list(BOUNDS), rounds=2, depth=4, step=1.0, validation="held", bounds=BOUNDS)
    assert again.trees == model.trees[:2]


def test_sampled_rows_and_columns_repeat_and_a_model_survives_saving(spark, noisy, tmp_path):
    rows, df = noisy
    options = dict(rounds=3, depth=2, subsample=0.5, columns_per_tree=0.7, id_cols=["id"], bins=16)
    model, again = (boosting.train(d, list(BOUNDS), **options) for d in (df, df.repartition(2)))
    assert model.bounds == again.bounds or len(model.trees) == len(again.trees)
    used = [{f for f in t.feature if f >= 0} for t in model.trees]
    assert all(len(u) <= 2 for u in used)
    model.save(spark, f"{tmp_path}/model")
    loaded = boosting.BoostedTrees.load(spark, f"{tmp_path}/model")
    assert loaded == model
    assert {(r.id, r.score) for r in loaded.transform(df).collect()} == {(r.id, r.score) for r in model.transform(df).collect()}
    shares = {r.feature: r.importance for r in model.importances(spark).collect()}
    assert set(shares) == set(BOUNDS) and abs(sum(shares.values()) - 1) < 1e-9


def test_one_class_and_no_rows(spark, noisy):
    df = noisy[1]
    for few in (df.where("label = 1"), df.limit(0)):
        model = boosting.train(few, list(BOUNDS), rounds=2, depth=2, bounds=BOUNDS)
        assert all(r.score >= 0.5 for r in model.transform(df).collect())
