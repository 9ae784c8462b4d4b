"""Classifiers and a reconstruction detector on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import q
from flowtide.operators import evaluate, explore, perceptron, rows, scale


def random_forest(train: DataFrame, label: str = "label", trees: int = 100, depth: int = 30, seed: int = 42) -> Model:
    """Forest with balanced class weights on a `features` vector; depth 30 is the largest there is."""
    weighted = explore.class_weights(train, label, "balanced")
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )
    return without_summary(forest.fit(weighted))


def without_summary(model: Model) -> Model:
    """The model alone: its training summary holds the session, which tasks cannot take once rows have been observed in it."""
    return model.copy()


def boosted_trees(
    train: DataFrame,
    label: str = "label",
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.3,
    subsample: float = 1.0,
    features_per_split: str = "all",
    validation: str | None = None,
    seed: int = 42,
) -> Model:
    """Boosted trees, positives weighted by neg/pos; `validation` names a 0/1 column for early stopping."""
    weighted = explore.class_weights(train, label, "ratio")
    booster = GBTClassifier(
        labelCol=label,
        featuresCol="features",
        weightCol="weight",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=subsample,
        featureSubsetStrategy=features_per_split,
        seed=seed,
    )
    if validation is not None:
        weighted = weighted.withColumn("_held_out", q(validation).cast("boolean"))
        booster = booster.setValidationIndicatorCol("_held_out")
    return booster.fit(weighted)


def balance_by_repeating(train: DataFrame, label: str, id_cols: Sequence[str] | None, seed: int) -> DataFrame:
    """Repeats the smaller class up to the larger one's size, for learners without row weights; no row is cut.

    Every row of the smaller class comes floor(larger / smaller) times; a hash of the row gives
    the remaining share one time more, so the sizes meet up to chance.
    """
    stats = explore.class_stats(train, label).first()
    small, large = sorted((stats["neg"], stats["pos"]))
    if not small or small == large:
        return train
    whole, left = divmod(large, small)
    share = F.conv(F.substring(scale.row_key(train, id_cols, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = F.lit(whole) + (share < left / small).cast("int")
    fewer = 1 if stats["pos"] == small else 0
    repeated = train.where(q(label) == fewer).withColumn("_times", times.cast("bigint"))
    return train.where(q(label) != fewer).unionByName(scale.repeat_rows(repeated, "_times"))


def mlp(
    train: DataFrame,
    features: int,
    label: str = "label",
    hidden: Sequence[int] = (128, 64, 32),
    iterations: int = 100,
    seed: int = 42,
) -> Model:
    """Feed-forward network with the given hidden layers and two outputs, trained on all rows at each step."""
    return perceptron.train(train, [features, *hidden, 2], label, iterations=iterations, seed=seed)


def predict(model: Model | None, df: DataFrame, score: str = "score") -> DataFrame:
    """Adds `prediction` (INT) and the positive-class probability."""
    if model is None:
        raise ValueError("the model must be trained before prediction")
    scored = model.transform(df)
    return scored.select(
        *[q(c) for c in df.columns],
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias(score),
    )


def feature_importances(model: Model, names: Sequence[str]) -> DataFrame:
    """(feature, importance) rows of a tree model."""
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray()
    pairs = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(pairs, "feature string, importance double")


def reconstruction_detector(train: DataFrame, encoding_dim: int = 32, label: str = "label") -> Model:
    """Linear autoencoder: `features` centred and scaled as on the normal rows, then those rows' principal components."""
    normal = train.where(q(label) == 0)
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_scaled")
    return Pipeline(stages=[scaled, PCA(k=encoding_dim, inputCol="_scaled", outputCol="encoded")]).fit(normal)


def reconstruction_error(model: Model | None, df: DataFrame, out: str = "error") -> DataFrame:
    """Mean squared difference between a scaled row and its projection on the components.

    The components are orthonormal, so the squared error is |x|^2 - |encoded|^2.
    """
    if model is None:
        raise ValueError("the detector must be trained before scoring")

    def square_sum(vector: str):
        return F.aggregate(vector_to_array(vector), F.lit(0.0), lambda a, x: a + x * x)

    left = (square_sum("_scaled") - square_sum("encoded")) / F.size(vector_to_array("_scaled"))
    coded = model.transform(df).withColumn(out, F.greatest(left, F.lit(0.0)))
    return coded.select(*[q(c) for c in df.columns], out)


def cross_validate(df: DataFrame, fit, k: int, label: str = "label", fold: str = "fold") -> DataFrame:
    """Per fold: trains on the others, evaluates on it; one row with sizes and metrics."""
    df = df.persist()
    results = []
    try:
        for i in range(k):
            train, held = df.where(q(fold) != i), df.where(q(fold) == i)
            row = evaluate.all_metrics(predict(fit(train), held), label).first()
            results.append(
                (
                    i + 1,
                    *[float(row[m]) for m in ("accuracy", "precision", "recall", "f1", "roc_auc")],
                    train.count(),
                    row["support_total"],
                    row["support_positive"],
                    row["support_negative"],
                )
            )
    finally:
        df.unpersist()
    return df.sparkSession.createDataFrame(
        results,
        "fold int, accuracy double, precision double, recall double, f1 double, roc_auc double, "
        "train_size bigint, val_size bigint, val_pos_count bigint, val_neg_count bigint",
    )


def train_centralized(
    df: DataFrame, features: Sequence[str], fit, label: str = "label", split: str = "split"
) -> tuple[Model, DataFrame]:
    """Pooled training on the train split; the metrics row of the test split."""
    table = rows.assemble(df, features)
    model = fit(table.where(q(split) == "train"))
    return model, evaluate.all_metrics(predict(model, table.where(q(split) == "test")), label)
