"""Exact metrics for rare-event detectors, overall or per fold / client."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.columns import anomaly_flag, anomaly_probability, q
from flowtide.operators import scale
from flowtide.session import materialize

# Probability clip of the log loss, normal quantile of the 95 % interval.
CLIP = 1e-15
Z95 = 1.96


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and supports; all four cells also when one class is absent."""
    y, p = q(label), q(prediction)
    return df.groupBy(*[q(b) for b in by]).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if(y == 1).alias("support_positive"),
        F.count_if(y == 0).alias("support_negative"),
        F.count(F.lit(1)).alias("support_total"),
    )


def confusion_normalized(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Confusion cells divided by the number of rows of the true class."""
    cells = confusion(df, label, prediction, by)
    share = {"tn": "support_negative", "fp": "support_negative", "fn": "support_positive", "tp": "support_positive"}
    return cells.select(*[q(b) for b in by], *[F.try_divide(F.col(c), F.col(n)).alias(f"{c}_share") for c, n in share.items()])


def metrics_from_confusion(cells: DataFrame) -> DataFrame:
    """All threshold metrics as arithmetic on the cells; undefined ones are 0, the imbalance ratio NULL."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall = _zero(F.try_divide(tp, tp + fn))
    specificity = _zero(F.try_divide(tn, tn + fp))
    return cells.select(
        "*",
        _zero(F.try_divide(tp + tn, F.col("support_total"))).alias("accuracy"),
        _zero(F.try_divide(tp, tp + fp)).alias("precision"),
        recall.alias("recall"),
        _zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        specificity.alias("specificity"),
        _zero(F.try_divide(fp, fp + tn)).alias("false_positive_rate"),
        _zero(F.try_divide(fn, fn + tp)).alias("false_negative_rate"),
        _zero(
            F.try_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
        ).alias("mcc"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        F.sqrt(recall * specificity).alias("g_mean"),
        F.when(F.col("support_negative") == 0, F.lit(0.0))
        .otherwise(F.try_divide(F.col("support_negative"), F.col("support_positive")))
        .alias("imbalance_ratio"),
    )


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return metrics_from_confusion(confusion(df, label, prediction, by))


def _score_totals(df: DataFrame, label: str, score: str, by: Sequence[str], task_rows: int) -> DataFrame:
    """Per distinct score, highest first: own and running positives and negatives."""
    parts = [q(b) for b in by]
    counts = df.where(q(score).isNotNull()).groupBy(*parts, q(score).cast("double").alias("threshold")).agg(
        F.count_if(q(label) == 1).alias("pos"), F.count_if(q(label) == 0).alias("neg")
    )
    if scale.is_larger_than(df, task_rows):
        counts = materialize(counts, "scores")
    totals = counts.groupBy(*parts).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    run = scale.running_totals(counts, list(by), "threshold", ["pos", "neg"], descending=True, task_rows=task_rows)
    if by:
        return scale.left_join_stats(run, totals, list(by))
    row = totals.first()
    return run.withColumn("all_pos", F.lit(row["all_pos"])).withColumn("all_neg", F.lit(row["all_neg"]))


def roc_curve(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), task_rows: int = scale.HOT_GROUP_ROWS
) -> DataFrame:
    """One point per distinct score, ties shared; the (0, 0) start is implied."""
    t = _score_totals(df, label, score, by, task_rows)
    return t.select(
        *[q(b) for b in by],
        "threshold",
        F.try_divide(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )


def pr_curve(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), task_rows: int = scale.HOT_GROUP_ROWS
) -> DataFrame:
    """One point per distinct score; the (recall 0, precision 1) anchor is implied."""
    t = _score_totals(df, label, score, by, task_rows)
    return t.select(
        *[q(b) for b in by],
        "threshold",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )


def auc_scores(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), task_rows: int = scale.HOT_GROUP_ROWS
) -> DataFrame:
    """roc_auc and pr_auc by the trapezoid rule from one table of running totals; 0 without both classes.

    A positive or negative met at a score adds its own trapezoid, so both areas are plain sums.
    """
    t = _score_totals(df, label, score, by, task_rows)
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    before = tp - pos + fp - neg
    precision = tp / (tp + fp)
    precision_before = F.when(before == 0, F.lit(1.0)).otherwise(F.try_divide(tp - pos, before))
    areas = t.select(
        *[q(b) for b in by],
        F.try_divide(neg * (tp - pos / 2), F.col("all_pos").cast("double") * F.col("all_neg")).alias("roc"),
        F.when(F.col("all_neg") > 0, F.try_divide(pos, F.col("all_pos")) * (precision + precision_before) / 2).alias("pr"),
    )
    return areas.groupBy(*[q(b) for b in by]).agg(
        _zero(F.sum("roc")).alias("roc_auc"), _zero(F.sum("pr")).alias("pr_auc")
    )


def pr_baseline(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[q(b) for b in by]).agg(F.avg(q(label)).alias("pr_baseline"))


def log_loss(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    p = F.greatest(F.least(q(score), F.lit(1 - CLIP)), F.lit(CLIP))
    y = q(label)
    return df.groupBy(*[q(b) for b in by]).agg((-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def all_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", score: str | None = "score", by: Sequence[str] = ()
) -> DataFrame:
    """Threshold metrics plus, with a score, both areas and the log loss."""
    found = binary_metrics(df, label, prediction, by)
    if score is None:
        return found
    areas, loss = auc_scores(df, label, score, by), log_loss(df, label, score, by)
    if by:
        return found.join(areas, list(by), "left").join(loss, list(by), "left")
    a, l = areas.first(), loss.first()
    return found.select(
        "*", F.lit(a["roc_auc"]).alias("roc_auc"), F.lit(a["pr_auc"]).alias("pr_auc"), F.lit(l["log_loss"]).alias("log_loss")
    )


def validation_or_train(df: DataFrame, part: str, split: str = "split") -> DataFrame:
    """Validation rows of parts that have any, training rows of the others."""
    has_val = df.groupBy(q(part)).agg(F.max((q(split) == "val").cast("int")).alias("_has_val"))
    marked = scale.left_join_stats(df, has_val, [part])
    chosen = F.when(F.col("_has_val") == 1, q(split) == "val").otherwise(q(split) == "train")
    return marked.where(chosen).drop("_has_val")


def evaluate_by(
    df: DataFrame, part: str, label: str = "label", prediction: str = "prediction", score: str = "score", split: str | None = None
) -> DataFrame:
    """Per part (fold or client): metrics and log loss on its validation rows, or its training rows without any."""
    rows = df if split is None else validation_or_train(df, part, split)
    found = binary_metrics(rows, label, prediction, [part])
    return found.join(log_loss(rows, label, score, [part]), part).withColumnRenamed("support_total", "num_examples")


def evaluate_detector_by(
    df: DataFrame, part: str, error: str, contamination: float, label: str = "label", split: str = "split"
) -> DataFrame:
    """As `evaluate_by` for a reconstruction detector: every part first derives its own threshold."""
    normal = df.where((q(split) == "train") & (q(label) == 0))
    limits = reconstruction_threshold(normal, error, contamination, [part])
    scored = scale.left_join_stats(df, limits, [part])
    scored = scored.withColumn("prediction", anomaly_flag(q(error), F.col("error_threshold"))).withColumn(
        "score", anomaly_probability(q(error), F.col("error_threshold"))
    )
    return evaluate_by(scored, part, label, "prediction", "score", split)


def reconstruction_threshold(df: DataFrame, error: str, contamination: float, by: Sequence[str] = ()) -> DataFrame:
    """(1 - contamination) quantile of the error of normal rows, overall or per part."""
    found = scale.exact_quantiles(df, list(by), error, [1 - contamination])
    return found.select(*[q(b) for b in by], F.col("quantile").alias("error_threshold"))


def anomaly_scores(df: DataFrame, error: str, threshold: float) -> DataFrame:
    """Flag and sigmoid probability of every row against a fitted threshold."""
    limit = F.lit(float(threshold))
    return df.withColumn("prediction", anomaly_flag(q(error), limit)).withColumn(
        "score", anomaly_probability(q(error), limit)
    )


def weighted_metric_average(
    df: DataFrame, part: str = "client_id", n: str = "num_examples", metric: str = "metric", value: str = "value"
) -> DataFrame:
    """Per metric: sum(n * value) / sum(n over all parts); a part without the metric counts as 0."""
    total = df.select(q(part), q(n)).distinct().agg(F.sum(q(n))).first()[0] or 0
    found = df.groupBy(q(metric)).agg((F.sum(q(n) * q(value)) / F.lit(float(total or 1))).alias("average"))
    return found if total else found.where(F.lit(False))


def to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to (ids, metric, value) rows."""
    return df.unpivot([q(i) for i in ids], [q(m).cast("double").alias(m) for m in metrics], "metric", "value")


def cv_summary(folds: DataFrame, metrics: Sequence[str], k: int | None = None, fold: str = "fold") -> DataFrame:
    """Mean, std (n-1) and 95 % interval of every metric over the folds."""
    long = to_long(folds, [fold], metrics)
    found = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("_k")
    )
    half = Z95 * F.col("std") / F.sqrt(F.lit(float(k)) if k else F.col("_k"))
    return found.select("metric", "mean", "std", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))
