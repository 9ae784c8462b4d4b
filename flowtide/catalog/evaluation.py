"""Metrics on scored rows: lineitem with returned = positive and the discount as score."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.catalog.registry import final, query, table
from flowtide.functions.columns import q
from flowtide.operators import evaluate

_SCORED_COLUMNS = {
    "fold": "CAST(l_linenumber AS INT)",
    "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "score": "l_discount * 5 + l_tax",
    "prediction": "CASE WHEN l_discount * 5 + l_tax >= 0.3 THEN 1 ELSE 0 END",
    "error": "l_extendedprice / 1000",
    "split": "CASE WHEN l_linestatus = 'F' AND l_linenumber < 5 THEN 'val' ELSE 'train' END",
}
SCORED = "scored AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SCORED_COLUMNS.items()) + " FROM lineitem)"


def scored(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _SCORED_COLUMNS.items()])


CELLS = """count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (label = 1) AS support_positive, count(*) FILTER (label = 0) AS support_negative, count(*) AS support_total"""
BASIC = """round((tp + tn) / support_total, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1"""
METRICS = f"""{BASIC}, round(tn / (tn + fp), 6) AS specificity, round(fp / (fp + tn), 6) AS false_positive_rate, round(fn / (fn + tp), 6) AS false_negative_rate,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(sqrt((tp / (tp + fn)) * (tn / (tn + fp))), 6) AS g_mean,
  round(support_negative / support_positive, 6) AS imbalance_ratio"""
LOSS = "-avg(label * ln(greatest(least(score, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)))"
CELL_NAMES = "tn, fp, fn, tp, support_positive, support_negative, support_total"


@query("i1_confusion", f"WITH {SCORED} SELECT {CELLS} FROM scored")
def _(spark, sf):
    return evaluate.confusion(scored(spark, sf))


@query("i1_confusion_by_fold", f"WITH {SCORED} SELECT CAST(fold AS BIGINT) AS fold, {CELLS} FROM scored GROUP BY 1")
def _(spark, sf):
    return final(evaluate.confusion(scored(spark, sf), by=["fold"]))


@query("i2_binary_metrics", f"WITH {SCORED}, c AS (SELECT {CELLS} FROM scored) SELECT {CELL_NAMES}, {METRICS} FROM c")
def _(spark, sf):
    return final(evaluate.binary_metrics(scored(spark, sf)))


def _curve_cte(by: str = "") -> str:
    part, sel = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""{SCORED}, g AS (SELECT {sel}score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY ALL),
    w AS (SELECT *, sum(pos) OVER ({part}ORDER BY threshold DESC) AS tp, sum(neg) OVER ({part}ORDER BY threshold DESC) AS fp,
      sum(pos) OVER ({'PARTITION BY ' + by if by else ''}) AS p, sum(neg) OVER ({'PARTITION BY ' + by if by else ''}) AS n FROM g)"""


@query(
    "i3_roc_curve",
    f"WITH {_curve_cte()} SELECT round(threshold, 9) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM w",
)
def _(spark, sf):
    return final(evaluate.roc_curve(scored(spark, sf)), threshold=9)


AUC_SQL = """round(coalesce(sum(neg * (2 * tp - pos) / 2 / (p::DOUBLE * n)), 0), 6) AS roc_auc,
  round(coalesce(sum(pos / p * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1 ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2), 0), 6) AS pr_auc"""


@query("i3_roc_auc", f"WITH {_curve_cte()} SELECT {AUC_SQL.split(',' + chr(10))[0]} FROM w")
def _(spark, sf):
    return final(evaluate.auc_scores(scored(spark, sf)).select("roc_auc"))


@query(
    "i4_pr_curve",
    f"WITH {_curve_cte()} SELECT round(threshold, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM w",
)
def _(spark, sf):
    return final(evaluate.pr_curve(scored(spark, sf)), threshold=9)


@query("i4_pr_auc", f"WITH {_curve_cte('fold')} SELECT CAST(fold AS BIGINT) AS fold, {AUC_SQL} FROM w GROUP BY fold")
def _(spark, sf):
    return final(evaluate.auc_scores(scored(spark, sf), by=["fold"]))


@query(
    "i5_confusion_normalized",
    f"""WITH {SCORED}, c AS (SELECT {CELLS} FROM scored) SELECT round(tn / support_negative, 6) AS tn_share, round(fp / support_negative, 6) AS fp_share,
    round(fn / support_positive, 6) AS fn_share, round(tp / support_positive, 6) AS tp_share FROM c""",
)
def _(spark, sf):
    return final(evaluate.confusion_normalized(scored(spark, sf)))


@query("i6_pr_baseline", f"WITH {SCORED} SELECT round(avg(label), 6) AS pr_baseline FROM scored")
def _(spark, sf):
    return final(evaluate.pr_baseline(scored(spark, sf)))


@query("i7_log_loss", f"WITH {SCORED} SELECT round({LOSS}, 6) AS log_loss FROM scored")
def _(spark, sf):
    return final(evaluate.log_loss(scored(spark, sf)))


CHOSEN = """chosen AS (SELECT s.* FROM {base} s JOIN (SELECT fold, max(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS has_val FROM {base} GROUP BY fold) h
  ON s.fold = h.fold WHERE CASE WHEN has_val = 1 THEN split = 'val' ELSE split = 'train' END)"""
BY_PART = f"""SELECT CAST(fold AS BIGINT) AS fold, tn, fp, fn, tp, support_positive, support_negative, num_examples, {METRICS}, round(log_loss, 6) AS log_loss
  FROM (SELECT fold, {CELLS}, support_total AS num_examples, {LOSS} AS log_loss FROM chosen GROUP BY fold)"""


@query("i8_evaluate_by", f"WITH {SCORED}, {CHOSEN.format(base='scored')} {BY_PART}")
def _(spark, sf):
    return final(evaluate.evaluate_by(scored(spark, sf), "fold", split="split"))


DETECTOR = """t AS (SELECT fold, quantile_cont(error, 0.9) AS thr FROM scored WHERE split = 'train' AND label = 0 GROUP BY fold),
  flagged AS (SELECT s.fold, s.label, s.split, CASE WHEN error > thr THEN 1 ELSE 0 END AS prediction, 1 / (1 + exp(-(error - thr) / thr * 5)) AS score
    FROM scored s JOIN t ON s.fold = t.fold)"""


@query("i8_evaluate_detector_by", f"WITH {SCORED}, {DETECTOR}, {CHOSEN.format(base='flagged')} {BY_PART}")
def _(spark, sf):
    return final(evaluate.evaluate_detector_by(scored(spark, sf), "fold", "error", 0.1))


@query(
    "j5_anomaly_score",
    f"""WITH {SCORED}, t AS (SELECT quantile_cont(error, 0.95) AS thr FROM scored WHERE label = 0)
    SELECT CAST(fold AS BIGINT) AS fold, CAST(CASE WHEN error > thr THEN 1 ELSE 0 END AS BIGINT) AS prediction,
    round(1 / (1 + exp(-(error - thr) / thr * 5)), 6) AS score FROM scored, t""",
)
def _(spark, sf):
    df = scored(spark, sf).select("fold", "label", "error")
    limit = evaluate.reconstruction_threshold(df.where(q("label") == 0), "error", 0.05).first()[0]
    return final(evaluate.anomaly_scores(df, "error", limit).select("fold", "prediction", "score"))


@query(
    "d35_reconstruction_threshold",
    f"WITH {SCORED} SELECT CAST(fold AS BIGINT) AS fold, round(quantile_cont(error, 0.99), 6) AS error_threshold FROM scored WHERE label = 0 GROUP BY fold",
)
def _(spark, sf):
    df = scored(spark, sf).where(q("label") == 0)
    return final(evaluate.reconstruction_threshold(df, "error", 0.01, ["fold"]))


def fold_table(spark, sf):
    """Per fold: the four headline metrics."""
    found = evaluate.binary_metrics(scored(spark, sf), by=["fold"])
    return found.select("fold", "accuracy", "precision", "recall", "f1")


FOLD_SQL = f"WITH {SCORED}, _c AS (SELECT fold, {CELLS} FROM scored GROUP BY fold), folds AS (SELECT CAST(fold AS BIGINT) AS fold, {BASIC} FROM _c)"
EXACT_FOLDS = f"""WITH {SCORED}, _c AS (SELECT fold, {CELLS} FROM scored GROUP BY fold),
  f AS (SELECT fold, support_total AS n, (tp + tn) / support_total AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM _c),
  long AS (SELECT fold, n, 'accuracy' AS metric, accuracy AS value FROM f UNION ALL SELECT fold, n, 'precision', precision FROM f
    UNION ALL SELECT fold, n, 'recall', recall FROM f)"""


@query(
    "d33_weighted_metric_average",
    f"{EXACT_FOLDS} SELECT metric, round(sum(n * value) / (SELECT sum(n) FROM f), 6) AS average FROM long WHERE NOT (metric = 'recall' AND value < 0.5) GROUP BY metric",
)
def _(spark, sf):
    found = evaluate.binary_metrics(scored(spark, sf), by=["fold"])
    long = evaluate.to_long(found.withColumn("num_examples", q("support_total")), ["fold", "num_examples"], ["accuracy", "precision", "recall"])
    kept = long.where(~((q("metric") == "recall") & (q("value") < 0.5)))
    return final(evaluate.weighted_metric_average(kept, "fold"))


@query(
    "d34_cv_summary",
    f"""{EXACT_FOLDS} SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci_high
    FROM long GROUP BY metric""",
)
def _(spark, sf):
    return final(evaluate.cv_summary(fold_table(spark, sf), ["accuracy", "precision", "recall"]))
