"""Row-level operators: missing values, filters, encodings, scaling, assembling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.columns import no_nan, q
from flowtide.operators import scale


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replaces columns in place and appends the others, in a single projection."""
    kept = [new[c].alias(c) if c in new else q(c) for c in df.columns]
    return df.select(*kept, *[expr.alias(c) for c, expr in new.items() if c not in df.columns])


def drop_invalid_time(df: DataFrame, ts: str) -> DataFrame:
    return df.where(q(ts).isNotNull())


def drop_invalid_time_counted(df: DataFrame, ts: str, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """What `write` makes of the rows with a time, and how many rows without one it did not get, counted in the same pass."""
    if df.isEmpty():  # an empty relation may be planned away, and the observation with it
        return write(df), 0
    watch = Observation()
    seen = df.observe(watch, F.count_if(q(ts).isNull()).alias("dropped"))
    written = write(drop_invalid_time(seen, ts))
    return written, watch.get["dropped"]


def count_invalid_time(df: DataFrame, ts: str) -> DataFrame:
    """How many rows `drop_invalid_time` removes, and how many stay."""
    return df.agg(
        F.count_if(q(ts).isNull()).alias("dropped_rows"),
        F.count_if(q(ts).isNotNull()).alias("rows_after_cleaning"),
    )


def fill_missing(df: DataFrame, strategy: str = "drop") -> DataFrame:
    """'drop' rows with a NULL or NaN, or fill numeric columns with zero or their exact median."""
    if strategy == "drop":
        return df.na.drop("any", subset=["`" + c.replace("`", "``") + "`" for c in df.columns])
    numbers = numeric_columns(df)
    if strategy == "fill_zero":
        return replace_columns(
            df, {c: F.coalesce(_present(df, c), F.lit(0).cast(df.schema[c].dataType)) for c in numbers}
        )
    if strategy != "fill_median":
        raise ValueError("strategy must be 'drop', 'fill_zero' or 'fill_median'")
    if not numbers:
        return df
    medians = {r["column"]: r["quantile"] for r in scale.column_quantiles(df, numbers, [0.5]).collect()}
    new = {}
    for c in numbers:
        if medians.get(c) is not None:
            new[c] = F.coalesce(_present(df, c).cast("double"), F.lit(medians[c]))
    return replace_columns(df, new)


def _present(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into NULL."""
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return no_nan(q(column)) if floating else q(column)


def apply_filters(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Per column include / exclude / min / max, all ANDed. An exclude rule keeps NULLs."""
    for column, rule in rules.items():
        if column not in df.columns:
            raise KeyError(f"filter column '{column}' is not in the table")
        if rule.get("include") is not None:
            df = df.where(q(column).isin(list(rule["include"])))
        if rule.get("exclude") is not None:
            df = df.where(~F.coalesce(q(column).isin(list(rule["exclude"])), F.lit(False)))
        if rule.get("min") is not None:
            df = df.where(q(column) >= rule["min"])
        if rule.get("max") is not None:
            df = df.where(q(column) <= rule["max"])
    return df


def top_values(df: DataFrame, column: str, k: int) -> list[Any]:
    """The k most frequent values, ties in value order. At most k values reach the driver."""
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).count()
    return [r["value"] for r in counts.orderBy(F.desc("count"), "value").limit(k).collect()]


def value_flags(column: str, prefix: str, values: Sequence[Any]) -> list[Column]:
    """One 0/1 column `{prefix}_{value}` per listed value; NULL matches none."""
    return [
        F.coalesce(q(column) == F.lit(v), F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in values
    ]


def one_hot_topk(df: DataFrame, column: str, k: int, prefix: str, vocabulary: Sequence[Any] | None = None) -> DataFrame:
    """One-hot of the top-k values; pass the vocabulary fitted on the training table to avoid leaks."""
    values = top_values(df, column, k) if vocabulary is None else vocabulary
    return df.select("*", *value_flags(column, prefix, values))


def topk_filter(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.where(q(column).isin(top_values(df, column, k)))


def column_quantile(df: DataFrame, column: str, prob: float) -> float | None:
    found = scale.exact_quantiles(df, [], column, [prob]).select("quantile").first()
    return None if found is None else found[0]


def below_quantile(df: DataFrame, column: str, prob: float) -> DataFrame:
    """Rows strictly under the exact quantile."""
    limit = column_quantile(df, column, prob)
    return df.where(F.lit(False) if limit is None else q(column) < F.lit(limit))


def clip_limit(df: DataFrame, column: str, prob: float, fall_back: bool = True) -> float:
    """The quantile; when it is missing or not positive, the maximum, then 1."""
    limit = column_quantile(df, column, prob)
    if not fall_back:
        return limit
    if limit is None or not 0 < limit < float("inf"):
        limit = df.agg(F.max(q(column)).cast("double")).first()[0]
    if limit is None or not 0 < limit < float("inf"):
        limit = 1.0
    return float(limit)


def clip_at_quantile(df: DataFrame, column: str, prob: float, fall_back: bool = True) -> DataFrame:
    limit = clip_limit(df, column, prob, fall_back)
    clipped = F.when(q(column).isNotNull(), F.least(q(column).cast("double"), F.lit(limit)))
    return replace_columns(df, {column: clipped})


def select_features(
    df: DataFrame, drops: Sequence[str], label: str, order: Sequence[str] | None = None
) -> list[str]:
    """Numeric and boolean columns minus drops and label, or the given order after a check."""
    if order is not None:
        absent = [c for c in order if c not in df.columns]
        if absent:
            raise KeyError(f"missing feature columns: {absent}")
        features = list(order)
    else:
        features = [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in drops and f.name != label
        ]
    if not features:
        raise ValueError("no numeric feature columns left after the drops")
    return features


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector beside the table; rows with a missing feature are an error, as for a dense matrix."""
    named = {f"_f{i}": q(c).cast("double") for i, c in enumerate(features)}
    wide = df.select("*", *[expr.alias(n) for n, expr in named.items()])
    return VectorAssembler(inputCols=list(named), outputCol=out, handleInvalid="error").transform(wide).drop(*named)


def group_codes(df: DataFrame, column: str, out: str = "group_code") -> DataFrame:
    """0-based position of the value among the sorted distinct values; NULL is -1."""
    codes = scale.sorted_codes(df, column, out)
    joined = scale.left_join_stats(df, codes, [column], scale.hot_groups(df, [column]))
    return replace_columns(joined, {out: F.coalesce(q(out), F.lit(-1)).cast("bigint")})


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of every column, in one aggregate row."""
    row = train.agg(
        *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std with the fitted values; a constant column keeps divisor 1."""
    return replace_columns(df, {c: (q(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in scaler.items()})


def add_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    return df.withColumn(column, F.lit(split))
