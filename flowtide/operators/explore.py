"""Exploratory aggregates: class mixes, summaries, volumes over time, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.columns import no_nan, q, short_label
from flowtide.operators import rows as row_ops
from flowtide.operators import scale


def _share(part: Column, total: int) -> Column:
    return part / F.lit(float(total)) * 100 if total else F.lit(None).cast("double")


def _with_share(counts: DataFrame, out: str, flows: str = "flows") -> DataFrame:
    """Share of all rows, for tables with a row per class: the total is the sum of the counts."""
    total = F.sum(q(flows)).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn(out, q(flows) / total.cast("double") * 100)


def class_stats(df: DataFrame, label: str, min_pos: int = 0) -> DataFrame:
    """One row: negatives, positives and their ratio; NULL ratio without positives unless `min_pos` is 1."""
    row = df.agg(F.count_if(q(label) == 0).alias("neg"), F.count_if(q(label) == 1).alias("pos"))
    return row.withColumn("ratio", F.try_divide(F.col("neg"), F.greatest(F.col("pos"), F.lit(min_pos))))


def class_weights(df: DataFrame, label: str, scheme: str = "balanced", out: str = "weight") -> DataFrame:
    """Row weights: 'balanced' = n / (classes * class rows); 'ratio' = 1 for negatives, neg/pos for positives."""
    counts = {r[label]: r["count"] for r in df.groupBy(q(label)).count().collect() if r[label] is not None}
    if scheme == "balanced":
        n = sum(counts.values())
        weights = {c: n / (len(counts) * m) for c, m in counts.items()}
    elif scheme == "ratio":
        weights = {0: 1.0, 1: counts.get(0, 0) / max(counts.get(1, 0), 1)}
    else:
        raise ValueError("scheme must be 'balanced' or 'ratio'")
    weight = F.lit(None).cast("double")
    for value, w in weights.items():
        weight = F.when(q(label) == F.lit(value), F.lit(float(w))).otherwise(weight)
    return df.withColumn(out, weight)


def class_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (part, class)."""
    return df.groupBy(*[q(b) for b in by], q(label)).agg(F.count(F.lit(1)).alias("n"))


def client_summary(df: DataFrame, client: str = "client_id", split: str = "split") -> DataFrame:
    """Training and validation rows per client."""
    return df.groupBy(q(client)).agg(
        F.count_if(q(split) == "train").alias("train_rows"), F.count_if(q(split) == "val").alias("val_rows")
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) for columns with at least one NULL or NaN; one pass over the table."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    gone = [F.count_if(q(c).isNull() | F.isnan(q(c)) if c in numeric else q(c).isNull()) for c in df.columns]
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), g.alias("missing")) for c, g in zip(df.columns, gone)]).alias("a"))
    return one.select(F.explode("a").alias("z")).select("z.*").where(F.col("missing") > 0)


def label_summary(
    df: DataFrame,
    label: str,
    means: Mapping[str, str],
    sums: Mapping[str, str] | None = None,
    medians: Mapping[str, str] | None = None,
    top: int | None = None,
) -> DataFrame:
    """Per label: flows, share of all rows, then means, exact medians and sums (name -> column)."""
    aggs = [F.count(F.lit(1)).alias("flows")]
    aggs += [F.avg(q(c)).alias(n) for n, c in means.items()]
    aggs += [F.sum(q(c)).alias(n) for n, c in (sums or {}).items()]
    found = _with_share(df.groupBy(q(label)).agg(*aggs), "flow_pct").where(q(label).isNotNull())
    for name, column in (medians or {}).items():
        middle = scale.exact_quantiles(df, [label], column, [0.5])
        found = found.join(middle.select(q(label), F.col("quantile").alias(name)), label, "left")
    return found if top is None else found.orderBy(F.desc("flows"), q(label)).limit(top)


def label_summary_ctu(df: DataFrame, label: str = "Label", top: int | None = None) -> DataFrame:
    return label_summary(
        df,
        label,
        means={
            "avg_duration_s": "Dur",
            "avg_total_packets": "TotPkts",
            "avg_total_bytes": "TotBytes",
            "avg_source_bytes": "SrcBytes",
        },
        sums={"total_bytes": "TotBytes"},
        medians={"median_duration_s": "Dur"},
        top=top,
    )


def label_summary_ugr(df: DataFrame, label: str = "label", top: int | None = 20) -> DataFrame:
    return label_summary(
        df,
        label,
        means={"avg_duration_s": "duration", "avg_total_packets": "packets_fwd", "avg_total_bytes": "bytes_total"},
        top=top,
    )


def flag_comparison(df: DataFrame, flag: str, means: Mapping[str, str]) -> DataFrame:
    """Flows and means per flag value."""
    return df.groupBy(q(flag)).agg(F.count(F.lit(1)).alias("flows"), *[F.avg(q(c)).alias(n) for n, c in means.items()])


def malicious_comparison(df: DataFrame, flag: str = "is_malicious") -> DataFrame:
    means = {
        "avg_duration": "duration",
        "avg_packets_fwd": "packets_fwd",
        "avg_packets_bwd": "packets_bwd",
        "avg_bytes": "bytes_total",
    }
    return flag_comparison(df, flag, means)


def botnet_means(df: DataFrame, flag: str = "is_botnet") -> DataFrame:
    means = {"avg_dur": "Dur", "avg_tot_pkts": "TotPkts", "avg_tot_bytes": "TotBytes", "avg_src_bytes": "SrcBytes"}
    return _with_share(flag_comparison(df, flag, means), "flow_pct")


def value_counts(df: DataFrame, column: str, top: int | None = None, keep_null: bool = False) -> DataFrame:
    """Counts per value, most frequent first, ties in value order."""
    rows = df if keep_null else df.where(q(column).isNotNull())
    counts = rows.groupBy(q(column).alias("value")).agg(F.count(F.lit(1)).alias("flows"))
    ordered = counts.orderBy(F.desc("flows"), F.asc("value"))
    return ordered if top is None else ordered.limit(top)


top_k = value_counts


def top_n_others(df: DataFrame, column: str, n: int = 10, keep_null: bool = False) -> DataFrame:
    """Top-n values plus an 'Others' row when anything is left, with shares of all rows."""
    counts = df.groupBy(q(column).alias("value")).agg(F.count(F.lit(1)).alias("flows"))
    sizes = counts.agg(F.sum("flows").alias("all"), F.sum(F.when(F.col("value").isNotNull(), F.col("flows"))).alias("known")).first()
    total, counted = sizes["all"] or 0, (sizes["all"] if keep_null else sizes["known"]) or 0
    listed = counts if keep_null else counts.where(F.col("value").isNotNull())
    top = listed.orderBy(F.desc("flows"), F.asc("value")).limit(n).select(F.col("value").cast("string").alias("value"), "flows")
    others = top.agg((F.lit(counted) - F.coalesce(F.sum("flows"), F.lit(0))).alias("flows"))
    others = others.select(F.lit("Others").alias("value"), "flows").where(F.col("flows") > 0)
    return top.unionByName(others).withColumn("pct", _share(F.col("flows"), total))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[Any] | None = None) -> DataFrame:
    """Counts of a by b. With `values` one column each, absent pairs as 0; without, all pairs that occur as rows (a, b, count)."""
    both = df.where(q(a).isNotNull() & q(b).isNotNull())
    if values is None:
        return both.groupBy(q(a), q(b)).agg(F.count(F.lit(1)).alias("count"))
    return both.groupBy(q(a)).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def crosstab_first(df: DataFrame, a: str, b: str, rows: int, values: Sequence[Any]) -> DataFrame:
    return crosstab(df, a, b, values).orderBy(q(a)).limit(rows)


def crosstab_top(df: DataFrame, a: str, b: str, k: int = 10, values: Sequence[Any] | None = None) -> DataFrame:
    """Crosstab over the k most frequent values of a."""
    return crosstab(row_ops.topk_filter(df, a, k), a, b, values)


def crosstab_col_pct(df: DataFrame, a: str, flag: str, k: int = 10) -> DataFrame:
    """Counts and column percentages of a by a 0/1 flag for the k largest rows; an empty column gives 0."""
    both = df.where(q(a).isNotNull() & q(flag).isNotNull())
    totals = both.agg(F.count_if(q(flag) == 0).alias("neg"), F.count_if(q(flag) == 1).alias("pos")).first()
    counts = both.groupBy(q(a)).agg(
        F.count_if(q(flag) == 0).alias("background"),
        F.count_if(q(flag) == 1).alias("botnet"),
        F.count(F.lit(1)).alias("total"),
    )
    pct = [
        (_share(F.col(c), totals[t]) if totals[t] else F.lit(0.0)).alias(f"{c}_pct")
        for c, t in (("background", "neg"), ("botnet", "pos"))
    ]
    return counts.orderBy(F.desc("total"), q(a)).limit(k).select("*", *pct)


def scenario_counts(df: DataFrame, scenario: str = "scenario") -> DataFrame:
    return _with_share(df.groupBy(q(scenario)).agg(F.count(F.lit(1)).alias("flows")), "pct")


def scenario_label_mix(df: DataFrame, scenario: str = "scenario", flag: str = "is_botnet") -> DataFrame:
    mix = df.groupBy(q(scenario)).agg(
        F.count_if(q(flag) == 0).alias("background_normal"),
        F.count_if(q(flag) == 1).alias("botnet"),
        F.count(F.lit(1)).alias("total"),
    )
    return mix.select(
        "*",
        (F.col("botnet") / F.col("total") * 100).alias("botnet_pct"),
        (F.col("background_normal") / F.col("total") * 100).alias("background_pct"),
    )


def top_shares(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent value combinations with their share of the rows, rounded to 2 digits.

    On malicious rows this gives the top hosts (one column) and service pairs (two).
    """
    counts = df.groupBy(*[q(c) for c in columns]).agg(F.count(F.lit(1)).alias("flows"))
    total = counts.agg(F.sum("flows").cast("double")).scalar()  # shares the counting shuffle
    known = counts
    for c in columns:
        known = known.where(q(c).isNotNull())
    top = known.orderBy(F.desc("flows"), *[q(c).asc() for c in columns]).limit(k)
    return top.withColumn("pct", F.round(F.col("flows") / total * 100, 2))


def time_bin(ts: Column, width_seconds: int = 3600) -> Column:
    """Start of the clock-aligned bin, in epoch seconds."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / width_seconds) * width_seconds


def _bin_time(column: Column) -> Column:
    return F.timestamp_seconds(column).cast("timestamp_ntz")


def _spine(width_seconds: int) -> Column:
    return F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(width_seconds).cast("bigint")))


def hourly_volume(df: DataFrame, ts: str, width_seconds: int = 3600) -> DataFrame:
    """Flows per bin from the first to the last, empty bins as 0."""
    bins = df.where(q(ts).isNotNull()).groupBy(time_bin(q(ts), width_seconds).alias("_bin"))
    return fill_bins(bins.agg(F.count(F.lit(1)).alias("flows")), width_seconds)


def fill_bins(counts: DataFrame, width_seconds: int = 3600) -> DataFrame:
    """(bin, flows) from counts of the non-empty bins (_bin, flows), the empty ones between first and last as 0."""
    bounds = counts.agg(F.min("_bin").alias("lo"), F.max("_bin").alias("hi"))
    spine = bounds.where(F.col("lo").isNotNull()).select(_spine(width_seconds).alias("_bin"))
    filled = spine.join(counts, "_bin", "left")
    return filled.select(_bin_time(F.col("_bin")).alias("bin"), F.coalesce("flows", F.lit(0)).alias("flows"))


def hourly_by_value(df: DataFrame, ts: str, column: str, values: Sequence[Any], width_seconds: int = 3600) -> DataFrame:
    """One gap-filled series per value, each over its own first to last bin."""
    chosen = df.where(q(ts).isNotNull() & q(column).isin(list(values)))
    binned = chosen.select(q(column), time_bin(q(ts), width_seconds).alias("_bin"))
    return fill_bins_by(binned.groupBy(q(column), "_bin").agg(F.count(F.lit(1)).alias("flows")), column, width_seconds)


def fill_bins_by(counts: DataFrame, column: str, width_seconds: int = 3600) -> DataFrame:
    """(column, bin, flows) from counts of the non-empty bins, each value's series filled between its own first and last bin."""
    bounds = counts.groupBy(q(column)).agg(F.min("_bin").alias("lo"), F.max("_bin").alias("hi"))
    spine = bounds.select(q(column), _spine(width_seconds).alias("_bin"))
    filled = spine.join(counts, [column, "_bin"], "left")
    return filled.select(q(column), _bin_time(F.col("_bin")).alias("bin"), F.coalesce("flows", F.lit(0)).alias("flows"))


def hourly_by_top_labels(df: DataFrame, ts: str, label: str, k: int = 5, width_seconds: int = 3600) -> DataFrame:
    return hourly_by_value(df, ts, label, row_ops.top_values(df, label, k), width_seconds)


def hourly_by_flag(df: DataFrame, ts: str, flag: str, width_seconds: int = 3600) -> DataFrame:
    """Flows per bin for flag 0 and 1 side by side, over the union of both spans."""
    return flag_columns(hourly_by_value(df, ts, flag, [0, 1], width_seconds), flag)


def flag_columns(long: DataFrame, flag: str) -> DataFrame:
    """The series of flag 0 and 1 side by side."""
    return long.groupBy("bin").agg(
        F.coalesce(F.sum(F.when(q(flag) == 0, F.col("flows"))), F.lit(0)).alias("benign"),
        F.coalesce(F.sum(F.when(q(flag) == 1, F.col("flows"))), F.lit(0)).alias("malicious"),
    )


def describe(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: count, mean, std (n-1), min, exact percentiles as p<percent>, max."""
    def summary(c: str) -> Column:
        value = no_nan(q(c).cast("double"))
        parts = {"count": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
        return F.struct(F.lit(c).alias("column"), *[v.alias(n) for n, v in parts.items()])

    stats = df.agg(F.array(*[summary(c) for c in columns]).alias("z")).select(F.explode("z").alias("z")).select("z.*")
    probs = sorted({*percentiles, 0.5})
    found = scale.column_quantiles(df, columns, probs)
    wide = found.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{p * 100:g}") for p in probs]
    )
    return stats.join(wide, "column", "left")


def dataset_overview(
    df: DataFrame, ts: str, distinct: Mapping[str, str], approximate: bool = False
) -> DataFrame:
    """One row: rows, first and last time, span in seconds, distinct values (name -> column)."""
    seconds = F.unix_seconds(q(ts).cast("timestamp"))

    def values(column: str) -> Column:
        """Each column is made distinct on its own; several in one aggregate would multiply the rows."""
        return df.select(q(column)).where(q(column).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(q(ts)).alias("first_time"),
        F.max(q(ts)).alias("last_time"),
        (F.max(seconds) - F.min(seconds)).alias("span_seconds"),
        *[(F.approx_count_distinct(q(c)) if approximate else values(c)).alias(n) for n, c in distinct.items()],
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present, as (a, b, corr)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(q(a).cast("double"), q(b).cast("double")).alias("corr"))
        for a, b in pairs
    ]
    half = df.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("z")).select("z.*")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "corr")))
    mirrored = sides.otherwise(F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr")))
    return half.select(F.explode(mirrored).alias("z")).select("z.*")


def histogram(
    df: DataFrame, column: str, bins: int, lo: float | None = None, hi: float | None = None, by: str | None = None
) -> DataFrame:
    """Equal-width bins from lo to hi (default: the column's range), last bin closed, empty bins as 0."""
    if lo is None or hi is None:
        row = df.agg(F.min(q(column)).cast("double"), F.max(q(column)).cast("double")).first()
        lo = row[0] if lo is None else lo
        hi = row[1] if hi is None else hi
        if lo is None or hi is None:
            return df.sparkSession.createDataFrame([], "bin bigint, bin_lo double, bin_hi double, flows bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    value = q(column).cast("double")
    place = F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("bigint")
    inside = df.where((value >= lo) & (value <= hi))
    groups = [q(by)] if by else []
    counts = inside.groupBy(*groups, place.alias("bin")).agg(F.count(F.lit(1)).alias("flows"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    if by:
        spine = df.where(q(by).isNotNull()).select(q(by)).distinct().select(
            q(by), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
        )
    filled = spine.join(counts, ([by] if by else []) + ["bin"], "left")
    return filled.select(
        *groups,
        "bin",
        (F.lit(lo) + F.col("bin") * step).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * step).alias("bin_hi"),
        F.coalesce("flows", F.lit(0)).alias("flows"),
    )


def class_histogram(
    df: DataFrame, column: str, flag: str, prob: float = 0.95, edges: int = 60, fall_back: bool = True
) -> DataFrame:
    """Counts per flag over [0, cap] after clipping at the quantile; 60 edges make 59 bins.

    Without the fall-back chain a cap that is not positive gives 50 bins over the range.
    """
    cap = row_ops.clip_limit(df, column, prob, fall_back)
    if cap is None:
        return histogram(df.where(F.lit(False)), column, edges - 1, 0.0, 1.0, flag)
    value = q(column).cast("double")
    clipped = df.where(value.isNotNull()).select(q(flag), F.least(value, F.lit(float(cap))).alias(column))
    if cap <= 0:
        return histogram(clipped, column, 50, by=flag)
    return histogram(clipped, column, edges - 1, 0.0, float(cap), flag)


def duration_by_label(df: DataFrame, label: str, duration: str, prob: float = 0.99, k: int = 8) -> DataFrame:
    """Mean and exact median duration of the k largest labels among the rows under the quantile."""
    under = row_ops.below_quantile(df, duration, prob)
    top = under.where(q(label).isNotNull()).groupBy(q(label)).agg(
        F.count(F.lit(1)).alias("flows"), F.avg(q(duration)).alias("mean_duration")
    )
    top = top.orderBy(F.desc("flows"), q(label)).limit(k)
    chosen = [r[0] for r in top.select(q(label)).collect()]
    middle = scale.exact_quantiles(under.where(q(label).isin(chosen)), [label], duration, [0.5])
    joined = top.join(middle.select(q(label), F.col("quantile").alias("median_duration")), label, "left")
    return joined.withColumn("short_label", short_label(q(label)))


def quantile(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Quantiles skipping NULLs: exact, or the built-in sketch when `approximate`."""
    if not approximate:
        return scale.exact_quantiles(df, list(by), column, probs)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    found = df.groupBy(*[q(b) for b in by]).agg(F.percentile_approx(q(column), [float(p) for p in probs], 10_000).alias("_q"))
    zipped = F.explode(F.arrays_zip(wanted.alias("prob"), F.col("_q").alias("quantile"))).alias("z")
    return found.select(*[q(b) for b in by], zipped).select(*[q(b) for b in by], "z.*")
