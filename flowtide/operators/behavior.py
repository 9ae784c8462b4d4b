"""Behavioural statistics: fitted on the training rows only, then joined to any table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtide.functions.columns import micros, q, regularity_score, variation
from flowtide.operators import scale
from flowtide.session import materialize

# Column names tried in this order, and the output names per family.
SRC_COLUMNS = ("SrcAddr", "src_ip")
DST_COLUMNS = ("DstAddr", "dst_ip")
PORT_COLUMNS = ("Dport", "dst_port")
PROTOCOL_COLUMNS = ("Proto", "protocol")
BYTES_COLUMNS = ("TotBytes", "bytes_total")
PACKET_COLUMNS = ("TotPkts", "total_packets")
IAT_COLUMNS = ("iat_mean", "iat_std", "iat_median", "iat_min", "iat_max", "iat_cv")
FLOW_COUNT_COLUMNS = ("flow_count_mean", "flow_count_std", "flow_count_max", "flow_count_total")


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate the table has."""
    return next((c for c in candidates if c in df.columns), None)


def resolve_group_columns(df: DataFrame) -> list[str]:
    """[source, destination], [source] alone, or nothing."""
    src, dst = resolve_column(df, SRC_COLUMNS), resolve_column(df, DST_COLUMNS)
    if src and dst:
        return [src, dst]
    return [src] if src else []


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.where(q(key).isNotNull())
    return df


def inter_arrival(
    df: DataFrame, keys: Sequence[str], ts: str, out: str = "iat", hot_rows: int = scale.HOT_GROUP_ROWS
) -> DataFrame:
    """Seconds since the previous flow of the group; NULL for the first and for rows without a key or time.

    Groups above `hot_rows` are cut at timestamps: the difference is taken inside every
    piece, and a piece's first row looks up the end of the piece before it.
    """
    keys = list(keys)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | q(key).isNull()
    names, content = [q(c) for c in df.columns], scale.row_key(df, None, 0)
    keyless = df.where(no_key).select(*names, F.lit(None).cast("double").alias(out))
    rows = with_keys(df, keys).withColumn("_us", micros(q(ts)))
    hot = scale.hot_groups(rows, keys, hot_rows)

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*[q(k) for k in keys]).orderBy("_us", "_key")
        keyed = part.withColumn("_key", content)
        return keyed.withColumn(out, (F.col("_us") - F.lag("_us").over(w)) / 1e6).drop("_key")

    if hot is None:
        return plain(rows).drop("_us").unionByName(keyless)
    hot_keys = scale.small(hot.select(*[q(k) for k in keys]))
    cold = plain(rows.join(hot_keys, keys, "left_anti"))
    timed = rows.join(hot_keys, keys, "left_semi")
    untimed = timed.where(F.col("_us").isNull()).withColumn(out, F.lit(None).cast("double"))
    timed = timed.where(F.col("_us").isNotNull())
    steps = _previous_times(scale.with_bucket(timed, "_us", scale.value_splits(timed, "_us")), keys)
    # Rows that share a timestamp follow each other at 0 s; one of them, the first in content
    # order, takes the step from the timestamp before. Exact copies are counted, not sorted.
    counted = (
        timed.withColumn("_key", content)
        .groupBy(*[q(c) for c in timed.columns], "_key")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    at = [*keys, "_us"]
    leaders = counted.groupBy(*[q(c) for c in at]).agg(F.min("_key").alias("_leader"))
    lookup = steps.select(*[q(c) for c in at], "_step").join(leaders, at)
    found = scale.left_join_stats(counted, lookup, at, scale.hot_groups(counted, at, hot_rows))
    leads = F.col("_key") == F.col("_leader")
    led = found.where(leads).select(*names, (F.col("_step") / 1e6).alias(out))
    zeros = found.select(*names, F.lit(0.0).alias(out), (F.col("_n") - leads.cast("bigint")).alias("_n"))
    rest = scale.repeat_rows(zeros, "_n")
    whole = cold.select(*names, q(out))
    for part in (led, rest, untimed.select(*names, q(out)), keyless):
        whole = whole.unionByName(part)
    return whole


def _previous_times(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (group, distinct timestamp): its row count and microseconds since the previous timestamp."""
    group = [q(k) for k in keys]
    times = pieces.groupBy(*group, "_bucket", "_us").agg(F.count(F.lit(1)).alias("_rows"))
    ends = times.groupBy(*group, "_bucket").agg(F.max("_us").alias("_last"))
    across = Window.partitionBy(*group).orderBy("_bucket")
    ends = ends.select(*group, "_bucket", F.lag("_last").over(across).alias("_before"))
    within = Window.partitionBy(*group, "_bucket").orderBy("_us")
    stepped = times.withColumn("_lag", F.lag("_us").over(within)).join(ends, [*keys, "_bucket"])
    step = F.col("_us") - F.coalesce(F.col("_lag"), F.col("_before"))
    return stepped.select(*group, "_us", "_rows", step.alias("_step"))


def fit_periodicity(
    df: DataFrame, keys: Sequence[str], ts: str, hot_rows: int = scale.HOT_GROUP_ROWS, rows: int | None = None
) -> DataFrame:
    """Per group: mean, std (n-1), exact median, min, max and variation of inter-arrival seconds."""
    keys = list(keys)
    group = [q(k) for k in keys]
    timed = with_keys(df, keys).select(*group, micros(q(ts)).alias("_us"))
    hot = scale.hot_groups(timed, keys, hot_rows, rows)
    if hot is None:
        stats = _plain_periodicity(timed, keys)
    else:
        hot_keys = scale.small(hot.select(*group))
        stats = _plain_periodicity(timed.join(hot_keys, keys, "left_anti"), keys).unionByName(
            _hot_periodicity(timed.join(hot_keys, keys, "left_semi").where(F.col("_us").isNotNull()), keys, hot_rows)
        )
    return stats.withColumn("iat_cv", variation(F.col("iat_std"), F.col("iat_mean")))


def _plain_periodicity(rows: DataFrame, keys: list[str]) -> DataFrame:
    group = [q(k) for k in keys]
    w = Window.partitionBy(*group).orderBy("_us")
    gaps = rows.select(*group, (F.col("_us") - F.lag("_us").over(w)).alias("gap"))
    # Whole microseconds keep the sums exact; seconds come last.
    return gaps.groupBy(*group).agg(
        (F.sum("gap") / F.count("gap") / 1e6).alias("iat_mean"),
        (F.stddev_samp("gap") / 1e6).alias("iat_std"),
        (F.median("gap") / 1e6).alias("iat_median"),
        (F.min("gap") / 1e6).alias("iat_min"),
        (F.max("gap") / 1e6).alias("iat_max"),
    )


def _hot_periodicity(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """The same statistics from distinct timestamps with counts; repeats count as 0-second gaps."""
    group = [q(k) for k in keys]
    steps = materialize(_previous_times(scale.with_bucket(rows, "_us", scale.value_splits(rows, "_us")), keys), "steps")
    ones, zeros = F.count("_step"), F.sum(F.col("_rows") - 1)
    merged = steps.groupBy(*group).agg(
        F.count("_step").alias("_n1"),
        F.sum(F.col("_rows") - 1).alias("_n0"),
        F.coalesce(F.sum("_step"), F.lit(0)).alias("_total"),
        F.coalesce(F.avg("_step"), F.lit(0.0)).alias("_m1"),
        F.coalesce(F.var_pop("_step"), F.lit(0.0)).alias("_v1"),
        F.min("_step").alias("_lo"),
        F.max("_step").alias("_hi"),
    )
    n = F.col("_n1") + F.col("_n0")
    # Positive steps and zeros combined without cancellation.
    m2 = F.col("_v1") * F.col("_n1") + F.try_divide(F.col("_m1") * F.col("_m1") * F.col("_n1") * F.col("_n0"), n)
    gaps = steps.select(*group, F.col("_step").alias("gap"), F.lit(1).cast("bigint").alias("w")).unionByName(
        steps.where(F.col("_rows") > 1).select(*group, F.lit(0).cast("bigint").alias("gap"), (F.col("_rows") - 1).alias("w"))
    )
    medians = scale.exact_quantiles(gaps, keys, "gap", [0.5], weight="w", hot_rows=hot_rows)
    return merged.join(medians.select(*group, F.col("quantile").alias("_median")), keys, "left").select(
        *group,
        (F.try_divide(F.col("_total"), n) / 1e6).alias("iat_mean"),
        F.when(n > 1, F.sqrt(m2 / (n - 1)) / 1e6).alias("iat_std"),
        (F.col("_median") / 1e6).alias("iat_median"),
        F.when(F.col("_n0") > 0, F.lit(0.0)).otherwise(F.col("_lo") / 1e6).alias("iat_min"),
        F.when(n > 0, F.coalesce(F.col("_hi"), F.lit(0)) / 1e6).alias("iat_max"),
    )


def fit_flow_counts(df: DataFrame, src: str, ts: str, width_seconds: int = 3600) -> DataFrame:
    """Per source: mean, std, max and total of flows per time bin, empty bins counted as 0.

    Only non-empty bins are stored; the zeros enter the mean and variance by formula.
    """
    if width_seconds <= 0 or 86_400 % width_seconds:
        raise ValueError("the bin width must divide a day, so that bins are clock-aligned")
    bin_no = F.floor(F.unix_seconds(q(ts).cast("timestamp")) / width_seconds)
    counts = (
        with_keys(df, [src, ts]).groupBy(q(src), bin_no.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    )
    per_src = counts.groupBy(q(src)).agg(
        F.count(F.lit(1)).alias("_k"),
        (F.max("_bin") - F.min("_bin") + 1).alias("_n"),
        F.avg("_c").alias("_mk"),
        F.var_pop("_c").alias("_vk"),
        F.max("_c").alias("flow_count_max"),
        F.sum("_c").alias("flow_count_total"),
    )
    k, n, mk = F.col("_k"), F.col("_n"), F.col("_mk")
    mean = F.col("flow_count_total") / n
    m2 = F.col("_vk") * k + k * (mk - mean) * (mk - mean) + (n - k) * mean * mean
    return per_src.select(
        q(src),
        mean.alias("flow_count_mean"),
        F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(0.0).alias("flow_count_std"),
        "flow_count_max",
        "flow_count_total",
    )


def fit_entropy(df: DataFrame, src: str, column: str, out: str) -> DataFrame:
    """Per source: Shannon entropy (nats) of a column; NULLs ignored, no values gives 0."""
    counts = with_keys(df, [src]).groupBy(q(src), q(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    c = F.when(F.col("_v").isNotNull(), F.col("_c"))
    entropy = F.ln(F.sum(c)) - F.sum(c * F.ln(c)) / F.sum(c)
    return counts.groupBy(q(src)).agg(F.greatest(F.coalesce(entropy, F.lit(0.0)), F.lit(0.0)).alias(out))


def fit_consistency(df: DataFrame, src: str, bytes_col: str | None = None, packets_col: str | None = None) -> DataFrame:
    """Per source: mean, std (n-1) and variation of bytes and of packets, in one aggregate."""
    aggs, names = [F.count(F.lit(1)).alias("_rows")], []
    for column, name in ((bytes_col, "bytes"), (packets_col, "pkts")):
        if column:
            aggs += [F.avg(q(column)).alias(f"{name}_mean"), F.stddev_samp(q(column)).alias(f"{name}_std")]
            names.append(name)
    stats = with_keys(df, [src]).groupBy(q(src)).agg(*aggs)
    columns = [q(src)]
    for name in names:
        std, mean = q(f"{name}_std"), q(f"{name}_mean")
        columns += [mean, std, variation(std, mean).alias(f"{name}_cv")]
    return stats.select(*columns)


@dataclass
class FittedBehavior:
    """What `fit_features` learnt: two written tables and the keys that are hot in training."""

    group_columns: list[str]
    pair_stats: DataFrame | None = None
    src_stats: DataFrame | None = None
    families: list[str] = field(default_factory=list)
    hot_pairs: DataFrame | None = None
    hot_sources: DataFrame | None = None


def fit_features(
    train: DataFrame,
    ts: str = "timestamp",
    group_columns: Sequence[str] | None = None,
    periodicity: bool = True,
    aggregation: bool = True,
    entropy: bool = True,
    consistency: bool = True,
    width_seconds: int = 3600,
    hot_rows: int = scale.HOT_GROUP_ROWS,
    path: str | None = None,
    written: bool = False,
) -> FittedBehavior:
    """Learns all enabled families from the training rows and writes them out.

    The source families share one table, so applying them costs one join. With `path`
    the tables are Parquet under it; otherwise they go to the shared scratch folder.
    The few columns needed are written once and read by all families, unless `train` is
    a `written` table already.
    """
    keys = resolve_group_columns(train) if group_columns is None else list(group_columns)
    if not keys:
        return FittedBehavior([])
    if not written:
        found = [resolve_column(train, names) for names in (PORT_COLUMNS, PROTOCOL_COLUMNS, BYTES_COLUMNS, PACKET_COLUMNS)]
        wanted = dict.fromkeys([*keys, *[c for c in (ts, *found) if c in train.columns]])
        train = materialize(train.select(*[q(c) for c in wanted]), "train-slice")
    src, timed, total = keys[0], ts in train.columns, train.count()
    fitted = FittedBehavior(keys)
    if periodicity and timed:
        fitted.pair_stats = _written(fit_periodicity(train, keys, ts, hot_rows, total), path, "pair_stats")
        fitted.hot_pairs = scale.hot_groups(train, keys, hot_rows, total)
        fitted.families.append("periodicity")
    parts = []
    if aggregation and timed:
        parts.append(fit_flow_counts(train, src, ts, width_seconds))
        fitted.families.append("flow_counts")
    port, proto = resolve_column(train, PORT_COLUMNS), resolve_column(train, PROTOCOL_COLUMNS)
    if entropy and port:
        parts.append(fit_entropy(train, src, port, "dst_port_entropy"))
        fitted.families.append("port_entropy")
    if entropy and proto:
        parts.append(fit_entropy(train, src, proto, "protocol_entropy"))
        fitted.families.append("protocol_entropy")
    size, packets = resolve_column(train, BYTES_COLUMNS), resolve_column(train, PACKET_COLUMNS)
    if consistency and (size or packets):
        parts.append(fit_consistency(train, src, size, packets))
        fitted.families += [n for n, c in (("bytes", size), ("pkts", packets)) if c]
    if parts:
        # Every side is already partitioned by source, so these joins need no further shuffle.
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.join(part, src, "full")
        fitted.src_stats = _written(merged, path, "src_stats")
        fitted.hot_sources = fitted.hot_pairs if keys == [src] else scale.hot_groups(train, [src], hot_rows, total)
    return fitted


def load_features(spark: SparkSession, path: str, group_columns: Sequence[str]) -> FittedBehavior:
    """What an earlier `fit_features(path=...)` wrote; hot keys are then left to the joins' own skew handling."""
    keys = list(group_columns)
    fitted = FittedBehavior(keys)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(root)} if fs.exists(root) else set()
    if "pair_stats" in there:
        fitted.pair_stats = spark.read.parquet(f"{path}/pair_stats")
        fitted.families.append("periodicity")
    if "src_stats" in there:
        fitted.src_stats = spark.read.parquet(f"{path}/src_stats")
        signs = {"flow_counts": "flow_count_mean", "port_entropy": "dst_port_entropy", "protocol_entropy": "protocol_entropy"}
        fitted.families += [f for f, c in signs.items() if c in fitted.src_stats.columns]
        fitted.families += [f for f in ("bytes", "pkts") if any(c.startswith(f"{f}_") for c in fitted.src_stats.columns)]
    return fitted


def _written(df: DataFrame, path: str | None, name: str) -> DataFrame:
    return materialize(df, name, f"{path}/{name}" if path else None)


def _zero_filled(df: DataFrame, columns: Sequence[str]) -> list:
    fill = set(columns)
    return [F.coalesce(q(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in fill else q(c) for c in df.columns]


def apply_pair_stats(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], hot: DataFrame | None = None, stats_rows: int | None = None
) -> DataFrame:
    """Adds the inter-arrival block; unseen groups get 0 and the score that follows from it."""
    stats = stats.select(*[q(k) for k in keys], *IAT_COLUMNS)
    joined = scale.left_join_stats(df, stats, keys, hot, stats_rows=stats_rows)
    filled = joined.select(*_zero_filled(joined, IAT_COLUMNS))
    return filled.withColumn("periodicity_score", regularity_score(F.col("iat_cv")))


def apply_src_stats(
    df: DataFrame, stats: DataFrame, src: str, hot: DataFrame | None = None, stats_rows: int | None = None
) -> DataFrame:
    """Adds every source family found in `stats`, in one join; unseen sources get 0."""
    new = [c for c in stats.columns if c != src]
    joined = scale.left_join_stats(df, stats, [src], hot, stats_rows=stats_rows)
    filled = joined.select(*_zero_filled(joined, new))
    out = []
    for c in filled.columns:
        out.append(q(c))
        if c in ("bytes_cv", "pkts_cv") and c in new:
            out.append(regularity_score(q(c)).alias(c.replace("_cv", "_consistency_score")))
    return filled.select(*out)


def transform_features(df: DataFrame, fitted: FittedBehavior | None) -> DataFrame:
    """Joins the fitted statistics to any table: one join per key (pair, source)."""
    if fitted is None:
        raise ValueError("fit the behavioural statistics on the training rows first")
    if not fitted.group_columns:
        return df
    if fitted.pair_stats is not None:
        pairs = fitted.pair_stats
        df = apply_pair_stats(df, pairs, fitted.group_columns, fitted.hot_pairs, pairs.count())
    if fitted.src_stats is not None:
        sources = fitted.src_stats
        df = apply_src_stats(df, sources, fitted.group_columns[0], fitted.hot_sources, sources.count())
    return df


def fitting_columns(df: DataFrame, ts: str) -> list[str]:
    """The columns `fit_features` reads."""
    found = [resolve_column(df, c) for c in (PORT_COLUMNS, PROTOCOL_COLUMNS, BYTES_COLUMNS, PACKET_COLUMNS)]
    return list(dict.fromkeys(c for c in [*resolve_group_columns(df), ts, *found] if c in df.columns))


def fit_transform(train: DataFrame, **options) -> DataFrame:
    return transform_features(train, fit_features(train, **options))
