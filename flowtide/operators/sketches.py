"""Inter-arrival statistics that can be merged: moments and a KLL quantile sketch per group.

The exact median of `fit_periodicity` needs all gaps of a group at once. Here a
group's state has a bounded size: counts, sums, the first and last time, and a
sketch of its gaps whose rank error does not depend on their number. States of
later rows are merged into it, the gap between the two stretches included, so a
table grows by its new rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.columns import micros, q, variation
from flowtide.operators.behavior import with_keys

K = 200
RANK_ERROR = 0.0133  # of a sketch with K = 200, at 99 % confidence, as published for KLL sketches
STATE = ("first_us", "last_us", "gaps", "gap_mean", "gap_m2", "gap_min", "gap_max", "sketch")


def gap_states(df: DataFrame, keys: Sequence[str], ts: str, k: int = K) -> DataFrame:
    """Per group the mergeable state of its inter-arrival gaps: one shuffle by the keys."""
    group = [q(c) for c in keys]
    timed = with_keys(df, keys).select(*group, micros(q(ts)).alias("us")).where("us IS NOT NULL")
    gaps = timed.select("*", (F.col("us") - F.lag("us").over(Window.partitionBy(*group).orderBy("us"))).alias("gap"))
    n = F.count("gap")
    return gaps.groupBy(*group).agg(
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        n.alias("gaps"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"),
        F.coalesce(F.var_pop("gap") * n, F.lit(0.0)).alias("gap_m2"),
        F.min("gap").alias("gap_min"),
        F.max("gap").alias("gap_max"),
        F.kll_sketch_agg_bigint("gap", k).alias("sketch"),
    )


def merge_states(states: Sequence[DataFrame], keys: Sequence[str], k: int = K) -> DataFrame:
    """One state per group from states of stretches of time that follow each other (in any order of the tables).

    The time from one stretch's last row to the next one's first is a gap of its own. Stretches must not overlap
    within a group; a group that does raises an error when the result is read.
    """
    group = [q(c) for c in keys]
    parts = states[0]
    for more in states[1:]:
        parts = parts.unionByName(more)
    between = F.col("first_us") - F.lag("last_us").over(Window.partitionBy(*group).orderBy("first_us", "last_us"))
    parts = parts.withColumn("between", F.when(between >= 0, between).when(between < 0, F.raise_error(F.lit("stretches overlap"))))
    joint, together = F.count("between"), Window.partitionBy(*group)
    centre = F.try_divide(F.sum(F.col("gaps") * F.col("gap_mean")).over(together), F.sum("gaps").over(together))
    parts = parts.withColumn("centre", F.coalesce(centre, F.lit(0.0)))
    off = F.col("gap_mean") - F.col("centre")
    whole = parts.groupBy(*group).agg(
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sum("gaps").alias("n"),
        F.first("centre").alias("mean"),
        F.sum(F.col("gap_m2") + F.col("gaps") * off * off).alias("m2"),
        joint.alias("n_between"),
        F.coalesce(F.avg("between"), F.lit(0.0)).alias("mean_between"),
        F.coalesce(F.var_pop("between") * joint, F.lit(0.0)).alias("m2_between"),
        F.least(F.min("gap_min"), F.min("between")).alias("gap_min"),
        F.greatest(F.max("gap_max"), F.max("between")).alias("gap_max"),
        F.kll_merge_agg_bigint("sketch", k).alias("inner"),
        F.kll_sketch_agg_bigint("between", k).alias("outer"),
    )
    total = F.col("n") + F.col("n_between")
    step = F.col("mean_between") - F.col("mean")
    return whole.select(
        *group,
        "first_us",
        "last_us",
        total.alias("gaps"),
        F.coalesce(F.col("mean") + F.try_divide(step * F.col("n_between"), total), F.lit(0.0)).alias("gap_mean"),
        (F.col("m2") + F.col("m2_between") + F.coalesce(F.try_divide(step * step * F.col("n") * F.col("n_between"), total), F.lit(0.0))).alias("gap_m2"),
        "gap_min",
        "gap_max",
        F.kll_sketch_merge_bigint("inner", "outer").alias("sketch"),
    )


def periodicity_of(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of `fit_periodicity` from states; the median is the sketch's."""
    n = F.col("gaps")
    some = n > 0
    median = F.when(some, F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)))
    out = states.select(
        *[q(k) for k in keys],
        F.when(some, F.col("gap_mean") / 1e6).alias("iat_mean"),
        F.when(n > 1, F.sqrt(F.try_divide(F.col("gap_m2"), n - 1)) / 1e6).alias("iat_std"),
        (median / 1e6).alias("iat_median"),
        (F.col("gap_min") / 1e6).alias("iat_min"),
        (F.col("gap_max") / 1e6).alias("iat_max"),
    )
    return out.withColumn("iat_cv", variation(F.col("iat_std"), F.col("iat_mean")))


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], k: int = K) -> DataFrame:
    """(keys, prob, quantile) per group from one sketch each: approximate, but a group of any size takes bounded memory."""
    group = [q(c) for c in keys]
    number = q(value).cast("double")
    sketched = with_keys(df, keys).where(number.isNotNull() & ~F.isnan(number)).groupBy(*group).agg(F.kll_sketch_agg_double(number, k).alias("_s"))
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias("quantile")) for p in probs]))
    return sketched.select(*group, each.alias("_z")).select(*group, "_z.prob", "_z.quantile")
