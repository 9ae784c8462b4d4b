"""Exact-size sampling, splitting, folds and client partitions.

All of them say how many rows of each stratum go where and leave the choice to a
seeded hash key, so results do not depend on partitioning and survive retries.
Pass `id_cols` when the table has a unique id; without one the row content is the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from flowtide.functions.columns import micros, q
from flowtide.operators import scale
from flowtide.session import materialize

ROLE_TRAIN, ROLE_TEST = "train", "test"
NO_TIME = (1 << 62)  # microseconds after any date


def shuffle(df: DataFrame, id_cols: Sequence[str] | None, seed: int, out: str = "shuffle_key") -> DataFrame:
    """A seeded random key to order by; rows of a DataFrame have no order of their own."""
    return df.withColumn(out, scale.row_key(df, id_cols, seed))


def sample_exact(df: DataFrame, n: int, id_cols: Sequence[str] | None, seed: int) -> DataFrame:
    """Uniform sample without replacement of exactly min(n, rows) rows; the table's size need not be known."""
    plan = df.sparkSession.createDataFrame([("sample", 0, int(n))], "part string, start bigint, stop bigint")
    return scale.assign_parts(df, plan, [], id_cols, seed, "_part").drop("_part")


def sample_and_count(df: DataFrame, n: int, id_cols: Sequence[str] | None, seed: int) -> tuple[DataFrame, int]:
    """`sample_exact` and the table's row count, observed in the pass that looks for the cut."""
    if df.isEmpty():  # an empty relation may be planned away, and the observation with it
        return df, 0
    watch = Observation()
    sample = sample_exact(df.observe(watch, F.count(F.lit(1)).alias("rows")), n, id_cols, seed)
    return sample, watch.get["rows"]


def stratified_limits(n: int, total: int, positives: int, min_ratio: float) -> tuple[int, int]:
    """(positive, negative) sample sizes: natural share or `min_ratio`, whichever is more, as far as rows reach."""
    ratio = max(positives / total, min_ratio)
    from_positive = min(int(n * ratio), positives)
    return from_positive, min(n - from_positive, total - positives)


def stratified_sample(
    df: DataFrame, n: int, min_ratio: float, condition: Column, id_cols: Sequence[str] | None, seed: int
) -> DataFrame:
    """Sample of at most n rows that holds at least `min_ratio` positives when there are enough."""
    flag = F.coalesce(condition, F.lit(False))
    row = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("pos")).first()
    if row["total"] <= n:
        return df
    pos, neg = stratified_limits(n, row["total"], row["pos"], min_ratio)
    plan = df.sparkSession.createDataFrame(
        [(1, "sample", 0, pos), (0, "sample", 0, neg)], "_flag int, part string, start bigint, stop bigint"
    )
    flagged = df.withColumn("_flag", flag.cast("int"))
    ids = id_cols or None
    return scale.assign_parts(flagged, plan, ["_flag"], ids, seed, "_part").drop("_part", "_flag")


def allocate(counts: DataFrame, total: Column, draws: Column, groups: Sequence[str], order: str, out: str) -> DataFrame:
    """Shares `draws` among the classes of a group: proportional, largest remainder first, then class order."""
    w = Window.partitionBy(*([q(g) for g in groups] or [F.lit(0)]))
    exact = F.col("n") * draws / total
    df = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    df = df.withColumn("_left", draws - F.sum("_floor").over(w))
    df = df.withColumn("_place", F.row_number().over(w.orderBy(F.desc("_rest"), q(order).asc())))
    share = F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("bigint")
    return df.withColumn(out, share.cast("bigint")).drop("_floor", "_rest", "_left", "_place")


def _class_counts(df: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    w = Window.partitionBy(*([q(g) for g in groups] or [F.lit(0)]))
    counts = df.groupBy(*[q(g) for g in groups], q(label)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(w))


def _ranges(df: DataFrame, keep: Sequence[str], sizes: Sequence[tuple[str, Column]]) -> DataFrame:
    """Consecutive rank ranges (part, start, stop) from part sizes."""
    stops, stop = [], F.lit(0).cast("bigint")
    for name, size in sizes:
        start, stop = stop, stop + size.cast("bigint")
        stops.append(F.struct(F.lit(name).alias("part"), start.alias("start"), stop.alias("stop")))
    return df.select(*[q(k) for k in keep], F.explode(F.array(*stops)).alias("_r")).select(*[q(k) for k in keep], "_r.*")


def split_sizes(df: DataFrame, test_size: float, val_size: float, label: str) -> DataFrame:
    """Per class: n, and how many rows go to test, val and train.

    n_test = ceil(test * N) and n_val = ceil(val / (1 - test) * (N - n_test)) overall; the kept
    side of each cut is shared among the classes proportionally.
    """
    counts = _class_counts(df, [], label)
    n_test = F.ceil(F.lit(test_size) * F.col("total"))
    counts = allocate(counts, F.col("total"), F.col("total") - n_test, [], label, "kept")
    rest = counts.select(
        q(label), F.col("n").alias("all_rows"), (F.col("n") - F.col("kept")).alias("test_rows"), F.col("kept").alias("n")
    )
    rest = rest.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    n_val = F.ceil(F.lit(val_size / (1 - test_size)) * F.col("total"))
    rest = allocate(rest, F.col("total"), F.col("total") - n_val, [], label, "train_rows")
    return rest.select(
        q(label),
        F.col("all_rows").alias("n"),
        "test_rows",
        (F.col("n") - F.col("train_rows")).alias("val_rows"),
        "train_rows",
    )


def stratified_split(
    df: DataFrame,
    label: str | None,
    id_cols: Sequence[str] | None,
    seed: int,
    test_size: float = 0.2,
    val_size: float = 0.1,
    out: str = "split",
) -> DataFrame:
    """Adds train / val / test; class shares are kept. Without the label column the split is plain random."""
    stratify = label is not None and label in df.columns
    rows = df if stratify else df.withColumn("_all", F.lit(0))
    column = label if stratify else "_all"
    sizes = split_sizes(rows, test_size, val_size, column)
    plan = _ranges(
        sizes, [column], [("test", F.col("test_rows")), ("val", F.col("val_rows")), ("train", F.col("train_rows"))]
    )
    return scale.assign_parts(rows, plan, [column], id_cols, seed, out).drop("_all")


def stratified_kfold(
    df: DataFrame, k: int, label: str, id_cols: Sequence[str] | None, seed: int, out: str = "fold"
) -> DataFrame:
    """Adds fold 0..k-1; fold i of a class holds as many rows as fall on i when the sorted classes are dealt in turn."""
    counts = _class_counts(df, [], label)
    w = Window.partitionBy(F.lit(0)).orderBy(q(label))
    counts = counts.withColumn("_offset", F.sum("n").over(w) - F.col("n"))

    def dealt(upto: Column, i: int) -> Column:
        """How many of the positions 0..upto-1 leave remainder i."""
        return F.floor((upto + (k - 1 - i)) / k)

    sizes = [(str(i), dealt(F.col("_offset") + F.col("n"), i) - dealt(F.col("_offset"), i)) for i in range(k)]
    placed = scale.assign_parts(df, _ranges(counts, [label], sizes), [label], id_cols, seed, "_fold")
    return placed.withColumn(out, F.col("_fold").cast("int")).drop("_fold")


def stratified_group_kfold(
    df: DataFrame, k: int, label: str, group: str, seed: int, out: str = "fold"
) -> DataFrame:
    """Adds a fold so that no group spans two; rows without a group form one group.

    A group belongs to the class of which it holds the largest share of the table. Class by
    class, rarest first, groups in order of that class's count, then size, then seeded hash
    are dealt to the folds in snake order (0..k-1, then back), each class beginning where the
    one before left off, so folds get groups of like size and mix.
    """
    name = F.coalesce(F.to_json(F.struct(q(group))), F.lit("{}"))
    rows = df.withColumn("_group", name)
    per_class = rows.groupBy("_group", F.to_json(F.struct(q(label))).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    per_class = materialize(per_class, "group-classes")
    totals = per_class.groupBy("_class").agg(F.sum("_n").alias("_total"))
    per_class = per_class.join(scale.small(totals), "_class").withColumn("_part", F.col("_n") / F.col("_total"))
    top = F.min(F.struct((-F.col("_part")).alias("_part"), "_total", "_class", F.col("_n").alias("_most"))).alias("_top")
    groups = per_class.groupBy("_group").agg(top, F.sum("_n").alias("_size"))
    groups = materialize(groups.select("_group", "_size", "_top._class", "_top._total", "_top._most"), "groups")
    # Rank in a class by (count, size): the distinct pairs are counted, groups of one pair are ranked by hash.
    at = ["_class", "_most", "_size"]
    steps = groups.groupBy(*at).agg(F.count(F.lit(1)).alias("_of"))
    falling = Window.partitionBy("_class").orderBy(F.desc("_most"), F.desc("_size"))
    steps = steps.select(*at, (F.sum("_of").over(falling) - F.col("_of")).alias("_before"))
    runs = groups.groupBy("_class", "_total").agg(F.count(F.lit(1)).alias("_of"))
    rarest = Window.partitionBy(F.lit(0)).orderBy("_total", "_class")
    runs = runs.select("_class", ((F.sum("_of").over(rarest) - F.col("_of")) % k).alias("_begin"))
    ranked = scale.distributed_rank(groups, at, ["_group"], seed, "_rank").join(steps, at).join(scale.small(runs), "_class")
    place = F.col("_before") + F.col("_rank")
    step = place % k
    turn = F.when(F.floor(place / k) % 2 == 0, step).otherwise(k - 1 - step)
    mapping = ranked.select("_group", ((turn + F.col("_begin")) % k).cast("int").alias(out))
    joined = scale.left_join_stats(rows, mapping, ["_group"], scale.hot_groups(rows, ["_group"]))
    return joined.select(*[q(c) for c in df.columns], q(out))


def time_series_bounds(
    rows: int, k: int, test_size: float | None = None, gap: int = 0, max_train: int | None = None
) -> list[tuple[int, int, int, int]]:
    """Rank bounds (train start, train stop, test start, test stop) of k expanding windows."""
    if test_size is not None and test_size < 1:
        test_size = max(1, int(rows * test_size))
    test = int(test_size) if test_size is not None else rows // (k + 1)
    if test < 1 or rows - gap - test * k <= 0:
        raise ValueError(f"too few rows ({rows}) for {k} folds of {test} with gap {gap}")
    bounds = []
    for i in range(k):
        start = rows - (k - i) * test
        stop = start - gap
        first = stop - max_train if max_train is not None and max_train < stop else 0
        bounds.append((first, stop, start, start + test))
    return bounds


def time_key(df: DataFrame, ts: str, id_cols: Sequence[str]) -> DataFrame:
    """Total order for time cuts: microseconds, then a hash of the id for equal timestamps; rows without a time last."""
    return df.withColumn("_us", F.coalesce(micros(q(ts)), F.lit(NO_TIME))).withColumn("_tie", scale.row_key(df, id_cols, 0))


def _at_or_after(cut: tuple[int, str] | None) -> Column:
    """Whether a row's (time, tie key) is at or after the cut; None means past the last row."""
    if cut is None:
        return F.lit(False)
    us, key = cut
    return (F.col("_us") > us) | ((F.col("_us") == us) & (F.col("_tie") >= key))


def time_series_split(
    df: DataFrame,
    k: int,
    ts: str,
    id_cols: Sequence[str],
    test_size: float | None = None,
    gap: int = 0,
    max_train: int | None = None,
) -> DataFrame:
    """One row per (input row, fold, role): k expanding windows in time order.

    Only the rows at the window bounds are looked up; all others are placed by comparison.
    """
    timed = time_key(df, ts, id_cols)
    bounds = time_series_bounds(timed.count(), k, test_size, gap, max_train)
    cuts = scale.rows_at_ranks(timed, "_us", "_tie", [r for b in bounds for r in b])
    roles = []
    for fold, (a, b, c, d) in enumerate(bounds):
        for role, lo, hi in ((ROLE_TRAIN, a, b), (ROLE_TEST, c, d)):
            inside = _at_or_after(cuts.get(lo)) & ~_at_or_after(cuts.get(hi))
            roles.append(F.when(inside, F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role"))))
    placed = timed.withColumn("_r", F.explode(F.array_compact(F.array(*roles))))
    return placed.select(*[q(c) for c in df.columns], "_r.fold", "_r.role")


def first_n_by_time(df: DataFrame, n: int, ts: str, id_cols: Sequence[str]) -> DataFrame:
    """The n earliest rows, found as a cut instead of a global sort."""
    timed = time_key(df, ts, id_cols)
    cut = scale.rows_at_ranks(timed, "_us", "_tie", [n]).get(n)
    rows = timed if cut is None else timed.where(~_at_or_after(cut))
    return rows.select(*[q(c) for c in df.columns])


def partition_iid(df: DataFrame, k: int, id_cols: Sequence[str] | None, seed: int, out: str = "client_id") -> DataFrame:
    """Random order cut into k near-equal clients; the first rows % k clients hold one more."""
    base, extra = divmod(df.count(), k)
    stops = [(i + 1) * base + min(i + 1, extra) for i in range(k)]
    rows = [(str(i), (stops[i - 1] if i else 0), stops[i]) for i in range(k)]
    plan = df.sparkSession.createDataFrame(rows, "part string, start bigint, stop bigint")
    placed = scale.assign_parts(df, plan, [], id_cols, seed, "_client")
    return placed.withColumn(out, F.col("_client").cast("int")).drop("_client")


def dirichlet_proportions(k: int, alpha: float, classes: Sequence, seed: int) -> dict:
    """One Dirichlet draw of k client shares per class."""
    rng = np.random.default_rng(seed)
    return {c: [float(p) for p in rng.dirichlet([alpha] * k)] for c in classes}


def partition_dirichlet(
    df: DataFrame,
    k: int,
    label: str,
    id_cols: Sequence[str] | None,
    seed: int,
    alpha: float = 0.5,
    proportions: Mapping | None = None,
    out: str = "client_id",
) -> DataFrame:
    """Label-skewed clients: per class a Dirichlet share each, rounded down, the rest to client 0."""
    counts = {r[label]: r["count"] for r in df.groupBy(q(label)).count().collect()}
    shares = proportions or dirichlet_proportions(k, alpha, sorted(counts), seed)
    rows = []
    for value, n in counts.items():
        sizes = [int(p * n) for p in shares[value]]
        sizes[0] += n - sum(sizes)
        stop = 0
        for client, size in enumerate(sizes):
            start, stop = stop, stop + size
            rows.append((value, str(client), start, stop))
    schema = df.select(q(label)).schema.add("part", "string").add("start", "long").add("stop", "long")
    plan = df.sparkSession.createDataFrame(rows, schema)
    placed = scale.assign_parts(df, plan, [label], id_cols, seed, "_client")
    return placed.withColumn(out, F.col("_client").cast("int")).drop("_client")


def client_val_split(
    df: DataFrame,
    fraction: float,
    label: str,
    id_cols: Sequence[str] | None,
    seed: int,
    client: str = "client_id",
    out: str = "split",
) -> DataFrame:
    """Per client with more than one row: ceil(fraction * n) rows to val, class shares kept; else all train."""
    counts = _class_counts(df, [client], label)
    n_val = F.when(F.col("total") > 1, F.ceil(F.lit(fraction) * F.col("total"))).otherwise(0)
    counts = allocate(counts, F.col("total"), F.col("total") - n_val, [client], label, "train_rows")
    plan = _ranges(
        counts, [client, label], [("val", F.col("n") - F.col("train_rows")), ("train", F.col("train_rows"))]
    )
    return scale.assign_parts(df, plan, [client, label], id_cols, seed, out)


def quick_sample(df: DataFrame, n: int | None, id_cols: Sequence[str] | None, seed: int) -> DataFrame:
    """The row limit of quick training and cross-validation runs; None keeps every row."""
    return df if n is None else sample_exact(df, n, id_cols, seed)


def sort_by_time(df: DataFrame, ts: str, id_cols: Sequence[str]) -> DataFrame:
    """Ascending time order, equal timestamps by id; a range-partitioned sort."""
    return df.orderBy(q(ts), *[q(c) for c in id_cols])


def union_classes(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both classes' samples in one table, matched by column name."""
    return positives.unionByName(negatives)
