"""Building blocks that keep results exact when one group holds most of the rows.

* hot groups: the few keys with more rows than one task should hold,
* salted left join: spreads hot and NULL keys over many tasks,
* exact quantiles and prefix sums: a value range is cut into buckets, the buckets
  are counted, and only single buckets are ever sorted,
* key cuts: sampling and splitting as comparisons of a row's hash key with a few
  cut values, so the rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.columns import q
from flowtide.session import materialize, pin

HOT_GROUP_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
SALTS = 64
MIN_PIECES = 1_000
KEY_CELL_ROWS = 100_000
MIN_DIGITS = 4
COPY_BLOCK = 1_000_000


def is_larger_than(df: DataFrame, rows: int) -> bool:
    return df.count() > rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast only after counting it; larger sides are left to the optimizer."""
    return df if is_larger_than(df, rows) else F.broadcast(df)


def pinned(df: DataFrame) -> DataFrame:
    """`pin`, with the broadcast mark when the table turned out small."""
    table, few = pin(df)
    return F.broadcast(table) if few else table


def hot_groups(
    df: DataFrame, keys: Sequence[str], limit: int = HOT_GROUP_ROWS, rows: int | None = None
) -> DataFrame | None:
    """Keys with more than `limit` rows, or None. There are at most rows/limit of them.

    `rows` is the table's row count where the caller knows it: too short a table has no hot key.
    """
    if (df.count() if rows is None else rows) <= limit:
        return None
    sizes = df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("group_rows"))
    for key in keys:
        sizes = sizes.where(q(key).isNotNull())
    hot, _ = pin(sizes.where(F.col("group_rows") > limit))
    return None if hot.isEmpty() else hot


def left_join_stats(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    stats_rows: int | None = None,
) -> DataFrame:
    """Left equi-join of rows to one-row-per-key statistics.

    The statistics are written once and counted, unless the caller knows their row count
    (`stats_rows`, for tables already written or literal). A small side is broadcast. Otherwise rows of hot keys and rows with a
    NULL key get a salt, and the statistics of hot keys are repeated once per salt.
    """
    keys = list(keys)
    if stats_rows is None:
        stats = materialize(stats, "stats")
        stats_rows = stats.count()
    if stats_rows <= broadcast_rows:
        return df.join(F.broadcast(stats), keys, "left")
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | q(key).isNull()
    # copies of one row must not share a salt; the joined rows do not depend on it, so a retry may deal anew
    spread = F.floor(F.rand(seed=salts) * salts).cast("int")
    if hot is None:
        left = df.withColumn("_salt", F.when(no_key, spread).otherwise(0))
        right = stats.withColumn("_salt", F.lit(0))
    else:
        mark = small(hot.select(*[q(k) for k in keys], F.lit(True).alias("_hot")), broadcast_rows)
        is_hot = F.coalesce(F.col("_hot"), F.lit(False))
        left = df.join(mark, keys, "left").withColumn("_salt", F.when(is_hot | no_key, spread).otherwise(0))
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        right = stats.join(mark, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt", "_hot").select(
        *[q(c) for c in df.columns], *[q(c) for c in stats.columns if c not in keys]
    )


def value_splits(df: DataFrame, value: str, pieces: int | None = None) -> list[float]:
    """Bounds that cut a numeric column into pieces of similar row count.

    They need not be exact: every later step counts what really falls between them.
    """
    if pieces is None:
        pieces = max(MIN_PIECES, df.count() // HOT_GROUP_ROWS)
    probs = [i / pieces for i in range(1, pieces)]
    found = df.select(q(value).cast("double").alias("v")).approxQuantile("v", probs, 0.5 / pieces)
    inner = sorted({b for b in found if abs(b) != float("inf")}) or [0.0]
    return [float("-inf"), *inner, float("inf")]


def with_bucket(df: DataFrame, value: str, splits: list[float], out: str = "_bucket") -> DataFrame:
    """Order-preserving bucket number (a binary search in the JVM)."""
    bucketed = Bucketizer(splits=splits, inputCol="_as_double", outputCol=out, handleInvalid="keep").transform(
        df.withColumn("_as_double", q(value).cast("double"))
    )
    return bucketed.withColumn(out, F.col(out).cast("int")).drop("_as_double")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    weight: str | None = None,
    hot_rows: int = HOT_GROUP_ROWS,
    pieces: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row (keys, prob, quantile) per group and prob.

    Groups up to `hot_rows` rows use the built-in percentile. Larger ones are cut into
    value buckets; bucket counts say where each rank lies and only those buckets are read again.
    """
    keys = list(keys)
    rows = df.select(
        *[q(k) for k in keys],
        q(value).alias("_v"),
        (q(weight) if weight else F.lit(1)).cast("bigint").alias("_w"),
    ).where(F.col("_v").isNotNull())
    for key in keys:
        rows = rows.where(q(key).isNotNull())
    prob_list = F.array(*[F.lit(float(p)) for p in probs])

    def built_in(part: DataFrame) -> DataFrame:
        at = (F.col("_v"), prob_list, F.col("_w")) if weight else (F.col("_v"), prob_list)
        found = part.groupBy(*[q(k) for k in keys]).agg(F.percentile(*at).alias("_q"))
        return found.select(
            *[q(k) for k in keys],
            F.explode(F.arrays_zip(prob_list.alias("prob"), F.col("_q").alias("quantile"))).alias("_z"),
        ).select(*[q(k) for k in keys], "_z.prob", "_z.quantile")

    if not keys:
        if not is_larger_than(rows, hot_rows):
            return built_in(rows)
        return _bucket_quantiles(rows, keys, probs, pieces)
    hot = hot_groups(rows, keys, hot_rows)
    if hot is None:
        return built_in(rows)
    hot_keys = small(hot.select(*[q(k) for k in keys]))
    cold = built_in(rows.join(hot_keys, keys, "left_anti"))
    return cold.unionByName(_bucket_quantiles(rows.join(hot_keys, keys, "left_semi"), keys, probs, pieces))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Exact quantiles of several columns, NULL and NaN left out: (column, prob, quantile).

    A table one task can hold is summarised in one pass; of a larger one every column is
    read and cut into value buckets on its own.
    """
    values = df.select(*[F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")).alias(c) for c in columns])
    if is_larger_than(df, hot_rows):
        found = None
        for c in columns:
            one = exact_quantiles(values, [], c, probs, hot_rows=hot_rows).select(F.lit(c).alias("column"), "prob", "quantile")
            found = one if found is None else found.unionByName(one)
        return found
    prob_list = F.array(*[F.lit(float(p)) for p in probs])
    one = values.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.percentile(q(c), prob_list).alias("all")) for c in columns]).alias("z"))
    each = one.select(F.explode("z").alias("z")).where(F.col("z.all").isNotNull())
    pairs = F.explode(F.arrays_zip(prob_list.alias("prob"), F.col("z.all").alias("quantile")))
    return each.select("z.column", pairs.alias("p")).select("column", "p.prob", "p.quantile")


def _bucket_quantiles(rows: DataFrame, keys: list[str], probs: Sequence[float], pieces: int | None) -> DataFrame:
    group = [q(k) for k in keys]
    bucketed = with_bucket(rows, "_v", value_splits(rows, "_v", pieces))
    counts = bucketed.groupBy(*group, "_bucket").agg(F.sum("_w").alias("_n"))
    in_order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket")
    total = Window.partitionBy(*(group or [F.lit(0)]))
    placed = counts.select(
        *group,
        "_bucket",
        "_n",
        (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(total).alias("_total"),
    )
    wanted = (
        placed.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_rank", F.when(F.col("_side") == 0, F.floor("_pos")).otherwise(F.ceil("_pos")))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    )
    wanted = pinned(
        wanted.select(
            *group,
            "_bucket",
            "prob",
            "_side",
            (F.col("_rank") - F.col("_before")).alias("_offset"),
            "_pos",
        )
    )
    at = [*keys, "_bucket"]
    values = (
        bucketed.join(wanted.select(*[q(c) for c in at]), at, "left_semi")
        .groupBy(*[q(c) for c in at], "_v")
        .agg(F.sum("_w").alias("_n"))
    )
    inside = Window.partitionBy(*[q(c) for c in at]).orderBy("_v")
    values = values.withColumn("_stop", F.sum("_n").over(inside))
    hit = values.join(wanted, at).where(
        (F.col("_offset") < F.col("_stop")) & (F.col("_offset") >= F.col("_stop") - F.col("_n"))
    )
    ends = hit.groupBy(*group, "prob").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_hi"),
        F.max("_pos").alias("_pos"),
    )
    between = (F.ceil("_pos") - F.col("_pos")) * F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * F.col("_hi")
    return ends.select(*group, "prob", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("quantile"))


def running_totals(
    df: DataFrame,
    parts: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    task_rows: int = HOT_GROUP_ROWS,
    pieces: int | None = None,
) -> DataFrame:
    """Adds inclusive running totals `cum_<name>` over a numeric order column.

    `df` holds one row per (parts, order). Long runs are cut into buckets: totals per
    bucket first, then a short running sum inside every bucket.
    """
    parts = list(parts)
    group = [q(p) for p in parts] or [F.lit(0)]
    by = q(order).desc() if descending else q(order).asc()
    if not is_larger_than(df, task_rows):
        w = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(q(s)).over(w).alias(f"cum_{s}") for s in sums])
    bucketed = with_bucket(df, order, value_splits(df, order, pieces))
    step = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    w = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    per_bucket = bucketed.groupBy(*[q(p) for p in parts], "_bucket").agg(*[F.sum(q(s)).alias(s) for s in sums])
    offsets = per_bucket.select(
        *[q(p) for p in parts], "_bucket", *[(F.sum(q(s)).over(w) - q(s)).alias(f"_before_{s}") for s in sums]
    )
    inner = Window.partitionBy(*[q(p) for p in parts], "_bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.join(offsets, [*parts, "_bucket"])
        .select(
            *[q(c) for c in df.columns],
            *[(F.sum(q(s)).over(inner) + q(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        )
    )


def prefix_digits(rows: int) -> int:
    """Hex digits of the key that cut `rows` rows into cells one task can sort."""
    digits = 1
    while digits < 32 and rows > KEY_CELL_ROWS * 16**digits:
        digits += 1
    return digits


def row_key(df: DataFrame, id_cols: Sequence[str] | None, seed: int) -> Column:
    """Seeded 32-digit hash of a row: the same for any partitioning and on any retry.

    Without an id the whole content is hashed; exact copies then share one key.
    """
    if id_cols:
        return F.md5(F.concat_ws(":", *[q(c).cast("string") for c in id_cols], F.lit(str(seed))))
    return F.md5(F.concat_ws(":", F.to_json(F.struct(*[q(c) for c in df.columns])), F.lit(str(seed))))


def repeat_rows(df: DataFrame, times: str, block: int = COPY_BLOCK) -> DataFrame:
    """Every row `times` times; long runs are made block by block on different tasks."""
    columns = [q(c) for c in df.columns if c != times]
    blocks = df.where(q(times) > 0).withColumn(
        "_start", F.explode(F.sequence(F.lit(0).cast("bigint"), q(times) - 1, F.lit(block).cast("bigint")))
    )
    return (
        blocks.repartition(F.col("_start"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(block), q(times) - F.col("_start")))))
        .select(*columns)
    )


def assign_parts(
    df: DataFrame,
    plan: DataFrame,
    strata: Sequence[str],
    id_cols: Sequence[str] | None,
    seed: int,
    part: str = "part",
) -> DataFrame:
    """Puts every row in the part whose rank range [start, stop) holds its seeded rank.

    `plan` has the strata columns, `part`, `start` and `stop`; ranks count from 0 inside a
    stratum in key order. Ranges must not overlap; rows outside all ranges are left out.
    Rows are never shuffled: only key-prefix counts and the few prefixes that hold a cut.
    """
    strata = list(strata)
    stratum = F.to_json(F.struct(*[q(s) for s in strata])) if strata else F.lit("all")
    rows = df.withColumn("_key", row_key(df, id_cols, seed)).withColumn("_stratum", stratum)
    ranges = (
        plan.where(F.col("stop") > F.col("start"))
        .withColumn("_stratum", stratum)
        .select("_stratum", F.col("part").alias("_part"), F.col("start").alias("_from"), F.col("stop").alias("_to"))
    )
    ranges, few = pin(ranges)
    longest = ranges.agg(F.max("_to")).first()[0] or 0
    # ranks of a sample say little about the table's size: at least MIN_DIGITS digits keep cells small for any
    cuts = _key_cuts(rows, F.broadcast(ranges) if few else ranges, max(MIN_DIGITS, prefix_digits(longest)))
    lookup = cuts.groupBy("_stratum").agg(
        F.sort_array(F.collect_list(F.struct("_upper", "_to", "_part"))).alias("_cuts")
    )
    lookup, few = pin(lookup)
    plain, extra = rows, None
    if not id_cols:
        tied = cuts.where(F.col("_copies") > 1)
        tied_keys = pinned(tied.select("_stratum", F.col("_upper").alias("_key")).distinct())
        if not tied_keys.isEmpty():
            plain = rows.join(tied_keys, ["_stratum", "_key"], "left_anti")
            extra = _share_copies(rows, ranges, cuts, tied_keys, df.columns)
    first = F.try_element_at(F.filter("_cuts", lambda c: F.col("_key") <= c["_upper"]), F.lit(1))
    placed = left_join_stats(plain, lookup, ["_stratum"], stats_rows=0 if few else None)
    placed = placed.withColumn("_place", first["_part"]).where(F.col("_place").isNotNull())
    placed = placed.select(*[q(c) for c in df.columns], F.col("_place").alias(part))
    return placed if extra is None else placed.unionByName(extra.withColumnRenamed("_part", part))


def _key_cuts(rows: DataFrame, ranges: DataFrame, digits: int) -> DataFrame:
    """For every range the key of its last row, with that key's first rank and copy count."""
    slim = rows.select("_stratum", "_key", F.substring("_key", 1, digits).alias("_prefix"))
    in_order = Window.partitionBy("_stratum").orderBy("_prefix")
    cells = (
        slim.groupBy("_stratum", "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy("_stratum")))
    )
    # a range that reaches beyond the stratum ends with its last row
    last = F.least("_to", "_all") - 1
    wanted = pinned(
        cells.join(ranges, "_stratum")
        .where((F.col("_from") < F.col("_all")) & (last >= F.col("_before")) & (last < F.col("_before") + F.col("_n")))
        .drop("_n")
    )
    at = ["_stratum", "_prefix"]
    keys = (
        slim.join(wanted.select(*at), at, "left_semi")
        .groupBy(*at, "_key")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    inside = Window.partitionBy(*at).orderBy("_key")
    keys = keys.withColumn("_stop", F.sum("_copies").over(inside))
    first = F.col("_before") + F.col("_stop") - F.col("_copies")
    hit = keys.join(wanted, at).where((last >= first) & (last < F.col("_before") + F.col("_stop")))
    return pinned(
        hit.select("_stratum", "_part", "_from", "_to", F.col("_key").alias("_upper"), first.alias("_first"), "_copies")
    )


def _share_copies(
    rows: DataFrame, ranges: DataFrame, cuts: DataFrame, tied_keys: DataFrame, columns: list[str]
) -> DataFrame:
    """Copies that straddle a cut: counted once, then dealt out to the ranges they overlap."""
    at = ["_stratum", "_key"]
    counted = rows.join(tied_keys, at, "left_semi").select(*at, *[q(c) for c in columns]).distinct()
    spans = cuts.where(F.col("_copies") > 1).select("_stratum", F.col("_upper").alias("_key"), "_first", "_copies").distinct()
    dealt = (
        counted.join(small(spans), at)
        .join(ranges, "_stratum")
        .withColumn(
            "_times",
            F.least(F.col("_to"), F.col("_first") + F.col("_copies")) - F.greatest(F.col("_from"), F.col("_first")),
        )
        .where(F.col("_times") > 0)
        .select(*[q(c) for c in columns], "_part", "_times")
    )
    return repeat_rows(dealt, "_times")


def distributed_rank(df: DataFrame, strata: Sequence[str], id_cols: Sequence[str], seed: int, out: str = "rank") -> DataFrame:
    """0-based rank in seeded key order inside every stratum, sorted one key prefix at a time."""
    strata = list(strata)
    digits = prefix_digits(df.count())
    rows = df.withColumn("_key", row_key(df, id_cols, seed)).withColumn("_prefix", F.substring("_key", 1, digits))
    group = [q(s) for s in strata]
    in_order = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_prefix")
    offsets = (
        rows.groupBy(*group, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_prefix").orderBy("_key")
    ranked = rows.withColumn("_rn", F.row_number().over(inside) - 1).alias("r")
    offsets = offsets.alias("o")
    same = F.col("r._prefix") == F.col("o._prefix")
    for s in strata:
        same = same & F.col(f"r.`{s}`").eqNullSafe(F.col(f"o.`{s}`"))
    return ranked.join(offsets, same).select(
        *[F.col(f"r.`{c}`") for c in df.columns], (F.col("_rn") + F.col("_before")).cast("bigint").alias(out)
    )


def rows_at_ranks(
    df: DataFrame, value: str, key: str, ranks: Sequence[int], pieces: int | None = None
) -> dict[int, tuple[int, str]]:
    """(value, key) of the rows at the given 0-based ranks in (value, key) order.

    Three narrowing counts (value bucket, value, key prefix), each over fewer rows; only
    bucket counts and the asked-for rows reach the driver.
    """
    ranks = sorted(set(ranks))
    if not ranks:
        return {}
    spark = df.sparkSession
    bucketed = with_bucket(df.select(q(value).alias("_v"), q(key).alias("_k")), "_v", value_splits(df, value, pieces))
    before, spans = 0, {}
    for b, n in bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("_bucket").collect():
        for r in ranks:
            if before <= r < before + n:
                spans[r] = (b, r - before)
        before += n

    def narrow(rows: DataFrame, within: list[str], step: str, wanted: DataFrame) -> DataFrame:
        """The cell of `step` inside `within` that holds each wanted offset, and the offset left over."""
        counts = rows.join(F.broadcast(wanted.select(*within).distinct()), within, "left_semi")
        counts = counts.groupBy(*within, step).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*within).orderBy(step)
        counts = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
        hit = counts.join(F.broadcast(wanted), within).where(
            (F.col("_offset") >= F.col("_before")) & (F.col("_offset") < F.col("_before") + F.col("_n"))
        )
        found = hit.select("_rank", *within, step, (F.col("_offset") - F.col("_before")).alias("_offset"))
        return spark.createDataFrame(found.collect(), found.schema)

    wanted = spark.createDataFrame(
        [(r, b, o) for r, (b, o) in spans.items()], "_rank bigint, _bucket int, _offset bigint"
    )
    cells = bucketed.withColumn("_prefix", F.substring("_k", 1, prefix_digits(before)))
    wanted = narrow(cells, ["_bucket"], "_v", wanted)
    wanted = narrow(cells, ["_bucket", "_v"], "_prefix", wanted)
    wanted = narrow(cells, ["_bucket", "_v", "_prefix"], "_k", wanted)
    return {r["_rank"]: (r["_v"], r["_k"]) for r in wanted.collect()}


def sorted_codes(df: DataFrame, column: str, out: str = "code", samples: int = 1_000, task_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Distinct values of a column with their 0-based position in sorted order.

    Long lists are cut at bounds taken from a hash-ordered set of the values themselves.
    """
    values = materialize(df.select(q(column).alias("_v")).where(F.col("_v").isNotNull()).distinct(), "values")
    if not is_larger_than(values, task_rows):
        codes = values.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_v")) - 1)
        return codes.select(F.col("_v").alias(column), F.col(out).cast("bigint").alias(out))
    bounds = [r[0] for r in values.orderBy(F.xxhash64("_v"), "_v").limit(samples).collect()]
    bound_list = F.array(*[F.lit(b) for b in sorted(bounds)])
    cells = values.withColumn("_bucket", F.size(F.filter(bound_list, lambda b: b < F.col("_v"))))
    w = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    offsets = cells.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("_bucket").orderBy("_v")
    coded = cells.withColumn("_rn", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "_bucket")
    return coded.select(F.col("_v").alias(column), (F.col("_rn") + F.col("_before")).cast("bigint").alias(out))
