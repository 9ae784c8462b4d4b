"""The paths for hot groups and large tables give the same results as the plain ones."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.operators import behavior, evaluate, sampling, scale

SKEWED = "group string, v double"


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows; values repeat."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(int(x))) for x in rng.exponential(40, 400)]
    rows += [(f"g{i % 25}", float(x)) for i, x in enumerate(rng.normal(0, 5, 800))]
    return spark.createDataFrame(rows, SKEWED).persist()


@pytest.fixture(scope="module")
def bursts(spark):
    """A hot pair with equal timestamps, exact copies and a NULL time; quiet pairs of 1 to 3 flows."""
    rng = np.random.default_rng(2)
    times = np.sort(rng.integers(0, 5_000, 300)) * 1_000_000 + 1_700_000_000_000_000
    rows = [(i, "h", "d", int(t)) for i, t in enumerate(times)]
    rows += [(900, "h", "d", int(times[5]))] * 4 + [(901, "h", "d", None)]
    rows += [(1000 + i, f"s{i % 6}", "d", 1_700_000_000_000_000 + 777_777 * i) for i in range(13)]
    df = spark.createDataFrame(rows, "id long, src_ip string, dst_ip string, us long")
    return df.withColumn("timestamp", F.timestamp_micros("us").cast("timestamp_ntz")).persist()


@pytest.mark.parametrize("keys", [["group"], []])
@pytest.mark.parametrize("pieces", [3, 50])
def test_bucketed_quantiles_equal_built_in(skewed, keys, pieces):
    probs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    plain = scale.exact_quantiles(skewed, keys, "v", probs)
    cut = scale.exact_quantiles(skewed, keys, "v", probs, hot_rows=100, pieces=pieces)
    as_dict = lambda df: {tuple(r[k] for k in keys) + (r["prob"],): round(r["quantile"], 9) for r in df.collect()}
    assert as_dict(plain) == as_dict(cut)


def test_weighted_quantiles(spark, skewed):
    counted = skewed.groupBy("group", "v").agg(F.count(F.lit(1)).alias("w"))
    plain = scale.exact_quantiles(skewed, ["group"], "v", [0.3])
    cut = scale.exact_quantiles(counted, ["group"], "v", [0.3], weight="w", hot_rows=20, pieces=5)
    as_dict = lambda df: {r["group"]: r["quantile"] for r in df.collect()}
    assert as_dict(plain) == pytest.approx(as_dict(cut))


def test_hot_periodicity_equals_plain(bursts):
    keys = ["src_ip", "dst_ip"]
    rounded = lambda df: sorted(
        tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()
    )
    timed = bursts.where(F.col("timestamp").isNotNull())
    assert rounded(behavior.fit_periodicity(timed, keys, "timestamp")) == rounded(
        behavior.fit_periodicity(timed, keys, "timestamp", hot_rows=50)
    )


def test_hot_inter_arrival_equals_plain(bursts):
    """Which of several rows with one timestamp gets the gap is open; gaps per (pair, time) are not."""
    keys = ["src_ip", "dst_ip"]

    def gaps(**options):
        out = behavior.inter_arrival(bursts, keys, "timestamp", **options)
        assert out.columns == [*bursts.columns, "iat"]
        rows = out.collect()
        return Counter((r["src_ip"], r["us"], r["iat"]) for r in rows), Counter(r["id"] for r in rows)

    plain, ids = gaps()
    hot, hot_ids = gaps(hot_rows=50)
    assert ids == hot_ids
    drop_null = lambda c: {k: v for k, v in c.items() if k[1] is not None}
    assert drop_null(plain) == drop_null(hot)


@pytest.mark.parametrize("salted", [False, True])
def test_left_join_keeps_rows_and_values(spark, salted):
    rows = [("a", i) for i in range(50)] + [("b", 1), (None, 2), ("zz", 3)]
    df = spark.createDataFrame(rows, "k string, x int")
    stats = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, s double")
    hot = scale.hot_groups(df, ["k"], 10) if salted else None
    joined = scale.left_join_stats(df, stats, ["k"], hot, broadcast_rows=0, salts=4)
    assert joined.columns == ["k", "x", "s"]
    want = sorted((k or "", x, {"a": 1.0, "b": 2.0}.get(k)) for k, x in rows)
    assert sorted((r["k"] or "", r["x"], r["s"]) for r in joined.collect()) == want


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_buckets(spark, descending):
    rng = np.random.default_rng(3)
    rows = [(p, float(v), int(n)) for p in ("a", "b") for v, n in zip(range(200), rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "p string, v double, n long")
    plain = scale.running_totals(df, ["p"], "v", ["n"], descending)
    cut = scale.running_totals(df, ["p"], "v", ["n"], descending, task_rows=10, pieces=7)
    pick = lambda d: sorted((r["p"], r["v"], r["cum_n"]) for r in d.collect())
    assert pick(plain) == pick(cut)


def test_curve_areas_in_buckets(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.3), float(round(rng.random(), 2))) for _ in range(500)]
    df = spark.createDataFrame(rows, "label int, score double")
    plain = evaluate.auc_scores(df).first()
    cut = evaluate.auc_scores(df, task_rows=10).first()
    assert tuple(plain) == pytest.approx(tuple(cut))


def test_sorted_codes_in_buckets(spark):
    df = spark.createDataFrame([(f"10.0.{i % 37}.{i % 11}",) for i in range(600)] + [(None,)], "ip string")
    plain = {r["ip"]: r["code"] for r in scale.sorted_codes(df, "ip").collect()}
    cut = {r["ip"]: r["code"] for r in scale.sorted_codes(df, "ip", samples=9, task_rows=10).collect()}
    assert plain == cut
    assert sorted(plain, key=plain.get) == sorted(plain)


def test_rows_at_ranks_with_ties(spark):
    rows = [(i // 40, f"{(i * 7919) % 1000:04x}") for i in range(400)]
    df = spark.createDataFrame(rows, "v long, k string")
    ordered = sorted(rows)
    found = scale.rows_at_ranks(df, "v", "k", [0, 39, 40, 217, 399], pieces=4)
    assert {r: tuple(x) for r, x in found.items()} == {r: ordered[r] for r in (0, 39, 40, 217, 399)}


def test_repeat_rows_blocks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 0)], "x string, n long")
    assert Counter(r["x"] for r in scale.repeat_rows(df, "n", block=4).collect()) == {"a": 25, "b": 1}


@pytest.mark.parametrize("n", [1, 10, 137, 299])
def test_sample_of_a_table_full_of_copies(spark, n):
    """Without an id, copies tie; the sample still has exactly n rows and no row too many of any kind."""
    rows = [("copy", 1)] * 200 + [(f"r{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "a string, b int")
    sample = [tuple(r) for r in sampling.sample_exact(df, n, None, 5).collect()]
    assert len(sample) == n
    assert all(m <= Counter(rows)[k] for k, m in Counter(sample).items())


def test_split_of_a_table_full_of_copies(spark):
    rows = [("copy", 1, "x")] * 120 + [(f"r{i}", i, "xy"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "a string, b int, label string")
    out = sampling.stratified_split(df, "label", None, 3)
    assert Counter(r["split"] for r in out.collect()) == {"train": 140, "val": 20, "test": 40}
    assert Counter((r["a"], r["b"], r["label"]) for r in out.collect()) == Counter(rows)


def test_same_result_for_any_partitioning(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    results = []
    for parts in (1, 7, 64):
        out = sampling.stratified_split(df.repartition(parts), "y", ["id"], 11)
        results.append(sorted((r["id"], r["split"]) for r in out.collect()))
    assert results[0] == results[1] == results[2]
