"""Mergeable statistics against the exact ones."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowtide.operators import behavior, sketches

START = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(9), []
    for group, n in (("a", 6000), ("b", 3), ("c", 1), ("d", 400)):
        at = 0.0
        for _ in range(n):
            at += rng.choice([0, 1, 1, 2, 30]) + (rng.random() * 50 if group == "a" else 0)
            out.append((group, START + dt.timedelta(seconds=at)))
    return out + [(None, START), ("a", None)]


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, ts timestamp_ntz").repartition(3)


@pytest.mark.parametrize("parts", [1, 3])
def test_merged_states_equal_the_exact_statistics(spark, rows, parts):
    df = table(spark, rows)
    exact = {r.g: r for r in behavior.fit_periodicity(df, ["g"], "ts").collect()}
    hour = F.coalesce(F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(START.timestamp())) / 20_000), F.lit(0))
    stretches = [sketches.gap_states(df.where(hour == i if i < parts - 1 else hour >= i), ["g"], "ts") for i in range(parts)]
    states = sketches.merge_states(stretches[::-1], ["g"]) if parts > 1 else stretches[0]
    found = {r.g: r for r in sketches.periodicity_of(states, ["g"]).collect()}
    assert set(found) == set(exact)
    for g, want in exact.items():
        for c in ("iat_mean", "iat_std", "iat_min", "iat_max", "iat_cv"):
            assert found[g][c] == (want[c] if want[c] is None else pytest.approx(want[c], rel=1e-9, abs=1e-9))
        times = sorted(t for k, t in rows if k == g and t is not None)
        gaps = sorted((y - x).total_seconds() for x, y in zip(times, times[1:]))
        if not gaps:
            assert found[g].iat_median is None
            continue
        low, high = (sum(x < found[g].iat_median for x in gaps) / len(gaps), sum(x <= found[g].iat_median for x in gaps) / len(gaps))
        assert low - 2 * sketches.RANK_ERROR <= 0.5 <= high + 2 * sketches.RANK_ERROR or len(gaps) < 5


def test_one_shuffle_and_no_percentile_buffer(spark, rows):
    plan = sketches.gap_states(table(spark, rows).select("g", "ts"), ["g"], "ts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "percentile" not in plan


def test_overlapping_stretches_are_refused(spark, rows):
    state = sketches.gap_states(table(spark, rows), ["g"], "ts")
    with pytest.raises(PySparkException, match="overlap"):
        sketches.merge_states([state, state], ["g"]).collect()


def test_quantiles_by_group(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") / 2).alias("v"))
    for r in sketches.quantiles_by(df, ["g"], "v", [0.1, 0.9]).collect():
        assert abs(r.quantile - r.prob * 10_000) < 10_000 * 2 * sketches.RANK_ERROR
