"""Plan shape: shuffles, pruning, push-down, no Python in the data path."""

import pytest
from pyspark.sql import functions as F

from flowtide.catalog import QUERIES
from flowtide.catalog.registry import flows, table
from flowtide.functions.columns import q
from flowtide.operators import behavior, rows, sampling
from flowtide.session import scratch_path
from flowtide.sources import files, schema

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_periodicity_shuffles_rows_once(spark):
    df = behavior.fit_periodicity(flows(spark, SF_DIR), ["src_ip", "dst_ip"], "timestamp")
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_split_and_sample_do_not_shuffle_rows(spark):
    orders = table(spark, SF_DIR, "orders").select("o_orderkey", "o_orderstatus")
    split = sampling.stratified_split(orders, "o_orderstatus", ["o_orderkey"], 1)
    sample = sampling.sample_exact(orders, 300, ["o_orderkey"], 1)
    for df in (split, sample):
        text = plan(df)
        assert "Exchange hashpartitioning" not in text and "SinglePartition" not in text


def test_applying_both_blocks_broadcasts_counted_tables(spark):
    df = flows(spark, SF_DIR).withColumn("total_packets", q("packets_fwd"))
    out = behavior.transform_features(df, behavior.fit_features(df))
    assert plan(out).count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in plan(out)


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(rows.apply_filters(table(spark, SF_DIR, "lineitem"), {"l_quantity": {"min": 10}}).select("l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "GreaterThanOrEqual(l_quantity,10" in text


def test_reading_a_split_prunes_the_others(spark):
    df = spark.range(30).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")))
    path = files.write_splits(df, scratch_path(spark, "pruned"))
    out = files.load_splits(spark, schema.processed_data(path), ["val"])
    assert out.count() == 10
    assert "PartitionFilters: [isnotnull(split" in plan(out) or "PartitionFilters: [split" in plan(out)


@pytest.mark.parametrize("name", ["b3_parse_port", "b14_temporal_features", "d3_fit_port_entropy", "d26_describe", "i2_binary_metrics"])
def test_no_python_in_the_data_path(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text
    assert text.count("Exchange") <= {"b3_parse_port": 0, "b14_temporal_features": 0}.get(name, 12)


def test_counts_are_observed_in_the_pass_that_samples(spark):
    orders = table(spark, SF_DIR, "orders").select("o_orderkey", "o_orderstatus")
    total = orders.count()

    def jobs(run):
        group = f"jobs-{run.__name__}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def counted():
        return sampling.sample_and_count(orders, 300, ["o_orderkey"], 1)

    def plain():
        return sampling.sample_exact(orders, 300, ["o_orderkey"], 1)

    (sample, rows_read), with_count = jobs(counted)
    same, without = jobs(plain)
    assert rows_read == total and with_count <= without + 1  # one look whether there is a first row
    assert sorted(sample.collect()) == sorted(same.collect()) and sample.count() == 300
    whole, n = sampling.sample_and_count(orders, total + 5, ["o_orderkey"], 1)
    assert whole.count() == n == total
    assert sampling.sample_and_count(orders.limit(0), 5, ["o_orderkey"], 1)[0].count() == 0
