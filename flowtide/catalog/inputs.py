"""Readers, writers, metadata and schema resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.catalog.behavior import SPLIT, parted
from flowtide.catalog.evaluation import FOLD_SQL, fold_table
from flowtide.catalog.registry import CTU_TEXT, FLOWS, MARKED, SEED, ctu_text, final, flows, query, rnd, table
from flowtide.catalog.rows import marked
from flowtide.functions.columns import q
from flowtide.operators import behavior, explore, sampling
from flowtide.session import scratch_path
from flowtide.sources import files, schema


def _ctu_names(prefix: str = "") -> str:
    return ", ".join(f'{prefix}"{c}"' for c in schema.CTU_COLUMNS)


@query("a1_read_flow_csv", f"WITH {CTU_TEXT} SELECT {_ctu_names()} FROM ctu_text")
def _(spark, sf):
    path = scratch_path(spark, "ctu-csv")
    ctu_text(spark, sf).select(*schema.CTU_COLUMNS).write.option("header", True).csv(path)
    return files.read_flow_csv(spark, path, schema.CTU_SCHEMA, required=["Label"])


_LINE = ", ".join(
    {
        "timestamp": "coalesce(date_format(`timestamp`, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '')",
        "duration": "CASE WHEN tos IS NULL THEN 'broken' ELSE CAST(duration AS STRING) END",
    }.get(c, f"coalesce(CAST(`{c}` AS STRING), '')")
    for c in schema.UGR_COLUMNS
)


def _headerless(spark, sf):
    """Flows as headerless lines; a line without ToS has a broken duration and must be skipped."""
    path = scratch_path(spark, "ugr-csv")
    flows(spark, sf).selectExpr(f"concat_ws(',', {_LINE}) AS value").write.text(path)
    return path


@query(
    "a2_read_flow_csv_headerless",
    f"""WITH {FLOWS} SELECT "timestamp", {rnd('duration')}, src_ip, dst_ip, src_port, dst_port, protocol, flags, tos, packets_fwd, packets_bwd,
    {rnd('bytes_total')}, label FROM flows WHERE tos IS NOT NULL""",
)
def _(spark, sf):
    return final(files.read_flow_csv(spark, _headerless(spark, sf), schema.UGR_SCHEMA, header=False, bad_rows="drop"))


@query(
    "a2_rejected_rows",
    f"WITH {FLOWS} SELECT count(*) FILTER (tos IS NOT NULL) AS good_rows, count(*) FILTER (tos IS NULL) AS rejected_rows, count(*) FILTER (tos IS NOT NULL) AS timed_rows FROM flows",
)
def _(spark, sf):
    df = files.read_flow_csv(spark, _headerless(spark, sf), schema.UGR_SCHEMA, header=False, bad_rows="keep")
    return files.count_rejects(df, "timestamp")


@query("a3_read_flows", "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM events")
def _(spark, sf):
    return final(files.read_flows(spark, f"{sf}/events.parquet"))


@query("a4_write_flows", f"WITH {FLOWS} SELECT event_id, src_ip, dst_port, protocol FROM flows")
def _(spark, sf):
    df = flows(spark, sf).select("event_id", "src_ip", "dst_port", "protocol")
    return files.read_flows(spark, files.write_flows(df, scratch_path(spark, "flows")))


@query("a5_write_splits", f"WITH {SPLIT} SELECT event_id, src_ip, split FROM parted")
def _(spark, sf):
    df = parted(spark, sf).select("event_id", "src_ip", "split")
    return files.read_flows(spark, files.write_splits(df, scratch_path(spark, "splits")))


@query(
    "a5_split_metadata",
    f"""WITH {SPLIT} SELECT count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'val') AS val_samples,
    count(*) FILTER (split = 'test') AS test_samples, count(*) AS total_samples, 'event_id,src_ip' AS features, 0.2::DOUBLE AS test_size, 0.1::DOUBLE AS val_size,
    42::BIGINT AS random_state FROM parted""",
)
def _(spark, sf):
    df = parted(spark, sf).select("event_id", "src_ip", "split")
    row = files.split_metadata(df, "split", 0.2, 0.1, SEED)
    return final(row.withColumn("features", F.array_join("features", ",")))


@query(
    "a6_dataset_metadata",
    f"""WITH {MARKED} SELECT count(*) AS sample_size, count(*) FILTER (is_malicious = 1) AS malicious_samples, count(*) FILTER (is_malicious = 0) AS benign_samples,
    42::BIGINT AS random_seed, round(count(*) FILTER (is_malicious = 1) / count(*), 6) AS malicious_ratio,
    round(count(*) FILTER (is_malicious = 0) / count(*) FILTER (is_malicious = 1), 6) AS imbalance_ratio, 'event_id,is_malicious' AS columns,
    '{{"event_id":"bigint","is_malicious":"int"}}' AS dtypes FROM marked""",
)
def _(spark, sf):
    df = marked(spark, sf).select("event_id", "is_malicious")
    row = files.dataset_metadata(df, q("is_malicious") == 1, SEED)
    path = files.write_metadata(row, scratch_path(spark, "metadata"))
    back = spark.read.schema(row.schema).json(path)
    return final(back.withColumn("columns", F.array_join("columns", ",")))


@query(
    "a7_load_splits",
    f"WITH {SPLIT} SELECT event_id, protocol, split FROM parted WHERE split IN ('train', 'val') AND protocol IN ('TCP', 'UDP')",
)
def _(spark, sf):
    path = scratch_path(spark, "splits")
    files.write_splits(parted(spark, sf).select("event_id", "protocol", "split"), path)
    described = schema.processed_data(path, row_filters={"protocol": {"include": ["TCP", "UDP"]}})
    return files.load_splits(spark, described, ["train", "val"])


@query(
    "a7_load_splits_files",
    f"""WITH {SPLIT} SELECT event_id, to_timestamp_ntz AS timestamp_seconds, split FROM (
    SELECT event_id, split, date_trunc('second', "timestamp") AS to_timestamp_ntz FROM parted WHERE split IN ('val', 'test'))""",
)
def _(spark, sf):
    path = scratch_path(spark, "split-files")
    df = parted(spark, sf).select(
        "event_id", F.unix_seconds(q("timestamp").cast("timestamp")).alias("timestamp_seconds"), "split"
    )
    for name in ("val", "test"):
        files.write_flows(df.where(q("split") == name).drop("split"), f"{path}/ctu13_{name}.parquet")
    described = schema.processed_data(path, time="timestamp_seconds")
    return files.load_splits(spark, described, ["train", "val", "test"], allow_missing=True)


@query("a8_source_row_count", "SELECT count(*) AS source_rows, round(2000 / count(*) * 100, 6) AS sampling_pct FROM orders")
def _(spark, sf):
    return final(files.source_row_count(table(spark, sf, "orders"), 2000))


@query("a8_sample_with_source_count", "SELECT count(*) AS source_rows, least(2000, count(*)) AS sampled_rows FROM orders")
def _(spark, sf):
    """The source's rows are counted by the pass that draws the sample."""
    sample, rows = sampling.sample_and_count(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 2000, ["o_orderkey"], SEED)
    return sample.agg(F.lit(rows).cast("bigint").alias("source_rows"), F.count(F.lit(1)).alias("sampled_rows"))


@query("a9_verify_written", "SELECT count(*) AS written_rows, count(*) AS expected_rows, true AS matches FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer")
    return files.verify_written(spark, files.write_flows(df, scratch_path(spark, "customer")), df.count())


@query("a10_write_fold_results", f"{FOLD_SQL} SELECT * FROM folds")
def _(spark, sf):
    folds = final(fold_table(spark, sf))
    return spark.read.schema(folds.schema).option("header", True).csv(
        files.write_fold_results(folds, scratch_path(spark, "folds"))
    )


@query(
    "a11_append_run_metrics",
    f"""{FOLD_SQL} SELECT 'run-1' AS run_id, metric, fold AS step, value FROM (
    SELECT fold, 'accuracy' AS metric, accuracy AS value FROM folds UNION ALL SELECT fold, 'recall', recall FROM folds)""",
)
def _(spark, sf):
    path = scratch_path(spark, "run-metrics")
    files.append_run_metrics(fold_table(spark, sf), "run-1", ["accuracy", "recall"], "fold", path)
    return final(spark.read.parquet(path))


@query("a12_standardize_columns", f'WITH {FLOWS} SELECT "timestamp", src_ip, dst_port, packets_bwd, event_id AS other FROM flows')
def _(spark, sf):
    raw = flows(spark, sf).selectExpr(
        "`timestamp` AS column00", "src_ip AS column2", "dst_port AS column05", "packets_bwd AS column10", "event_id AS other"
    )
    return schema.standardize_columns(raw)


@query(
    "a13_resolve_schema",
    f"WITH {MARKED} SELECT CAST(is_malicious AS BIGINT) AS binary_label, count(*) AS n FROM marked WHERE dst_port <= 50 GROUP BY 1",
)
def _(spark, sf):
    path = files.write_splits(
        marked(spark, sf).select("dst_port", q("is_malicious").alias("binary_label"), F.lit("train").alias("split")),
        scratch_path(spark, "ugr"),
    )
    described = schema.processed_data(path, "ugr16", row_filters={"dst_port": {"max": 50}})
    return final(explore.class_distribution(files.load_splits(spark, described, ["train"]), described.label))


@query(
    "a14_resolve_columns",
    f"WITH {FLOWS} SELECT src_ip, dst_ip, dst_port, count(*) AS n FROM flows GROUP BY ALL",
)
def _(spark, sf):
    df = flows(spark, sf)
    keys = [*behavior.resolve_group_columns(df), behavior.resolve_column(df, behavior.PORT_COLUMNS)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
