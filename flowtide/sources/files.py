"""Readers and writers: flow files, split datasets, metadata, run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.columns import epoch_to_timestamp, q
from flowtide.operators.evaluate import to_long
from flowtide.operators.rows import add_split, apply_filters
from flowtide.sources.schema import CTU_SCHEMA, ProcessedData

CORRUPT = "_corrupt_record"
SPLITS = ("train", "val", "test")


def read_flow_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CTU_SCHEMA,
    header: bool = True,
    bad_rows: str = "drop",
    required: Sequence[str] = (),
    time_format: str | None = None,
) -> DataFrame:
    """Flow file with a given schema; no inference pass. Malformed rows are dropped, kept aside or an error.

    With a header every column named in `required` must be in the file.
    """
    if header and required:
        found = spark.read.option("header", True).csv(path).columns
        absent = [c for c in required if c not in found]
        if absent:
            raise ValueError(f"column(s) {absent} not in {path}")
    modes = {"drop": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}
    reader = spark.read.option("header", header).option("mode", modes[bad_rows]).option("enforceSchema", not header)
    if time_format:
        reader = reader.option("timestampNTZFormat", time_format)
    if bad_rows == "keep":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.schema(schema).csv(path)
    if bad_rows == "fail":
        return df
    # The parser only casts columns a query uses, so a bad value in an unused column would go
    # unnoticed and the row count would depend on the query. The filter, always true, uses them all.
    parsed = [q(f.name) for f in schema.fields if f.name != CORRUPT]
    return df.where(F.xxhash64(*parsed) >= F.lit(-(2**63)))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their raw text) of a file read with bad_rows='keep'."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull())


def count_rejects(df: DataFrame, ts: str) -> DataFrame:
    """One row: good rows, rejected rows, and good rows with a readable time."""
    good = F.col(CORRUPT).isNull()
    return df.agg(
        F.count_if(good).alias("good_rows"),
        F.count_if(~good).alias("rejected_rows"),
        F.count_if(good & q(ts).isNotNull()).alias("timed_rows"),
    )


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_flows(df: DataFrame, path: str, compression: str = "snappy", mode: str = "error") -> str:
    df.write.mode(mode).option("compression", compression).parquet(path)
    return path


def source_row_count(df: DataFrame, sampled: int | None = None) -> DataFrame:
    """One row: rows before sampling and, given the sample size, the sampled share in percent."""
    count = df.agg(F.count(F.lit(1)).alias("source_rows"))
    if sampled is None:
        return count
    return count.withColumn("sampling_pct", F.try_divide(F.lit(float(sampled)), F.col("source_rows")) * 100)


def verify_written(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """Re-reads the row count of a written table and compares it."""
    rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written_rows"))
    return rows.select("written_rows", F.lit(expected).cast("bigint").alias("expected_rows")).withColumn(
        "matches", F.col("written_rows") == F.col("expected_rows")
    )


def write_splits(df: DataFrame, path: str, split_column: str = "split", mode: str = "error") -> str:
    """One Parquet dataset partitioned by split, so reading a split prunes the others."""
    df.write.mode(mode).option("compression", "snappy").partitionBy(split_column).parquet(path)
    return path


def split_metadata(df: DataFrame, split_column: str, test_size: float, val_size: float, seed: int) -> DataFrame:
    """One row: samples per split, total, feature names, sizes and seed."""
    features = [c for c in df.columns if c != split_column]
    counts = [F.count_if(q(split_column) == s).alias(f"{s}_samples") for s in SPLITS]
    return df.agg(*counts, F.count(F.lit(1)).alias("total_samples")).select(
        "*",
        F.array(*[F.lit(c) for c in features]).alias("features"),
        F.lit(test_size).alias("test_size"),
        F.lit(val_size).alias("val_size"),
        F.lit(seed).alias("random_state"),
    )


def dataset_metadata(df: DataFrame, malicious: Column, seed: int, source_rows: int | None = None) -> DataFrame:
    """One row: size, seed, class counts and ratios, column names and types."""
    hit = F.coalesce(malicious, F.lit(False))
    counts = df.agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(hit).alias("malicious_samples"),
        F.count_if(~hit).alias("benign_samples"),
    )
    names = F.array(*[F.lit(f.name) for f in df.schema.fields])
    types = F.to_json(F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())]))
    row = counts.select(
        "*",
        F.lit(seed).alias("random_seed"),
        F.try_divide(F.col("malicious_samples"), F.col("sample_size")).alias("malicious_ratio"),
        F.try_divide(F.col("benign_samples"), F.col("malicious_samples")).alias("imbalance_ratio"),
        names.alias("columns"),
        types.alias("dtypes"),
    )
    if source_rows is not None:
        row = row.withColumn("sampling_ratio", F.try_divide(F.col("sample_size"), F.lit(source_rows)))
    return row


def write_metadata(row: DataFrame, path: str, mode: str = "error") -> str:
    row.coalesce(1).write.mode(mode).json(path)
    return path


def load_splits(
    spark: SparkSession, data: ProcessedData, splits: Sequence[str], allow_missing: bool = False
) -> DataFrame:
    """The named splits with their name as a column, after filters and time parsing.

    Reads one dataset partitioned by split, or separate `{dataset}_{split}.parquet` tables
    (united by column name) when there is no partitioned one.
    """
    present = _present_splits(spark, data)
    missing = [s for s in splits if s not in present]
    wanted = [s for s in splits if s in present]
    if missing and not allow_missing:
        raise FileNotFoundError(f"splits {missing} not found under {data.path}")
    if not wanted:
        raise FileNotFoundError(f"none of the splits {list(splits)} is under {data.path}")
    if present[wanted[0]] is None:
        df = spark.read.parquet(data.path).where(q(data.split).isin(wanted))
    else:
        df = union_splits([add_split(spark.read.parquet(present[s]), s, data.split) for s in wanted])
    df = apply_filters(df, data.row_filters)
    column = data.time
    if column and column in df.columns and not df.schema[column].dataType.typeName().startswith("timestamp"):
        df = df.withColumn(column, epoch_to_timestamp(q(column).try_cast("double")))
    return df


def _present_splits(spark: SparkSession, data: ProcessedData) -> dict[str, str | None]:
    """Split name to table path, or to None when it is a partition of one dataset."""
    root = spark._jvm.org.apache.hadoop.fs.Path(data.path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found: dict[str, str | None] = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{data.split}="):
            found[name.split("=", 1)[1]] = None
        elif name.startswith(f"{data.dataset}_") and name.endswith(".parquet"):
            found[name[len(data.dataset) + 1 : -len(".parquet")]] = f"{data.path}/{name}"
    return found


def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    """Stacks tables by column name; a column missing on one side is NULL there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def write_fold_results(folds: DataFrame, path: str, mode: str = "error") -> str:
    folds.write.mode(mode).option("header", True).csv(path)
    return path


def append_run_metrics(
    df: DataFrame, run_id: str, metrics: Sequence[str], step: str | None = None, path: str | None = None
) -> DataFrame:
    """Wide metric rows to (run_id, metric, step, value) rows, appended to a Parquet table when a path is given."""
    steps = q(step).cast("bigint") if step else F.lit(0).cast("bigint")
    long = to_long(df.withColumn("step", steps), ["step"], metrics)
    out = long.select(F.lit(run_id).alias("run_id"), "metric", "step", "value")
    if path is not None:
        out.write.mode("append").parquet(path)
    return out
