"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, skew-join splitting)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a folder beside the session's tables is used: the
    warehouse is always set and, on a cluster, shared.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        jvm = sc._jvm
        base = jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
        folder = base.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(base).toString()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_runs: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediates written inside the block go to one folder, deleted at its end.

    For whole jobs: write the result inside the block. A result that is still to
    be computed reads its intermediates later and must not be made here.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (in the open run's folder, if any); every call gives a new one."""
    base = _runs[-1] if _runs else shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


DRIVER_ROWS = 20_000


def pin(df: DataFrame, rows: int = DRIVER_ROWS) -> tuple[DataFrame, bool]:
    """Computes a table once: (table, whether it is small enough to broadcast).

    Up to `rows` rows it becomes a literal table; a longer one is checkpointed instead.
    """
    found = df.limit(rows + 1).toArrow()
    if found.num_rows <= rows:
        return df.sparkSession.createDataFrame(found, schema=df.schema), True
    return cut_lineage(df), False


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read the written rows instead of recomputing them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table that several jobs will read, as Parquet: later scans prune columns and push filters."""
    target = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite" if path else "error").option("compression", "snappy").parquet(target)
    return df.sparkSession.read.parquet(target)
