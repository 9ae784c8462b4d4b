"""Streams of flows: counts per time bin with a watermark, and fitted statistics applied batch by batch.

Counting: rows are grouped by event-time window (and optional keys) under a
watermark. A window is appended to the sink once the watermark has passed it;
windows that are still open stay in the stream's state, where `counted` reads them.
A row behind the watermark is not counted in any window; `late_rows` says how
many there were. A restart from the checkpoint repeats nothing: files that were
read are in its log, and the file sink lists each batch once.

Applying: every micro-batch is joined to the statistics as they are when it
starts and written to a folder of its own, which a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowtide.functions.columns import q
from flowtide.operators.behavior import FittedBehavior, transform_features

TIMED = "timed_rows"


def read_flow_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, oldest first, at most so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def bin_counts(stream: DataFrame, ts: str, keys: Sequence[str] = (), width_seconds: int = 3600, lateness: str = "2 hours") -> DataFrame:
    """start, keys and flows of every window of rows with a time; the number of such rows is observed."""
    timed = stream.where(q(ts).isNotNull()).select(q(ts).cast("timestamp").alias("_time"), *[q(k) for k in keys])
    seen = timed.observe(TIMED, F.count(F.lit(1)).alias("n"))
    window = F.window("_time", f"{width_seconds} seconds").alias("window")
    counts = seen.withWatermark("_time", lateness).groupBy(window, *[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("flows"))
    return counts.select(F.unix_seconds(F.col("window.start")).alias("_bin"), *[q(k) for k in keys], "flows")


def start_counting(counts: DataFrame, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends finished windows to Parquet under `sink`; by default all files that are there now."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def counted(spark: SparkSession, counts: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """All windows so far: the finished ones from the sink, the open ones from the stream's state."""
    keys = [f for f in counts.schema if f.name not in ("_bin", "flows")]
    closed = spark.read.schema(counts.schema).parquet(sink)
    state = spark.read.format("statestore").load(checkpoint)
    # the grouping columns keep their order in the state's key, the count is its only value
    key, value = (state.schema[c].dataType.fieldNames() for c in ("key", "value"))
    named = [F.col(f"key.`{k}`").alias(f.name) for k, f in zip(key[1:], keys, strict=True)]
    still = state.select(F.unix_seconds(F.col(f"key.`{key[0]}`.start")).alias("_bin"), *named, F.col(f"value.`{value[0]}`").alias("flows"))
    return closed.unionByName(still)


def observed_rows(query: StreamingQuery) -> int:
    """Rows with a time that this run of the stream has read."""
    found = (p.observedMetrics.get(TIMED) for p in query.recentProgress)
    return sum(r["n"] for r in found if r is not None)


def late_rows(read: int, counts: DataFrame) -> int:
    """Rows that came behind the watermark: all rows read by the stream's runs less those counted."""
    return read - (counts.agg(F.sum("flows")).first()[0] or 0)


def start_applying(stream: DataFrame, fitted: Callable[[], FittedBehavior], sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Joins every micro-batch to the newest fitted statistics and writes it under `sink`/batch=<number>."""

    def apply(batch: DataFrame, number: int) -> None:
        transform_features(batch, fitted()).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
