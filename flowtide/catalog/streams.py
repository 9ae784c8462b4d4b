"""Streaming forms of batch queries, held against the batch queries' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.catalog.behavior import PAIR, parted, scored
from flowtide.catalog.registry import ORACLES, flows, query
from flowtide.catalog.rows import marked
from flowtide.functions.columns import q
from flowtide.operators import behavior, explore
from flowtide.session import scratch_path
from flowtide.streaming import flows as streams

SLICES = 6


def as_files(df: DataFrame, ts: str | None, slices: int = SLICES) -> str:
    """The table as a folder to stream from: in time order, slice after slice, or all at once without a time."""
    path = scratch_path(df.sparkSession, "arriving")
    if ts is None:
        df.repartition(slices).write.parquet(path)
        return path
    seconds = F.unix_seconds(q(ts).cast("timestamp"))
    low, high = df.agg(F.min(seconds), F.max(seconds)).first()
    if low is None:
        df.write.parquet(path)
        return path
    place = F.coalesce(F.least(F.floor((seconds - low) * slices / (high - low + 1)), F.lit(slices - 1)), F.lit(0))
    for i in range(slices):  # one after the other, as files arrive
        df.where(place == i).write.mode("append").parquet(path)
    return path


def hourly(spark: SparkSession, df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """(_bin, keys, flows) as a finished stream over the table's files has counted them."""
    arriving = streams.read_flow_stream(spark, as_files(df, ts), df.schema, 4)
    counts = streams.bin_counts(arriving, ts, keys)
    sink, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "stream")
    running = streams.start_counting(counts, sink, checkpoint)
    running.awaitTermination()
    return streams.counted(spark, counts, sink, checkpoint)


@query("d23_hourly_volume_stream", ORACLES["d23_hourly_volume"])
def _(spark, sf):
    df = flows(spark, sf).select("timestamp")
    return explore.fill_bins(hourly(spark, df, "timestamp", []))


@query("d24_hourly_by_flag_stream", ORACLES["d24_hourly_by_flag"])
def _(spark, sf):
    df = marked(spark, sf).select("timestamp", "is_malicious")
    return explore.flag_columns(explore.fill_bins_by(hourly(spark, df, "timestamp", ["is_malicious"]), "is_malicious"), "is_malicious")


@query("c5_transform_stream", ORACLES["c5_transform_features"])
def _(spark, sf):
    """Statistics are fitted on the train split; the flows arrive as a stream and are joined batch by batch."""
    df = parted(spark, sf)
    path = scratch_path(spark, "fitted")
    behavior.fit_features(df.where(q("split") == "train"), path=path)
    slim = df.select("event_id", *PAIR, "split")
    arriving = streams.read_flow_stream(spark, as_files(slim, None), slim.schema, 2)
    sink = scratch_path(spark, "applied")
    running = streams.start_applying(arriving, lambda: behavior.load_features(spark, path, PAIR), sink, scratch_path(spark, "stream"))
    running.awaitTermination()
    return scored(spark.read.parquet(sink).drop("batch"), "periodicity_score", "bytes_consistency_score", "pkts_consistency_score")
