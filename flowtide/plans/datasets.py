"""Whole preprocessing jobs for the two flow datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions import columns as c
from flowtide.functions.columns import q
from flowtide.operators import behavior, rows, sampling, scale
from flowtide.session import materialize
from flowtide.sources.schema import standardize_columns

# How many of the most frequent values get a one-hot column.
TOP_PROTOCOLS, TOP_STATES, TOP_PORTS, TOP_FLAGS = 10, 10, 20, 10
# Spark compares names without case, so the raw `Label` text and the 0/1 `label` cannot share a table.
CTU_TEXT_LABEL = "label_text"
CTU_LOG_COLUMNS = ("Dur", "TotPkts", "TotBytes", "SrcBytes")
UGR_LOG_COLUMNS = ("duration", "packets_fwd", "packets_bwd", "bytes_total")


def clean_ctu(df: DataFrame, time_format: str = c.CTU_TIME_FORMAT) -> DataFrame:
    """Typed columns; rows without a readable time are dropped."""
    new = {
        "StartTime": c.parse_timestamp(q("StartTime"), time_format),
        "Sport": c.parse_port(q("Sport")),
        "Dport": c.parse_port(q("Dport")),
        "sTos": c.fill_tos(q("sTos")),
        "dTos": c.fill_tos(q("dTos")),
        "Dur": c.to_double(q("Dur")),
        "TotPkts": c.to_bigint(q("TotPkts")),
        "TotBytes": c.to_double(q("TotBytes")),
        "SrcBytes": c.to_double(q("SrcBytes")),
    }
    return rows.drop_invalid_time(rows.replace_columns(df, {k: v for k, v in new.items() if k in df.columns}), "StartTime")


def label_ctu(df: DataFrame, word: str = "Botnet") -> DataFrame:
    return df.withColumnRenamed("Label", CTU_TEXT_LABEL).select(
        "*",
        c.contains_word(q(CTU_TEXT_LABEL), word).alias("label"),
        c.extract_scenario(q(CTU_TEXT_LABEL)).alias("scenario"),
    )


def ctu_vocabulary(df: DataFrame) -> dict[str, list[Any]]:
    return {"Proto": rows.top_values(df, "Proto", TOP_PROTOCOLS), "State": rows.top_values(df, "State", TOP_STATES)}


def _time_features(ts: str) -> list:
    return [
        c.hour_of_day(q(ts)).alias("hour"),
        c.day_of_week(q(ts)).alias("day_of_week"),
        c.epoch_seconds(q(ts)).alias("timestamp_seconds"),
    ]


def ctu_ratios() -> list[Column]:
    """The numeric features, in output order; any of them may be NULL."""
    return [
        c.bytes_per_packet(q("TotBytes"), q("TotPkts")).alias("bytes_per_packet"),
        c.bytes_ratio(q("SrcBytes"), q("TotBytes")).alias("src_bytes_ratio"),
        *[c.log_feature(q(x)).alias(f"{x}_log") for x in CTU_LOG_COLUMNS],
    ]


def ctu_features(vocabulary: Mapping[str, Sequence[Any]]) -> list[Column]:
    """All per-row features, for one projection over cleaned and labelled rows."""
    return [
        *_time_features("StartTime"),
        *ctu_ratios(),
        *rows.value_flags("Proto", "proto", vocabulary["Proto"]),
        c.is_common_port(q("Sport")).alias("is_common_src_port"),
        c.is_common_port(q("Dport")).alias("is_common_dst_port"),
        *rows.value_flags("State", "state", vocabulary["State"]),
    ]


def clean_ugr(df: DataFrame, time_format: str | None = None) -> DataFrame:
    df = standardize_columns(df)
    new = {"timestamp": q("timestamp").cast("timestamp_ntz")}
    if df.schema["timestamp"].dataType.typeName() == "string":
        new = {"timestamp": c.parse_timestamp(q("timestamp"), time_format)}
    for name in ("duration", "bytes_total"):
        new[name] = c.to_double(q(name))
    for name in ("src_port", "dst_port", "packets_fwd", "packets_bwd", "tos"):
        new[name] = c.to_bigint(q(name))
    return rows.drop_invalid_time(rows.replace_columns(df, {k: v for k, v in new.items() if k in df.columns}), "timestamp")


def label_ugr(df: DataFrame, keywords: Sequence[str] = c.MALICIOUS_KEYWORDS) -> DataFrame:
    if "label" not in df.columns:
        raise ValueError("column 'label' not found")
    flag = c.contains_any(q("label"), keywords)
    return df.select("*", flag.alias("is_malicious"), flag.alias("binary_label"))


def ugr_vocabulary(df: DataFrame) -> dict[str, list[Any]]:
    return {
        "protocol": rows.top_values(df, "protocol", TOP_PROTOCOLS),
        "dst_port": rows.top_values(df, "dst_port", TOP_PORTS),
        "flags": rows.top_values(df, "flags", TOP_FLAGS),
    }


def ugr_ratios() -> list[Column]:
    total = q("total_packets")
    return [
        c.fwd_packet_ratio(q("packets_fwd"), total).alias("fwd_packet_ratio"),
        c.bytes_per_packet(q("bytes_total"), total).alias("bytes_per_packet"),
        *[c.log_feature(q(x), null_as_zero=True).alias(f"{x}_log") for x in UGR_LOG_COLUMNS],
    ]


def ugr_features(vocabulary: Mapping[str, Sequence[Any]]) -> list[Column]:
    """All per-row features, for one projection over labelled rows with `total_packets`."""
    return [
        *_time_features("timestamp"),
        q("total_packets"),
        *ugr_ratios(),
        *rows.value_flags("protocol", "proto", vocabulary["protocol"]),
        c.is_common_port(q("src_port")).alias("is_common_src_port"),
        c.is_common_port(q("dst_port")).alias("is_common_dst_port"),
        *rows.value_flags("dst_port", "dst_port", vocabulary["dst_port"]),
        *rows.value_flags("flags", "flag", vocabulary["flags"]),
    ]


def split_fit_apply(
    typed: DataFrame,
    features: Sequence[Column],
    nullable: Sequence[Column],
    label: str,
    ts: str,
    id_cols: Sequence[str] | None,
    seed: int,
    test_size: float,
    val_size: float,
    hot_rows: int = scale.HOT_GROUP_ROWS,
) -> DataFrame:
    """Incomplete rows out, stratified split, statistics from the train rows, joined to all rows.

    `typed` is a written table. The split is a comparison per row with a few cut keys, so it is
    not written out; only the handful of columns the fit reads are, for the train rows, because
    each family scans them. The per-row features come last, in the final projection.
    """
    complete = rows.fill_missing(typed, "drop")
    for feature in nullable:
        complete = complete.where(feature.isNotNull())
    split = sampling.stratified_split(complete, label, id_cols, seed, test_size, val_size)
    train = split.where(F.col("split") == "train").select(*[q(x) for x in behavior.fitting_columns(split, ts)])
    fitted = behavior.fit_features(materialize(train, "train"), ts, hot_rows=hot_rows, written=True)
    done = behavior.transform_features(split, fitted)
    base = [q(x) for x in typed.columns if x != "total_packets"]
    block = [q(x) for x in done.columns if x not in split.columns]
    return done.select(*base, *features, *block, "split")


def preprocess_ctu(
    raw: DataFrame,
    id_cols: Sequence[str] | None = None,
    seed: int = 42,
    test_size: float = 0.2,
    val_size: float = 0.1,
    vocabulary: Mapping[str, Sequence[Any]] | None = None,
    time_format: str = c.CTU_TIME_FORMAT,
) -> DataFrame:
    """Clean, label, derive, drop incomplete rows, split, fit on train, apply to all.

    Text is parsed once: the typed table is written and everything after reads it.
    """
    typed = materialize(label_ctu(clean_ctu(raw, time_format)), "typed")
    features = ctu_features(vocabulary or ctu_vocabulary(typed))
    return split_fit_apply(typed, features, ctu_ratios(), "label", "StartTime", id_cols, seed, test_size, val_size)


def preprocess_ugr(
    raw: DataFrame,
    id_cols: Sequence[str] | None = None,
    seed: int = 42,
    test_size: float = 0.2,
    val_size: float = 0.1,
    vocabulary: Mapping[str, Sequence[Any]] | None = None,
    keywords: Sequence[str] = c.MALICIOUS_KEYWORDS,
) -> DataFrame:
    labelled = label_ugr(clean_ugr(raw), keywords)
    total = c.total_packets(q("packets_fwd"), q("packets_bwd"))
    typed = materialize(labelled.withColumn("total_packets", total), "typed")
    features = ugr_features(vocabulary or ugr_vocabulary(typed))
    return split_fit_apply(
        typed, features, ugr_ratios(), "binary_label", "timestamp", id_cols, seed, test_size, val_size
    )
