"""Row-local queries: parsing, cleaning, features, filters, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.catalog.registry import (
    CTU,
    CTU_TEXT,
    FLOWS,
    KEYWORDS_SQL,
    MARKED,
    SEED,
    ctu_text,
    final,
    flows,
    key_sql,
    port_sql,
    query,
    rnd,
    split_sql,
    table,
)
from flowtide.functions import columns as c
from flowtide.functions.columns import q
from flowtide.operators import explore, rows
from flowtide.plans import datasets
from flowtide.session import materialize

TIME_SQL = "try_strptime(StartTime, '%Y/%m/%d %H:%M:%S.%f')"


def ctu(spark, sf):
    return datasets.label_ctu(datasets.clean_ctu(ctu_text(spark, sf)))


def marked(spark, sf):
    """Flows with the malicious flag and packet total."""
    df = flows(spark, sf)
    return df.select(
        "*",
        c.contains_any(q("label")).alias("is_malicious"),
        c.total_packets(q("packets_fwd"), q("packets_bwd")).alias("total_packets"),
    )


@query("b1_parse_timestamp", f"WITH {CTU_TEXT} SELECT event_id, {TIME_SQL} AS start_time FROM ctu_text")
def _(spark, sf):
    return ctu_text(spark, sf).select(
        "event_id", c.parse_timestamp(q("StartTime"), c.CTU_TIME_FORMAT).alias("start_time")
    )


@query(
    "b2_epoch_to_timestamp",
    "SELECT o_orderkey, make_timestamp((1000000000 + o_orderkey * 61) * 1000000) AS at FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", c.epoch_to_timestamp(F.lit(1000000000) + q("o_orderkey") * 61).alias("at"))


@query(
    "b3_parse_port",
    f"WITH {CTU_TEXT} SELECT event_id, CAST({port_sql('Sport')} AS BIGINT) AS sport, CAST({port_sql('Dport', 'NULL')} AS BIGINT) AS dport FROM ctu_text",
)
def _(spark, sf):
    return final(
        ctu_text(spark, sf).select(
            "event_id", c.parse_port(q("Sport")).alias("sport"), c.parse_port(q("Dport"), "null").alias("dport")
        )
    )


@query(
    "b4_coerce_numeric",
    f"""WITH {CTU_TEXT} SELECT event_id, round(TRY_CAST(Dur AS DOUBLE), 6) AS dur, TRY_CAST(TotPkts AS BIGINT) AS pkts,
    round(TRY_CAST(TotBytes AS DOUBLE), 6) AS bytes FROM ctu_text""",
)
def _(spark, sf):
    t = ctu_text(spark, sf)
    return final(
        t.select(
            "event_id",
            c.to_double(q("Dur")).alias("dur"),
            c.to_bigint(q("TotPkts")).alias("pkts"),
            c.to_double(q("TotBytes")).alias("bytes"),
        )
    )


@query(
    "b5_fill_tos",
    f"WITH {CTU_TEXT} SELECT event_id, CAST(coalesce(TRY_CAST(sTos AS DOUBLE), 0) AS BIGINT) AS stos, CAST(coalesce(TRY_CAST(dTos AS DOUBLE), 0) AS BIGINT) AS dtos FROM ctu_text",
)
def _(spark, sf):
    t = ctu_text(spark, sf)
    return final(t.select("event_id", c.fill_tos(q("sTos")).alias("stos"), c.fill_tos(q("dTos")).alias("dtos")))


@query(
    "b6_drop_invalid_time",
    f"WITH {CTU_TEXT} SELECT count(*) FILTER ({TIME_SQL} IS NULL) AS dropped_rows, count(*) FILTER ({TIME_SQL} IS NOT NULL) AS rows_after_cleaning FROM ctu_text",
)
def _(spark, sf):
    t = ctu_text(spark, sf).select(c.parse_timestamp(q("StartTime"), c.CTU_TIME_FORMAT).alias("StartTime"))
    return rows.count_invalid_time(t, "StartTime")


@query(
    "b7_missing_drop",
    f"WITH {FLOWS} SELECT event_id, src_port, tos, label, {rnd('bytes_total')} FROM flows "
    "WHERE src_port IS NOT NULL AND tos IS NOT NULL AND label IS NOT NULL AND bytes_total IS NOT NULL",
)
def _(spark, sf):
    t = flows(spark, sf).select("event_id", "src_port", "tos", "label", "bytes_total")
    return final(rows.fill_missing(t, "drop"))


@query(
    "b8_missing_fill_zero",
    f"WITH {FLOWS} SELECT event_id, coalesce(src_port, 0) AS src_port, coalesce(tos, 0) AS tos, label, round(coalesce(bytes_total, 0), 6) AS bytes_total FROM flows",
)
def _(spark, sf):
    t = flows(spark, sf).select("event_id", "src_port", "tos", "label", "bytes_total")
    return final(rows.fill_missing(t, "fill_zero"))


@query(
    "b9_missing_fill_median",
    f"""WITH {FLOWS} SELECT event_id, round(coalesce(CAST(src_port AS DOUBLE), (SELECT quantile_cont(src_port, 0.5) FROM flows)), 6) AS src_port,
    round(coalesce(CAST(tos AS DOUBLE), (SELECT quantile_cont(tos, 0.5) FROM flows)), 6) AS tos, label,
    round(coalesce(bytes_total, (SELECT quantile_cont(bytes_total, 0.5) FROM flows)), 6) AS bytes_total FROM flows""",
)
def _(spark, sf):
    t = flows(spark, sf).select("event_id", "src_port", "tos", "label", "bytes_total")
    return final(rows.fill_missing(t, "fill_median")).withColumn("event_id", q("event_id").cast("bigint"))


@query(
    "b10_label_contains",
    f"WITH {CTU_TEXT} SELECT event_id, CAST(coalesce(Label ILIKE '%botnet%', false) AS BIGINT) AS label FROM ctu_text",
)
def _(spark, sf):
    return final(ctu_text(spark, sf).select("event_id", c.contains_word(q("Label"), "Botnet").alias("label")))


@query(
    "b11_label_keywords",
    f"WITH {FLOWS} SELECT event_id, CAST({KEYWORDS_SQL} AS BIGINT) AS is_malicious, CAST({KEYWORDS_SQL} AS BIGINT) AS binary_label FROM flows",
)
def _(spark, sf):
    return final(datasets.label_ugr(flows(spark, sf)).select("event_id", "is_malicious", "binary_label"))


@query(
    "b12_extract_scenario",
    f"WITH {CTU} SELECT event_id, scenario FROM ctu",
)
def _(spark, sf):
    return ctu(spark, sf).select("event_id", "scenario")


@query(
    "b13_apply_filters",
    f"""WITH {FLOWS} SELECT event_id, label, protocol, dst_port FROM flows
    WHERE protocol IN ('TCP', 'UDP') AND (label NOT IN ('blacklist') OR label IS NULL) AND dst_port >= 10 AND dst_port <= 80""",
)
def _(spark, sf):
    rules = {
        "protocol": {"include": ["TCP", "UDP"]},
        "label": {"exclude": ["blacklist"]},
        "dst_port": {"min": 10, "max": 80},
    }
    return rows.apply_filters(flows(spark, sf), rules).select("event_id", "label", "protocol", "dst_port")


@query(
    "b14_temporal_features",
    f"""WITH {FLOWS} SELECT event_id, CAST(hour("timestamp") AS BIGINT) AS hour, CAST(isodow("timestamp") - 1 AS BIGINT) AS day_of_week,
    CAST(floor(epoch("timestamp")) AS BIGINT) AS timestamp_seconds FROM flows""",
)
def _(spark, sf):
    ts = q("timestamp")
    return final(
        flows(spark, sf).select(
            "event_id",
            c.hour_of_day(ts).alias("hour"),
            c.day_of_week(ts).alias("day_of_week"),
            c.epoch_seconds(ts).alias("timestamp_seconds"),
        )
    )


@query(
    "b15_bytes_per_packet",
    f"WITH {CTU} SELECT event_id, round(TotBytes / (TotPkts + 1), 6) AS bytes_per_packet FROM ctu",
)
def _(spark, sf):
    return final(ctu(spark, sf).select("event_id", c.bytes_per_packet(q("TotBytes"), q("TotPkts")).alias("bytes_per_packet")))


@query(
    "b16_src_bytes_ratio",
    f"WITH {CTU} SELECT event_id, round(SrcBytes / (TotBytes + 1), 6) AS src_bytes_ratio FROM ctu",
)
def _(spark, sf):
    return final(ctu(spark, sf).select("event_id", c.bytes_ratio(q("SrcBytes"), q("TotBytes")).alias("src_bytes_ratio")))


@query(
    "b17_packet_direction",
    f"""WITH {FLOWS}, f AS (SELECT event_id, CASE WHEN tos IS NULL THEN NULL ELSE packets_fwd END AS fwd, packets_bwd AS bwd FROM flows)
    SELECT event_id, coalesce(fwd, 0) + coalesce(bwd, 0) AS total_packets, round(fwd / (coalesce(fwd, 0) + coalesce(bwd, 0) + 1), 6) AS fwd_packet_ratio FROM f""",
)
def _(spark, sf):
    f = flows(spark, sf).select(
        "event_id", F.when(q("tos").isNotNull(), q("packets_fwd")).alias("fwd"), q("packets_bwd").alias("bwd")
    )
    total = c.total_packets(q("fwd"), q("bwd"))
    return final(
        f.select("event_id", total.alias("total_packets"), c.fwd_packet_ratio(q("fwd"), total).alias("fwd_packet_ratio"))
    )


@query(
    "b18_log_features",
    f"WITH {FLOWS} SELECT event_id, round(ln(1 + duration), 6) AS duration_log, round(ln(1 + bytes_total), 6) AS bytes_log_plain, round(ln(1 + coalesce(bytes_total, 0)), 6) AS bytes_total_log FROM flows",
)
def _(spark, sf):
    return final(
        flows(spark, sf).select(
            "event_id",
            c.log_feature(q("duration")).alias("duration_log"),
            c.log_feature(q("bytes_total")).alias("bytes_log_plain"),
            c.log_feature(q("bytes_total"), null_as_zero=True).alias("bytes_total_log"),
        )
    )


@query(
    "b19_port_flags",
    f"""WITH {FLOWS} SELECT event_id, CAST(coalesce(src_port > 0 AND src_port < 1024, false) AS BIGINT) AS is_common_src_port,
    CAST(coalesce(dst_port > 0 AND dst_port < 1024, false) AS BIGINT) AS is_common_dst_port FROM flows""",
)
def _(spark, sf):
    return final(
        flows(spark, sf).select(
            "event_id",
            c.is_common_port(q("src_port")).alias("is_common_src_port"),
            c.is_common_port(q("dst_port")).alias("is_common_dst_port"),
        )
    )


_FLAG_VALUES = (".A....", ".AP.SF", "....S.", ".APRSF")
_PROTO_VALUES = ("TCP", "UDP", "ICMP", "ipx/spx")


@query(
    "b20_one_hot_topk",
    f"WITH {FLOWS} SELECT event_id, "
    + ", ".join(f"CAST(protocol = '{v}' AS BIGINT) AS \"proto_{v}\"" for v in _PROTO_VALUES)
    + ", "
    + ", ".join(f"CAST(flags = '{v}' AS BIGINT) AS \"flag_{v}\"" for v in _FLAG_VALUES)
    + " FROM flows",
)
def _(spark, sf):
    df = flows(spark, sf).select("event_id", "protocol", "flags")
    hot = rows.one_hot_topk(rows.one_hot_topk(df, "protocol", 10, "proto"), "flags", 10, "flag")
    return final(hot.drop("protocol", "flags"))


@query(
    "b21_topk_filter",
    f"""WITH {FLOWS}, top AS (SELECT dst_port FROM flows GROUP BY 1 ORDER BY count(*) DESC, dst_port LIMIT 10)
    SELECT event_id, dst_port FROM flows WHERE dst_port IN (SELECT dst_port FROM top)""",
)
def _(spark, sf):
    return rows.topk_filter(flows(spark, sf), "dst_port", 10).select("event_id", "dst_port")


@query(
    "b22_below_quantile",
    f"WITH {FLOWS} SELECT event_id, {rnd('duration')} FROM flows WHERE duration < (SELECT quantile_cont(duration, 0.99) FROM flows)",
)
def _(spark, sf):
    return final(rows.below_quantile(flows(spark, sf), "duration", 0.99).select("event_id", "duration"))


@query(
    "b23_clip_at_quantile",
    f"""WITH {FLOWS} SELECT event_id,
    round(CASE WHEN bytes_total IS NULL THEN NULL ELSE least(bytes_total, (SELECT quantile_cont(bytes_total, 0.95) FROM flows)) END, 6) AS bytes_total FROM flows""",
)
def _(spark, sf):
    return final(rows.clip_at_quantile(flows(spark, sf).select("event_id", "bytes_total"), "bytes_total", 0.95))


@query(
    "b24_short_label",
    f"WITH {CTU_TEXT} SELECT event_id, substring(replace(replace(Label, 'Background-', 'BG-'), 'Botnet-', 'Bot-'), 1, 35) AS short_label FROM ctu_text",
)
def _(spark, sf):
    return ctu_text(spark, sf).select("event_id", c.short_label(q("Label")).alias("short_label"))


@query(
    "b25_label_severity",
    f"""WITH {FLOWS} SELECT event_id, CASE WHEN contains(lower(label), 'bot') OR contains(lower(label), 'attack') THEN 'malicious'
    WHEN contains(lower(label), 'blacklist') OR contains(lower(label), 'anomaly') THEN 'suspicious' ELSE 'background' END AS severity FROM flows""",
)
def _(spark, sf):
    return flows(spark, sf).select("event_id", c.label_severity(q("label")).alias("severity"))


@query(
    "b26_select_features",
    f"""WITH {MARKED} SELECT event_id, {rnd('duration')}, src_port, dst_port, tos, packets_fwd, packets_bwd, {rnd('bytes_total')}, total_packets FROM marked""",
)
def _(spark, sf):
    from flowtide.sources.schema import processed_data

    df = marked(spark, sf).withColumn("binary_label", q("is_malicious"))
    described = processed_data("", "ugr16")
    return final(df.select(*[q(x) for x in rows.select_features(df, described.not_features, described.label)]))


@query(
    "b27_assemble",
    f"""WITH {MARKED} SELECT event_id, CAST(is_malicious AS BIGINT) AS label, round(duration, 6) AS x0, round(coalesce(bytes_total, 0), 6) AS x1,
    round(CAST(total_packets AS DOUBLE), 6) AS x2 FROM marked""",
)
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = rows.fill_missing(marked(spark, sf), "fill_zero")
    x = vector_to_array("features")
    cells = [x[i].alias(f"x{i}") for i in range(3)]
    out = rows.assemble(df, ["duration", "bytes_total", "total_packets"])
    return final(out.select("event_id", q("is_malicious").alias("label"), *cells))


@query(
    "b28_group_codes",
    f"""WITH {FLOWS}, g AS (SELECT event_id, CASE WHEN tos IS NULL THEN NULL ELSE src_ip END AS src_ip FROM flows),
    codes AS (SELECT src_ip, row_number() OVER (ORDER BY src_ip) - 1 AS code FROM (SELECT DISTINCT src_ip FROM g WHERE src_ip IS NOT NULL))
    SELECT event_id, g.src_ip, coalesce(code, -1) AS group_code FROM g LEFT JOIN codes ON g.src_ip = codes.src_ip""",
)
def _(spark, sf):
    g = flows(spark, sf).select("event_id", F.when(q("tos").isNotNull(), q("src_ip")).alias("src_ip"))
    return rows.group_codes(g, "src_ip")


_SCALED = ("duration", "bytes_total", "packets_fwd")


@query(
    "b29_standard_scale",
    f"WITH {FLOWS}, {split_sql('flows', 'dst_ip', key_sql('event_id'))} SELECT event_id, "
    + ", ".join(
        f"round(({x} - (SELECT avg({x}) FROM parted WHERE split = 'train')) / (SELECT stddev_pop({x}) FROM parted WHERE split = 'train'), 6) AS {x}"
        for x in _SCALED
    )
    + " FROM parted",
)
def _(spark, sf):
    from flowtide.operators.sampling import stratified_split

    df = stratified_split(flows(spark, sf).select("event_id", "dst_ip", *_SCALED), "dst_ip", ["event_id"], SEED)
    scaler = rows.fit_scaler(df.where(q("split") == "train"), _SCALED)
    return final(rows.standard_scale(df, scaler).select("event_id", *_SCALED))


@query("b30_add_split", "SELECT o_orderkey, 'holdout' AS split FROM orders")
def _(spark, sf):
    return rows.add_split(table(spark, sf, "orders").select("o_orderkey"), "holdout")


@query(
    "d11_missing_counts",
    f"""WITH {FLOWS} SELECT * FROM (
      SELECT 'src_port' AS "column", count(*) FILTER (src_port IS NULL) AS missing FROM flows UNION ALL
      SELECT 'tos', count(*) FILTER (tos IS NULL) FROM flows UNION ALL
      SELECT 'bytes_total', count(*) FILTER (bytes_total IS NULL) FROM flows UNION ALL
      SELECT 'label', count(*) FILTER (label IS NULL) FROM flows) WHERE missing > 0""",
)
def _(spark, sf):
    return explore.missing_counts(flows(spark, sf))


@query(
    "b6_drop_invalid_time_counted",
    f"WITH {CTU_TEXT} SELECT count(*) FILTER ({TIME_SQL} IS NULL) AS dropped_rows, count(*) FILTER ({TIME_SQL} IS NOT NULL) AS rows_after_cleaning FROM ctu_text",
)
def _(spark, sf):
    """Dropped rows are counted by the pass that writes the others."""
    t = ctu_text(spark, sf).select(c.parse_timestamp(q("StartTime"), c.CTU_TIME_FORMAT).alias("StartTime"))
    kept, dropped = rows.drop_invalid_time_counted(t, "StartTime", lambda df: materialize(df, "timed"))
    return kept.agg(F.lit(dropped).cast("bigint").alias("dropped_rows"), F.count(F.lit(1)).alias("rows_after_cleaning"))
