"""Exploratory aggregates."""

from __future__ import annotations

from flowtide.catalog.registry import CTU, FLOWS, MARKED, final, flows, key_sql, query, split_sql, table
from flowtide.catalog.behavior import parted
from flowtide.catalog.rows import ctu, marked
from flowtide.functions.columns import q
from flowtide.operators import explore, rows

SPLIT = f"{MARKED}, {split_sql('marked', 'is_malicious', key_sql('event_id'))}"
BOTNET = f"{CTU}, bot AS (SELECT *, label AS is_botnet FROM ctu)"


def botnet(spark, sf):
    return ctu(spark, sf).withColumn("is_botnet", q("label"))


@query(
    "d8_class_stats",
    f"""WITH {MARKED} SELECT count(*) FILTER (is_malicious = 0) AS neg, count(*) FILTER (is_malicious = 1) AS pos,
    round(count(*) FILTER (is_malicious = 0) / count(*) FILTER (is_malicious = 1), 6) AS ratio FROM marked""",
)
def _(spark, sf):
    return final(explore.class_stats(marked(spark, sf), "is_malicious"))


@query(
    "d9_class_weights",
    f"""WITH {MARKED}, s AS (SELECT count(*) AS n, count(*) FILTER (is_malicious = 1) AS pos FROM marked)
    SELECT event_id, CAST(is_malicious AS BIGINT) AS is_malicious, round(n / (2 * CASE WHEN is_malicious = 1 THEN pos ELSE n - pos END), 6) AS balanced,
    round(CASE WHEN is_malicious = 1 THEN (n - pos) / pos ELSE 1 END, 6) AS ratio FROM marked, s""",
)
def _(spark, sf):
    df = marked(spark, sf).select("event_id", "is_malicious")
    both = explore.class_weights(explore.class_weights(df, "is_malicious", "balanced", "balanced"), "is_malicious", "ratio", "ratio")
    return final(both)


@query(
    "d10_class_distribution",
    f"WITH {SPLIT} SELECT split, CAST(is_malicious AS BIGINT) AS is_malicious, count(*) AS n FROM parted GROUP BY 1, 2",
)
def _(spark, sf):
    return final(explore.class_distribution(parted(spark, sf), "is_malicious", ["split"]))


@query(
    "d12_label_summary_ctu",
    f"""WITH {CTU} SELECT label_text, count(*) AS flows, round(avg(Dur), 6) AS avg_duration_s, round(avg(TotPkts), 6) AS avg_total_packets,
    round(avg(TotBytes), 6) AS avg_total_bytes, round(avg(SrcBytes), 6) AS avg_source_bytes, round(sum(TotBytes), 6) AS total_bytes,
    round(count(*) / (SELECT count(*) FROM ctu) * 100, 6) AS flow_pct, round(quantile_cont(Dur, 0.5), 6) AS median_duration_s
    FROM ctu WHERE label_text IS NOT NULL GROUP BY label_text ORDER BY flows DESC, label_text LIMIT 20""",
)
def _(spark, sf):
    return final(explore.label_summary_ctu(ctu(spark, sf), "label_text", top=20))


@query(
    "d13_label_summary_ugr",
    f"""WITH {FLOWS} SELECT label, count(*) AS flows, round(avg(duration), 6) AS avg_duration_s, round(avg(packets_fwd), 6) AS avg_total_packets,
    round(avg(bytes_total), 6) AS avg_total_bytes, round(count(*) / (SELECT count(*) FROM flows) * 100, 6) AS flow_pct
    FROM flows WHERE label IS NOT NULL GROUP BY label ORDER BY flows DESC, label LIMIT 20""",
)
def _(spark, sf):
    return final(explore.label_summary_ugr(flows(spark, sf)))


@query(
    "d14_malicious_comparison",
    f"""WITH {MARKED} SELECT CAST(is_malicious AS BIGINT) AS is_malicious, count(*) AS flows, round(avg(duration), 6) AS avg_duration,
    round(avg(packets_fwd), 6) AS avg_packets_fwd, round(avg(packets_bwd), 6) AS avg_packets_bwd, round(avg(bytes_total), 6) AS avg_bytes FROM marked GROUP BY 1""",
)
def _(spark, sf):
    return final(explore.malicious_comparison(marked(spark, sf)))


@query(
    "d15_botnet_means",
    f"""WITH {BOTNET} SELECT CAST(is_botnet AS BIGINT) AS is_botnet, count(*) AS flows, round(avg(Dur), 6) AS avg_dur, round(avg(TotPkts), 6) AS avg_tot_pkts,
    round(avg(TotBytes), 6) AS avg_tot_bytes, round(avg(SrcBytes), 6) AS avg_src_bytes, round(count(*) / (SELECT count(*) FROM bot) * 100, 6) AS flow_pct FROM bot GROUP BY 1""",
)
def _(spark, sf):
    return final(explore.botnet_means(botnet(spark, sf)))


@query("d16_value_counts", f"WITH {FLOWS} SELECT label AS value, count(*) AS flows FROM flows GROUP BY 1")
def _(spark, sf):
    return explore.value_counts(flows(spark, sf), "label", keep_null=True)


@query(
    "d17_top_n_others",
    f"""WITH {FLOWS}, c AS (SELECT dst_port, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, dst_port) AS r FROM flows GROUP BY 1)
    SELECT CASE WHEN r <= 10 THEN CAST(dst_port AS STRING) ELSE 'Others' END AS value, CAST(sum(n) AS BIGINT) AS flows,
    round(sum(n) / (SELECT count(*) FROM flows) * 100, 6) AS pct FROM c GROUP BY 1""",
)
def _(spark, sf):
    return final(explore.top_n_others(flows(spark, sf), "dst_port", 10))


def _pivot_sql(a: str, b: str, values, source: str) -> str:
    cells = ", ".join(f"count(*) FILTER ({b} = '{v}') AS \"{v}\"" for v in values)
    return f"SELECT {a}, {cells} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}"


LABELS = ("anomaly-sshscan", "background", "blacklist")


@query("d18_crosstab", f"WITH {FLOWS} {_pivot_sql('protocol', 'label', LABELS, 'flows')} ORDER BY protocol LIMIT 10")
def _(spark, sf):
    return explore.crosstab_first(flows(spark, sf), "protocol", "label", 10, LABELS)


@query("d18_crosstab_pairs", f"WITH {FLOWS} SELECT dst_port, src_ip, count(*) AS count FROM flows WHERE dst_port IS NOT NULL AND src_ip IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    """A crosstab over columns nobody listed: every pair, whatever their number."""
    return explore.crosstab(flows(spark, sf), "dst_port", "src_ip")


@query(
    "d18_crosstab_top_ports",
    f"""WITH {FLOWS}, top AS (SELECT dst_port AS p FROM flows GROUP BY 1 ORDER BY count(*) DESC, dst_port LIMIT 10)
    {_pivot_sql('dst_port', 'label', LABELS, '(SELECT * FROM flows WHERE dst_port IN (SELECT p FROM top))')}""",
)
def _(spark, sf):
    return explore.crosstab_top(flows(spark, sf), "dst_port", "label", 10, LABELS)


@query(
    "d19_crosstab_col_pct",
    f"""WITH {BOTNET}, t AS (SELECT count(*) FILTER (is_botnet = 0) AS neg, count(*) FILTER (is_botnet = 1) AS pos FROM bot)
    SELECT Proto, count(*) FILTER (is_botnet = 0) AS background, count(*) FILTER (is_botnet = 1) AS botnet, count(*) AS total,
    round(count(*) FILTER (is_botnet = 0) / any_value(neg) * 100, 6) AS background_pct, round(count(*) FILTER (is_botnet = 1) / any_value(pos) * 100, 6) AS botnet_pct
    FROM bot, t GROUP BY Proto ORDER BY total DESC, Proto LIMIT 10""",
)
def _(spark, sf):
    return final(explore.crosstab_col_pct(botnet(spark, sf), "Proto", "is_botnet"))


@query(
    "d20_scenario_counts",
    f"WITH {CTU} SELECT scenario, count(*) AS flows, round(count(*) / (SELECT count(*) FROM ctu) * 100, 6) AS pct FROM ctu GROUP BY 1",
)
def _(spark, sf):
    return final(explore.scenario_counts(ctu(spark, sf)))


@query(
    "d21_scenario_label_mix",
    f"""WITH {BOTNET} SELECT scenario, count(*) FILTER (is_botnet = 0) AS background_normal, count(*) FILTER (is_botnet = 1) AS botnet, count(*) AS total,
    round(count(*) FILTER (is_botnet = 1) / count(*) * 100, 6) AS botnet_pct, round(count(*) FILTER (is_botnet = 0) / count(*) * 100, 6) AS background_pct FROM bot GROUP BY 1""",
)
def _(spark, sf):
    return final(explore.scenario_label_mix(botnet(spark, sf)))


def _top_sql(*columns: str) -> str:
    cols = ", ".join(columns)
    return f"""WITH {MARKED}, m AS (SELECT * FROM marked WHERE is_malicious = 1)
    SELECT {cols}, count(*) AS flows, round(count(*) / (SELECT count(*) FROM m) * 100, 2) AS pct FROM m GROUP BY {cols} ORDER BY flows DESC, {cols} LIMIT 10"""


@query("d22_top_hosts", _top_sql("src_ip"))
def _(spark, sf):
    return explore.top_shares(marked(spark, sf).where(q("is_malicious") == 1), ["src_ip"])


@query("d22_top_destinations", _top_sql("dst_ip"))
def _(spark, sf):
    return explore.top_shares(marked(spark, sf).where(q("is_malicious") == 1), ["dst_ip"])


@query("d22_top_service_pairs", _top_sql("protocol", "dst_port"))
def _(spark, sf):
    return explore.top_shares(marked(spark, sf).where(q("is_malicious") == 1), ["protocol", "dst_port"])


@query(
    "d23_hourly_volume",
    f"""WITH {FLOWS}, h AS (SELECT date_trunc('hour', "timestamp") AS bin, count(*) AS n FROM flows GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM h)
    SELECT s.bin, coalesce(n, 0) AS flows FROM s LEFT JOIN h ON s.bin = h.bin""",
)
def _(spark, sf):
    return explore.hourly_volume(flows(spark, sf), "timestamp")


@query(
    "d23_hourly_volume_orders",
    """WITH h AS (SELECT date_trunc('day', o_orderdate) AS bin, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 6 HOUR)) AS bin FROM h)
    SELECT s.bin, coalesce(n, 0) AS flows FROM s LEFT JOIN h ON s.bin = h.bin""",
)
def _(spark, sf):
    return explore.hourly_volume(table(spark, sf, "orders"), "o_orderdate", 6 * 3600)


@query(
    "d24_hourly_by_flag",
    f"""WITH {MARKED}, h AS (SELECT is_malicious AS f, date_trunc('hour', "timestamp") AS bin, count(*) AS n FROM marked GROUP BY 1, 2),
    s AS (SELECT DISTINCT bin FROM (SELECT f, unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM h GROUP BY f))
    SELECT s.bin, CAST(coalesce(sum(n) FILTER (f = 0), 0) AS BIGINT) AS benign, CAST(coalesce(sum(n) FILTER (f = 1), 0) AS BIGINT) AS malicious
    FROM s LEFT JOIN h ON s.bin = h.bin GROUP BY s.bin""",
)
def _(spark, sf):
    return explore.hourly_by_flag(marked(spark, sf), "timestamp", "is_malicious")


@query(
    "d25_hourly_by_top_labels",
    f"""WITH {CTU}, top AS (SELECT label_text FROM ctu WHERE label_text IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, label_text LIMIT 5),
    h AS (SELECT label_text, date_trunc('hour', StartTime) AS bin, count(*) AS n FROM ctu WHERE label_text IN (SELECT label_text FROM top) GROUP BY 1, 2),
    s AS (SELECT label_text, unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM h GROUP BY 1)
    SELECT label_text, bin, coalesce(n, 0) AS flows FROM s LEFT JOIN h USING (label_text, bin)""",
)
def _(spark, sf):
    return explore.hourly_by_top_labels(ctu(spark, sf), "StartTime", "label_text")


_NUMERIC = ("duration", "packets_fwd", "packets_bwd", "bytes_total")


def _describe_sql(columns, probs, source) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
        + ", ".join(f'round(quantile_cont({c}, {p}), 6) AS "p{p * 100:g}"' for p in probs)
        + f", round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {source}"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


@query("d26_describe", f"WITH {FLOWS} " + _describe_sql(_NUMERIC, (0.5, 0.9, 0.99), "flows"))
def _(spark, sf):
    return final(explore.describe(flows(spark, sf), _NUMERIC, (0.5, 0.9, 0.99)))


@query(
    "d26_describe_hourly",
    f"""WITH {FLOWS}, h AS (SELECT date_trunc('hour', "timestamp") AS bin, count(*) AS n FROM flows GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM h),
    v AS (SELECT coalesce(n, 0) AS flows FROM s LEFT JOIN h ON s.bin = h.bin) """
    + _describe_sql(("flows",), (0.25, 0.5, 0.75), "v"),
)
def _(spark, sf):
    return final(explore.describe(explore.hourly_volume(flows(spark, sf), "timestamp"), ["flows"]))


@query(
    "d27_dataset_overview",
    f"""WITH {FLOWS} SELECT count(*) AS n_rows, min("timestamp") AS first_time, max("timestamp") AS last_time,
    CAST(floor(epoch(max("timestamp"))) - floor(epoch(min("timestamp"))) AS BIGINT) AS span_seconds, count(DISTINCT src_ip) AS unique_src_ips,
    count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT protocol) AS unique_protocols, count(DISTINCT label) AS unique_labels FROM flows""",
)
def _(spark, sf):
    names = {"unique_src_ips": "src_ip", "unique_dst_ips": "dst_ip", "unique_protocols": "protocol", "unique_labels": "label"}
    return final(explore.dataset_overview(flows(spark, sf), "timestamp", names))


@query(
    "d28_corr_matrix",
    f"WITH {FLOWS} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM flows"
        for a in _NUMERIC
        for b in _NUMERIC
    ),
)
def _(spark, sf):
    return final(explore.corr_matrix(flows(spark, sf), _NUMERIC))


def _hist_sql(column: str, bins: int, source: str) -> str:
    return f"""r AS (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {source}),
    c AS (SELECT CAST(least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM {source}, r WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT b.bin, round(lo + b.bin * ((hi - lo) / {bins}), 6) AS bin_lo, round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, coalesce(n, 0) AS flows
    FROM (SELECT unnest(range({bins})) AS bin) b LEFT JOIN c ON b.bin = c.bin, r"""


@query("d29_histogram", f"WITH {_hist_sql('l_extendedprice', 100, 'lineitem')}")
def _(spark, sf):
    return final(explore.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 100))


@query(
    "d30_class_histogram",
    f"""WITH {MARKED}, r AS (SELECT quantile_cont(duration, 0.95) AS cap FROM marked),
    v AS (SELECT is_malicious, least(duration, cap) AS x, cap FROM marked, r WHERE duration IS NOT NULL),
    c AS (SELECT is_malicious, CAST(least(floor(x / cap * 59), 58) AS BIGINT) AS bin, count(*) AS n FROM v WHERE x >= 0 GROUP BY 1, 2)
    SELECT CAST(f.is_malicious AS BIGINT) AS is_malicious, b.bin, round(b.bin * (cap / 59), 6) AS bin_lo, round((b.bin + 1) * (cap / 59), 6) AS bin_hi, coalesce(n, 0) AS flows
    FROM (SELECT DISTINCT is_malicious FROM marked) f CROSS JOIN (SELECT unnest(range(59)) AS bin) b CROSS JOIN r
    LEFT JOIN c ON c.is_malicious = f.is_malicious AND c.bin = b.bin""",
)
def _(spark, sf):
    return final(explore.class_histogram(marked(spark, sf), "duration", "is_malicious"))


@query(
    "d31_duration_by_label",
    f"""WITH {CTU}, u AS (SELECT * FROM ctu WHERE Dur < (SELECT quantile_cont(Dur, 0.99) FROM ctu))
    SELECT label_text, count(*) AS flows, round(avg(Dur), 6) AS mean_duration, round(quantile_cont(Dur, 0.5), 6) AS median_duration,
    substring(replace(replace(label_text, 'Background-', 'BG-'), 'Botnet-', 'Bot-'), 1, 35) AS short_label
    FROM u WHERE label_text IS NOT NULL GROUP BY label_text ORDER BY flows DESC, label_text LIMIT 8""",
)
def _(spark, sf):
    return final(explore.duration_by_label(ctu(spark, sf), "label_text", "Dur"))


@query(
    "d32_quantile",
    " UNION ALL ".join(
        f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(l_extendedprice, {p}), 6) AS quantile FROM lineitem GROUP BY l_returnflag"
        for p in (0.95, 0.99)
    ),
)
def _(spark, sf):
    return final(explore.quantile(table(spark, sf, "lineitem"), "l_extendedprice", [0.95, 0.99], ["l_returnflag"]))


@query(
    "f2_top_k",
    "SELECT l_partkey AS value, count(*) AS flows FROM lineitem GROUP BY 1 ORDER BY flows DESC, value LIMIT 20",
)
def _(spark, sf):
    return explore.top_k(table(spark, sf, "lineitem"), "l_partkey", 20)
