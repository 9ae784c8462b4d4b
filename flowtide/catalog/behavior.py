"""Behavioural statistics: fit on the training rows, apply to all rows."""

from __future__ import annotations

from flowtide.catalog.registry import FLOWS, MARKED, SEED, final, flows, key_sql, query, rnd, split_sql
from flowtide.catalog.rows import marked
from flowtide.functions.columns import q
from flowtide.operators import behavior
from flowtide.operators.sampling import stratified_split

PAIR = ["src_ip", "dst_ip"]

IAT = """iat AS (SELECT *, epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY src_ip, dst_ip ORDER BY "timestamp") AS gap FROM {base})"""
PERIODICITY = """_p AS (SELECT src_ip, dst_ip, CAST(sum(gap) AS DOUBLE) / count(gap) / 1000000.0::DOUBLE AS iat_mean, stddev_samp(gap) / 1e6 AS iat_std,
  quantile_cont(gap, 0.5) / 1000000.0::DOUBLE AS iat_median, min(gap) / 1000000.0::DOUBLE AS iat_min, max(gap) / 1000000.0::DOUBLE AS iat_max
  FROM iat WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY src_ip, dst_ip),
  pair_stats AS (SELECT *, coalesce(iat_std / (iat_mean + 1e-9), 0) AS iat_cv FROM _p)"""
FLOW_COUNTS = """_hours AS (SELECT src_ip, date_trunc('hour', "timestamp") AS h, count(*) AS c FROM {base} GROUP BY 1, 2),
  _spine AS (SELECT src_ip, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM _hours GROUP BY src_ip),
  _filled AS (SELECT s.src_ip, coalesce(c, 0) AS c FROM _spine s LEFT JOIN _hours USING (src_ip, h)),
  flow_counts AS (SELECT src_ip, avg(c) AS flow_count_mean, coalesce(stddev_samp(c), 0) AS flow_count_std, max(c) AS flow_count_max,
    CAST(sum(c) AS BIGINT) AS flow_count_total FROM _filled GROUP BY src_ip)"""


def entropy_sql(column: str, out: str, base: str, name: str) -> str:
    return f"""{name} AS (SELECT src_ip, coalesce(-sum(p * ln(p)), 0) AS {out} FROM (
    SELECT src_ip, {column}, count(*) / sum(count(*)) OVER (PARTITION BY src_ip) AS p FROM {base}
    WHERE {column} IS NOT NULL GROUP BY src_ip, {column}) GROUP BY src_ip)"""


def consistency_sql(column: str, name: str, base: str, cte: str) -> str:
    return f"""{cte} AS (SELECT src_ip, avg({column}) AS {name}_mean, stddev_samp({column}) AS {name}_std,
    coalesce(stddev_samp({column}) / (avg({column}) + 1e-9), 0) AS {name}_cv FROM {base} GROUP BY src_ip)"""


# Training rows: the train part of the stratified split of all flows.
SPLIT = f"{MARKED}, {split_sql('marked', 'is_malicious', key_sql('event_id'))}, train AS (SELECT * FROM parted WHERE split = 'train')"
IAT_NAMES = ("iat_mean", "iat_std", "iat_median", "iat_min", "iat_max", "iat_cv")
# Whole microseconds make these exact in both engines, so they need no rounding.
EXACT = ("iat_mean", "iat_median", "iat_min", "iat_max")
IAT_FILL = ", ".join(
    f"coalesce({c}, 0::DOUBLE) AS {c}" if c in EXACT else f"round(coalesce({c}, 0), 6) AS {c}" for c in IAT_NAMES
)
IAT_ROUNDED = ", ".join(c if c in EXACT else f"round({c}, 6) AS {c}" for c in IAT_NAMES)
COUNT_FILL = (
    "round(coalesce(flow_count_mean, 0), 6) AS flow_count_mean, round(coalesce(flow_count_std, 0), 6) AS flow_count_std, "
    "coalesce(flow_count_max, 0) AS flow_count_max, coalesce(flow_count_total, 0) AS flow_count_total"
)


def consistency_fill(name: str) -> str:
    return ", ".join(f"round(coalesce({name}_{x}, 0), 6) AS {name}_{x}" for x in ("mean", "std", "cv")) + (
        f", round(1 / (coalesce({name}_cv, 0) + 1e-9), 4) AS {name}_consistency_score"
    )


def parted(spark, sf):
    return stratified_split(marked(spark, sf), "is_malicious", ["event_id"], SEED)


def scored(df, *names):
    """Scores rounded to 4 digits (they reach 1e9), other doubles to 6."""
    return final(df, **dict.fromkeys(EXACT), **dict.fromkeys(names, 4))


@query("e1_inter_arrival", f"WITH {FLOWS}, {IAT.format(base='flows')} SELECT event_id, gap / 1000000.0::DOUBLE AS iat FROM iat")
def _(spark, sf):
    return final(behavior.inter_arrival(flows(spark, sf), PAIR, "timestamp").select("event_id", "iat"), iat=None)


@query(
    "d1_fit_periodicity",
    f"WITH {FLOWS}, {IAT.format(base='flows')}, {PERIODICITY} SELECT src_ip, dst_ip, {IAT_ROUNDED} FROM pair_stats",
)
def _(spark, sf):
    return final(behavior.fit_periodicity(flows(spark, sf), PAIR, "timestamp"), **dict.fromkeys(EXACT))


@query(
    "d2_fit_flow_counts",
    f"WITH {FLOWS}, {FLOW_COUNTS.format(base='flows')} SELECT src_ip, {rnd('flow_count_mean', 'flow_count_std')}, flow_count_max, flow_count_total FROM flow_counts",
)
def _(spark, sf):
    return final(behavior.fit_flow_counts(flows(spark, sf), "src_ip", "timestamp"))


@query(
    "d3_fit_port_entropy",
    f"WITH {FLOWS}, {entropy_sql('dst_port', 'dst_port_entropy', 'flows', 'e')} SELECT src_ip, {rnd('dst_port_entropy')} FROM e",
)
def _(spark, sf):
    return final(behavior.fit_entropy(flows(spark, sf), "src_ip", "dst_port", "dst_port_entropy"))


@query(
    "d4_fit_proto_entropy",
    f"WITH {FLOWS}, {entropy_sql('protocol', 'protocol_entropy', 'flows', 'e')} SELECT src_ip, {rnd('protocol_entropy')} FROM e",
)
def _(spark, sf):
    return final(behavior.fit_entropy(flows(spark, sf), "src_ip", "protocol", "protocol_entropy"))


@query(
    "d5_fit_bytes_consistency",
    f"WITH {FLOWS}, {consistency_sql('bytes_total', 'bytes', 'flows', 's')} SELECT src_ip, {rnd('bytes_mean', 'bytes_std', 'bytes_cv')} FROM s",
)
def _(spark, sf):
    return final(behavior.fit_consistency(flows(spark, sf), "src_ip", bytes_col="bytes_total"))


@query(
    "d6_fit_pkts_consistency",
    f"WITH {MARKED}, {consistency_sql('total_packets', 'pkts', 'marked', 's')} SELECT src_ip, {rnd('pkts_mean', 'pkts_std', 'pkts_cv')} FROM s",
)
def _(spark, sf):
    return final(behavior.fit_consistency(marked(spark, sf), "src_ip", packets_col="total_packets"))


SRC_FAMILIES = ", ".join(
    [
        FLOW_COUNTS.format(base="train"),
        entropy_sql("dst_port", "dst_port_entropy", "train", "pe"),
        entropy_sql("protocol", "protocol_entropy", "train", "qe"),
        consistency_sql("bytes_total", "bytes", "train", "bs"),
        consistency_sql("total_packets", "pkts", "train", "ps"),
    ]
)


@query(
    "d7_fit_features",
    f"""WITH {SPLIT}, {SRC_FAMILIES} SELECT src_ip, {rnd('flow_count_mean', 'flow_count_std')}, flow_count_max, flow_count_total,
    {rnd('dst_port_entropy', 'protocol_entropy', 'bytes_mean', 'bytes_std', 'bytes_cv', 'pkts_mean', 'pkts_std', 'pkts_cv')}
    FROM flow_counts JOIN pe USING (src_ip) JOIN qe USING (src_ip) JOIN bs USING (src_ip) JOIN ps USING (src_ip)""",
)
def _(spark, sf):
    return final(behavior.fit_features(parted(spark, sf).where(q("split") == "train")).src_stats)


@query(
    "c1_apply_pair_stats",
    f"""WITH {SPLIT}, {IAT.format(base='train')}, {PERIODICITY} SELECT event_id, parted.src_ip, parted.dst_ip, split, {IAT_FILL},
    round(1 / (coalesce(iat_cv, 0) + 1e-9), 4) AS periodicity_score
    FROM parted LEFT JOIN pair_stats ON parted.src_ip = pair_stats.src_ip AND parted.dst_ip = pair_stats.dst_ip""",
)
def _(spark, sf):
    df = parted(spark, sf)
    stats = behavior.fit_periodicity(df.where(q("split") == "train"), PAIR, "timestamp")
    slim = df.select("event_id", *PAIR, "split")
    return scored(behavior.apply_pair_stats(slim, stats, PAIR), "periodicity_score")


@query(
    "c2_apply_flow_counts",
    f"WITH {SPLIT}, {FLOW_COUNTS.format(base='train')} SELECT event_id, src_ip, {COUNT_FILL} FROM parted LEFT JOIN flow_counts USING (src_ip)",
)
def _(spark, sf):
    df = parted(spark, sf)
    stats = behavior.fit_flow_counts(df.where(q("split") == "train"), "src_ip", "timestamp")
    return final(behavior.apply_src_stats(df.select("event_id", "src_ip"), stats, "src_ip"))


@query(
    "c3_apply_entropy",
    f"""WITH {SPLIT}, {entropy_sql('dst_port', 'dst_port_entropy', 'train', 'pe')}
    SELECT event_id, src_ip, round(coalesce(dst_port_entropy, 0), 6) AS dst_port_entropy FROM parted LEFT JOIN pe USING (src_ip)""",
)
def _(spark, sf):
    df = parted(spark, sf)
    stats = behavior.fit_entropy(df.where(q("split") == "train"), "src_ip", "dst_port", "dst_port_entropy")
    return final(behavior.apply_src_stats(df.select("event_id", "src_ip"), stats, "src_ip"))


@query(
    "c4_apply_consistency",
    f"""WITH {SPLIT}, {consistency_sql('bytes_total', 'bytes', 'train', 'bs')}, {consistency_sql('total_packets', 'pkts', 'train', 'ps')}
    SELECT event_id, src_ip, {consistency_fill('bytes')}, {consistency_fill('pkts')} FROM parted LEFT JOIN bs USING (src_ip) LEFT JOIN ps USING (src_ip)""",
)
def _(spark, sf):
    df = parted(spark, sf)
    stats = behavior.fit_consistency(df.where(q("split") == "train"), "src_ip", "bytes_total", "total_packets")
    out = behavior.apply_src_stats(df.select("event_id", "src_ip"), stats, "src_ip")
    return scored(out, "bytes_consistency_score", "pkts_consistency_score")


BLOCK = (
    f"{IAT_FILL}, round(1 / (coalesce(iat_cv, 0) + 1e-9), 4) AS periodicity_score, {COUNT_FILL}, "
    "round(coalesce(dst_port_entropy, 0), 6) AS dst_port_entropy, round(coalesce(protocol_entropy, 0), 6) AS protocol_entropy, "
    f"{consistency_fill('bytes')}, {consistency_fill('pkts')}"
)
BLOCK_JOINS = """LEFT JOIN pair_stats ON parted.src_ip = pair_stats.src_ip AND parted.dst_ip = pair_stats.dst_ip
    LEFT JOIN flow_counts ON parted.src_ip = flow_counts.src_ip LEFT JOIN pe ON parted.src_ip = pe.src_ip LEFT JOIN qe ON parted.src_ip = qe.src_ip
    LEFT JOIN bs ON parted.src_ip = bs.src_ip LEFT JOIN ps ON parted.src_ip = ps.src_ip"""


@query(
    "c5_transform_features",
    f"""WITH {SPLIT}, {IAT.format(base='train')}, {PERIODICITY}, {SRC_FAMILIES}
    SELECT event_id, parted.src_ip, parted.dst_ip, split, {BLOCK} FROM parted {BLOCK_JOINS}""",
)
def _(spark, sf):
    df = parted(spark, sf)
    fitted = behavior.fit_features(df.where(q("split") == "train"))
    out = behavior.transform_features(df.select("event_id", *PAIR, "split"), fitted)
    return scored(out, "periodicity_score", "bytes_consistency_score", "pkts_consistency_score")
