"""Training and scoring queries, and the whole preprocessing jobs.

The learners run at full size on a label that one feature decides, so that their outputs are known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.catalog.behavior import BLOCK, BLOCK_JOINS, IAT, PERIODICITY, SRC_FAMILIES
from flowtide.catalog.registry import CTU, FLOWS, MARKED, SEED, ctu_text, final, flows, key_sql, query, rnd, split_sql, table
from flowtide.catalog.rows import marked
from flowtide.functions.columns import q
from flowtide.operators import averaging, boosting, evaluate, models, rows, sampling
from flowtide.plans import datasets
from flowtide.session import materialize

FEATURES = ["duration", "bytes_total", "dst_port", "packets_fwd", "packets_bwd"]
ID = ["event_id"]


# A rule that one feature decides: every learner with enough capacity must find it.
RULED = f"""{MARKED}, ruled AS (SELECT event_id, CAST(packets_bwd >= 3 AS BIGINT) AS label FROM marked)"""
RULED_SPLIT = f"WITH {RULED}, {split_sql('ruled', 'label', key_sql('event_id'))}"
_PERFECT = "1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, 1.0::DOUBLE AS roc_auc"
_TEST_METRICS = f"""{RULED_SPLIT} SELECT {_PERFECT}, count(*) AS support_total, CAST(sum(label) AS BIGINT) AS support_positive,
    CAST(sum(1 - label) AS BIGINT) AS support_negative FROM parted WHERE split = 'test'"""
_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "support_total", "support_positive", "support_negative"]


def split_table(spark, sf):
    """Split flows with scaled features; label 1 means at least three packets back."""
    df = rows.fill_missing(marked(spark, sf), "fill_zero").withColumn("label", (q("packets_bwd") >= 3).cast("int"))
    df = df.select("event_id", "src_ip", "label", *FEATURES)
    df = sampling.stratified_split(df, "label", ID, SEED)
    scaler = rows.fit_scaler(df.where(q("split") == "train"), FEATURES)
    return rows.standard_scale(df, scaler)


def assembled(spark, sf):
    return materialize(rows.assemble(split_table(spark, sf), FEATURES), "model-rows")


def _train(df):
    return df.where(q("split") == "train")


def _test(df):
    return df.where(q("split") == "test")


@query("j1_random_forest", _TEST_METRICS)
def _(spark, sf):
    df = assembled(spark, sf)
    model = models.random_forest(_train(df))
    return final(evaluate.all_metrics(models.predict(model, _test(df))).select(*_METRICS))


@query("j2_boosted_trees", _TEST_METRICS)
def _(spark, sf):
    """Up to 100 rounds, stopped early on the validation rows."""
    df = assembled(spark, sf)
    fit = df.where(q("split") != "test").withColumn("held", (q("split") == "val").cast("int"))
    model = models.boosted_trees(fit, validation="held")
    return final(evaluate.all_metrics(models.predict(model, _test(df))).select(*_METRICS))


# A label of several features with noise and ties, and features with missing values.
NOISY_LABEL = """CAST((CASE WHEN dst_port > 60 AND packets_bwd >= 2 OR src_port < 500 AND packets_bwd = 1 THEN 1 ELSE 0 END
    + CASE WHEN event_id * 7919 % 13 = 0 THEN 1 ELSE 0 END) % 2 AS INT)"""
BOOST_BOUNDS = {"dst_port": [10 * i for i in range(1, 10)], "packets_bwd": [1, 2, 3, 4], "src_port": [250 * i for i in range(1, 12)], "bytes_total": [500 * i for i in range(1, 16)]}


def _boost_sql(rounds: int, depth: int, step: float, positive: int, reg_lambda: float = 1.0, least: float = 1.0) -> str:
    """The same boosting level by level: histograms, cumulative sums, best split of each node, leaf values."""
    n = len(BOOST_BOUNDS)
    bins = ", ".join(
        f"CASE WHEN {f} IS NULL THEN -1 ELSE " + " + ".join(f"CAST({f} >= {b} AS INT)" for b in bounds) + f" END AS b{i}" for i, (f, bounds) in enumerate(BOOST_BOUNDS.items())
    )
    ctes = [f"m0 AS (SELECT event_id, {NOISY_LABEL} AS y, {bins}, 0::DOUBLE AS margin FROM flows)"]
    kept = "event_id, y, margin, " + ", ".join(f"b{i}" for i in range(n))

    def part(g: str, h: str) -> str:
        return f"({g}) * ({g}) / (({h}) + {reg_lambda})"

    for r in range(rounds):
        ctes.append(f"p{r} AS (SELECT *, 1 / (1 + exp(-margin)) AS p, CASE WHEN y = 1 THEN {positive}::DOUBLE ELSE 1 END AS w FROM m{r})")
        ctes.append(f"n{r}_0 AS (SELECT {kept}, (p - y) * w AS g, p * (1 - p) * w AS h, 0 AS node FROM p{r})")
        for level in range(depth):
            t = f"{r}_{level}"
            ctes += [
                f"s{t} AS (SELECT node, f, b, sum(g) AS g, sum(h) AS h FROM (" + " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS b, g, h FROM n{t} WHERE node >= {2**level - 1}" for i in range(n)) + ") GROUP BY node, f, b)",
                f"""c{t} AS (SELECT node, f, b, sum(CASE WHEN b >= 0 THEN g ELSE 0 END) OVER o AS gl, sum(CASE WHEN b >= 0 THEN h ELSE 0 END) OVER o AS hl,
                sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(CASE WHEN b < 0 THEN g ELSE 0 END) OVER a AS gm, sum(CASE WHEN b < 0 THEN h ELSE 0 END) OVER a AS hm
                FROM s{t} WINDOW o AS (PARTITION BY node, f ORDER BY b), a AS (PARTITION BY node, f))""",
                f"""d{t} AS (SELECT node, f, b, ml, gt, ht, gl + CASE WHEN ml THEN gm ELSE 0 END AS gl, hl + CASE WHEN ml THEN hm ELSE 0 END AS hl
                FROM c{t}, (SELECT unnest([false, true]) AS ml) WHERE b >= 0)""",
                f"""e{t} AS (SELECT *, 0.5 * ({part('gl', 'hl')} + {part('gt - gl', 'ht - hl')} - {part('gt', 'ht')}) AS gain FROM d{t} WHERE hl >= {least} AND ht - hl >= {least})""",
                f"x{t} AS (SELECT * FROM e{t} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b, ml) = 1)",
                f"""n{r}_{level + 1} AS (SELECT {kept}, g, h, CASE WHEN x.f IS NULL THEN node WHEN CASE WHEN [b0, b1, b2, b3][x.f + 1] < 0 THEN x.ml ELSE [b0, b1, b2, b3][x.f + 1] <= x.b END
                THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM n{t} LEFT JOIN (SELECT node, f, b, ml FROM x{t}) x USING (node))""",
            ]
        ctes.append(f"v{r} AS (SELECT node, -{step} * sum(g) / (sum(h) + {reg_lambda}) AS v FROM n{r}_{depth} GROUP BY node)")
        ctes.append(f"m{r + 1} AS (SELECT {kept.replace('margin', 'margin + v AS margin')} FROM n{r}_{depth} JOIN v{r} USING (node))")
    return f"WITH {FLOWS}, {', '.join(ctes)} SELECT event_id, CAST(y AS BIGINT) AS label, round(1 / (1 + exp(-margin)), 6) AS score FROM m{rounds}"


@query("j2_second_order_boosting", _boost_sql(3, 3, 0.3, 3))
def _(spark, sf):
    """Three trees on given bins; every row's probability."""
    df = flows(spark, sf).selectExpr("event_id", f"{NOISY_LABEL} AS label", *BOOST_BOUNDS)
    model = boosting.train(df, list(BOOST_BOUNDS), rounds=3, depth=3, positive_weight=3.0, bounds=BOOST_BOUNDS)
    return final(model.transform(df).select("event_id", "label", "score"))


@query(
    "j3_mlp",
    f"""{RULED_SPLIT} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, true AS in_range, true AS cut_at_half, true AS cells_add_up, true AS ranks_well
    FROM parted WHERE split = 'test'""",
)
def _(spark, sf):
    """What the rule determines of a network's output: sizes, the 0.5 cut, the confusion cells' sums, a good ranking."""
    df = assembled(spark, sf)
    balanced = models.balance_by_repeating(_train(df).select("event_id", "label", "features"), "label", ID, SEED)
    scored = materialize(models.predict(models.mlp(balanced, len(FEATURES)), _test(df)), "network-scores")
    auc = evaluate.all_metrics(scored).select("roc_auc").scalar()
    right = F.count_if((q("prediction") == 1) & (q("label") == 1)) + F.count_if((q("prediction") == 0) & (q("label") == 1))
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("positives"),
        F.every((q("score") >= 0) & (q("score") <= 1)).alias("in_range"),
        F.every((q("prediction") == 1) == (q("score") > 0.5)).alias("cut_at_half"),
        (right == F.sum("label")).alias("cells_add_up"),
    ).withColumn("ranks_well", auc > 0.95)


_LINE = """d AS (SELECT event_id, CAST(event_id % 50 = 0 AS INT) AS label, value AS x, 2 * value AS y, 3 * value + CASE WHEN event_id % 50 = 0 THEN 10 + event_id % 7 ELSE 0 END AS z FROM events)"""


@query(
    "j4_reconstruction_detector",
    f"""WITH {_LINE}, s AS (SELECT stddev_samp(z) AS sd FROM d WHERE label = 0 AND event_id % 5 > 0)
    SELECT event_id, CAST(label AS BIGINT) AS label, CASE WHEN label = 1 THEN round(2.0 / 9 * pow((10 + event_id % 7) / sd, 2), 6) ELSE 0.0 END AS error
    FROM d, s WHERE event_id % 5 = 0""",
)
def _(spark, sf):
    """Normal rows lie on the line (x, 2x, 3x); the error of a row off it is two ninths of its squared scaled offset."""
    off = F.when(F.col("event_id") % 50 == 0, 10 + F.col("event_id") % 7).otherwise(0)
    df = table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 50 == 0).cast("int").alias("label"), F.col("value").alias("x"), (2 * F.col("value")).alias("y"), (3 * F.col("value") + off).alias("z")
    )
    df = rows.assemble(df, ["x", "y", "z"])
    detector = models.reconstruction_detector(df.where("event_id % 5 > 0"), 1)
    return final(models.reconstruction_error(detector, df.where("event_id % 5 = 0")).select("event_id", "label", "error"))


# Client rows for weight averaging: two scaled order features, finished orders as positives.
_CLIENT_COLUMNS = {
    "client_id": "CAST(o_custkey % 6 AS INT)",
    "label": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "x1": "o_totalprice / 250000 - 1",
    "x2": "month(o_orderdate) / 6 - 1",
}
CLIENT_FEATURES = ["x1", "x2"]
CLIENT_ROWS = "d AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CLIENT_COLUMNS.items()) + " FROM orders)"


def clients(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _CLIENT_COLUMNS.items()])


_P = "(1 / (1 + exp(-(w.a * x1 + w.b * x2 + w.c))))"
_START = "s0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c), "


def _spread(name: str, shared: str) -> str:
    return f"{name} AS (SELECT client_id, a, b, c FROM (SELECT DISTINCT client_id FROM d), {shared})"


def _step(name: str, before: str, shared: str, mu: float) -> str:
    """One full-gradient step of every client from its weights in `before`."""

    def moved(w: str, x: str) -> str:
        return f"any_value(w.{w}) - 0.5::DOUBLE * (avg(({_P} - label) * {x}) + {mu}::DOUBLE * (any_value(w.{w}) - any_value(s.{w}))) AS {w}"

    return f"""{name} AS (SELECT client_id, count(*) AS n, {moved('a', 'x1')}, {moved('b', 'x2')}, {moved('c', '1')}
    FROM d JOIN {before} w USING (client_id) CROSS JOIN {shared} s GROUP BY client_id)"""


def _result(name: str, after: str) -> str:
    return f"""{name} AS (SELECT client_id, count(*) AS n, any_value(w.a) AS a, any_value(w.b) AS b, any_value(w.c) AS c,
    avg(CASE WHEN ({_P} >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS acc, -avg(label * ln({_P}) + (1 - label) * ln(1 - {_P})) AS loss
    FROM d JOIN {after} w USING (client_id) GROUP BY client_id)"""


def _mean(name: str, of: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"sum(n * {w}) / sum(n) AS {w}" for w in "abc") + f" FROM {of})"


def _rounds_sql(rounds: int, epochs: int, mu: float) -> str:
    ctes, out = [], []
    for r in range(rounds):
        ctes.append(_spread(f"w{r}_0", f"s{r}"))
        ctes += [_step(f"w{r}_{e + 1}", f"w{r}_{e}", f"s{r}", mu) for e in range(epochs)]
        ctes += [_result(f"r{r}", f"w{r}_{epochs}"), _mean(f"s{r + 1}", f"r{r}")]
        out.append(
            f"""SELECT {r + 1}::BIGINT AS round, count(*) AS clients, CAST(sum(n) AS BIGINT) AS n, round(sum(n * acc) / sum(n), 6) AS train_accuracy,
            round(sum(n * loss) / sum(n), 6) AS train_loss, round((SELECT a FROM s{r + 1}), 6) AS w0, round((SELECT b FROM s{r + 1}), 6) AS w1,
            round((SELECT c FROM s{r + 1}), 6) AS w2 FROM r{r}"""
        )
    return f"WITH {CLIENT_ROWS}, {_START}" + ", ".join(ctes) + " " + " UNION ALL ".join(out)


def _weight_columns(df):
    return df.select(*[q(x) for x in df.columns if x != "weights"], *[q("weights")[i].alias(f"w{i}") for i in range(3)])


@query(
    "j6_local_update",
    f"""WITH {CLIENT_ROWS}, {_START} {_spread('u0', 's0')}, {_step('u1', 'u0', 's0', 0.0)}, {_step('u2', 'u1', 's0', 0.0)}, {_result('r', 'u2')}
    SELECT CAST(client_id AS BIGINT) AS client_id, n, round(acc, 6) AS train_accuracy, round(loss, 6) AS train_loss,
    round(a, 6) AS w0, round(b, 6) AS w1, round(c, 6) AS w2 FROM r""",
)
def _(spark, sf):
    return final(_weight_columns(averaging.local_update(clients(spark, sf), [0.0] * 3, CLIENT_FEATURES, epochs=2)))


@query(
    "j7_average_weights",
    f"""WITH {FLOWS}, u AS (SELECT src_ip, count(*) AS n, avg(duration) AS w0, avg(dst_port) AS w1, avg(packets_bwd) AS w2 FROM flows GROUP BY 1)
    SELECT 0::BIGINT AS index, round(sum(n * w0) / sum(n), 6) AS weight FROM u UNION ALL
    SELECT 1, round(sum(n * w1) / sum(n), 6) FROM u UNION ALL SELECT 2, round(sum(n * w2) / sum(n), 6) FROM u""",
)
def _(spark, sf):
    updates = flows(spark, sf).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(F.avg("duration"), F.avg("dst_port"), F.avg("packets_bwd")).alias("weights"),
    )
    return final(averaging.average_weights(updates))


@query("j7_fedavg", _rounds_sql(2, 1, 0.0))
def _(spark, sf):
    return final(_weight_columns(averaging.fedavg(clients(spark, sf), CLIENT_FEATURES, rounds=2, seed=SEED)[1]))


@query("j8_fedprox", _rounds_sql(2, 2, 0.1))
def _(spark, sf):
    history = averaging.fedprox(clients(spark, sf), CLIENT_FEATURES, mu=0.1, rounds=2, epochs=2, seed=SEED)[1]
    return final(_weight_columns(history))


@query("j9_feature_importances", "SELECT 'packets_bwd' AS first_feature, 5::BIGINT AS features, 1.0::DOUBLE AS total")
def _(spark, sf):
    model = models.random_forest(_train(assembled(spark, sf)))
    found = models.feature_importances(model, FEATURES)
    return final(found.agg(F.max_by("feature", "importance").alias("first_feature"), F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total")))


@query("j10_predict", f"{RULED_SPLIT} SELECT event_id, label, label AS prediction, label = 1 AS likelier FROM parted WHERE split = 'test'")
def _(spark, sf):
    df = assembled(spark, sf)
    model = models.random_forest(_train(df))
    return final(models.predict(model, _test(df)).select("event_id", "label", "prediction", (q("score") > 0.5).alias("likelier")))


FOLDS = 5


@query(
    "j11_cross_validate",
    f"""WITH {RULED}, c AS (SELECT label, count(*) AS n, sum(count(*)) OVER (ORDER BY label) - count(*) AS off, sum(count(*)) OVER () AS total FROM ruled GROUP BY 1),
    f AS (SELECT i, label, total, floor((off + n + {FOLDS - 1} - i) / {FOLDS}) - floor((off + {FOLDS - 1} - i) / {FOLDS}) AS size FROM c, (SELECT unnest(range({FOLDS})) AS i))
    SELECT CAST(i + 1 AS BIGINT) AS fold, {_PERFECT}, CAST(any_value(total) - sum(size) AS BIGINT) AS train_size, CAST(sum(size) AS BIGINT) AS val_size,
    CAST(sum(size) FILTER (label = 1) AS BIGINT) AS val_pos_count, CAST(sum(size) FILTER (label = 0) AS BIGINT) AS val_neg_count FROM f GROUP BY i""",
)
def _(spark, sf):
    df = assembled(spark, sf).select("event_id", "label", "features")
    folds = sampling.stratified_kfold(df, FOLDS, "label", ID, SEED)
    return final(models.cross_validate(folds, models.random_forest, FOLDS))


@query("j12_train_centralized", _TEST_METRICS)
def _(spark, sf):
    return final(models.train_centralized(split_table(spark, sf), FEATURES, models.random_forest)[1].select(*_METRICS))


_PROTO = ("tcp", "udp", "icmp", "ipx/spx")
_STATE = ("CON", "FSPA_FSPA", "S_", "INT")
_CTU_COMPLETE = """complete AS (SELECT *, StartTime AS "timestamp", SrcAddr AS src_ip, DstAddr AS dst_ip, Dport AS dst_port, Proto AS protocol, TotBytes AS bytes_total,
  TotPkts AS total_packets FROM ctu WHERE Dur IS NOT NULL AND State IS NOT NULL AND label_text IS NOT NULL)"""


@query(
    "b31_preprocess_ctu",
    f"""WITH {CTU}, {_CTU_COMPLETE}, {split_sql('complete', 'label', key_sql('event_id'))}, train AS (SELECT * FROM parted WHERE split = 'train'),
    {IAT.format(base='train')}, {PERIODICITY}, {SRC_FAMILIES}
    SELECT event_id, StartTime, {rnd('Dur')}, Proto, SrcAddr, CAST(Sport AS BIGINT) AS Sport, Dir, DstAddr, CAST(Dport AS BIGINT) AS Dport, State,
    CAST(sTos AS BIGINT) AS sTos, CAST(dTos AS BIGINT) AS dTos, TotPkts, {rnd('TotBytes', 'SrcBytes')}, label_text, CAST(label AS BIGINT) AS label, scenario,
    CAST(hour(StartTime) AS BIGINT) AS hour, CAST(isodow(StartTime) - 1 AS BIGINT) AS day_of_week, CAST(floor(epoch(StartTime)) AS BIGINT) AS timestamp_seconds,
    round(TotBytes / (TotPkts + 1), 6) AS bytes_per_packet, round(SrcBytes / (TotBytes + 1), 6) AS src_bytes_ratio,
    round(ln(1 + Dur), 6) AS Dur_log, round(ln(1 + TotPkts), 6) AS TotPkts_log, round(ln(1 + TotBytes), 6) AS TotBytes_log, round(ln(1 + SrcBytes), 6) AS SrcBytes_log, """
    + ", ".join(f"CAST(Proto = '{v}' AS BIGINT) AS \"proto_{v}\"" for v in _PROTO)
    + ", CAST(Sport > 0 AND Sport < 1024 AS BIGINT) AS is_common_src_port, CAST(Dport > 0 AND Dport < 1024 AS BIGINT) AS is_common_dst_port, "
    + ", ".join(f"CAST(State = '{v}' AS BIGINT) AS \"state_{v}\"" for v in _STATE)
    + f", {BLOCK}, split FROM parted {BLOCK_JOINS}",
)
def _(spark, sf):
    from flowtide.catalog.behavior import scored

    out = datasets.preprocess_ctu(ctu_text(spark, sf), ID, SEED)
    return scored(out, "periodicity_score", "bytes_consistency_score", "pkts_consistency_score")


_UGR_COMPLETE = f"""complete AS (SELECT *, CAST(coalesce(regexp_matches(lower(label), 'anomaly|blacklist'), false) AS INT) AS is_malicious,
  packets_fwd + packets_bwd AS total_packets FROM flows WHERE src_port IS NOT NULL AND tos IS NOT NULL AND bytes_total IS NOT NULL AND label IS NOT NULL)"""
_TOP_PORTS = "(SELECT dst_port FROM flows GROUP BY 1 ORDER BY count(*) DESC, dst_port LIMIT 20)"


@query(
    "b31_preprocess_ugr",
    f"""WITH {FLOWS}, {_UGR_COMPLETE}, {split_sql('complete', 'is_malicious', key_sql('event_id'))}, train AS (SELECT * FROM parted WHERE split = 'train'),
    {IAT.format(base='train')}, {PERIODICITY}, {SRC_FAMILIES}
    SELECT event_id, parted."timestamp", {rnd('duration')}, parted.src_ip, parted.dst_ip, src_port, dst_port, protocol, flags, tos, packets_fwd, packets_bwd,
    {rnd('bytes_total')}, label, CAST(is_malicious AS BIGINT) AS is_malicious, CAST(is_malicious AS BIGINT) AS binary_label,
    CAST(hour("timestamp") AS BIGINT) AS hour, CAST(isodow("timestamp") - 1 AS BIGINT) AS day_of_week, CAST(floor(epoch("timestamp")) AS BIGINT) AS timestamp_seconds,
    total_packets, round(packets_fwd / (total_packets + 1), 6) AS fwd_packet_ratio, round(bytes_total / (total_packets + 1), 6) AS bytes_per_packet,
    round(ln(1 + duration), 6) AS duration_log, round(ln(1 + packets_fwd), 6) AS packets_fwd_log, round(ln(1 + packets_bwd), 6) AS packets_bwd_log,
    round(ln(1 + bytes_total), 6) AS bytes_total_log, """
    + ", ".join(f"CAST(protocol = '{v}' AS BIGINT) AS \"proto_{v}\"" for v in ("TCP", "UDP", "ICMP", "ipx/spx"))
    + ", CAST(src_port > 0 AND src_port < 1024 AS BIGINT) AS is_common_src_port, CAST(dst_port > 0 AND dst_port < 1024 AS BIGINT) AS is_common_dst_port, "
    + f"CASE WHEN dst_port IN {_TOP_PORTS} THEN 'dst_port_' || dst_port ELSE '' END AS port_set, "
    + f"(SELECT string_agg('dst_port_' || dst_port, ',' ORDER BY 'dst_port_' || dst_port) FROM {_TOP_PORTS} p) AS port_columns, "
    + ", ".join(f"CAST(flags = '{v}' AS BIGINT) AS \"flag_{v}\"" for v in (".A....", ".AP.SF", "....S.", ".APRSF"))
    + f", {BLOCK}, split FROM parted {BLOCK_JOINS}",
)
def _(spark, sf):
    """The 20 port columns carry names that depend on the data: their names, and those that are 1 in a row, are listed."""
    from flowtide.catalog.behavior import scored

    out = datasets.preprocess_ugr(flows(spark, sf), ID, SEED)
    ports = [x for x in out.columns if x.startswith("dst_port_") and x != "dst_port_entropy"]
    ports.sort()
    named = F.concat_ws(",", *[F.when(q(x) == 1, F.lit(x)) for x in ports])
    out = out.withColumn("port_set", named).withColumn("port_columns", F.lit(",".join(ports))).drop(*ports)
    return scored(out, "periodicity_score", "bytes_consistency_score", "pkts_consistency_score")
