"""Ranks, samples, splits, folds and client partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.catalog.registry import MARKED, SEED, final, key_sql, query, split_sql, table
from flowtide.catalog.rows import marked
from flowtide.functions.columns import q
from flowtide.operators import sampling, scale
from flowtide.sources import files

ORDER_KEY = key_sql("o_orderkey")
TIE_KEY = key_sql("o_orderkey", seed=0)
ID = ["o_orderkey"]


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query(
    "e2_distributed_rank",
    f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER_KEY}) - 1 AS rank FROM orders",
)
def _(spark, sf):
    return scale.distributed_rank(orders(spark, sf).select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ID, SEED)


@query("f1_sort_by_time", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def _(spark, sf):
    return sampling.sort_by_time(orders(spark, sf).select("o_orderkey", "o_orderdate"), "o_orderdate", ID)


@query(
    "f3_first_n_by_time",
    f"SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, {TIE_KEY} LIMIT 1000",
)
def _(spark, sf):
    return sampling.first_n_by_time(orders(spark, sf).select("o_orderkey", "o_orderdate"), 1000, "o_orderdate", ID)


@query("f4_shuffle", f"SELECT o_orderkey, {ORDER_KEY} AS shuffle_key FROM orders")
def _(spark, sf):
    return sampling.shuffle(orders(spark, sf).select("o_orderkey"), ID, SEED)


@query(
    "g1_union_splits",
    """SELECT c_custkey AS id, c_nationkey AS nation, round(c_acctbal, 6) AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey, round(s_acctbal, 6), NULL FROM supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    s = table(spark, sf, "supplier").selectExpr("s_acctbal AS balance", "s_suppkey AS id", "s_nationkey AS nation")
    return final(files.union_splits([c, s]))


@query("g2_union_classes", f"WITH {MARKED} SELECT event_id, CAST(is_malicious AS BIGINT) AS is_malicious FROM marked")
def _(spark, sf):
    df = marked(spark, sf).select("event_id", "is_malicious")
    return final(sampling.union_classes(df.where(q("is_malicious") == 1), df.where(q("is_malicious") == 0)))


@query("h1_sample_exact", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {ORDER_KEY} LIMIT 2000")
def _(spark, sf):
    return sampling.sample_exact(orders(spark, sf).select("o_orderkey", "o_custkey"), 2000, ID, SEED)


@query("h2_sample_rows", f"SELECT event_id, user_id FROM events ORDER BY {key_sql('event_id', seed=7)} LIMIT 1500")
def _(spark, sf):
    return sampling.quick_sample(table(spark, sf, "events").select("event_id", "user_id"), 1500, ["event_id"], 7)


@query(
    "h3_stratified_sample",
    f"""WITH {MARKED}, s AS (SELECT count(*) AS n, count(*) FILTER (is_malicious = 1) AS pos FROM marked),
    l AS (SELECT n, pos, least(CAST(floor(3000 * greatest(pos / n, 0.5)) AS BIGINT), pos) AS m FROM s),
    r AS (SELECT event_id, is_malicious, row_number() OVER (PARTITION BY is_malicious ORDER BY {key_sql('event_id')}) AS r FROM marked)
    SELECT event_id, CAST(is_malicious AS BIGINT) AS is_malicious FROM r, l
    WHERE n <= 3000 OR r <= CASE WHEN is_malicious = 1 THEN m ELSE least(3000 - m, n - pos) END""",
)
def _(spark, sf):
    df = marked(spark, sf).select("event_id", "is_malicious")
    return final(sampling.stratified_sample(df, 3000, 0.5, q("is_malicious") == 1, ["event_id"], SEED))


@query(
    "h4_stratified_split",
    f"WITH {split_sql('orders', 'o_orderstatus', ORDER_KEY)} SELECT o_orderkey, o_orderstatus, split FROM parted",
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return sampling.stratified_split(df, "o_orderstatus", ID, SEED)


K = 5


@query(
    "h5_stratified_kfold",
    f"""WITH c AS (SELECT o_orderstatus AS y, count(*) AS n, sum(count(*)) OVER (ORDER BY o_orderstatus) - count(*) AS off FROM orders GROUP BY 1),
    f AS (SELECT y, i, floor((off + n + {K - 1} - i) / {K}) - floor((off + {K - 1} - i) / {K}) AS size FROM c, (SELECT unnest(range({K})) AS i)),
    b AS (SELECT y, i, sum(size) OVER (PARTITION BY y ORDER BY i) AS stop, sum(size) OVER (PARTITION BY y ORDER BY i) - size AS start FROM f),
    r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER_KEY}) - 1 AS r FROM orders)
    SELECT o_orderkey, o_orderstatus, CAST(i AS BIGINT) AS fold FROM r JOIN b ON y = o_orderstatus AND r >= start AND r < stop""",
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return final(sampling.stratified_kfold(df, K, "o_orderstatus", ID, SEED))


@query(
    "h6_stratified_group_kfold",
    f"""WITH c AS (SELECT o_custkey, o_orderstatus AS class, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_orderstatus) AS total FROM orders GROUP BY 1, 2),
    g AS (SELECT o_custkey, class, total, n AS most, sum(n) OVER (PARTITION BY o_custkey) AS size FROM c
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n::DOUBLE / total DESC, total, class) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY most DESC, size DESC, md5(concat('{{"o_custkey":', o_custkey, '}}:{SEED}'))) - 1 AS place FROM g),
    b AS (SELECT class, CAST(sum(count(*)) OVER (ORDER BY total, class) - count(*) AS BIGINT) % {K} AS first FROM g GROUP BY class, total)
    SELECT o_orderkey, o_custkey, o_orderstatus,
        CAST((CASE WHEN place // {K} % 2 = 0 THEN place % {K} ELSE {K - 1} - place % {K} END + first) % {K} AS BIGINT) AS fold
    FROM orders JOIN p USING (o_custkey) JOIN b USING (class)""",
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus")
    return final(sampling.stratified_group_kfold(df, K, "o_orderstatus", "o_custkey", SEED))


@query("h6_group_integrity", "SELECT o_custkey, count(*) AS rows_in_group, 1::BIGINT AS folds FROM orders GROUP BY 1")
def _(spark, sf):
    """Every group lies in one fold and keeps all its rows."""
    df = orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderstatus")
    placed = sampling.stratified_group_kfold(df, K, "o_orderstatus", "o_custkey", SEED)
    return placed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows_in_group"), F.count_distinct("fold").alias("folds"))


def _time_split_sql(test: str, gap: int, first: str) -> str:
    return f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, {TIE_KEY}) - 1 AS r, count(*) OVER () AS n FROM orders),
    t AS (SELECT *, {test} AS t FROM r), f AS (SELECT t.*, i, n - ({K} - i) * t AS start FROM t, (SELECT unnest(range({K})) AS i))
    SELECT o_orderkey, CAST(i AS BIGINT) AS fold, CASE WHEN r >= start THEN 'test' ELSE 'train' END AS role FROM f
    WHERE (r >= start AND r < start + t) OR (r < start - {gap} AND r >= {first})"""


@query("h7_time_series_split", _time_split_sql(f"n // {K + 1}", 0, "0"))
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderdate")
    return final(sampling.time_series_split(df, K, "o_orderdate", ID).drop("o_orderdate"))


@query(
    "h7_time_series_split_gap",
    _time_split_sql("greatest(1, CAST(floor(n * 0.1) AS BIGINT))", 100, "greatest(0, start - 100 - 5000)"),
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderdate")
    return final(sampling.time_series_split(df, K, "o_orderdate", ID, 0.1, 100, 5000).drop("o_orderdate"))


CLIENTS = 7


@query(
    "h8_partition_iid",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {ORDER_KEY}) - 1 AS r, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN r < (n % {CLIENTS}) * (n // {CLIENTS} + 1) THEN r // (n // {CLIENTS} + 1)
    ELSE n % {CLIENTS} + (r - (n % {CLIENTS}) * (n // {CLIENTS} + 1)) // (n // {CLIENTS}) END AS client_id FROM r""",
)
def _(spark, sf):
    return final(sampling.partition_iid(orders(spark, sf).select("o_orderkey"), CLIENTS, ID, SEED))


SHARES = {"F": [0.15, 0.55, 0.05, 0.25], "O": [0.4, 0.1, 0.3, 0.2], "P": [0.05, 0.05, 0.85, 0.05]}
_SHARE_ROWS = ", ".join(f"('{y}', {i}, {p}::DOUBLE)" for y, ps in SHARES.items() for i, p in enumerate(ps))


@query(
    "h9_partition_dirichlet",
    f"""WITH p AS (SELECT * FROM (VALUES {_SHARE_ROWS}) v(y, i, p)), c AS (SELECT o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT p.y, i, CAST(floor(p * n) AS BIGINT) AS size, n FROM p JOIN c ON p.y = c.y),
    z AS (SELECT y, i, size + CASE WHEN i = 0 THEN n - sum(size) OVER (PARTITION BY y) ELSE 0 END AS size FROM s),
    b AS (SELECT y, i, sum(size) OVER (PARTITION BY y ORDER BY i) AS stop, sum(size) OVER (PARTITION BY y ORDER BY i) - size AS start FROM z),
    r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER_KEY}) - 1 AS r FROM orders)
    SELECT o_orderkey, o_orderstatus, CAST(i AS BIGINT) AS client_id FROM r JOIN b ON y = o_orderstatus AND r >= start AND r < stop""",
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return final(sampling.partition_dirichlet(df, 4, "o_orderstatus", ID, SEED, proportions=SHARES))


@query(
    "h10_client_val_split",
    f"""WITH o AS (SELECT o_orderkey, o_custkey % 20 AS client_id, o_orderstatus FROM orders),
    c AS (SELECT client_id, o_orderstatus AS y, count(*) AS n, sum(count(*)) OVER (PARTITION BY client_id) AS total FROM o GROUP BY 1, 2),
    a AS (SELECT *, total - CASE WHEN total > 1 THEN ceil(0.2 * total) ELSE 0 END AS draws FROM c),
    e AS (SELECT *, n * draws / total AS ex FROM a),
    p AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round(ex - floor(ex), 9) DESC, y) AS pl, draws - sum(floor(ex)) OVER (PARTITION BY client_id) AS lft FROM e),
    v AS (SELECT client_id, y, n - (floor(ex) + CASE WHEN pl <= lft THEN 1 ELSE 0 END) AS val_rows FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY client_id, o_orderstatus ORDER BY {ORDER_KEY}) - 1 AS r FROM o)
    SELECT o_orderkey, r.client_id, o_orderstatus, CASE WHEN r < val_rows THEN 'val' ELSE 'train' END AS split
    FROM r JOIN v ON r.client_id = v.client_id AND o_orderstatus = y""",
)
def _(spark, sf):
    df = orders(spark, sf).select("o_orderkey", (q("o_custkey") % 20).alias("client_id"), "o_orderstatus")
    return sampling.client_val_split(df, 0.2, "o_orderstatus", ID, SEED)
