"""Registry and the flow tables that queries derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.columns import q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def final(df: DataFrame, digits: int = 6, **column_digits: int | None) -> DataFrame:
    """Doubles rounded and integers widened, so that both engines print the same values.

    Per column other digits can be given; None leaves a value alone that is exact in both.
    """
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        places = column_digits.get(f.name, digits)
        if kind in ("double", "float", "decimal") and places is not None:
            out.append(F.round(q(f.name).cast("double"), places).alias(f.name))
        elif kind in ("integer", "short", "byte"):
            out.append(q(f.name).cast("bigint").alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


# One projection of `events` to flows with the semantic column names, valid in both SQL dialects.
_PORT = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_PROTO = f"CASE WHEN {_PORT} % 10 < 6 THEN 'TCP' WHEN {_PORT} % 10 < 8 THEN 'UDP' WHEN {_PORT} % 10 = 8 THEN 'ICMP' ELSE 'ipx/spx' END"
_FLOW_COLUMNS = {
    "event_id": "event_id",
    "timestamp": "ts",
    "duration": "value",
    "src_ip": "CAST(user_id AS STRING)",
    "dst_ip": "event_type",
    "src_port": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id * 7) % 3000 END",
    "dst_port": _PORT,
    "protocol": _PROTO,
    "flags": "CASE event_id % 4 WHEN 0 THEN '.A....' WHEN 1 THEN '.AP.SF' WHEN 2 THEN '....S.' ELSE '.APRSF' END",
    "tos": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_id % 3 END",
    "packets_fwd": f"{_PORT} + 1",
    "packets_bwd": "event_id % 5",
    "bytes_total": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * 100 END",
    "label": "CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_type = 'error' THEN 'anomaly-sshscan' "
    "WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'blacklist' ELSE 'background' END",
}

# The same events as the text of a headered flow file, with the oddities cleaning must cope with.
_CTU_COLUMNS = {
    "event_id": "event_id",
    "StartTime": "CASE WHEN event_id % 97 = 0 THEN 'not a time' ELSE {time_text} END",
    "Dur": "CASE WHEN event_id % 89 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END",
    "Proto": f"lower({_PROTO})",
    "SrcAddr": "CAST(user_id AS STRING)",
    "Sport": "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '-' "
    "WHEN event_id % 7 = 0 THEN '0x' || lower(hex((event_id * 7) % 3000)) WHEN event_id % 23 = 0 THEN 'http' "
    "ELSE CAST((event_id * 7) % 3000 AS STRING) END",
    "Dir": "CASE WHEN event_id % 3 = 0 THEN '<->' ELSE '->' END",
    "DstAddr": "event_type",
    "Dport": f"CASE WHEN event_id % 29 = 0 THEN '80.0' WHEN event_id % 7 = 0 THEN '0x' || lower(hex({_PORT})) "
    f"ELSE CAST({_PORT} AS STRING) END",
    "State": "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'CON' WHEN event_id % 5 = 1 THEN 'FSPA_FSPA' "
    "WHEN event_id % 5 = 2 THEN 'S_' ELSE 'INT' END",
    "sTos": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 3 AS STRING) END",
    "dTos": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE '0' END",
    "TotPkts": f"CAST({_PORT} + 1 + event_id % 5 AS STRING)",
    "TotBytes": "CAST(CAST(round(value * 100) AS BIGINT) AS STRING)",
    "SrcBytes": "CAST(CAST(round(value * 60) AS BIGINT) AS STRING)",
    "Label": "CASE WHEN event_id % 101 = 0 THEN NULL "
    "WHEN event_type = 'error' THEN 'flow=From-Botnet-V' || CAST(40 + user_id % 13 AS STRING) || '-TCP-CC' "
    "ELSE 'flow=Background-' || event_type END",
}
_SPARK_TIME = "date_format(ts, 'yyyy/MM/dd HH:mm:ss.SSSSSS')"
_DUCK_TIME = "strftime(ts, '%Y/%m/%d %H:%M:%S.%f')"


def _projection(columns: dict[str, str], quote: str, time_text: str) -> str:
    return ", ".join(f"{e.replace('{time_text}', time_text)} AS {quote}{n}{quote}" for n, e in columns.items())


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed flows with the headerless files' column names, plus event_id as row id."""
    return table(spark, sf_dir, "events").selectExpr(
        *[f"{e} AS `{n}`" for n, e in _FLOW_COLUMNS.items()]
    )


def ctu_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text flows as a headered flow file holds them, plus event_id as row id."""
    return table(spark, sf_dir, "events").selectExpr(
        *[f"{e.replace('{time_text}', _SPARK_TIME)} AS `{n}`" for n, e in _CTU_COLUMNS.items()]
    )


KEYWORDS_SQL = "coalesce(regexp_matches(lower(label), 'botnet|attack|anomaly|malicious|ddos|worm|spam|blacklist'), false)"
FLOWS = f"flows AS (SELECT {_projection(_FLOW_COLUMNS, chr(34), '')} FROM events)"
# Flows with the malicious flag and packet total.
MARKED = f"{FLOWS}, marked AS (SELECT *, CAST({KEYWORDS_SQL} AS INT) AS is_malicious, packets_fwd + packets_bwd AS total_packets FROM flows)"
CTU_TEXT = f"ctu_text AS (SELECT {_projection(_CTU_COLUMNS, chr(34), _DUCK_TIME)} FROM events)"


def port_sql(column: str, default: str = "0") -> str:
    """Port rule in the other engine's SQL."""
    return (
        f"CASE WHEN regexp_full_match({column}, '0x[0-9a-fA-F]+') THEN CAST({column} AS INT) "
        f"WHEN regexp_full_match(trim({column}), '[+-]?[0-9]+') THEN TRY_CAST(trim({column}) AS INT) ELSE NULL END"
        if default == "NULL"
        else f"coalesce({port_sql(column, 'NULL')}, 0)"
    )


# Cleaned and labelled headered flows.
CTU = f"""{CTU_TEXT}, ctu AS (
  SELECT event_id, try_strptime(StartTime, '%Y/%m/%d %H:%M:%S.%f') AS StartTime, TRY_CAST(Dur AS DOUBLE) AS Dur, Proto, SrcAddr,
    {port_sql('Sport')} AS Sport, Dir, DstAddr, {port_sql('Dport')} AS Dport, State,
    CAST(coalesce(TRY_CAST(sTos AS DOUBLE), 0) AS INT) AS sTos, CAST(coalesce(TRY_CAST(dTos AS DOUBLE), 0) AS INT) AS dTos,
    TRY_CAST(TotPkts AS BIGINT) AS TotPkts, TRY_CAST(TotBytes AS DOUBLE) AS TotBytes, TRY_CAST(SrcBytes AS DOUBLE) AS SrcBytes,
    Label AS label_text, CAST(coalesce(Label ILIKE '%botnet%', false) AS INT) AS label,
    CASE WHEN regexp_extract(coalesce(Label, ''), '(V[0-9][0-9])', 1) = '' THEN 'Unknown'
         ELSE regexp_extract(Label, '(V[0-9][0-9])', 1) END AS scenario
  FROM ctu_text WHERE try_strptime(StartTime, '%Y/%m/%d %H:%M:%S.%f') IS NOT NULL)"""


def rnd(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def key_sql(*ids: str, seed: int = SEED) -> str:
    return "md5(concat_ws(':', " + ", ".join(f"CAST({i} AS STRING)" for i in ids) + f", '{seed}'))"


def split_sql(base: str, label: str, key: str, test: str = "0.2", val: str = "0.125", name: str = "parted") -> str:
    """CTEs that add `split` to `base` by the largest-remainder rule; val is val/(1-test)."""

    def share(n: str, draws: str, total: str) -> str:
        return f"({n}) * ({draws}) / ({total})"

    ex1, ex2 = share("n", "total - ceil(" + test + " * total)", "total"), share("kept", "tv - ceil(" + val + " * tv)", "tv")
    return f"""
  _keyed AS (SELECT *, {key} AS _k FROM {base}),
  _cls AS (SELECT {label} AS y, count(*) AS n, sum(count(*)) OVER () AS total FROM _keyed GROUP BY {label}),
  _a AS (SELECT y, n, total, {ex1} AS ex, total - ceil({test} * total) AS draws FROM _cls),
  _b AS (SELECT *, row_number() OVER (ORDER BY round(ex - floor(ex), 9) DESC, y) AS pl, draws - sum(floor(ex)) OVER () AS lft FROM _a),
  _c AS (SELECT y, n, floor(ex) + CASE WHEN pl <= lft THEN 1 ELSE 0 END AS kept FROM _b),
  _d AS (SELECT *, sum(kept) OVER () AS tv FROM _c),
  _e AS (SELECT *, {ex2} AS ex, tv - ceil({val} * tv) AS draws FROM _d),
  _f AS (SELECT *, row_number() OVER (ORDER BY round(ex - floor(ex), 9) DESC, y) AS pl, draws - sum(floor(ex)) OVER () AS lft FROM _e),
  _g AS (SELECT y, n, n - kept AS test_rows, kept - (floor(ex) + CASE WHEN pl <= lft THEN 1 ELSE 0 END) AS val_rows FROM _f),
  _h AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY _k) - 1 AS _r FROM _keyed),
  {name} AS (SELECT _h.*, CASE WHEN _r < test_rows THEN 'test' WHEN _r < test_rows + val_rows THEN 'val' ELSE 'train' END AS split
    FROM _h JOIN _g ON _h.{label} IS NOT DISTINCT FROM _g.y)"""
