"""One query per text operator over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import decontamination, fingerprints, jaccard_join, language, outliers, periodic_runs, personal_data, pieces, quality, sharding, token_alignment, token_counts, toxicity
from flowtide.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents; their columns are the names the operators default to."""
    return table(spark, sf_dir, "documents")


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data.find_spans(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(personal_data.KINDS[:4])]
    return spans.select("doc_id", *counts, F.sha2(personal_data.listed(base), 256).alias("base_sha256"), personal_data.listed(F.col("spans")).alias("spans"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _documents(spark, sf_dir), fold("doc_id", 4, 2)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _documents(spark, sf_dir), fold("doc_id", 4, 2)
    model = language.learn(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# CRC-32 in SQL: the table from its polynomial by rule, then one step per byte of the UTF-8 text.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
    list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(generate_series(0::BIGINT, 255)) AS i)))"""
_UTF8 = """flatten(list_transform(list_transform(string_split(text, ''), lambda ch: unicode(ch)::BIGINT), lambda u: CASE WHEN u < 128 THEN [u]
    WHEN u < 2048 THEN [192 + u // 64, 128 + u % 64] WHEN u < 65536 THEN [224 + u // 4096, 128 + u // 64 % 64, 128 + u % 64]
    ELSE [240 + u // 262144, 128 + u // 4096 % 64, 128 + u // 64 % 64, 128 + u % 64] END))"""


@query(
    "op5_sharding",
    f"""
WITH {_CRC_TABLE},
docs AS (SELECT doc_id, source, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(concat_ws(':', doc_id, '42')) AS k FROM documents),
crc AS (SELECT doc_id, source, size, k, CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {_UTF8}),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) END AS text_crc32 FROM docs, crc_table),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM crc),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2 * n), source NULLS FIRST, k, doc_id, text_crc32, size) - 1 AS p, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 16 // total AS INTEGER) AS shard,
    CAST(p - (p * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_pieces")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes the ids again and reports digests of both."""
    both = pieces.round_trip(_documents(spark, sf_dir), pieces.Vocabulary.load())
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits per document: a replacement at one third, an insertion at two thirds, a cut at the end."""
    n = F.char_length("text")

    def change(start, end, new):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("text"))

    edits = F.array(
        change(F.floor(n / 3), F.floor(n / 3) + 20, F.expr("right(text, 10)")),
        change(F.floor(2 * n / 3), F.floor(2 * n / 3), F.expr("left(text, 16)")),
        change(n - 5, n + 10, F.lit("")),
    )
    docs = _documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits"))
    counted = token_counts.count_tokens(docs)
    return counted.select("doc_id", "n_tokens", "n_tokens_edited", "n_pretokens_recounted", F.sha2("edited_text", 256).alias("edited_sha256"))


_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sketch_sql(text: str) -> str:
    """Bottom-128 sketch of a text in the other engine's SQL."""
    w = f"regexp_extract_all({_LOWER.format(t=text)}, '[^\\x20\\x09-\\x0D]+')"
    hashes = "list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: md5(array_to_string(w[i:i + 4], ' '))[1:16])"
    return f"(SELECT CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct({hashes}))[1:128] END FROM (SELECT {w} AS w))"


def _near_sql(a: str, b: str) -> str:
    both = f"list_sort(list_distinct(list_concat({a}, {b})))[1:128]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({both}, list_intersect({a}, {b})))::DOUBLE / len({both}) END"


@query(
    "op8_fingerprints",
    f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, len(coalesce(text, '')) AS n FROM documents),
nexts AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nt
    FROM docs WINDOW w AS (ORDER BY doc_id DESC, md5(text) DESC)),
edits AS (SELECT doc_id, n, text, nt, concat(text[1:n - n // 3], CASE WHEN n // 3 > 0 THEN nt[1:n // 3] ELSE '' END) AS ed FROM nexts),
prints AS (SELECT doc_id, n, ed, {_sketch_sql('text')} AS a, {_sketch_sql('ed')} AS b, {_sketch_sql('nt')} AS c FROM edits)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
    {_near_sql('a', 'b')} AS near_edited, {_near_sql('a', 'c')} AS near_next
FROM prints""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprints.with_next(docs, ["text", "sketch"], "doc_id", "text", prepare=fingerprints.sketch)
    rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("_next_text")))
    rows = fingerprints.sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("_next_sketch")).alias("near_next"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op9_decontamination",
    f"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 13) - 1] AS win FROM (
    SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM wins),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs),
found AS (SELECT doc_id, i, l, item_id FROM (SELECT doc_id, i, l, w[i:i + l - 1] AS win FROM pos, lens WHERE i + l - 1 <= len(w)) JOIN wins USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM found)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3, 1)
    scored = quality.fit_and_score(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_SHINGLES_SQL = f"""
words AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t='text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION
    SELECT reach.doc_id, CASE WHEN links.a = reach.r THEN links.b ELSE links.a END FROM reach JOIN links ON links.a = reach.r OR links.b = reach.r)"""


@query(
    "op4_jaccard_join",
    f"""
WITH RECURSIVE {_SHINGLES_SQL}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir))


@query(
    "op11_periodic_runs",
    f"""
WITH {_CRC_TABLE},
ids AS (SELECT doc_id, coalesce(text, '') AS body, CAST(doc_id AS VARCHAR) AS text FROM documents),
crc AS (SELECT doc_id, body, xor(list_reduce(list_prepend(4294967295::BIGINT, {_UTF8}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h
    FROM ids, crc_table),
given AS (SELECT doc_id, h, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w FROM crc),
sized AS (SELECT *, len(w) AS n, (h // 10) % len(w) AS a FROM given),
placed AS (SELECT *, (n - a) // (3 + (h // 10) % 8) + 1 AS p FROM sized),
words AS (SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS x FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
same AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM words u JOIN words v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i AND 2 * (v.i - u.i) <= u.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(start ORDER BY length DESC, start, period) AS start, first(length ORDER BY length DESC, start, period) AS length,
    first(period ORDER BY length DESC, start, period) AS period FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
    CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document gets a periodic tail first, as the query's definition asks."""
    found = periodic_runs.find_runs(periodic_runs.with_repeated_tail(_documents(spark, sf_dir)))
    found = found.withColumn("best", periodic_runs.longest(F.col("runs")))
    length, period = F.col("best.length"), -F.col("best.minus")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length DIV -best.minus").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(_documents(spark, sf_dir))


@query("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_documents(spark, sf_dir))
