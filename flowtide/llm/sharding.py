"""Sharding by proportional stratified interleaving.

Rows get a seeded shuffle rank within their source. Their fractional rank
((2 rank + 1) / (2 rows of the source)) spreads every source evenly over [0, 1];
all rows in order of fractional rank are cut into shards of equal row count, so
every shard holds each source in the proportion of the whole table.

Both ranks are found without gathering a source or the table in one task: rows
fall into cells (ranges of the shuffle key within a source, ranges of the
fractional rank over all sources) of some thousand rows, cells are counted and
added up block by block, and a row's rank is the rows in earlier cells plus its rank within its own cell.

Law: `rows`, shards' row counts differ by at most one. Equal texts are not kept
together: the mixture decides.

Defined cases: a row without id is placed by its text; a null source is a source of its own; a null text has size 1 and
the crc32 of no bytes (0); repeated ids are ordered by checksum and size, and
exact copies share ranks among themselves arbitrarily; an empty table gives no
rows; only the columns named below are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.session import materialize

CELL_ROWS = 4_000
BLOCK_CELLS = 1_000


def shuffle_key(doc_id: str, text: str, seed: int) -> Column:
    """Seeded hash of the id; of the text for a row without one, so that such rows spread over the cells too."""
    named = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.md5(F.concat_ws(":", named, F.lit(str(seed))))


def rows_before(cells: DataFrame, parts: list[str]) -> DataFrame:
    """(parts, _at, _before): rows in earlier cells, from cell counts _n. Blocks of cells are summed first, so no task sees all cells."""
    blocked = cells.withColumn("_block", F.floor(F.col("_at") / BLOCK_CELLS))
    heads = blocked.groupBy(*parts, "_block").agg(F.sum("_n").alias("_m"))
    heads = heads.withColumn("_start", F.sum("_m").over(W.partitionBy(*(parts or [F.lit(0)])).orderBy("_block")) - F.col("_m"))
    inside = F.sum("_n").over(W.partitionBy(*parts, "_block").orderBy("_at")) - F.col("_n")
    own, head = blocked.withColumn("_own", inside).alias("o"), heads.alias("h")
    same = F.col("o._block") == F.col("h._block")
    for p in parts:
        same = same & F.col(f"o.{p}").eqNullSafe(F.col(f"h.{p}"))
    return own.join(head, same).select(*[F.col(f"o.{p}") for p in parts], "_at", (F.col("_own") + F.col("_start")).alias("_before"))


def interleave(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (from 0 in each shard) of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_crc32"),
        shuffle_key(doc_id, text, seed).alias("_key"),
    )
    rows = materialize(rows, "shard-rows")
    sources = rows.groupBy("source").agg(F.count("*").alias("_of")).withColumnRenamed("source", "_source")
    total = rows.count()
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    fraction = F.conv(F.substring("_key", 1, 10), 16, 10).cast("double") / float(16**10)
    rows = rows.withColumn("_cell", F.floor(fraction * F.ceil(F.col("_of") / cell_rows)))
    cells = rows.groupBy(F.col("source").alias("_source"), F.col("_cell").alias("_at")).agg(F.count("*").alias("_n"))
    cells = rows_before(cells, ["_source"])
    inside = W.partitionBy("source", "_cell").orderBy("_key", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1)
    ranked = ranked.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_cell") == F.col("_at")))
    ranked = ranked.withColumn("_fraction", (2 * (F.col("_before") + F.col("_in")) + 1) / (2 * F.col("_of")))
    ranked = ranked.drop("_cell", "_before", "_in", "_source", "_at", "_of")

    pieces = max(1, -(-total // cell_rows))
    ranked = ranked.withColumn("_cell", F.floor(F.col("_fraction") * pieces))
    cells = ranked.groupBy(F.col("_cell").alias("_at")).agg(F.count("*").alias("_n"))
    cells = rows_before(cells, [])
    inside = W.partitionBy("_cell").orderBy("_fraction", "source", "_key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_in", F.row_number().over(inside) - 1).join(cells, F.col("_cell") == F.col("_at"))
    position = F.col("_before") + F.col("_in")
    n = max(total, 1)
    placed = placed.withColumn("_position", position).withColumn("shard", F.expr(f"CAST(_position * {shards} DIV {n} AS INT)"))
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", F.expr(f"_position - (shard * {n}L + {shards - 1}) DIV {shards}").alias("slot"))
