"""Helpers shared by the text operators: one-pass row mapping, folds and stable hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int, rest: int) -> Column:
    """True for rows whose crc32(doc_id as text) leaves `rest`; a missing id belongs to no held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == rest, F.lit(False))


def unit_hash(*columns: str, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) per row."""
    return (F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


_kept: list = []


def kept(source, build: Callable):
    """What `build` makes of a broadcast value, kept in this worker process for later tasks with the same value.

    A worker keeps one such thing at a time, whatever operator it belongs to, so stages that
    follow each other in reused workers do not add up their tables.
    """
    if not _kept or _kept[0][0] is not source:
        _kept.clear()
        _kept.append((source, build(source)))
    return _kept[0][1]


def free_name(name: str, taken: Sequence[str]) -> str:
    """`name`, lengthened until no taken column has it (Spark compares names without case)."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sends rows to Python workers in batches of about `BATCH_BYTES`, unless the session has a lower bound.

    Each running task holds a batch several times over, in the executor and in its worker;
    whole texts reach Spark's default of 64 MB long before its 10,000 rows. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def map_text(
    docs: DataFrame,
    build: Callable[[], Callable[[list[str | None]], list[Sequence]]],
    fields: str,
    keep: Sequence[str],
    text: str = "text",
    rows: int = 512,
) -> DataFrame:
    """Adds columns computed from each text in one pass without a shuffle.

    `build()` runs once per task and returns a function from a list of texts to
    one list or Arrow array per field of `fields` (a DDL string). Texts are handed over `rows`
    at a time, so memory is bounded by the longest texts, not by the partition.
    Kept columns pass through untouched; a kept column named like a field is
    replaced by the field. A text that is kept too is sent once.
    """
    bound_batches(docs.sparkSession)
    added = T._parse_datatype_string(fields)
    names = {f.name for f in added}
    kept = [c for c in keep if c not in names]
    if text in kept and docs.schema[text].dataType == T.StringType():
        slot, source = text, docs.select(*[F.col(f"`{c}`") for c in kept])
    else:
        slot = free_name("_text_in", kept)
        source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(slot))
    schema = T.StructType([docs.schema[c] for c in kept] + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                results = work(batch.column(slot).to_pylist())
                columns = [batch.column(c).cast(arrow.field(c).type) for c in kept]
                columns += [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(f.name).type) for v, f in zip(results, added, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            del whole, batch, results, columns
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
