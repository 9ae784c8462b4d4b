"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct hashes of a text's 5-word shingles, in
order. The sketch of a union is the k smallest of two sketches' hashes, so parts
can be sketched apart and merged. Two sketches estimate resemblance and
containment, one estimates the number of distinct shingles. Everything is
DataFrame functions.

Words are runs without white space, A-Z lower-cased; a text of fewer than five
words is one shingle. The hash is the first 16 hexadecimal digits of md5.

Defined cases: a null or wordless text has an empty sketch; two empty sketches
resemble and contain each other fully, an empty and another one not at all;
equal texts have equal sketches; a repeated row is sketched again. In
`with_next`, a missing id counts as the largest and rows that share an id follow
each other by md5 of their text.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.operators.scale import value_splits, with_bucket

K = 128
SHINGLE = 5
HEX = 16


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(w: Column) -> Column:
    """Hash of every run of five words (of all words, if there are fewer)."""
    n = F.size(w)
    runs = F.when(n > SHINGLE, F.sequence(F.lit(1), n - SHINGLE + 1)).when(n > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(runs, lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(w, i, SHINGLE))), 1, HEX))


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(docs: DataFrame, text: str = "text", name: str = "sketch", k: int = K) -> DataFrame:
    """Adds the sketch column."""
    return docs.withColumn("_words", words(F.col(text))).withColumn(name, smallest(shingle_hashes(F.col("_words")), k)).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of the two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.conv(F.substring(F.element_at(a, -1), 1, 12), 16, 10).cast("double") / float(16**12)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    union = distinct_count(merge(a, b, k), k)
    both = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def with_next(docs: DataFrame, columns: list[str], doc_id: str, text: str, bucket_rows: int = 2_000, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Adds `_next_<column>`: the value in the following row by descending id, the first row's after the last.

    `prepare` adds columns that the following row is to supply; it runs once per row.

    Rows are cut at id quantiles into buckets that are sorted on their own; a
    copy of each bucket's first row closes the bucket before it.
    """
    pieces = min(20_000, max(2, docs.count() // bucket_rows))
    bucketed = with_bucket(docs, doc_id, value_splits(docs, doc_id, pieces)).withColumn("_tie", F.md5(F.coalesce(F.col(text), F.lit(""))))
    bucketed = bucketed.withColumn("_bucket", F.coalesce("_bucket", F.lit(pieces + 1)))  # rows without id come first
    order = F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"), F.col("_tie").alias("tie"))
    heads = bucketed.groupBy("_bucket").agg(F.max(order).alias("_head"))
    everything = W.partitionBy(F.lit(0))
    target = F.coalesce(F.lag("_bucket").over(everything.orderBy(F.desc("_bucket"))), F.min("_bucket").over(everything))
    heads = heads.select(F.col("_bucket").alias("_own"), target.alias("_target"), "_head")
    same = (F.col("_bucket") == F.col("_own")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("_head.id")) & (F.col("_tie") == F.col("_head.tie"))
    closing = bucketed.join(F.broadcast(heads), same).dropDuplicates(["_own"])
    closing = closing.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_target").alias("_bucket"), "_tie", F.lit(True).alias("_closing"))
    rows = prepare(bucketed.withColumn("_closing", F.lit(False))).unionByName(prepare(closing))
    following = W.partitionBy("_bucket").orderBy("_closing", F.desc_nulls_first(doc_id), F.desc("_tie"))
    rows = rows.select("*", *[F.lead(c).over(following).alias(f"_next_{c}") for c in columns])
    return rows.where(~F.col("_closing")).drop("_closing", "_bucket", "_tie")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the next text's first ones."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))
