"""A corpus preparation job as a chain of stages, and the text operators' queries.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import decontamination, jaccard_join, language, personal_data, pieces
from flowtide.llm.common import fold, table
from flowtide.llm.queries import ORACLES, QUERIES
from flowtide.operators.scale import small
from flowtide.session import materialize


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the labelled documents and drops those in none of them."""
    model = language.learn(docs, ~fold("doc_id", 4, 2))
    names = ("_lang_pred", "_lang_score", "_lang_bits", "_lang_symbols")
    read = language.predict(docs, model, keep=docs.columns, names=names)
    return read.where(~language.rejected("_lang_pred", "_lang_bits", "_lang_symbols", model.limit("_lang_pred"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents one row stays, of the smallest id; of repeated rows without words one.

    An id on one row is decided by the id alone, an id on several rows text by text.
    """
    near = materialize(jaccard_join.near_duplicates(docs, nodes=True), "near-duplicates")
    ids = near.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.count("*") > 1).alias("_again"), F.min("stays").alias("_stays"))
    ids = materialize(ids.where("_again OR NOT _stays"), "repeated-or-gone")
    kept = docs.join(small(ids.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    again = ids.where("_again").select("doc_id")
    if again.isEmpty():
        return kept
    again = small(again)
    rows = jaccard_join.with_node(docs.join(again, "doc_id", "left_semi"), docs.columns, names=("_n", "_node"))
    stays = near.where("stays").join(again, "doc_id", "left_semi").select("doc_id", F.col("node").alias("_node")).distinct()
    wordless = F.when(F.col("_n") == 0, F.struct("text"))  # no set to compare: only equal texts are copies
    once = rows.join(stays, ["doc_id", "_node"], "left_semi").groupBy("doc_id", "_node", wordless.alias("_text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = once.agg(F.min_by(F.struct(*columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*columns))).alias("_row"))
    return kept.unionByName(once.select(*[F.col(f"_row.`{c}`") for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much benchmark text."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns, prefix="_found_")
    return found.where(~decontamination.is_contaminated("_found_")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    found = personal_data.find_spans(docs, keep=docs.columns, out="_spans")
    clean = found.withColumn("_masked", personal_data.masked(F.col("text"), F.col("_spans")))
    fresh = {"text": F.col("_masked"), "n_chars": F.char_length("_masked").cast(docs.schema["n_chars"].dataType)}
    return clean.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the digest of what they decode to."""
    both = pieces.round_trip(docs, pieces.Vocabulary.load(), keep=("doc_id", "lang", "source"), names=("pieces", None, "_text"))
    return both.select("doc_id", "lang", "source", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", F.sha2("_text", 256).alias("text_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("pieces", encode_pieces),
]

# Learnt models and the tokenizer's scores are not SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**QUERIES, "pipeline": run}

__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]
