"""The pipeline against plain Python, stage by stage and from end to end."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from test_rules import base_spans, brute_components, brute_hits, prose

MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")


def masked(text):
    """Base spans only; spans that overlap become one mark."""
    out, at = "", 0
    for start, kind, end in base_spans(text):
        if start >= at:
            out += text[at:start] + MARKS[kind]
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(rng, 25)) for i in range(6)]
    rows = []
    for i in range(60):
        body = prose(rng, rng.randint(8, 80))
        if i % 7 == 0 and rows:
            body = rows[-1][1] + " end"
        if i % 10 == 3:
            body = items[i % 6][1] + ", " + body
        if i % 6 == 1:
            body += f" mail to jo.{i}@mail.example.com or 10.0.0.{i} or +1 (212) 555-01{i:02d}."
        rows.append((i, body, "en" if i % 2 else "fr", "src", len(body)))
    rows += [(100, None, None, None, None), (101, "", "en", "src", 0), (102, "12 34 !", "en", "src", 7), (103, rows[5][1], "en", "other", rows[5][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}, [(str(i), t) for i, t in items]


def test_the_stages_keep_and_change_what_they_should(spark, corpus):
    folder, texts, items = corpus
    texts = {i: t for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    components = brute_components(texts)
    kept = {i: t for i, t in texts.items() if components[i][1] == i}
    hits = {i: brute_hits(t, items) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    want = {(i, hashlib.sha256(masked(t).encode()).hexdigest()) for i, t in kept.items()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.text_sha256) for r in got} == want
    assert all(r.n_pieces == len(r.pieces) for r in got)


def test_stages_return_the_columns_of_documents(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes


def test_repeated_rows_leave_one(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IN (1, 2)")
    assert corpus_pipeline.drop_near_duplicates(spark, docs.union(docs), folder).count() == 2


def test_an_id_on_several_rows_is_judged_text_by_text(spark):
    rng = random.Random(8)
    x, y, z, v = (prose(rng, 40) for _ in range(4))
    rows = [(3, x), (5, x), (5, y), (7, z), (7, z + " end"), (8, z + " end"), (3, v), (9, v), (6, ""), (6, ""), (6, " "), (None, x), (None, x)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    one_of_two = [r for r in got if r[0] == 7]
    assert len(one_of_two) == 1 and one_of_two[0][1] in (z, z + " end")
    assert [r for r in got if r[0] != 7] == sorted([(0, x), (0, x), (3, x), (3, v), (5, y), (6, ""), (6, " ")])


def test_empty_documents(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
