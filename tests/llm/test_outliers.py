"""Quality rules against plain Python and the outlier estimate against numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rules import prose

from flowtide.llm import outliers as o


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_python(spark):
    rng = random.Random(1)
    bits = ["a", "b", "ab", "é", "😀", " ", " ", "\n", "\t", "\r\n", "\x0b", " ", "#", "<>", "x y z u v\n", "1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += [None, "", " \n ", "a b c d e " * 400, "one two three four five", "a a a a a a", "same line\nsame line\n\nsame line \n"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = o.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def plain_fit(x, floors, share=o.SHARE, steps=o.STEPS):
    """The same estimate over one group, in numpy."""
    d, n = x.shape[1], len(x)

    def quantile(c, p):
        cells = np.sort(np.floor(c / o.GRID))
        return (cells[int(np.ceil(p * n)) - 1] + 0.5) * o.GRID

    def distance(centre, inverse):
        z = x - centre
        return np.einsum("ni,ij,nj->n", z, inverse, z)

    def estimate(rows, factor=1.0):
        m = rows.mean(0)
        s = (rows.T @ rows / len(rows) - np.outer(m, m)) * factor
        return m, np.linalg.inv(s + np.diag(np.square(floors)))

    def step(fit):
        bins = np.floor(np.log(distance(*fit) + 1e-9) * o.BINS)
        ranked = np.sort(bins)
        limit = ranked[int(np.ceil(share * n)) - 1]
        middle = ranked[int(np.ceil(0.5 * n)) - 1]
        return estimate(x[bins <= limit]), np.exp((middle + 0.5) / o.BINS)

    spread = [max((quantile(x[:, i], 0.75) - quantile(x[:, i], 0.25)) / 1.349, floors[i]) for i in range(d)]
    fit = np.array([quantile(x[:, i], 0.5) for i in range(d)]), np.diag(1 / np.square(spread))
    for _ in range(steps):
        fit, _ = step(fit)
    _, median = step(fit)
    scale = max(median / o.chi_square(0.5, d), 1.0)
    limit = o.chi_square(0.975, d)
    return estimate(x[distance(*fit) <= limit * scale], 0.975 / o.chi_square_share(limit, d + 2))


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(4)
    shape = np.array([[1.0, 0.8, 0.0], [0.0, 0.5, 0.2], [0.0, 0.0, 0.3]])
    first = rng.normal(size=(900, 3)) @ shape + [3, 5, 1]
    first[:180] = rng.normal(size=(180, 3)) * 0.1 + [3, -4, 6]  # a fifth of the rows form a cluster elsewhere
    return {"a": first, "b": rng.normal(size=(400, 3)) * [0.2, 2, 1] + 9}


def test_estimate_equals_numpy_and_ignores_a_cluster_of_outliers(spark, clouds):
    floors = [0.05, 0.05, 0.05]
    rows = [(g, *map(float, r)) for g, x in clouds.items() for r in x]
    table = spark.createDataFrame(rows, "fit string, x0 double, x1 double, x2 double").repartition(5)
    fits = {r.fit: r for r in o.fit_groups(table, floors).collect()}
    for g, x in clouds.items():
        centre, inverse = plain_fit(x, floors)
        assert np.allclose(fits[g].centre, centre, atol=1e-6) and np.allclose(fits[g].inverse, inverse, rtol=1e-6)
    z = clouds["a"] - np.array(fits["a"].centre)
    far = np.einsum("ni,ij,nj->n", z, np.array(fits["a"].inverse), z) > o.chi_square(0.999, 3)
    assert far[:180].all() and far[180:].mean() < 0.01


def test_junk_goes_and_prose_stays_in_every_group(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        text = "\n".join(prose(rng, rng.randint(5, 12)) for _ in range(rng.randint(2, 12)))
        if i % 30 == 7:
            text = " ".join(w + "$$$%%%" for w in text.split())
        rows.append((i, text, ["en", "fr", None][i % 3], "big" if i % 9 else f"small{i}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = o.judge(docs, keep=docs.columns)
    assert got.columns == ["doc_id", "text", "lang", "source", *o.COUNTS, "base_failed", "kept", "distance"]
    asked = [r for r in got.collect() if not r.base_failed]
    assert not any(r.kept for r in asked if r.doc_id % 30 == 7)
    assert all(r.kept for r in asked if r.doc_id % 30 != 7)
    few = o.judge(docs.limit(50)).where(~F.col("base_failed")).collect()
    assert all(r.kept and r.distance is None for r in few)


def test_odd_rows_and_an_empty_table(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("spans", "_t").withColumnRenamed("ids", "x0").withColumnRenamed("stats", "fit")
    got = o.judge(docs, keep=docs.columns)
    rows = got.collect()
    assert len(rows) == docs.count() and {(r._t, r.x0, r.fit) for r in rows} == {("p", "i", "t")}
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert o.judge(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = o.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
