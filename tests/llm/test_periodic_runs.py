"""Periodic runs against a comparison of every word with every later one."""

import hashlib
import random
import zlib

import numpy as np

from flowtide.llm import periodic_runs as pr
from flowtide.llm.queries import QUERIES


def brute(w, least=12):
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample(rng):
    kind, n = rng.randint(0, 5), rng.randint(0, 90)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        block = [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        edge = lambda: [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        return edge() + block * rng.randint(1, 6) + block[: rng.randint(0, len(block))] + edge()
    if kind == 3:  # Fibonacci words hold as many runs as a text can
        a, b = "a", "ab"
        for _ in range(8):
            a, b = b, b + a
        start = rng.randint(0, 30)
        return list(b[start : start + n + 20])
    if kind == 4:
        out = []
        while len(out) < n:
            out += list(rng.choice(["aab", "aabaab", "ab", "aabaabaaab", "b"]) * rng.randint(1, 4))
        return out * rng.randint(1, 3)
    return [str(rng.randint(0, 30)) for _ in range(n)]


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = [sample(rng) for _ in range(rng.randint(1, 8))]
        runs, texts = pr.solve([" ".join(d) for d in docs], batch_words=rng.choice([50, 1 << 17]))
        for d, r, t in zip(docs, runs.to_pylist(), texts.to_pylist(), strict=True):
            want = brute(d)
            assert [(x["start"], x["length"], x["period"]) for x in r] == want
            assert t == collapsed(d, want)


def test_range_successor_equals_a_scan():
    rng = random.Random(2)
    order = np.array(rng.sample(range(77), 77))
    tree = pr.WaveletTree(order)
    lo = np.array([rng.randint(0, 76) for _ in range(300)])
    hi = np.array([rng.randint(x, 77) for x in lo])
    after = np.array([rng.randint(-1, 75) for _ in range(300)])
    want = [min((v for v in order[x:y] if v > z), default=77) for x, y, z in zip(lo, hi, after)]
    assert tree.successor(lo, hi, after).tolist() == want


def test_a_very_long_periodic_text_takes_few_steps():
    n = 200_000
    runs, _ = pr.solve([" ".join(["a", "b"] * (n // 2) + ["c"] * 5), " ".join(["x"] * n)])
    assert [[tuple(r.values()) for r in one] for one in runs.to_pylist()] == [[(0, n, 2)], [(0, n, 1)]]


def test_odd_rows_and_clashing_columns(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("spans", "runs").withColumnRenamed("ids", "_text_in")
    found = pr.find_runs(docs, keep=docs.columns)
    assert found.columns == [c for c in docs.columns if c != "runs"] + ["runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == docs.count() and {r._text_in for r in rows} == {"i"}
    for r in rows:
        w = (r.text or "").split()
        want = [(0, 20_000, 4)] if len(w) > 1000 else []
        assert [tuple(x) for x in r.runs] == want and r.collapsed == collapsed(w, want)
    assert pr.find_runs(docs.limit(0)).count() == 0


def test_the_query_on_chosen_documents(spark, tmp_path):
    rng = random.Random(7)
    texts = {i: " ".join(sample(rng)) for i in range(150)} | {900: None, 901: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        w = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs, r = brute(w), rows[i]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
