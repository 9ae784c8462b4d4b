"""Token alignment against a plain restatement with the libraries' own encoders."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowtide.llm import token_alignment as ta


@pytest.fixture(scope="module")
def plain():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(ta.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)
    byte = ta.byte_of_char()
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}

    def encode(text):
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        spelled = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        data = (" " + text).encode()
        if b"".join(a_bytes[i] for i in x) != data or b"".join(spelled) != data:
            return [], []
        return [(i, len(a_bytes[i])) for i in x], [(i, len(s)) for i, s in zip(y, spelled)]

    return encode


def ranges(tokens):
    at = 0
    for i, n in tokens:
        yield i, at, at + n
        at += n


def brute(plain, rows):
    """One result per row, by comparing every pair of tokens of a text."""
    links, out = [], []
    for doc_id, text in rows:
        a, b = plain(text) if text else ([], [])
        ra, rb = list(ranges(a)), list(ranges(b))
        links.append([(x[0], y[0]) for x in ra for y in rb if x[1] < y[2] and y[1] < x[2]])
        ends = sorted({e for *_, e in ra} & {e for *_, e in rb})
        groups = []
        low = 0
        for e in ends:
            groups.append(",".join(str(i) for i, s, _ in ra if low <= s < e) + "|" + ",".join(str(i) for i, s, _ in rb if low <= s < e))
            low = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append([doc_id, len(a), len(b), len(ends), digest, ";".join(groups) or None])
    count = Counter(p for one in links for p in one)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    full = []
    for (doc_id, n_a, n_b, n_groups, digest, groups), one in zip(out, links):
        full.append((doc_id, n_a, n_b, n_groups, len(one), sum(count[p] == best[p[1]] for p in one), sum(count[p] for p in one), digest, groups))
    return sorted(full, key=repr)


def texts():
    rng = random.Random(3)
    bits = ["the", " cat", "s ", "  ", "\n", "é", "中文", "😀", "'ll", "12", "<s>", "<|endoftext|>", "tion", ".", "\t", "#", "Ωμέγα", "\x00"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [None, "", "▁ is no space", "same words here", "same words here", *made]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_all_pairs(spark, plain, small):
    rows = list(enumerate(texts())) + [(3, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    limits = {"parts": 3, "run_records": 150, "fan_in": 2} if small else {}
    got = ta.align_tokens(docs, groups=True, **limits).collect()
    mine = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in got), key=repr)
    assert mine == brute(plain, rows)


def test_odd_rows_clashing_columns_and_an_empty_table(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("sketch", "n_best").withColumnRenamed("spans", "_run").withColumnRenamed("ids", "groups")
    got = ta.align_tokens(docs, keep=docs.columns)
    assert got.columns == [c for c in docs.columns if c != "n_best"] + ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r._run == "p" and r.groups == "i" for r in rows)
    assert {r.n_a for r in rows if not r.text} == {0}
    assert ta.align_tokens(docs.limit(0)).count() == 0
    blank = docs.where("text IS NULL")
    assert [r.n_links for r in ta.align_tokens(blank).collect()] == [0, 0]


def test_merging_runs_equals_a_counter():
    rng = random.Random(5)
    for turn in range(30):
        runs, want = [], Counter()
        for _ in range(rng.randint(0, 6)):
            one = Counter(rng.randint(0, 4000) for _ in range(rng.randint(1, 3000)))
            want += one
            runs.append(ta.pack_pairs(*(np.array(c) for c in zip(*sorted(one.items())))))
        monkey, ta.FRAME = ta.FRAME, 64
        try:
            found = list(ta.with_best(ta.merge_runs(runs), 100))
        finally:
            ta.FRAME = monkey
        got = {k: (n, b) for block in found for k, n, b in zip(*(c.tolist() for c in block))}
        assert {k: n for k, (n, _) in got.items()} == dict(want)
        for k, (n, b) in got.items():
            assert b == (n == max(v for x, v in want.items() if x // 100 == k // 100))
        flat = [k for block in found for k in block[0].tolist()]
        assert flat == sorted(flat)
