"""Nodes of frequent signatures that are compared chunk by chunk, against all pairs."""

import itertools
import random

from flowtide.llm import jaccard_join


def test_chunks_of_a_frequent_passage_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    passage = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(24):
        own = [f"x{i // 2}_{k}" for k in range(8 + i % 3)] if i % 4 else [f"y{i}_{k}" for k in range(30)]
        words = passage[:]
        words[rng.randrange(60)] = f"z{i}"
        texts.append(" ".join(words + own))
    parent = list(range(24))
    sets = [jaccard_join.shingles(t) for t in texts]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(24), 2):
        if jaccard_join.linked(sets[i], sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard_join.near_duplicates(docs, hot_nodes=3, star_rounds=0).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: root(i) for i in range(24)}
    assert len({root(i) for i in range(24)}) > 2
