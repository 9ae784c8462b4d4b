"""Each operator against brute force in plain Python, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import decontamination, fingerprints, jaccard_join, language, personal_data, pieces, quality, sharding, token_counts, toxicity
from flowtide.llm.common import fold

SF = "/root/testdata/sf0.001"
SYLLABLES = "an the er on tion re ha st lo mi ka".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# personal data

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text or "", re.A):
            d = re.sub("[^0-9]", "", m.group())
            fits = [lambda: True, lambda: all(int(x) <= 255 for x in m.group().split(".")), lambda: 12 <= len(d) <= 19 and luhn(d), lambda: 9 <= len(d) <= 15]
            if fits[kind]():
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["a", "b@", "@", ".", "-", "_", "x.com", " ", "1", "255", "256", "4", "+1", "(", ")", "4539578763621486", "1.2.3.4", "é", "😀", "%", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 22))) for _ in range(300)]
    texts += [None, "", "1" * 9000, "a" * 9000 + "@", "1 " * 4000, "a." * 4000 + "@" + "a." * 4000, "+1" + " " * 9000, "a@b.com_x@c.de"]
    rows = personal_data.find_spans(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == base_spans(texts[r.doc_id])


def test_added_spans_follow_the_labelers_and_masks_cover_them(spark):
    texts = ["call phone (212) 555-0188 now"] * 20 + ["please mail jo.doe [at] example [dot] com today"] * 20 + ["mail me at a@b.com"] * 20 + ["serial key 123-4567-8901x"] * 20
    found = personal_data.find_spans(frame(spark, texts), keep=("doc_id", "text"))
    rows = {r.doc_id: r for r in found.withColumn("clean", personal_data.masked(F.col("text"), F.col("spans"))).collect()}
    assert rows[0].clean == "call phone [PHONE] now"
    assert rows[20].clean == "please mail [EMAIL] today"
    assert rows[40].clean == "mail me at [EMAIL]"
    assert rows[60].clean == texts[60]


def test_a_hundred_thousand_addresses_in_one_text(spark):
    import time

    many = " ".join(f"u{i}@ex{i % 7}.com" for i in range(100_000))
    docs = frame(spark, [many, "(212) 555-0188 or +1 (212) 555-0188 " * 20_000])
    start = time.monotonic()
    found = personal_data.find_spans(docs, keep=("doc_id", "text"))
    rows = {r.doc_id: r for r in found.select("doc_id", F.size("spans").alias("n"), personal_data.masked(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert time.monotonic() - start < 60  # about 10 on an idle machine, hours if it grew with the square
    assert rows[0].n == 100_000 and rows[0].clean == " ".join(["[EMAIL]"] * 100_000)
    assert rows[1].clean.count("[PHONE]") >= 20_000


def test_running_values_and_cuts(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)], "".join(rng.choice("aé😀\n") for _ in range(700))) for i, n in enumerate([0, 1, 63, 64, 65, 300])]
    df = spark.createDataFrame(rows, "id int, v array<int>, t string")
    sums = personal_data.running(F.col("v"), F.lit(0), lambda a, b: a + b)
    tops = personal_data.running(F.col("v"), F.lit(0), F.greatest)
    cut = personal_data._cut(personal_data.pieces_of(F.col("t")), F.lit(250), F.lit(520))
    for r in df.select("id", sums.alias("s"), tops.alias("m"), cut.alias("c")).collect():
        v = rows[r.id][1]
        assert r.s == [sum(v[:i]) for i in range(len(v))] and r.m == [max(v[:i], default=0) for i in range(len(v))]
        assert r.c == rows[r.id][2][250:520]


def test_personal_data_on_odd_rows_with_clashing_columns(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("ids", "_candidates").withColumnRenamed("stats", "_base").withColumnRenamed("node", "_pieces")
    found = personal_data.find_spans(docs, keep=[c for c in docs.columns if c != "spans"])
    rows = found.collect()
    assert len(rows) == docs.count() and {(r._candidates, r._base, r._pieces) for r in rows} == {("i", "t", "n")}
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == base_spans(r.text)
    assert personal_data.find_spans(docs.limit(0)).count() == 0


def test_em_finds_the_reliable_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        v = "".join("1" if rng.random() < (a if truth else 1 - a) else "0" for a in (0.95, 0.9, 0.9, 0.85, 0.5))
        counts[v] = counts.get(v, 0) + 1
    prior, rates, _ = personal_data.reliabilities(sorted(counts.items()))
    assert abs(prior - 0.4) < 0.05
    assert rates[0][0] > 0.9 and rates[0][1] < 0.12
    assert abs(rates[4][0] - rates[4][1]) < 0.1


# toxicity

def test_swapping_groups_is_penalised(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [prose(rng, 20), "women" if bad or i % 10 == 0 else "men"] + (["scumbag", "vile"] if bad and i % 20 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = ["many women met there", "many men met there"]
    gaps = []
    for fairness in (0.0, 1000.0):
        model = toxicity.learn(docs, marks, F.lit(True), fairness=fairness)
        reader = model.reader()
        a, b = (model.score(reader, t) for t in neutral)
        gaps.append(abs(a - b))
    assert model.score(reader, "you scumbag vile thing") > 0.5  # with the penalty, the abuse decides
    assert gaps[1] < 0.1 * gaps[0]


def test_toxicity_without_labels_gives_the_base_rate(spark, odd_docs):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(odd_docs, marks, F.lit(True))
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {round(r.score, 6) for r in rows} == {0.5}


# language

def test_array_parse_equals_the_automaton():
    rng = random.Random(3)
    model = language.Model({"aa": [prose(rng, 300)], "bb": [prose(rng, 200)[::-1]]})
    packed = language.tables(model.packed())
    texts = [prose(rng, 60), "zzz qqq", "an", "ANÉ the"]
    blocks = [language.symbols(t, packed["lookup"]) for t in texts]
    dense = language.parse(blocks, packed)
    hashed = [language.hashed(e, int(own.max()) + 1) for e, own in zip(model.edges, model.alphabets)]
    for got in (dense, language.parse(blocks, {**packed, "tables": hashed})):
        for k, own in enumerate(model.alphabets):
            assert got[k].tolist() == [model.automaton(k).phrases(own[b].tolist()) for b in blocks]


def test_thousands_of_letters_in_six_languages_stay_small():
    rng = random.Random(13)
    samples = {f"l{k}": [many_signs(rng, [[c] for c in range(1334)], 30_000, 0x4E00 + 1334 * k)] for k in range(6)}
    model = language.Model(samples)
    assert len(model.codes) > 7_900 and all(isinstance(t, dict) for t in language.tables(model.packed())["tables"])
    held = sum(a.nbytes for t in language.tables(model.packed())["tables"] for a in t.values()) + sum(a.nbytes for a in model.alphabets)
    assert held < 300 << 20
    packed = language.tables(model.packed())
    for k in range(6):
        text = samples[f"l{k}"][0][100:400]
        cost = [p * w for p, w in zip(language.parse([language.symbols(text, packed["lookup"])], packed)[:, 0], model.weight)]
        assert int(np.argmin(cost)) == k


def test_phrases_are_the_longest_that_occur():
    rng = random.Random(4)
    for _ in range(60):
        known = [rng.randint(2, 4) for _ in range(40)]
        text = [rng.randint(2, 5) for _ in range(30)]
        count, at = 0, 0
        while at < len(text):
            n = 0
            while at + n < len(text) and any(known[i : i + n + 1] == text[at : at + n + 1] for i in range(len(known))):
                n += 1
            at, count = at + max(1, n), count + 1
        assert language.Automaton(known).phrases(text) == count


def test_language_on_given_documents_and_odd_rows(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs, ~fold("doc_id", 4, 2))
    read = language.predict(docs, model, keep=("doc_id", "lang")).where(fold("doc_id", 4, 2)).collect()
    assert sum(r.lang == r.lang_pred for r in read) >= 0.95 * len(read)
    odd = language.predict(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 3)} == {"und"}
    nothing = language.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(odd_docs, nothing).collect()} == {"und"}


def many_signs(rng, words, n, start=0x4E00):
    """Words of one or two signs out of thousands, most often the early ones."""
    out = []
    while len(out) < n:
        out += words[int(len(words) * rng.random() ** 4)]
    return "".join(chr(start + c) for c in out[:n])


def test_a_language_of_thousands_of_signs_keeps_its_texts(spark):
    rng = random.Random(12)
    words = [[int(3000 * rng.random() ** 2) for _ in range(rng.choice((1, 2, 2)))] for _ in range(8000)]
    rare = words[:400] + rng.sample(words[400:], len(words) - 400)  # the same language on another subject
    rows = [(i, many_signs(rng, words, 500), "zz") for i in range(60)] + [(i, prose(rng, 90), "en") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True))
    assert model.limits["en"] == 8.0 < model.limits["zz"] < model.weight[1]
    tests = [(1, many_signs(rng, rare, 1500)), (2, prose(rng, 80)), (3, many_signs(rng, words, 400, start=0xAC00)), (4, "".join(chr(0x3B1 + rng.randrange(24)) for _ in range(300)))]
    read = language.predict(spark.createDataFrame(tests, "doc_id long, text string"), model)
    got = {r.doc_id: (r.gone, r.lang_pred, r.bits) for r in read.select("*", language.rejected(limit=model.limit()).alias("gone")).collect()}
    assert got[1][1] == "zz" and got[1][2] > 8
    assert [got[i][0] for i in (1, 2, 3, 4)] == [False, False, True, True], (got, model.limits)


def test_languages_are_learnt_past_a_common_header(spark):
    rng = random.Random(13)
    header = prose(rng, 150)  # more than sample_chars characters
    bodies = {"aa": lambda: prose(rng, 400), "bb": lambda: prose(rng, 400)[::-1].lower(), "cc": lambda: "".join(chr(0x3B1 + rng.randrange(24)) for _ in range(2000))}
    rows = [(1000 * k + i, ("0" * 800 if lang == "cc" else header) + " " + body(), lang) for k, (lang, body) in enumerate(bodies.items()) for i in range(40)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    fresh = spark.createDataFrame([(i, body(), lang) for lang, body in bodies.items() for i in range(5)], "doc_id long, text string, lang string")
    assert all(r.lang == r.lang_pred for r in language.predict(fresh, model, keep=("lang",)).collect())


# Jaccard join

def brute_components(texts):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low)

    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, families, copies, length):
    rng = random.Random(seed)
    passage = prose(rng, length // 3)
    texts = []
    for _ in range(families):
        base = (prose(rng, length) + " " + passage).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = rng.choice(SYLLABLES) + "x"
            texts.append(" ".join(w[: len(w) - rng.choice([0, 0, 1, 5])]))
    texts += [passage, passage + " more", None, "", " ", "a b c", "A b C", "a b c d", *[prose(rng, n) for n in range(1, 14)]]
    return dict(enumerate(texts))


@pytest.mark.parametrize(("seed", "length", "hot", "rounds"), [(1, 60, 64, 3), (2, 90, 3, 2), (3, 25, 2, 0), (4, 200, 4, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, length, hot, rounds):
    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", 3)
    texts = near_copies(seed, 6, 8, length)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = jaccard_join.near_duplicates(docs, hot_nodes=hot, star_rounds=rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_sketch_distance_is_a_lower_bound_and_signatures_meet():
    rng = np.random.default_rng(7)
    for _ in range(300):
        size = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        drop, add = int(rng.integers(0, max(1, size // 9))), int(rng.integers(0, max(1, size // 9)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert jaccard_join.distance(jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)) <= apart
        if jaccard_join.linked(a, b) and apart:
            assert len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)))


def test_join_on_odd_rows(spark, odd_docs):
    rows = jaccard_join.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(0, 0, 0), (2, 0, 2), (6, 2, 6), (7, 2, 6), (None, 1, None)} <= got
    assert jaccard_join.near_duplicates(odd_docs.limit(0)).count() == 0


# sharding

def test_shards_are_even_and_keep_the_mixture(spark):
    rows = [(i, f"text {i % 50} é", "big" if i % 3 else f"s{i % 5}") for i in range(1000)] + [(2000, None, None), (2001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(docs, cell_rows=37).collect()
    want = {i: t for i, t, _ in rows}
    per = {}
    for r in got:
        data = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        per.setdefault(r.shard, []).append(r)
    assert sorted(per) == list(range(16)) and {len(v) for v in per.values()} <= {62, 63}
    for v in per.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        assert abs(sum(r.source == "big" for r in v) - 666 / 16) <= 3  # seven small sources shift a cut by a few rows
    other = sharding.interleave(docs.repartition(7), cell_rows=5000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, other), key=str)
    assert sharding.interleave(docs.limit(0)).count() == 0


def test_half_the_rows_without_id_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_CELLS", 3)
    rng = random.Random(14)
    rows = [(i if i % 2 else None, prose(rng, 5), rng.choice([None, "a", "a", "b"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = sharding.interleave(docs, cell_rows=7).collect()
    assert len(placed) == 600 and len({(r.shard, r.slot) for r in placed}) == 600
    for source in (None, "a", "b"):
        per = [sum(r.shard == s and r.source == source for r in placed) for s in range(16)]
        assert max(per) - min(per) <= 2
    sizes = [[r.slot for r in placed if r.shard == s] for s in range(16)]
    assert all(sorted(x) == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    keys = docs.where("doc_id IS NULL").select(sharding.shuffle_key("doc_id", "text", 42)).distinct().count()
    assert keys == docs.where("doc_id IS NULL").select("text").distinct().count()


# pieces

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_best_path_equals_plain_dynamic_programming(vocabulary):
    codec = pieces.Codec(vocabulary)
    scores = {p.replace(pieces.MARK, " "): (vocabulary.scores[i], i) for i, p in enumerate(vocabulary.pieces) if vocabulary.usable[i]}
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["the", " ", "  ", "an", "e,", "\n", "é", "中", "😀", "▁", ".com", "Q"]) for _ in range(rng.randint(0, 12)))
        whole, text = text, " " + text if text else ""  # this model marks the first word
        best = [(0.0, [])]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - 40), end):
                if text[start:end] in scores:
                    s, i = scores[text[start:end]]
                    options.append((best[start][0] + s, best[start][1] + [i]))
            if text[end - 1] not in scores:
                options.append((best[end - 1][0] + codec.unknown_score, best[end - 1][1] + [vocabulary.bytes_at[b] for b in text[end - 1].encode()]))
            best.append(max(options, key=lambda o: o[0]))
        ids = codec.encode(whole)
        assert ids == best[-1][1]
        assert codec.decode(ids) == whole == codec.decode_flat(codec.encode_flat(whole))


def test_whole_text_path_equals_chunked_path(vocabulary):
    codec = pieces.Codec(vocabulary)
    rng = random.Random(8)
    for _ in range(50):
        text = prose(rng, 12).replace("re", "re,").replace("st", "st.\n") + " (www.x.com) it's 12%"
        assert codec.encode(text) == codec.best_path(" " + text)


def test_the_first_word_is_marked_as_the_model_does(vocabulary):
    codec = pieces.Codec(vocabulary)
    assert vocabulary.marked and vocabulary.pieces[codec.encode("The")[0]].startswith(pieces.MARK)
    assert codec.encode("") == [] and codec.decode(codec.encode("  two")) == "  two"


def test_forgetting_paths_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 2_000)
    small, rng = pieces.Codec(vocabulary), random.Random(12)
    texts = [prose(rng, 60) for _ in range(20)]
    got = [small.encode(t) for t in texts]
    assert max(len(small.cache), len(small.older)) < 20
    monkeypatch.setattr(pieces, "CACHE_BYTES", 1 << 30)
    assert got == [pieces.Codec(vocabulary).encode(t) for t in texts]


def test_pieces_round_trip_on_odd_rows(spark, odd_docs, vocabulary):
    encoded = pieces.encode(odd_docs, vocabulary)
    back = {(r.doc_id, r.text) for r in pieces.decode(encoded, vocabulary).collect()}
    assert back == {(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()}
    both = pieces.round_trip(odd_docs, vocabulary, keep=("doc_id", "ids", "text"))
    assert both.columns == ["doc_id", "text", "ids", "ids_sha256", "decoded"]
    rows = both.collect()
    assert len(rows) == odd_docs.count() and all(r.decoded == r.text for r in rows)
    want = {(r.doc_id, tuple(r.ids or ()), r.ids_sha256) for r in encoded.collect()}
    assert {(r.doc_id, tuple(r.ids or ()), r.ids_sha256) for r in rows} == want
    assert pieces.round_trip(odd_docs.limit(0), vocabulary).count() == 0
    assert pieces.Codec(vocabulary).decode([10**6, None]) == "��"


# token counts

def test_edits_keep_counts_and_pretokens_exact():
    with open(token_counts.RANKS, "rb") as f:
        tokens = token_counts.Tokens(f.read())
    rng = random.Random(9)
    bits = "ab '\n\t .1x'sllre é"
    for turn in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) if turn % 3 else prose(rng, 400)
        tree = token_counts.Tree(tokens, text)
        for _ in range(3):
            start = rng.randint(0, len(text) + 2)
            end = start + rng.choice([0, 1, 3, 10, 500])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 5, 30])))
            at = min(start, len(text))
            text = text[:at] + new + text[max(at, end) :]
            tree.edit(start, end, new)
        assert tree.text() == text and tree.n_tokens == tokens.count(text)
        assert [p for i in range(len(tree.leaves)) for p in tree.pretokens(i)] == tokens.split.findall(text)


def test_an_edit_recounts_little():
    with open(token_counts.RANKS, "rb") as f:
        tokens = token_counts.Tokens(f.read())
    tree = token_counts.Tree(tokens, prose(random.Random(1), 20_000))
    tree.edit(30_000, 30_010, "new words")
    assert tree.recounted < 12


def test_token_counts_on_odd_rows(spark, odd_docs):
    edits = "array(named_struct('start', cast(null as int), 'end', 3, 'text', cast(null as string)), cast(null as struct<start:int,end:int,text:string>))"
    rows = token_counts.count_tokens(odd_docs.withColumn("edits", F.expr(edits))).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(r.edited_text == (texts[r.doc_id] or "")[3:] for r in rows)
    none = token_counts.count_tokens(odd_docs.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>"))).collect()
    assert all(r.n_tokens == r.n_tokens_edited for r in none)


# fingerprints

def test_sketches_estimate_and_merge(spark):
    rng = random.Random(11)
    base = prose(rng, 1200).split()
    other = base[:800] + prose(rng, 400).split()
    docs = frame(spark, [" ".join(base), " ".join(other), None, "", "one two"])
    rows = fingerprints.sketch(docs)
    pair = rows.alias("x").where("doc_id = 0").crossJoin(rows.where("doc_id = 1").select(F.col("sketch").alias("other")))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other)]
    r = pair.select(
        fingerprints.resemblance(F.col("sketch"), F.col("other")).alias("near"),
        fingerprints.containment(F.col("sketch"), F.col("other")).alias("inside"),
        fingerprints.distinct_count(F.col("sketch")).alias("n"),
        fingerprints.distinct_count(fingerprints.merge(F.col("sketch"), F.col("other"))).alias("union"),
    ).first()
    both, either = len(sets[0] & sets[1]), len(sets[0] | sets[1])
    assert abs(r.near - both / either) < 0.15 and abs(r.inside - both / len(sets[0])) < 0.2
    assert abs(r.n / len(sets[0]) - 1) < 0.3 and abs(r.union / either - 1) < 0.3
    sizes = {x.doc_id: len(x.sketch) for x in rows.collect()}
    assert (sizes[2], sizes[3], sizes[4]) == (0, 0, 1)


def test_next_row_wraps_and_takes_ties(spark, odd_docs):
    rows = [(i % 40, f"t{i}") for i in range(120)] + [(None, "n1"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = fingerprints.with_next(docs, ["text"], "doc_id", "text", bucket_rows=10).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()), reverse=True)
    texts = [r[1] or "" for r in order]
    assert sorted((r.text, r._next_text) for r in got) == sorted(zip(texts, texts[1:] + texts[:1], strict=True))
    one = fingerprints.with_next(docs.limit(1), ["text"], "doc_id", "text").collect()
    assert len(one) == 1 and one[0].text == one[0]._next_text
    assert fingerprints.with_next(docs.limit(0), ["text"], "doc_id", "text").count() == 0


# decontamination

def brute_hits(text, items):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    w, hit, seen = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for i in range(max(1, len(b) - 12) if b else 0):
            win = b[i : i + 13]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    seen.add(item)
    return len(w), len(hit), sorted(x for x in seen if x is not None)


@pytest.mark.parametrize("slice_bytes", [1 << 30, 900])
def test_hits_equal_plain_search(spark, slice_bytes):
    rng = random.Random(12)
    items = [(str(i), prose(rng, n)) for i, n in enumerate([30, 14, 13, 12, 9, 3, 2, 1, 20])] + [("20", None), ("21", "..."), (None, prose(rng, 15))]
    items.append(items[0])
    texts = [None, "", "?!"]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            body = (rng.choice(items)[1] or "").split()
            start = rng.randint(0, 3)
            parts += [" ".join(body[start : start + rng.randint(10, 30)]).upper(), prose(rng, rng.randint(0, 5))]
        texts.append(", ".join(parts))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_contamination(frame(spark, texts), bench, slice_bytes=slice_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontamination_on_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "hello there general reader of texts")], "item_id int, text string")
    got = decontamination.find_contamination(odd_docs, bench)
    assert sorted(r.doc_id for r in got.where(decontamination.is_contaminated()).collect()) == [6, 6, 7]
    assert decontamination.find_contamination(odd_docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


# quality

def test_normal_equations_and_isotonic_steps(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, len(quality.STATS))), rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(int(i % 4), [float(v) for v in x[i]], float(y[i])) for i in range(200)], "fold int, stats array<double>, y double").repartition(5)
    fourier = quality.Fourier(x.mean(0), x.std(0), 16, 3.0, 1)
    sums = sum(quality.normal_equations(rows, fourier).values())
    z = fourier(x)
    assert np.allclose(sums, z.T @ np.c_[z, y])
    xs, ys = quality.pool_adjacent([(0.1, 1, 0.0), (0.2, 1, 1.0), (0.3, 1, 0.0), (0.4, 2, 1.0)])
    assert xs.tolist() == [0.1, 0.2, 0.3, 0.4] and ys.tolist() == [0.0, 0.5, 0.5, 1.0]


def test_quality_on_given_documents_and_odd_rows(spark, odd_docs):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    stats = quality.text_statistics(docs)
    model = quality.learn(stats, labels, ~fold("doc_id", 3, 1))
    held = quality.score(stats, model).where(fold("doc_id", 3, 1)).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in held) >= 0.95 * len(held)
    odd = quality.fit_and_score(odd_docs, labels.limit(0), F.lit(True)).collect()
    assert len(odd) == odd_docs.count() and {r.score for r in odd} == {0.5}
    assert all(0 <= r.score <= 1 for r in quality.score(quality.text_statistics(odd_docs), model).collect())
