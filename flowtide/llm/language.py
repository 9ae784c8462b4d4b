"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed from left to right into the longest phrases that occur
in the sample; text in the sample's language needs few, long phrases. The
language with the fewest phrases, normalised to bits per symbol (phrases times
log2 of the sample's length, over the text's symbols), wins.

Symbols are lower-cased letters of the samples; runs of anything that is not a
letter become one space. The parse starts anew after every BLOCK symbols, for
every language alike, so that many blocks advance together as array lanes and a
very long text is just more lanes. Every symbol of the text is parsed.

Defined cases: a null text or one without a letter is `und` with score 0; with
no labelled text at all every row is `und`; equal costs go to the first language
in order of name; rows without id or lang are never learnt from; repeated rows
are answered one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.llm.common import kept, map_text, unit_hash
from flowtide.operators.scale import small

BLOCK = 1024
PLAIN_BITS = 8.0
LANES = 2_000_000
TABLE_BYTES = 64 << 20
SPACE = 1


class Automaton:
    """Suffix automaton of one symbol sequence, built online."""

    def __init__(self, symbols: Sequence[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, symbols: Sequence[int]) -> int:
        """Number of phrases of the greedy parse, symbol by symbol (the array parse must agree)."""
        state, count = 0, 0
        for c in symbols:
            if c in self.next[state]:
                state = self.next[state][c]
                continue
            count += state != 0
            state = self.next[0].get(c, 0)
            count += state == 0
        return count + (state != 0)

    def edges(self) -> dict[str, np.ndarray]:
        """All steps as arrays, in order of state."""
        n = [len(e) for e in self.next]
        return {
            "state": np.repeat(np.arange(len(n), dtype=np.int32), n),
            "symbol": np.fromiter((c for e in self.next for c in e), np.int32, sum(n)),
            "next": np.fromiter((t for e in self.next for t in e.values()), np.int32, sum(n)),
        }


def _root(edges: dict[str, np.ndarray], width: int) -> np.ndarray:
    """Next state of every symbol from the root, 0 for none."""
    root, first = np.zeros(width, np.int32), edges["state"] == 0
    root[edges["symbol"][first]] = edges["next"][first]
    return root


def dense(edges: dict[str, np.ndarray], states: int, width: int) -> np.ndarray:
    """Steps as a full table: for (state, symbol) the next state's row offset, times 4, plus the phrases that end."""
    root = _root(edges, width)
    # where the walk starts anew the phrase before ends; with an unknown symbol one more does
    restart = np.where(root > 0, root * (4 * width) + 1, 2).astype(np.int32)
    out = np.tile(restart, (states, 1))
    out[0] = np.where(root > 0, root * (4 * width), 1)
    out[edges["state"], edges["symbol"]] = edges["next"] * (4 * width)
    return out.ravel()


def hashed(edges: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Steps as an open-addressing table of (state * width + symbol), at most half full, and the root's row."""
    key = edges["state"].astype(np.int64) * width + edges["symbol"]
    size = 1 << max(4, (2 * len(key) - 1).bit_length())
    keys, nexts = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    slot, open_ = _slot(key, size), np.arange(len(key))
    while len(open_):
        free = open_[keys[slot[open_]] < 0]
        keys[slot[free]] = key[free]  # of several that want one slot the last stays
        stays = free[keys[slot[free]] == key[free]]
        nexts[slot[stays]] = edges["next"][stays]
        open_ = np.setdiff1d(open_, stays, assume_unique=True)
        slot[open_] = (slot[open_] + 1) & (size - 1)
    return {"keys": keys, "next": nexts, "root": _root(edges, width)}


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    """First place of a key: the high bits of a product that wraps around."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


class Model:
    """Automata of all learnt languages; each has the letters of its own sample as its alphabet.

    Only their edges are broadcast; a worker makes tables of them (`tables`).
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if len(c) == 1 and c.isalpha()})
        self.codes = {c: i + 2 for i, c in enumerate(letters)}
        lookup = self.lookup()
        rows = {k: [symbols(t, lookup) for t in samples[k]] for k in self.langs}
        joint = [np.concatenate([[SPACE], *[np.append(r, SPACE) for r in rows[k]]]).astype(np.int64) for k in self.langs]
        self.weight = np.array([math.log2(len(s) + 1) for s in joint])
        self.limits = {k: _limit(rows[k]) for k in self.langs}
        self.alphabets, self.streams, self.edges = [], [], []
        for stream in joint:
            own = np.zeros(len(letters) + 2, np.int32)  # 0: a letter that this language's sample does not have
            own[np.unique(stream)] = np.arange(1, len(np.unique(stream)) + 1)
            self.alphabets.append(own)
            self.streams.append(own[stream])
            self.edges.append(Automaton(self.streams[-1].tolist()).edges())

    def automaton(self, k: int) -> Automaton:
        """The automaton behind the k-th table, over its own alphabet."""
        return Automaton(self.streams[k].tolist())

    def lookup(self) -> np.ndarray:
        return lookup_of(self.codes)

    def limit(self, lang: str = "lang_pred") -> Column:
        """Bits per symbol above which a text counts as none of the row's language."""
        pairs = [F.lit(v) for k in self.langs for v in (k, self.limits[k])]
        return F.coalesce(F.create_map(*pairs)[F.col(lang)], F.lit(PLAIN_BITS)) if pairs else F.lit(PLAIN_BITS)

    def packed(self) -> dict:
        """What a worker needs, as plain arrays."""
        return {"langs": self.langs, "weight": self.weight, "codes": self.codes, "alphabets": self.alphabets, "edges": self.edges}


def lookup_of(codes: dict[str, int]) -> np.ndarray:
    """Code of every code point: 0 an unlearnt letter, 1 no letter, from 2 the alphabet."""
    out = np.fromiter((0 if chr(c).isalpha() else SPACE for c in range(0x110000)), np.int32, 0x110000)
    for c, code in codes.items():
        out[ord(c)] = code
        if len(c.upper()) == 1:
            out[ord(c.upper())] = code
    return out


def tables(packed: dict) -> dict:
    """A worker's tables: dense where those of all languages fit in TABLE_BYTES together, otherwise hashed.

    So thousands of letters cost no more than few.
    """
    made = []
    for own, edges in zip(packed["alphabets"], packed["edges"], strict=True):
        states, width = int(edges["next"].max(initial=0)) + 1, int(own.max()) + 1
        fits = states * width * 4 <= TABLE_BYTES // len(packed["edges"])
        made.append(dense(edges, states, width) if fits else hashed(edges, width))
    return {**packed, "lookup": lookup_of(packed["codes"]), "tables": made}


def _limit(rows: list[np.ndarray]) -> float:
    """The limit of a language, from its labelled rows: every second one is parsed by the others.

    Two costs are taken of such a row, as it is and with its symbols in random order. The
    limit is the usual cost without order or the highest with it, whichever is more, over
    the rows whose order helps; no less than plain bytes.
    """
    rows = [r for r in rows if (r != SPACE).any()]
    if len(rows) == 1:
        rows = np.array_split(rows[0], 2)
    known = np.concatenate([[SPACE], *[np.append(r, SPACE) for r in rows[::2]]])
    automaton, weight, random = Automaton(known.tolist()), math.log2(len(known) + 1), np.random.default_rng(0)
    ordered, mixed = [], []
    for r in rows[1::2]:
        if len(r):
            plain, any_order = (weight * automaton.phrases(s.tolist()) / len(r) for s in (r, random.permutation(r)))
            if plain < any_order:
                ordered.append(plain)
                mixed.append(any_order)
    return float(max([PLAIN_BITS, *ordered, *([np.median(mixed)] if mixed else [])]))


def symbols(text: str, lookup: np.ndarray) -> np.ndarray:
    """Symbol codes with runs of non-letters joined to one space."""
    codes = lookup[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    if len(keep):
        keep[0] = True
    return codes[keep]


def parse(blocks: list[np.ndarray], packed: dict) -> np.ndarray:
    """Phrases of each block under each language: all blocks advance together, one symbol a step."""
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    lengths = np.array([len(blocks[i]) for i in order])
    grid = np.zeros((lengths[0], len(blocks)), np.int32)
    for lane, i in enumerate(order):
        grid[: lengths[lane], lane] = blocks[i]
    out = np.empty((len(packed["langs"]), len(blocks)), np.int64)
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for k, (own, table) in enumerate(zip(packed["alphabets"], packed["tables"], strict=True)):
        walk = _walk_hashed if isinstance(table, dict) else _walk_dense
        out[k, order] = walk(table, own[grid], alive)
    return out


def _walk_dense(steps: np.ndarray, grid: np.ndarray, alive: np.ndarray) -> np.ndarray:
    state, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int32)
    for t, n in enumerate(alive):
        found = steps[state[:n] + grid[t, :n]]
        count[:n] += found & 3
        state[:n] = found >> 2
    return count + (state != 0)


def _walk_hashed(table: dict[str, np.ndarray], grid: np.ndarray, alive: np.ndarray) -> np.ndarray:
    keys, nexts, root = table["keys"], table["next"], table["root"]
    size, width = len(keys), len(root)
    state, count = np.zeros(grid.shape[1], np.int64), np.zeros(grid.shape[1], np.int64)
    for t, n in enumerate(alive):
        key = state[:n] * width + grid[t, :n]
        slot = _slot(key, size)
        there = keys[slot]
        probing = np.flatnonzero((there != key) & (there >= 0))
        while len(probing):
            slot[probing] = (slot[probing] + 1) & (size - 1)
            there[probing] = keys[slot[probing]]
            probing = probing[(there[probing] != key[probing]) & (there[probing] >= 0)]
        known = there == key
        again = root[grid[t, :n]]
        count[:n] += np.where(known, 0, np.add(state[:n] != 0, again == 0, dtype=np.int64))
        state[:n] = np.where(known, nexts[slot], again)
    return count + (state != 0)


def _predictor(shared):
    packed = kept(shared.value, tables)
    lookup, langs = packed["lookup"], packed["langs"]

    def flush(blocks, owners, sizes, bits):
        if blocks:
            for k, phrases in enumerate(parse(blocks, packed)):
                np.add.at(bits[k], owners, phrases * packed["weight"][k])
            blocks.clear()
            owners.clear()

    def work(texts: list[str | None]) -> list[list]:
        sizes = np.zeros(len(texts), np.int64)
        bits = np.zeros((max(1, len(langs)), len(texts)))
        blocks, owners, held = [], [], 0
        for i, text in enumerate(texts):
            if not text or not langs:
                continue
            codes = symbols(text, lookup)
            if (codes == SPACE).all():
                continue
            sizes[i] = len(codes)
            for start in range(0, len(codes), BLOCK):
                blocks.append(codes[start : start + BLOCK])
                owners.append(i)
                held += len(blocks[-1])
                if held >= LANES:
                    flush(blocks, owners, sizes, bits)
                    held = 0
        flush(blocks, owners, sizes, bits)
        cost = bits / np.maximum(sizes, 1)
        best = cost.argmin(axis=0)
        low = np.sort(cost, axis=0)
        if len(langs) > 1:
            score = low[1] / np.maximum(low[0] + low[1], 1e-12)
        else:
            score = np.ones(len(texts))
        known = sizes > 0
        return [
            [langs[b] if k else "und" for b, k in zip(best, known, strict=True)],
            np.where(known, score, 0.0).tolist(),
            [float(v) if k else None for v, k in zip(low[0], known, strict=True)],
            sizes.tolist(),
        ]

    return work


def learn(docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = 128, sample_chars: int = 512, total_chars: int = 1 << 19) -> Model:
    """Fits the automata on a bounded sample of the labelled rows that `learn_from` admits.

    Per language about `sample_docs` rows, chosen by hash of the id, contribute
    an excerpt of up to `sample_chars` characters each, from a place in the text
    that is hashed from the id too; excerpts without a letter are passed over.
    All languages together give at most `total_chars`, so the broadcast model does not grow with the data.
    """
    rows = docs.where(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    spare = F.greatest(F.char_length(text) - sample_chars, F.lit(0))
    start = F.floor(unit_hash(doc_id, seed=4) * (spare + 1)).cast("int") + 1
    rows = rows.select(F.col(lang).alias("lang"), F.substring(F.col(text), start, F.lit(sample_chars)).alias("text"), unit_hash(doc_id, seed=3).alias("_u"), F.col(doc_id).alias("_id"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count()
    picked = (
        rows.join(small(counts), "lang")
        .where(F.col("_u") < F.lit(2.0 * sample_docs) / F.col("count"))
        .withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_u", "_id", "text")))
        .where(F.col("_n") <= sample_docs)
    )
    samples: dict[str, list[str]] = {}
    for r in picked.orderBy("lang", "_n").select("lang", "text").collect():
        samples.setdefault(r.lang, []).append(r.text)
    share = total_chars // max(1, len(samples))
    return Model({k: _fill(v, share) for k, v in samples.items()})


def _fill(texts: list[str], chars: int) -> list[str]:
    out = []
    for t in texts:
        if chars <= 0:
            break
        out.append(t[:chars])
        chars -= len(t)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), names: Sequence[str] = ("lang_pred", "score", "bits", "n_symbols")) -> DataFrame:
    """Kept columns plus the language, its score, its bits per symbol and the number of symbols parsed."""
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    kinds = ("string", "double", "double", "bigint")
    return map_text(docs, lambda: _predictor(shared), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)), keep, text)


def rejected(lang: str = "lang_pred", bits: str = "bits", n_symbols: str = "n_symbols", limit: float | Column = PLAIN_BITS, at_least: int = 64) -> Column:
    """No letters at all, or a text of some length that costs more than the limit, by default 8 bits a symbol.

    `Model.limit` gives the limit of each language: one of thousands of signs needs more than plain bytes.
    """
    return (F.col(lang) == "und") | ((F.col(n_symbols) >= at_least) & (F.col(bits) > limit))
