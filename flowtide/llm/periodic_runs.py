"""Periodic runs of words: stretches that repeat themselves, found by internal pattern matching.

A run is a stretch of consecutive words of smallest period q and at least
max(MIN_WORDS, 2 q) words that no neighbouring word extends with that period.

The words of some documents are numbered document by document and prefix
doubling gives their suffix array. A wavelet tree over it answers range
successor queries: the next occurrence of a block behind a given position. For
every size 2^k, blocks start at every multiple of 2^(k-1), and the occurrences
of a block in the window behind it are asked for one after the other. A block
that overlaps its first occurrence by half or more has that distance as its
period; its occurrences then form arithmetic progressions, which are skipped or
listed as a whole, so a block asks a bounded number of queries. Distances are
candidate periods; a candidate is extended both ways by comparing ranks of the
doubling and kept if it is long enough. Of candidates for the same stretch the
smallest period stays.

Complete: let m = max(q, MIN_WORDS - q). A run of period q agrees with itself
shifted by q over at least m words, which hold a whole block of every size with
3 * 2^(k-1) - 1 <= m. For the largest such k, q lies within the window of
3 * 2^k - 2 words, so the block's occurrence q words on is among those listed
(or is in the same progression as the block itself, and then q is no smallest period).

One pass without a shuffle; documents are handled together up to BATCH_WORDS
words, a longer document on its own, so memory follows the longest text.

Defined cases: a null, empty or blank text has no runs and collapses to an empty
text; words are split at ASCII white space only; runs are ordered by start, then
period; repeated rows are answered one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import map_text

MIN_WORDS = 12
BATCH_WORDS = 1 << 17
FIELDS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class SuffixIndex:
    """Suffix array of several word sequences, with the ranks of all substrings of 2^k words.

    `codes` must differ between sequences; `ends` gives the end of each position's sequence.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        n = self.n = len(codes)
        order = np.argsort(codes, kind="stable")
        key, slots, rank = codes[order], np.arange(n), np.zeros(n, np.int64)
        chosen, self.ranks, step = order, [], 1
        while True:
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(key)))
            rank = rank.copy()
            rank[chosen] = np.repeat(slots[starts], sizes)
            self.ranks.append(rank)
            open_ = np.repeat(sizes > 1, sizes)
            if not open_.any():
                break
            slots, chosen = slots[open_], chosen[open_]
            follow = chosen + step
            second = np.where(follow < ends[chosen], rank[np.minimum(follow, n - 1)] + 1, 0)
            key = rank[chosen] * (n + 1) + second
            by_key = np.argsort(key, kind="stable")
            key, chosen = key[by_key], chosen[by_key]
            order[slots] = chosen
            step *= 2
        self.order = order

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common words from positions a and b on."""
        at = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y, rank = a + at, b + at, self.ranks[k]
            inside = (x < self.n) & (y < self.n)
            same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
            at += same * (1 << k)
        return at

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common words before positions a and b."""
        at = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y, rank = a - at - (1 << k), b - at - (1 << k), self.ranks[k]
            inside = (x >= 0) & (y >= 0)
            same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
            at += same * (1 << k)
        return at


class WaveletTree:
    """Values 0..n-1 in a given order; counts and quantiles of any stretch of that order, many at once."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), []
        for bit in range(self.n.bit_length() - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(low, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[low], values[~low]])

    def less(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are below the bound."""
        count = np.zeros(len(lo), np.int64)
        for bit, zeros, ones_at in self.levels:
            z_lo, z_hi, one = zeros[lo], zeros[hi], (bound >> bit) & 1 == 1
            count += np.where(one, z_hi - z_lo, 0)
            lo, hi = np.where(one, ones_at + lo - z_lo, z_lo), np.where(one, ones_at + hi - z_hi, z_hi)
        return count

    def quantile(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of a 0-based rank among those in [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for bit, zeros, ones_at in self.levels:
            z_lo, z_hi = zeros[lo], zeros[hi]
            below = z_hi - z_lo
            one = rank >= below
            rank = np.where(one, rank - below, rank)
            value |= one.astype(np.int64) << bit
            lo, hi = np.where(one, ones_at + lo - z_lo, z_lo), np.where(one, ones_at + hi - z_hi, z_hi)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The smallest value in [lo, hi) above `after`; n where there is none."""
        rank = self.less(lo, hi, after + 1)
        found = rank < hi - lo
        value = np.full(len(lo), self.n, np.int64)
        value[found] = self.quantile(lo[found], hi[found], rank[found])
        return value


def candidates(index: SuffixIndex, tree: WaveletTree, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of the occurrences of all blocks of 2^k words in the windows behind them."""
    size, window, rank = 1 << k, 3 * (1 << k) - 2, index.ranks[k]
    block = np.arange(0, index.n, size // 2)
    lo = rank[block]
    hi = lo + np.bincount(rank, minlength=index.n)[lo]
    many = (hi - lo > 1) & (block + size <= ends[block])
    block, lo, hi = block[many], lo[many], hi[many]
    starts, distances = [], []
    at, period = block.copy(), np.zeros(len(block), np.int64)
    fresh = True
    while len(block):
        found = tree.successor(lo, hi, at)
        near = (found < index.n) & (found <= block + window)
        block, lo, hi, found, period = block[near], lo[near], hi[near], found[near], period[near]
        if fresh:  # the first distance tells whether the block is periodic
            period = np.where(2 * (found - block) <= size, found - block, 0)
        begin = np.where(period > 0, block, found) if fresh else found
        at, terms = found.copy(), np.zeros(len(block), np.int64)
        some = np.flatnonzero(period)
        if len(some):
            p, b = period[some], begin[some]
            terms[some] = (p + index.common_after(b, b + p) - size) // p
            at[some] = b + p * terms[some]
        listed = terms + 1
        if fresh:
            listed = np.where(period > 0, 0, 1)  # occurrences in the block's own progression repeat a smaller period
            starts.append(block[period > 0])
            distances.append(period[period > 0])
        which = np.repeat(np.arange(len(block)), listed)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(listed) - listed, listed)
        far = found[which] + nth * period[which] - block[which]
        starts.append(block[which][far <= window])
        distances.append(far[far <= window])
        fresh = False
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(distances)


def runs_of(codes: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, ordered by start and period."""
    empty = np.zeros(0, np.int64)
    if len(codes) < min_words:
        return empty, empty, empty
    index = SuffixIndex(codes, ends)
    if len(index.ranks) < 2:
        return empty, empty, empty
    tree, found = None, []
    for k in range(1, len(index.ranks)):
        if 3 * 2**k - 2 < min_words // 2:  # every period belongs to a longer block
            continue
        tree = tree or WaveletTree(index.order)
        start, distance = candidates(index, tree, ends, k)
        reach = np.maximum(distance, min_words - distance)
        own = (3 * 2**k // 2 - 1 <= reach) & (reach < 3 * 2**k - 1)  # the level that answers for this period
        start, distance = start[own], distance[own]
        before, after = index.common_before(start, start + distance), index.common_after(start, start + distance)
        length = distance + before + after
        long = length >= np.maximum(min_words, 2 * distance)
        found.append(np.stack([start[long] - before[long], length[long], distance[long]]))
    start, length, period = np.concatenate(found, axis=1) if found else (empty, empty, empty)
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _solve(group: list[list[bytes]], min_words: int) -> tuple[list[int], list[np.ndarray], list[str]]:
    """Runs per document and the collapsed texts of some documents' words."""
    sizes = np.array([len(w) for w in group])
    ends_at = np.cumsum(sizes)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for words in group for w in words), np.int64, int(ends_at[-1]))
    owner = np.repeat(np.arange(len(group)), sizes)
    start, length, period = runs_of(owner * max(1, len(names)) + ids, ends_at[owner], min_words)
    runs_of_doc = np.bincount(owner[start], minlength=len(group)) if len(start) else np.zeros(len(group), np.int64)
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.cumsum(marks)[:-1] == 0
    texts = []
    for words, n_runs, end in zip(group, runs_of_doc, ends_at, strict=True):
        if n_runs:
            words = [w for w, k in zip(words, kept[end - len(words) : end].tolist(), strict=True) if k]
        texts.append(b" ".join(words).decode("utf-8", "replace"))
    offset = (ends_at - sizes)[owner[start]] if len(start) else start
    return runs_of_doc.tolist(), [start - offset, length, period], texts


def solve(texts: Sequence[str | None], min_words: int = MIN_WORDS, batch_words: int = BATCH_WORDS) -> list[pa.Array]:
    """Runs (list of structs) and collapsed text of every text."""
    counts, columns, collapsed, group, held = [], [], [], [], 0

    def flush():
        if group:
            n, found, out = _solve(group, min_words)
            counts.extend(n)
            columns.append(found)
            collapsed.extend(out)
            group.clear()

    for text in texts:
        words = (text or "").encode("utf-8", "replace").split()
        if held + len(words) > batch_words:
            flush()
            held = 0
        group.append(words)
        held += len(words)
    flush()
    fields = [np.concatenate([c[i] for c in columns]) if columns else np.zeros(0, np.int64) for i in range(3)]
    structs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], names=["start", "length", "period"])
    offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
    return [pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.string())]


def find_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), min_words: int = MIN_WORDS) -> DataFrame:
    """Kept columns plus `runs` (word number, words, period) and `collapsed`, the text with every run cut to one period.

    Kept columns named like a result are replaced by it.
    """
    return map_text(docs, lambda: lambda texts: solve(texts, min_words), FIELDS, keep, text)


def with_repeated_tail(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text; one document of ten, chosen by crc32 of the id, gets a periodic tail, other texts stay as they are."""
    h = F.crc32(F.col(doc_id).cast("string"))
    chosen = docs.select(F.col(doc_id), F.col(text), h.alias("_h"))
    chosen = chosen.withColumn("_w", F.when(h % 10 == 0, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")))
    chosen = chosen.withColumn("_n", F.when(F.size("_w") > 0, F.size("_w").cast("bigint")))
    g, n, w = F.floor(F.col("_h") / 10), F.col("_n"), F.col("_w")
    chosen = chosen.withColumn("_a", g % n).withColumn("_p", F.floor((n - F.col("_a")) / (3 + g % 8)) + 1)
    a, p = F.col("_a"), F.col("_p")
    made = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return chosen.select(F.col(doc_id), F.when(n.isNotNull(), F.array_join(made, " ")).otherwise(F.col(text)).alias(text))


def longest(runs: Column) -> Column:
    """The longest run; of equally long ones the first, then the one of smallest period. NULL without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("minus"))))


def listed(runs: Column) -> Column:
    """`start,length,period` lines of all runs."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.array_join(lines, "")
