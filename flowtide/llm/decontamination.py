"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of 13 consecutive benchmark words (an item of fewer
words is one window). They are grouped by length. For each length a shift
table maps every block of consecutive words that occurs in a window to the
smallest distance from a window's end; a block of the text that is in no window
moves the search on by the largest safe step. A block at distance 0 selects the
bucket of windows ending in it, and each of these is compared word by word.

The text is scanned in one pass without a shuffle. The windows are broadcast;
the benchmark is cut into slices of at most `slice_bytes`, so what is broadcast
is bounded, and the hits of several slices are merged per document.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless benchmark text has no window; repeated benchmark rows count once per
item id; an item without an id marks words but is not listed; every document
row is answered on its own, also repeated ones; only the id column is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import kept, map_text

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (bytes.lower leaves every other character alone)."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows(items: Iterable[tuple[str | None, str | None]], size: int = WINDOW) -> dict[tuple[bytes, ...], set[str | None]]:
    """Every window of every item with the items that contain it."""
    found: dict[tuple[bytes, ...], set[str | None]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add(item)
    return found


class WuManber:
    """Shift and bucket tables for windows of one length each."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str | None]]):
        self.groups = []
        for length in sorted({len(p) for p in patterns}):
            block = 3 if length >= 8 else 2 if length >= 3 else 1
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, list] = {}
            for pattern, items in patterns.items():
                if len(pattern) != length:
                    continue
                for end in range(block, length + 1):
                    key = b" ".join(pattern[end - block : end])
                    shift[key] = min(shift.get(key, length), length - end)
                buckets.setdefault(b" ".join(pattern[-block:]), []).append((list(pattern), items))
            self.groups.append((length, block, shift, buckets))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """(start, end) of every occurrence, and the items they belong to."""
        spans, seen = [], set()
        for length, block, shift, buckets in self.groups:
            step, end, n = length - block + 1, length, len(w)
            while end <= n:
                key = b" ".join(w[end - block : end])
                skip = shift.get(key, step)
                if skip:
                    end += skip
                    continue
                for pattern, items in buckets[key]:
                    if w[end - length : end] == pattern:
                        spans.append((end - length, end))
                        seen |= items
                        break
                end += 1
        return spans, seen


# Measured: windows take about 80 bytes a character of benchmark text, the tables made of them about 220 more.
BYTES_A_CHARACTER = 300


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> Iterable[list[tuple[str | None, str | None]]]:
    """The benchmark in lists whose windows and tables take at most about `slice_bytes` in a worker (an item above that is a slice of its own)."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).distinct()
    for item, text in rows.toLocalIterator():
        weight = BYTES_A_CHARACTER * len(text or "")
        if part and size + weight > slice_bytes:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += weight
    if part:
        yield part


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    slice_bytes: int = 256 << 20,
    prefix: str = "",
) -> DataFrame:
    """Per document: n_words, spans (start, end in words, joined), items (sorted ids) and n_hit.

    `keep` names the columns passed through (default: the id); `prefix` goes before the result's names.
    """
    sc = docs.sparkSession.sparkContext
    keep = [doc_id] if keep is None else keep
    current = docs
    fields = f"`{prefix}n_words` bigint, `{prefix}n_hit` bigint, `{prefix}spans` array<struct<start:int,end:int>>, `{prefix}items` array<string>"
    names = [f"{prefix}{n}" for n in ("n_words", "n_hit", "spans", "items")]
    carried: list[str] = []
    slices = 0
    for part in _slices(benchmark, item_id, item_text, slice_bytes):
        shared, slices = sc.broadcast(windows(part)), slices + 1
        current = _scan(current, shared, fields, keep, text, carried, prefix)
        carried = names
    if not slices:
        current = _scan(docs, sc.broadcast({}), fields, keep, text, [], prefix)
    return current.select(*[F.col(f"`{c}`") for c in keep if c not in names], *names)


def _scan(docs: DataFrame, shared, fields: str, keep: list[str], text: str, carried: list[str], prefix: str) -> DataFrame:
    """One pass with one slice; hits of an earlier slice are merged in the same projection."""
    now = map_text(
        docs.withColumnsRenamed({c: f"_was_{c}" for c in carried}),
        lambda: _scanner(shared),
        fields,
        [*dict.fromkeys([*keep, text]), *[f"_was_{c}" for c in carried]],
        text,
    )
    if not carried:
        return now
    spans = (
        f"aggregate(array_sort(concat(`_was_{prefix}spans`, `{prefix}spans`)), cast(array() as array<struct<start:int,end:int>>), "
        "(a, s) -> CASE WHEN size(a) > 0 AND s.start <= element_at(a, -1).end "
        "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(s.end, element_at(a, -1).end)))) "
        "ELSE concat(a, array(s)) END)"
    )
    items = F.array_sort(F.array_union(f"_was_{prefix}items", f"{prefix}items"))
    merged = now.withColumns({f"{prefix}items": items, f"{prefix}spans": F.expr(spans)})
    covered_words = F.expr(f"aggregate(`{prefix}spans`, 0L, (n, s) -> n + s.end - s.start)")
    return merged.withColumn(f"{prefix}n_hit", covered_words).drop(*[f"_was_{c}" for c in carried])


def _scanner(shared):
    """The tables are built once per worker process and broadcast."""
    matcher = kept(shared.value, WuManber)

    def work(texts: list[str | None]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for text in texts:
            w = words(text)
            spans, items = matcher.search(w)
            spans = covered(spans)
            out[0].append(len(w))
            out[1].append(sum(e - s for s, e in spans))
            out[2].append([{"start": s, "end": e} for s, e in spans])
            out[3].append(sorted(i for i in items if i is not None))
        return out

    return work


def is_contaminated(prefix: str = "") -> Column:
    """At least one word in twenty is inside an occurrence."""
    hit = F.col(f"{prefix}n_hit")
    return (hit > 0) & (20 * hit >= F.col(f"{prefix}n_words"))
