"""Token counts that follow edits.

A document is split into pre-tokens; the tokens of a text are the tokens of its
pre-tokens. Runs of pre-tokens are the leaves of a segment tree whose nodes hold
sums of characters and tokens (a run is split up when an edit first touches it). An edit descends the tree to the pre-tokens it
touches, splits again from a little before it (a pre-token's end depends on at
most two characters behind it) until the new boundaries meet old ones, re-encodes
only those pre-tokens, and updates the sums above the changed leaves.

Everything happens in one pass over the documents without a shuffle; the
vocabulary file is read on the driver and broadcast.

Defined cases: a null text counts as empty; null edits are none; an edit's range
is cut to the text as it is at that moment, a null replacement is empty, a null
or negative start is 0, an end before the start is the start; edits apply in the
order of the array; repeated rows are counted one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 3
LEAF = 400


class Tokens:
    """Pre-token splitting and token counts."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def runs(self, text: str) -> list[str]:
        """The text in runs of whole pre-tokens, about LEAF characters each.

        A space behind a character that is no white space always begins a
        pre-token, so runs can be cut there without splitting them.
        """
        out, start = [], 0
        while len(text) - start > LEAF:
            cut = text.find(" ", start + LEAF)
            while cut > 0 and text[cut - 1].isspace():
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[start:cut])
            start = cut
        if start < len(text) or not out:
            out.append(text[start:])
        return out


class Tree:
    """Segment tree over runs of pre-tokens: node k covers nodes 2k and 2k+1, leaves from `size` on.

    A leaf is a text until an edit touches it, then the list of its pre-tokens.
    """

    def __init__(self, tokens: Tokens, text: str):
        self.tokens, self.recounted = tokens, 0
        runs = tokens.runs(text)
        self._build(runs, [tokens.count(r) for r in runs])

    def _build(self, leaves: list, counts: list[int]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = [len(x) if isinstance(x, str) else sum(map(len, x)) for x in leaves]
        self.sums[self.size : self.size + len(leaves)] = counts
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.sums[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else "".join(x) for x in self.leaves)

    def pretokens(self, leaf: int) -> list[str]:
        """The leaf's pre-tokens; split when first asked for."""
        if isinstance(self.leaves[leaf], str):
            self.leaves[leaf] = self.tokens.split.findall(self.leaves[leaf])
        return self.leaves[leaf]

    def _find(self, position: int) -> tuple[int, int]:
        """Leaf that holds a character position and the characters before that leaf."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if position - before >= self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _add(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.size + leaf
        while k:
            self.chars[k] += chars
            self.sums[k] += tokens
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters [start, end) by `new`."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, at = self._find(max(0, start - CONTEXT))
        head, skip = self.pretokens(first), 0
        while skip < len(head) and at + len(head[skip]) <= start - CONTEXT:  # these cannot see the edit
            at += len(head[skip])
            skip += 1
        old: list[str] = []  # old pre-tokens from there on, read leaf by leaf as far as needed
        places: list[tuple[int, int]] = []  # (leaf, index behind) of each
        leaf, index = first, skip

        def more() -> bool:
            nonlocal leaf, index
            while leaf < len(self.leaves) and index >= len(self.pretokens(leaf)):
                leaf, index = leaf + 1, 0
            if leaf >= len(self.leaves):
                return False
            run = self.leaves[leaf][index:]
            old.extend(run)
            places.extend((leaf, index + i + 1) for i in range(len(run)))
            leaf, index = leaf + 1, 0
            return True

        read = 0
        while at + read < end and more():
            read = sum(map(len, old))
        shift, edited = len(new) - (end - start), start + len(new) - at
        while True:
            whole = not more()
            body = "".join(old)
            text = body[: start - at] + new + body[end - at :]
            ends, position = {}, at  # where old boundaries behind the edit are in the new text
            for n, p in enumerate(old):
                position += len(p)
                if position >= end:
                    ends[position + shift - at] = n
            made: list[str] = []
            meet = None
            for m in self.tokens.split.finditer(text):
                if not whole and m.end() + CONTEXT > len(text):
                    break  # what follows is needed to know where this pre-token ends
                made.append(m.group())
                if m.end() >= edited and m.end() in ends:
                    meet = ends[m.end()]
                    break
            if meet is not None or whole:
                break
        gone = len(old) if meet is None else meet + 1
        last, behind = places[gone - 1] if gone else (first, skip)
        self.recounted += len(made)
        for i in range(first, last + 1):
            run = self.leaves[i]
            low, high = (skip if i == first else 0), (behind if i == last else len(run))
            removed, added = run[low:high], made if i == first else []
            run[low:high] = added
            tokens = sum(map(self.tokens.count, added)) - sum(map(self.tokens.count, removed))
            self._add(i, sum(map(len, added)) - sum(map(len, removed)), tokens)
        if len(self.leaves[first]) > 4 * LEAF:  # a leaf swollen by insertions: cut it up
            runs = self.tokens.runs("".join(self.leaves[first]))
            counts = self.sums[self.size : self.size + len(self.leaves)]
            self._build([*self.leaves[:first], *runs, *self.leaves[first + 1 :]], [*counts[:first], *map(self.tokens.count, runs), *counts[first + 1 :]])


_workers: dict[str, tuple[bytes, Tokens]] = {}


def worker(ranks: bytes, pattern: str) -> Tokens:
    if pattern not in _workers or _workers[pattern][0] is not ranks:
        _workers[pattern] = (ranks, Tokens(ranks, pattern))
    return _workers[pattern][1]


def count_tokens(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN, text: str = "text", edits: str = "edits", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns plus n_tokens, n_tokens_edited, n_pretokens_recounted and edited_text.

    `edits` is a column array<struct<start:int, end:int, text:string>> in code points.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    added = T._parse_datatype_string("n_tokens bigint, n_tokens_edited bigint, n_pretokens_recounted bigint, edited_text string")
    kept = [c for c in keep if c not in added.names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text"), F.col(edits).alias("_edits"))
    arrow = to_arrow_schema(T.StructType([docs.schema[c] for c in kept] + list(added)))

    def run(batches):
        tokens = worker(shared.value, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out: list[list] = [[], [], [], []]
                for body, changes in zip(batch.column("_text").to_pylist(), batch.column("_edits").to_pylist(), strict=True):
                    tree = Tree(tokens, body or "")
                    out[0].append(tree.n_tokens)
                    for e in changes or []:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    out[1].append(tree.n_tokens)
                    out[2].append(tree.recounted)
                    out[3].append(tree.text())
                columns = [batch.column(c).cast(arrow.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, arrow.field(f.name).type) for v, f in zip(out, added, strict=True)]], schema=arrow)

    return source.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + list(added)))
