"""Alignment of two tokenizers by byte offsets, with pair counts by external spill counting.

Each text is encoded by both tokenizers: A, a byte-level BPE, gets a space and
the text; B, a piece model that marks the first word itself, gets the text.
Bytes where a token of A and one of B both end cut the tokens into groups; two
tokens whose byte ranges overlap are linked. A pair's count is the number of its
links in all documents.

Counting is external. A task collects pair-document records up to RUN_RECORDS,
sorts them with B's id as the major key, cuts them by B's id into PARTS and
writes each as a run of zstd frames: pairs with totals, and the documents of
every pair. Only the pairs are shuffled. The runs of a part are merged k ways with
a heap of their next pairs, at most FAN_IN runs in a task, in as many passes as
that takes. The last pass sees all pairs of one B id one after the other and so
knows their highest count. Counts go back to the runs of their part, not more
than FAN_IN runs at a time: each run streams its documents' contributions, and
the parts' contributions to the documents of one run meet in one small group.

Memory: a run's records in a task, one frame per merged run and one part's
distinct pairs. A pair or id that holds a third of all links is one entry per run.

Defined cases: a null or empty text, and one whose tokens of A or of B do not
spell space + text (such as one with a literal U+2581), has no tokens: zeros and
an empty digest; strings of special tokens are plain text; repeated rows each count; kept columns
named like a result are replaced by it; ties for the highest count are all best.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowtide.llm.common import kept as _shared_once
from flowtide.llm.token_counts import PATTERN
from flowtide.session import materialize

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
PARTS = 128
RUN_RECORDS = 1 << 20
RUN_DOCS = 1 << 16
FAN_IN = 256
FRAME = 8192
RESULTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers and the bytes of their tokens, from the contents of their files."""

    def __init__(self, byte_bpe: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken

        spec, byte = json.loads(byte_bpe), byte_of_char()
        special = {t["content"] for t in spec["added_tokens"]}
        spelled = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [spelled[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=spelled, special_tokens={})
        self.n_a = max(spelled.values()) + 1
        self.a_size = np.zeros(self.n_a, np.int64)
        for token, i in spelled.items():
            self.a_size[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.n_b = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.b_size = np.array([len(b) for b in self.b_bytes])
        self.a_text = _labels(self.n_a, ",", "|")
        self.b_text = _labels(self.n_b, ",", ";")


def _labels(n: int, inside: str, last: str) -> np.ndarray:
    """Decimal ids with what follows them inside a group (first half) and at its end (second half)."""
    out = np.empty(2 * n, object)
    out[:] = [f"{i}{c}".encode() for c in (inside, last) for i in range(n)]
    return out


def align(pair: Pair, texts: Sequence[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Counts and group listings per text; pair keys (b * n_a + a) of all links with their text's number."""
    n = len(texts)
    some = [i for i, t in enumerate(texts) if t]
    a_ids, b_ids, owners, sizes = [], [], [], []
    encoded = pair.b.encode([texts[i] for i in some], num_threads=1) if some else []
    for i, b in zip(some, encoded, strict=True):
        data = f" {texts[i]}".encode("utf-8", "surrogatepass")
        if b"".join(map(pair.b_bytes.__getitem__, b)) != data:
            continue
        a = pair.a.encode_to_numpy(f" {texts[i]}", disallowed_special=()).astype(np.int64)
        if pair.a_size[a].sum() == len(data):  # a byte-level token is a stretch of the data, so equal length is equality
            a_ids.append(a)
            b_ids.append(np.array(b, np.int64))
            owners.append(i)
            sizes.append(len(data))
    counts = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    listing: list[bytes] = [b""] * n
    if not owners:
        return {**counts, "groups": listing}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, owner = np.concatenate(a_ids), np.concatenate(b_ids), np.array(owners)
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    bytes_end = np.cumsum(sizes)
    by_a, by_b = np.zeros(bytes_end[-1] + 1, bool), np.zeros(bytes_end[-1] + 1, bool)
    by_a[a_end] = True
    by_b[b_end] = True
    both = by_a & by_b
    cut = np.flatnonzero(by_a | by_b)  # every stretch between cuts lies in one token of A and one of B
    rank_a, rank_b = np.cumsum(by_a, dtype=np.int32), np.cumsum(by_b, dtype=np.int32)
    link_a, link_b = rank_a[cut] - by_a[cut], rank_b[cut] - by_b[cut]
    cuts_end = np.searchsorted(cut, bytes_end, side="right")
    counts["n_a"][owner] = [len(x) for x in a_ids]
    counts["n_b"][owner] = [len(x) for x in b_ids]
    counts["n_links"][owner] = np.diff(cuts_end, prepend=0)
    group_rank = np.cumsum(both, dtype=np.int32)
    counts["n_groups"][owner] = np.diff(group_rank[bytes_end], prepend=0)
    key = b[link_b] * pair.n_a + a[link_a]
    text_of = np.repeat(owner, counts["n_links"][owner])

    a_last, b_last = both[a_end], both[b_end]
    a_group, b_group = group_rank[a_end] - a_last, group_rank[b_end] - b_last
    groups = int(group_rank[-1])
    b_before = np.cumsum(np.bincount(b_group, minlength=groups)) - np.bincount(b_group, minlength=groups)
    a_until = np.cumsum(np.bincount(a_group, minlength=groups))
    parts = np.empty(len(a) + len(b), object)
    parts[np.arange(len(a)) + b_before[a_group]] = pair.a_text[a + a_last * pair.n_a]
    parts[np.arange(len(b)) + a_until[b_group]] = pair.b_text[b + b_last * pair.n_b]
    parts, at = parts.tolist(), 0
    for i in owners:
        stop = at + int(counts["n_a"][i] + counts["n_b"][i])
        listing[i] = b"".join(parts[at:stop])[:-1]
        at = stop
    return {**counts, "groups": listing}, key, text_of


def _pack(*columns: np.ndarray) -> bytes:
    """One frame: the columns as 64-bit numbers with their bytes put plane by plane, zstd-compressed."""
    planes = b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(frame: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def pack_pairs(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Ascending keys and their values as length-prefixed frames."""
    out = []
    for at in range(0, len(keys), FRAME):
        part = keys[at : at + FRAME]
        frame = _pack(np.diff(part, prepend=0), *[v[at : at + FRAME] for v in values])
        out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def frames(blob: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    """The frames of `pack_pairs`, one at a time."""
    at = 0
    while at < len(blob):
        (size,) = struct.unpack_from("<I", blob, at)
        found = _unpack(blob[at + 4 : at + 4 + size], columns)
        found[0] = np.cumsum(found[0])
        yield found
        at += 4 + size


def merge_runs(blobs: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending distinct keys with summed counts of several runs, block by block: a heap holds every run's next key."""
    cursors = []
    heap: list[tuple[int, int]] = []
    for blob in blobs:
        source = frames(blob, 2)
        first = next(source, None)
        if first is not None:
            heap.append((int(first[0][0]), len(cursors)))
            cursors.append([source, *first])
    heapq.heapify(heap)
    while heap:
        taken, bound = [], None
        while heap and (bound is None or heap[0][0] <= bound):
            _, c = heapq.heappop(heap)
            taken.append(c)
            last = int(cursors[c][1][-1])
            bound = last if bound is None else min(bound, last)
        keys, sums = [], []
        for c in taken:
            source, key, count = cursors[c]
            n = int(np.searchsorted(key, bound, side="right"))
            keys.append(key[:n])
            sums.append(count[:n])
            if n == len(key):
                following = next(source, None)
                if following is None:
                    cursors[c] = None
                    continue
                cursors[c][1:] = following
            else:
                cursors[c][1:] = key[n:], count[n:]
            heapq.heappush(heap, (int(cursors[c][1][0]), c))
        key = np.concatenate(keys)
        by = np.argsort(key, kind="stable")
        key, count = key[by], np.concatenate(sums)[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if len(key):
            yield key[first], np.add.reduceat(count, first)


def with_best(merged: Iterator[tuple[np.ndarray, np.ndarray]], n_a: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds whether a pair's count is the highest of its B id; holds back one B id at a time."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def marked(key, count):
        side = key // n_a
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        top = np.maximum.reduceat(count, first)
        return key, count, (count == np.repeat(top, np.diff(np.append(first, len(key))))).astype(np.int64)

    for key, count in merged:
        key, count = np.concatenate([held[0], key]), np.concatenate([held[1], count])
        open_ = int(np.searchsorted(key, key[-1] // n_a * n_a))
        held = key[open_:], count[open_:]
        if open_:
            yield marked(key[:open_], count[:open_])
    if len(held[0]):
        yield marked(*held)


def part_of(key: np.ndarray, n_a: int, parts: int) -> np.ndarray:
    """Radix: the low digits of B's id, so that all pairs of one B id share a part."""
    return key // n_a % parts


def write_run(codes: np.ndarray, shift: int, n_a: int, parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part, pairs, postings) of the records key << shift | document, for every part that has any."""
    codes, times = np.unique(codes, return_counts=True)
    key, doc = codes >> shift, codes & ((1 << shift) - 1)
    part = part_of(key, n_a, parts)
    by = np.argsort(part, kind="stable")  # keys stay ascending within a part
    key, doc, times, part = key[by], doc[by], times[by], part[by]
    edges = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in range(parts):
        k, d, t = (c[edges[p] : edges[p + 1]] for c in (key, doc, times))
        if not len(k):
            continue
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        listed = np.diff(np.append(first, len(k)))
        pairs = pack_pairs(k[first], np.add.reduceat(t, first))
        heads = _pack(listed)
        out.append((p, pairs, struct.pack("<I", len(heads)) + heads + _pack(d, t)))
    return out


def contributions(pairs: bytes, postings: bytes, key: np.ndarray, count: np.ndarray, best: np.ndarray) -> bytes:
    """(document, best links, count sum) of one run and part, given the part's counts in key order."""
    own = np.concatenate([f[0] for f in frames(pairs, 2)])
    (size,) = struct.unpack_from("<I", postings, 0)
    (listed,) = _unpack(postings[4 : 4 + size], 1)
    doc, times = _unpack(postings[4 + size :], 2)
    at = np.repeat(np.searchsorted(key, own), listed)
    total, top = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
    np.add.at(total, doc, times * count[at])
    np.add.at(top, doc, times * best[at])
    docs = np.flatnonzero(total)
    return _pack(docs, top[docs], total[docs])


def _encode(docs: DataFrame, files, text: str, kept: list[str], parts: int, run_records: int, groups: bool) -> DataFrame:
    """Rows of documents (run, nth, counts) and rows of runs (run, part, pairs, postings) in one table."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    own = T._parse_datatype_string(
        "_run bigint, _nth bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, _part int, _pairs binary, _postings binary"
    )
    keep = [T.StructField(f"_kept{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    source = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_kept{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*own, *keep])
    arrow = to_arrow_schema(schema)
    shift = RUN_DOCS.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _shared_once(shared.value, lambda files: Pair(*files))
        number, nth, held, codes = TaskContext.get().partitionId() << 32, 0, 0, []

        def table(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow
            )

        def spill() -> pa.RecordBatch:
            made = write_run(np.concatenate(codes), shift, pair.n_a, parts)
            p, pairs, postings = zip(*made, strict=True)
            return table(len(made), _run=[number] * len(made), _part=list(p), _pairs=list(pairs), _postings=list(postings))

        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                found, key, text_of = align(pair, batch.column("_text").to_pylist())
                n = batch.num_rows
                listing = found.pop("groups")
                shown = [g.decode() if g else None for g in listing] if groups else [None] * n
                digest = [hashlib.sha256(g).hexdigest() if g else "" for g in listing]
                columns = {f"_kept{i}": batch.column(f"_kept{i}").cast(arrow.field(f"_kept{i}").type) for i in range(len(kept))}
                yield table(n, _run=[number] * n, _nth=np.arange(nth, nth + n), groups_sha256=digest, groups=shown, **found, **columns)
                if len(key):
                    codes.append(key << shift | (text_of + nth))
                    held += len(key)
                nth += n
                if held >= run_records or nth > RUN_DOCS - 64:
                    if codes:
                        yield spill()
                    number, nth, held, codes = number + 1, 0, 0, []
        if codes:
            yield spill()

    return source.mapInArrow(run, schema)


def count_pairs(runs: DataFrame, n_a: int, parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """(part, blob of key, count, best) from rows (run, part, pairs): merges of at most `fan_in` runs, pass after pass."""
    level = runs.select(F.col("_part").alias("part"), F.col("_pairs").alias("pairs"), F.col("_run").alias("run"))
    while True:
        most = level.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        ways = max(1, -(-most // fan_in))
        salted = level.withColumn("salt", F.pmod(F.xxhash64("run", "part"), F.lit(ways)).cast("int"))
        done = salted.groupBy("part", "salt").applyInArrow(_merger(n_a, ways == 1), "part int, run bigint, pairs binary")
        level = materialize(done, "pair-counts" if ways == 1 else "pair-runs")
        if ways == 1:
            return level.select("part", F.col("pairs").alias("counts"))


def _merger(n_a: int, last: bool):
    def merge(group: pa.Table) -> pa.Table:
        merged = merge_runs(group.column("pairs").to_pylist())
        blocks = [np.concatenate(c) for c in zip(*(with_best(merged, n_a) if last else merged), strict=True)]
        return pa.table({"part": group.column("part").slice(0, 1), "run": group.column("run").slice(0, 1), "pairs": pa.array([pack_pairs(*blocks)], pa.binary())})

    return merge


def align_tokens(
    docs: DataFrame,
    byte_bpe: str = BYTE_BPE,
    pieces: str = PIECES,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    groups: bool = False,
    parts: int = PARTS,
    run_records: int = RUN_RECORDS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Kept columns plus n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, the groups as text.

    n_best counts the links whose pair has the highest count of its B id, count_sum adds up the links' counts.
    """
    with open(byte_bpe, "rb") as a, open(pieces, "rb") as b:
        files = (a.read(), b.read())
    n_a = _n_a(files[0])
    results = [f.name for f in T._parse_datatype_string(RESULTS)] + (["groups"] if groups else [])
    kept = [c for c in keep if c not in results]
    rows = materialize(_encode(docs, files, text, kept, parts, run_records, groups), "alignment")
    runs = rows.where("_part IS NOT NULL").select("_run", "_part", "_pairs", "_postings")
    counts = count_pairs(runs, n_a, parts, fan_in)
    most = runs.groupBy("_part").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // fan_in))
    salted = runs.withColumn("_salt", F.pmod(F.xxhash64("_run", "_part"), F.lit(salts)).cast("int"))
    spread = counts.select(F.col("part").alias("_part"), "counts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))

    def contribute(left: pa.Table, right: pa.Table) -> pa.Table:
        given = list(frames(right.column("counts")[0].as_py(), 3)) if right.num_rows else []
        out = []
        if left.num_rows:
            key, count, best = (np.concatenate(c) for c in zip(*given, strict=True))
            for pairs, postings in zip(left.column("_pairs"), left.column("_postings"), strict=True):
                out.append(contributions(pairs.as_py(), postings.as_py(), key, count, best))
        return pa.table({"_run": left.column("_run"), "_share": pa.array(out, pa.binary())})

    shares = salted.groupBy("_part", "_salt").cogroup(spread.groupBy("_part", "_salt")).applyInArrow(contribute, "_run bigint, _share binary")
    names = ["_run", "_nth", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", *[f"_kept{i}" for i in range(len(kept))]]
    documents = rows.where("_part IS NULL").select(*names)
    final = T.StructType([*[T.StructField(f"_kept{i}", docs.schema[c].dataType) for i, c in enumerate(kept)], *T._parse_datatype_string(RESULTS + ", groups string")])
    arrow = to_arrow_schema(final)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        nth = left.column("_nth").to_numpy()
        top, total = np.zeros(nth.max() + 1 if len(nth) else 0, np.int64), np.zeros(nth.max() + 1 if len(nth) else 0, np.int64)
        for share in right.column("_share"):
            doc, best, count = _unpack(share.as_py(), 3)
            top[doc] += best
            total[doc] += count
        found = {"n_best": pa.array(top[nth]), "count_sum": pa.array(total[nth])}
        return pa.table([found[f.name] if f.name in found else left.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    done = documents.groupBy("_run").cogroup(shares.groupBy("_run")).applyInArrow(finish, final)
    return done.select(*[F.col(f"_kept{i}").alias(c) for i, c in enumerate(kept)], *results)


def _n_a(byte_bpe: bytes) -> int:
    """Ids of A's own tokens, special ones left out, as `Pair` counts them."""
    spec = json.loads(byte_bpe)
    special = {t["content"] for t in spec["added_tokens"]}
    return max(i for t, i in spec["model"]["vocab"].items() if t not in special) + 1
