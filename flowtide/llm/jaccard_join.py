"""Exact Jaccard self-join of word-shingle sets by parity sketches.

A document's set holds its distinct 5-word shingles as 64-bit hashes; documents
with equal sets are one node. Two nodes link when 100 |A & B| >= 80 |A | B|, so
their symmetric difference is at most (|A| + |B|) / 9.

* Pigeonhole join. Sets are handled per size band (powers of two; a set near a
  band's upper end also enters the next). In a band a sketch has P words; every
  shingle is XORed into one of them. A differing shingle changes one word, so the
  number of differing words is at most the symmetric difference d: linked nodes
  agree on at least P - d words. Ordered by a rule common to all sets (words that
  took in most shingles first), the first d + 1 + e words of both share at least
  1 + e. Only these are shuffled, as (signature, node).
* Frequent signatures. A passage in very many documents makes signatures that
  many nodes share. A node with at most e such signatures still meets every
  partner in a rare one, so it leaves them out; only nodes made up of common text
  stay in. That loses no link.
* Candidates without all pairs. Within a signature nodes are first compared with
  one of them, in rounds with changing centres; what is linked already is not
  compared again. At the end the pairs still in different components are compared,
  in bounded chunks where very many nodes share a signature.
* Verification: a second parity sketch (one bit per shingle), whose Hamming distance
  is a lower bound of the symmetric difference, rules most pairs out; the sets
  themselves decide on the rest. Components follow from the links by
  repeated minimum labels.

Defined cases: a null, empty or wordless text has an empty set and is linked
with nothing; fewer than five words are one shingle; repeated rows are copies of
each other; a row without id is linked with nothing and its component is null;
an id that repeats with other texts is judged text by text. Other columns are
ignored. Sets are told apart by 64-bit content hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import bound_batches, map_text
from flowtide.operators.scale import small
from flowtide.session import materialize

SHINGLE = 5
HOT_NODES = 64
CHUNK_NODES = 500
STAR_ROUNDS = 3
PAIRS_AT_ONCE = 10_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MUL
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _MUL, np.uint64)]), dtype=np.uint64)
    return _POWERS


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    body = data[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(body)) - np.repeat(first, lengths)
    words = mix(np.add.reduceat(body * _powers(int(lengths.max()))[place], first) + lengths.astype(np.uint64) * _ODD)
    width = min(SHINGLE, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = out * _MUL + words[k : n - width + 1 + k]
    return np.unique(mix(out))


def node_id(hashes: np.ndarray) -> int:
    """Content hash of a set, as a signed 64-bit number."""
    total = np.append(mix(hashes ^ _ODD), np.uint64(len(hashes))).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total).view(np.int64)[0])


def band_plan(band: int) -> tuple[int, int]:
    """(words of the sketch, spare signatures e) in the band of sets of 2^band to 2^(band+1) - 1 shingles."""
    low = 1 << band
    spare = max(1, low // 32)
    most = (2 * low - 1) // 4 + 1 + spare
    return max(most, -(-4 * low // 5), 64 if band < 6 else 0), spare


def signatures(hashes: np.ndarray) -> np.ndarray:
    """Signatures that linked sets share, for the set's band and, near its end, for the next; the low 5 bits hold the band."""
    size = len(hashes)
    if size < 4:  # such a set links with equal sets only
        return np.zeros(0, np.uint64)
    own = size.bit_length() - 1
    out = []
    for band in (own, own + 1) if 5 * size >= 4 * (2 << own) else (own,):
        pieces, spare = band_plan(band)
        wanted = min(pieces, size // 4 + 1 + spare)
        piece = (hashes >> np.uint64(20)) % np.uint64(pieces)
        order = np.argsort(piece, kind="stable")
        piece, token = piece[order], mix(hashes[order] + _MUL)
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        count = np.diff(np.append(first, size))
        word = np.bitwise_xor.reduceat(token, first)
        at = piece[first]
        if len(at) < wanted:  # words without a shingle agree, too
            empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), at)
            at, word, count = np.append(at, empty), np.append(word, np.zeros(len(empty), np.uint64)), np.append(count, np.zeros(len(empty), int))
        value = mix(word ^ mix(at * np.uint64(64) + np.uint64(band) + _ODD))
        best = np.lexsort((value, -count))[:wanted]
        out.append((value[best] & ~np.uint64(31)) | np.uint64(band & 31))
    return np.concatenate(out)


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity of the shingles that hash to each of m bits, m a power of two of at least twice the set's size."""
    m = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    bits = np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches: never more than the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def with_node(docs: DataFrame, keep: Sequence[str], text: str = "text", names: Sequence[str] = ("n_shingles", "node")) -> DataFrame:
    """Kept columns plus the size and the content hash of the text's set."""

    def build():
        def work(texts):
            sets = [shingles(t) for t in texts]
            return [[len(s) for s in sets], [node_id(s) for s in sets]]

        return work

    return map_text(docs, build, ", ".join(f"`{n}` bigint" for n in names), keep, text)


def document_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n_shingles, node) of every row."""
    return with_node(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), ("_id",), "_text")


def _index(docs: DataFrame, text: str) -> DataFrame:
    """(signature, node) rows; a node that comes again in the same task is left out."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("sig", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                sigs, nodes = [], []
                for t in whole.column(0).slice(start, 128).to_pylist():
                    s = shingles(t)
                    node = node_id(s)
                    if len(s) < 4 or node in seen:
                        continue
                    seen.add(node)
                    sigs.append(signatures(s))
                    nodes.append(np.full(len(sigs[-1]), node, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(nodes))], schema=schema)

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "sig bigint, node bigint")


def _by_signature(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("sig").sortWithinPartitions("sig", *order)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node): each pair once, and only of signatures with two nodes or more."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    written = None  # signature of which a row was passed on last

    def out(sig, node):
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], names=["sig", "node"])

    for batch in batches:
        sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
        if held is not None:
            sig, node = np.concatenate([held[0], sig]), np.concatenate([held[1], node])
        if not len(sig):
            continue
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[fresh], node[fresh]
        same = sig[1:] == sig[:-1]
        keep = np.concatenate([[sig[0] == written if written is not None else False], same]) | np.concatenate([same, [False]])
        held = (sig[-1:], node[-1:])  # judged when the next batch is known
        if keep[:-1].any():
            written = sig[:-1][keep[:-1]][-1]
            yield out(sig[:-1][keep[:-1]], node[:-1][keep[:-1]])
    if held is not None and written is not None and held[0][0] == written:
        yield out(*held)


def candidates(docs: DataFrame, text: str, hot_nodes: int = HOT_NODES) -> DataFrame:
    """(sig, node) rows in which every pair of linked nodes meets, without the frequent signatures that are not needed."""
    shared = materialize(_by_signature(_index(docs, text), "node").mapInArrow(_shared, "sig bigint, node bigint"), "shared-signatures")
    hot = shared.groupBy("sig").count().where(F.col("count") > hot_nodes).select("sig")
    hot = materialize(hot, "frequent-signatures")
    if hot.isEmpty():
        return shared
    hot = small(hot)
    band = F.col("sig").bitwiseAND(F.lit(31))
    spare = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), band) / 32))  # as in band_plan
    frequent = shared.join(hot, "sig", "left_semi").withColumn("_band", band)
    needed = frequent.groupBy("node", "_band").agg(F.count("*").alias("_n"), F.first(spare).alias("_spare")).where("_n > _spare").select("node", "_band")
    rest = frequent.join(needed, ["node", "_band"], "left_semi").select("sig", "node")
    return materialize(shared.join(hot, "sig", "left_anti").unionByName(rest), "candidate-signatures")


def _node_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, n, bits, hashes) of the given nodes, read from one document each."""
    chosen = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_id").alias("_id"))
    chosen = small(materialize(chosen, "candidate-documents"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(chosen, "_id")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                part = whole.slice(start, 128)
                found = [(node, s) for t, node in zip(part.column("_text").to_pylist(), part.column("node").to_pylist(), strict=True) if node_id(s := shingles(t)) == node]
                columns = [[n for n, _ in found], [len(s) for _, s in found], [bit_sketch(s) for _, s in found], [s.tobytes() for _, s in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = texts.select("_text", "node").mapInArrow(run, "node bigint, n bigint, bits binary, hashes binary")
    return materialize(found.dropDuplicates(["node"]) if doc_ids_repeat(chosen, texts) else found, "candidate-sets")


def doc_ids_repeat(chosen: DataFrame, texts: DataFrame) -> bool:
    """Whether some chosen id stands on several rows."""
    return texts.select("_id").groupBy("_id").count().where("count > 1").limit(1).count() > 0


def _stars(rows: DataFrame, salt: int) -> DataFrame:
    """(a, b) of each signature's centre with its nodes of other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, node0, label0 = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node, label = (batch.column(c).to_numpy() for c in ("sig", "node", "label"))
            first = np.concatenate([[sig[0] != last], sig[1:] != sig[:-1]])
            group = np.cumsum(first) - 1
            centre, home = node[first], label[first]
            if not first[0]:
                group, centre, home = group + 1, np.append(np.int64(node0), centre), np.append(np.int64(label0), home)
            a, other = centre[group], label != home[group]
            last, node0, label0 = sig[-1], centre[-1], home[-1]
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(node[other])], names=["a", "b"])

    ordered = _by_signature(rows.withColumn("_order", F.xxhash64(F.lit(salt), "node")), "_order", "node")
    return ordered.select("sig", "node", "label").mapInArrow(run, "a bigint, b bigint")


def _within(rows: DataFrame) -> DataFrame:
    """(a, b) of each signature's nodes in different components, for signatures of few nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []
        ready: set[tuple[int, int]] = set()

        def out():
            found = list(ready)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for sig, node, label in zip(*[batch.column(c).to_pylist() for c in ("sig", "node", "label")], strict=True):
                if sig != last:
                    last, group = sig, []
                    if len(ready) > PAIRS_AT_ONCE:
                        yield out()
                ready.update((other, node) for other, home in group if home != label)  # nodes come in order
                group.append((node, label))
        if ready:
            yield out()

    return _by_signature(rows, "node").select("sig", "node", "label").mapInArrow(run, "a bigint, b bigint")


def _across(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b) of a signature's nodes in different components, for signatures of many nodes.

    A signature's nodes are dealt to chunks, and each pair of chunks is one group, so a
    task holds two chunks however many nodes share the signature. Size and bit sketch
    rule pairs out; a pair that shares several such signatures is passed on by the
    smallest of them only.
    """

    def pairs(sig: int, group: list[tuple]) -> Iterator[tuple[int, int]]:
        side, node, label, size, sketches, shared = zip(*group, strict=True)
        least = min(map(len, sketches))
        sketch = np.stack([_folded(s, least) for s in sketches]).view(np.uint64)
        side, label, size = np.array(side), np.array(label), np.array(size)
        first = np.flatnonzero(side == side.min())
        second = np.flatnonzero(side == side.max())
        apart = np.zeros((len(first), len(second)), np.int64)
        for word in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[first, word][:, None] ^ sketch[second, word][None, :])
        s, t = size[first][:, None], size[second][None, :]
        fits = (label[first][:, None] != label[second][None, :]) & (9 * apart <= s + t) & (5 * np.minimum(s, t) >= 4 * np.maximum(s, t))
        for x, y in zip(*np.nonzero(fits), strict=True):
            i, j = first[x], second[y]
            if node[i] != node[j] and np.intersect1d(shared[i], shared[j], assume_unique=True)[0] == sig:
                yield min(node[i], node[j]), max(node[i], node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []

        def out():
            """The group's pairs, some thousands at a time."""
            if len(group) > 1 and (last[1] == last[2] or len({r[0] for r in group}) == 2):
                found = pairs(last[0], group)
                while part := list(islice(found, PAIRS_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                numbers = [batch.column(c).to_pylist() for c in ("sig", "_low", "_high", "_side", "node", "label", "n")]
                for sig, low, high, side, node, label, n, bits, sigs in zip(*numbers, batch.column("bits"), batch.column("_sigs"), strict=True):
                    if (sig, low, high) != last:
                        yield from out()
                        last, group = (sig, low, high), []
                    # arrays of their own: a row kept must not hold its batch
                    group.append((side, node, label, n, np.frombuffer(bits.as_py(), np.uint8), sigs.values.to_numpy().copy()))
        yield from out()

    chunks = F.ceil(F.col("_nodes") / CHUNK_NODES).cast("int")
    every = rows.groupBy("node").agg(F.collect_list("sig").alias("_sigs"))  # bounded by the set's own signatures
    rows = rows.join(every, "node").join(sketches, "node")
    dealt = rows.withColumn("_side", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.withColumn("_low", F.least("_side", "_other")).withColumn("_high", F.greatest("_side", "_other"))
    ordered = dealt.repartition("sig", "_low", "_high").sortWithinPartitions("sig", "_low", "_high", "node")
    return ordered.select("sig", "_low", "_high", "_side", "node", "label", "n", "bits", "_sigs").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the pairs: first by size and bit sketch, then by the sets."""
    sizes = sets.select("node", "n", "bits")

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.toDF(name, *[f"{c}_{name}" for c in frame.columns[1:]])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            x, y = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
            keep = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
            keep &= np.array([k and 9 * distance(p, q) <= s for k, p, q, s in zip(keep, x, y, n + m, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist()
            keep = pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    joined = pairs.join(side(sizes, "b"), "b").join(side(sizes, "a"), "a")
    likely = materialize(joined.mapInArrow(possible, "a bigint, b bigint"), "likely-pairs")
    hashes = sets.select("node", "hashes")
    joined = likely.join(side(hashes, "b"), "b").join(side(hashes, "a"), "a")
    return joined.select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, "a bigint, b bigint")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, by minimum labels of neighbours and label jumps until nothing changes."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")), "links")
    state = nodes.select("node", F.col("node").alias("label"))
    if both.isEmpty():
        return state
    linked_nodes = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = both.join(linked_nodes.toDF("b", "_l"), "b").groupBy("a").agg(F.min("_l").alias("_l"))
        lower = linked_nodes.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("_old"), F.least("label", "_l").alias("label"))
        jump = linked_nodes.toDF("label", "_next")
        now = materialize(lower.join(jump, "label").select("node", "_old", F.least("label", "_next").alias("label")), "labels")
        linked_nodes = now.select("node", "label")
        if now.where("_old <> label").isEmpty():
            break
    return state.select("node").join(linked_nodes, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def join_links(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_nodes: int = HOT_NODES, star_rounds: int = STAR_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(node, label) of all candidate nodes, and the verified links (a, b) that were needed to find them."""
    cells = candidates(docs, text, hot_nodes)
    nodes = materialize(cells.select("node").distinct(), "candidate-nodes")
    sets = _node_sets(docs, rows, nodes, doc_id, text)
    labels, links, tried = nodes.select("node", F.col("node").alias("label")), None, None
    for turn in range(star_rounds + 1):
        labelled = cells.join(labels, "node")
        open_sigs = labelled.groupBy("sig").agg(F.min("label").alias("_min"), F.max("label").alias("_max"), F.count("*").alias("_nodes"))
        # two nodes alone were compared in the first round
        open_sigs = open_sigs.where(F.col("_min") != F.col("_max")).where(F.lit(turn == 0) | (F.col("_nodes") > 2)).select("sig", "_nodes")
        left = materialize(labelled.join(open_sigs, "sig"), "open-signatures")
        if left.isEmpty():
            break
        if turn < star_rounds:
            pairs = _stars(left, turn)
        else:
            many = left.where(F.col("_nodes") > hot_nodes)
            pairs = _within(left.where(F.col("_nodes") <= hot_nodes)).unionByName(_across(many, sets.select("node", "n", "bits")))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = materialize(_verified(pairs, sets), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        labels = materialize(components(nodes, links), "labels")
    return labels, links if links is not None else docs.sparkSession.createDataFrame([], "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_nodes: int = HOT_NODES, star_rounds: int = STAR_ROUNDS, nodes: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; with `nodes` also its node and whether
    (doc_id, node) is the one that stands for its component: the smallest id, then the smallest node."""
    every = materialize(document_sets(docs, doc_id, text), "document-sets")
    rows = every.where("_id IS NOT NULL AND n_shingles > 0")
    labels, _ = join_links(docs, rows, doc_id, text, hot_nodes, star_rounds)
    extra = ["node"] if nodes else []
    rows = materialize(rows.join(labels, "node", "left").select("_id", "n_shingles", F.coalesce("label", "node").alias("label"), *extra), "labelled-documents")
    first = F.min(F.struct("_id", *extra)).alias("_first")
    shown = rows.join(rows.groupBy("label").agg(first), "label").withColumn("component_id", F.col("_first._id"))
    alone = every.where("_id IS NULL OR n_shingles = 0").withColumn("component_id", F.col("_id"))
    if nodes:
        shown = shown.withColumn("stays", F.struct("_id", "node") == F.col("_first"))
        alone, extra = alone.withColumn("stays", F.lit(True)), ["node", "stays"]
    columns = [F.col("_id").alias(doc_id), "n_shingles", "component_id", *extra]
    return shown.select(*columns).unionByName(alone.select(*columns))
