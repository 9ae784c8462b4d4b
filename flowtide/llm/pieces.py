"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces. While it reads a text character by character,
the pieces that end at the current position are found by following output
links, longest first, and each relaxes the best score of that position. The best
path gives the piece ids. Scores are those stored in the vocabulary file; a
character without a piece of its own costs `penalty` below the lowest score and
is written as its UTF-8 bytes.

A model that puts a word-start mark before a text (found out when it is loaded)
gets it here too, and decoding takes it off again.

Where no piece of the vocabulary continues (before a space that follows another
character, at a line break, between a letter and most punctuation; proved from
the vocabulary when it is loaded) a text is cut, and its best path is the best
paths of its chunks put together. Paths of short chunks are remembered as the
bytes of their ids, in two generations of at most CACHE_BYTES each, so a text's
ids are one flat buffer from the start. If a vocabulary has pieces across
spaces, a whole text is one chunk.

The vocabulary file is read on the driver; its pieces (a bounded table) are
broadcast.

Defined cases: a null text gives null ids and decodes to null, an empty text
gives no ids; equal scores go to the longest last piece; a literal U+2581 in a
text is written as bytes, so that decoding returns the text exactly; an id
outside the vocabulary decodes to U+FFFD; repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import re
import string
import sys
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import kept, map_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LETTER = re.compile(r"[^\W\d_]")
CACHE_BYTES = 24 << 20
CACHED_CHARS = 48
UNKNOWN = (1, 0.0, -1)


class Vocabulary:
    """Pieces, scores and kinds, as read from a model file; picklable."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], bytes_at: dict[int, int], unknown: int, marked: bool = False):
        self.pieces, self.scores, self.usable, self.bytes_at, self.unknown, self.marked = pieces, scores, usable, bytes_at, unknown, marked

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        bytes_at = {int(pieces[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        marked = sp.encode_as_pieces("a")[0].startswith(MARK)
        return cls(pieces, [sp.get_score(i) for i in range(n)], [not s for s in special], bytes_at, sp.unk_id(), marked)


def chunker(pieces: list[str]) -> Callable[[str], list[str]]:
    """Cuts a text where no piece can continue, as far as the pieces prove it.

    Before a space that follows another character, around a line break, and
    between a letter and those punctuation marks that follow a letter in no piece.
    """
    if any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in pieces):
        return lambda text: [text] if text else []
    after = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if LETTER.fullmatch(a)}
    marks = re.escape("".join(c for c in string.punctuation if c not in after))
    return re.compile(rf" *[^\W\d_]+(?=[{marks} \n]|\Z)| *[^ \n]+| +|\n").findall


class Codec:
    """Automaton and tables built from a vocabulary, once per worker process."""

    def __init__(self, vocabulary: Vocabulary, penalty: float = 10.0):
        v = vocabulary
        texts = [p.replace(MARK, " ") for p in v.pieces]
        used = [i for i, ok in enumerate(v.usable) if ok and texts[i]]
        self.unknown_score = min((v.scores[i] for i in used), default=0.0) - penalty
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, float, int] | None] = [None]  # (length, score, id) of the piece spelled by a state
        for i in used:
            state = 0
            for c in texts[i]:
                if c not in self.goto[state]:
                    self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(None)
                state = self.goto[state][c]
            self.piece[state] = (len(texts[i]), v.scores[i], i)
        self.fail = [0] * len(self.goto)
        self.output = [0] * len(self.goto)  # nearest state on the failure path that spells a piece
        queue = list(self.goto[0].values())
        for state in queue:
            for c, t in self.goto[state].items():
                f = self.fail[state]
                while f and c not in self.goto[f]:
                    f = self.fail[f]
                self.fail[t] = self.goto[f].get(c, 0)
                self.output[t] = self.fail[t] if self.piece[self.fail[t]] else self.output[self.fail[t]]
                queue.append(t)
        self.bytes_at, self.unknown = v.bytes_at, v.unknown
        spells = {i: bytes([b]) for b, i in v.bytes_at.items()}
        self.spelled = [spells[i] if i in spells else texts[i].encode() if v.usable[i] else b"" for i in range(len(texts))]
        if v.unknown >= 0:
            self.spelled[v.unknown] = "�".encode()
        self.chunks = chunker([texts[i] for i in used])
        self.mark = " " if v.marked else ""
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = 0
        self.steps: dict[int, tuple[int, dict[str, tuple]]] = {0: (0, {})}

    def _step(self, row: tuple[int, dict[str, tuple]], c: str) -> tuple:
        """The automaton's move from a state, remembered: (next state, pieces that end there, longest first; one-character piece?)."""
        state = row[0]
        while state and c not in self.goto[state]:
            state = self.fail[state]
        state = self.goto[state].get(c, 0)
        ends, at = [], state if self.piece[state] else self.output[state]
        while at:
            ends.append(self.piece[at])
            at = self.output[at]
        step = (self.steps.setdefault(state, (state, {})), tuple(ends), bool(ends) and ends[-1][0] == 1)
        if len(row[1]) < 512:  # alphabets of thousands of characters are looked up, not remembered
            row[1][c] = step
        return step

    def best_path(self, chunk: str) -> list[int]:
        """Ids of the best segmentation: one pass of the automaton, relaxing each position."""
        steps, unknown = self.steps, self.unknown_score
        best, back = [0.0], [None]
        row = steps[0]
        for end, c in enumerate(chunk, 1):
            step = row[1].get(c)
            if step is None:
                step = self._step(row, c)
            row, ends, single = step
            top, via = -1e300, UNKNOWN
            for found in ends:
                total = best[end - found[0]] + found[1]
                if total > top:
                    top, via = total, found
            if not single and best[-1] + unknown > top:
                top, via = best[-1] + unknown, UNKNOWN
            best.append(top)
            back.append(via)
        out, end = [], len(chunk)
        while end:
            length, _, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                data = chunk[end - 1].encode("utf-8", "surrogatepass")
                out.extend(self.bytes_at.get(b, self.unknown) for b in reversed(data))
            end -= length
        out.reverse()
        return out

    def _path(self, chunk: str) -> bytes:
        """The chunk's ids as 32-bit numbers, remembered if it is short."""
        path = self.older.get(chunk)
        if path is None:
            path = array("i", self.best_path(chunk)).tobytes()
        if len(chunk) <= CACHED_CHARS:
            self.cached += sys.getsizeof(chunk) + sys.getsizeof(path) + 100  # its share of the dictionary
            if self.cached > CACHE_BYTES:
                self.older, self.cache, self.cached = self.cache, {}, 0
            self.cache[chunk] = path
        return path

    def encode_flat(self, text: str) -> bytes:
        """Ids of a whole text as consecutive 32-bit numbers."""
        if not text:
            return b""
        chunks = self.chunks(self.mark + text)
        paths = list(map(self.cache.get, chunks))
        if None in paths:
            for at, path in enumerate(paths):
                if path is None:
                    chunk = chunks[at]
                    paths[at] = self.cache.get(chunk) or self._path(chunk)
        return b"".join(paths)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_flat(text)).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        spelled, n = self.spelled, len(self.spelled)
        data = b"".join([spelled[i] if i is not None and 0 <= i < n else b"\xef\xbf\xbd" for i in ids])
        return self._unmarked(data)

    def decode_flat(self, flat: bytes) -> str:
        """The text of ids that this codec gave."""
        return self._unmarked(b"".join(map(self.spelled.__getitem__, array("i", flat))))

    def _unmarked(self, data: bytes) -> str:
        if self.mark and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


def id_lists(flats: Sequence[bytes | None]) -> pa.Array:
    """list<int32> of flat id buffers, without a Python object per id."""
    ends = np.cumsum([0, *[len(f) // 4 if f is not None else 0 for f in flats]])
    missing = [f is None for f in flats]
    offsets = pa.array(ends, pa.int32(), mask=np.array([*missing, False])) if any(missing) else pa.array(ends, pa.int32())
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(f for f in flats if f is not None))])
    return pa.ListArray.from_arrays(offsets, values)


def codec(vocabulary: Vocabulary) -> Codec:
    """The codec of a broadcast vocabulary, kept for the worker's later tasks."""
    return kept(vocabulary, Codec)


def ids_digest(flat: bytes) -> str:
    """sha256 of the ids as little-endian 32-bit numbers."""
    if sys.byteorder == "big":
        swapped = array("i", flat)
        swapped.byteswap()
        flat = swapped.tobytes()
    return hashlib.sha256(flat).hexdigest()


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Kept columns plus `ids`, the piece ids of the whole text, and `ids_sha256`."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build():
        worker = codec(shared.value)

        def work(texts: list[str | None]) -> list:
            flats = [None if t is None else worker.encode_flat(t) for t in texts]
            return [id_lists(flats), [None if f is None else ids_digest(f) for f in flats]]

        return work

    return map_text(docs, build, "ids array<int>, ids_sha256 string", keep, text, rows=64)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: Sequence[str] = ("doc_id",), names: Sequence[str] = ("ids", "ids_sha256", "decoded")) -> DataFrame:
    """Encodes and decodes in one pass: kept columns plus ids, their digest and the text they spell.

    Columns that a query does not ask for (`names` with None) are not sent back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = [f"`{n}` {k}" for n, k in zip(names, ("array<int>", "string", "string"), strict=True) if n]

    def build():
        worker = codec(shared.value)

        def work(texts: list[str | None]) -> list:
            flats = [None if t is None else worker.encode_flat(t) for t in texts]
            makers = (
                lambda: id_lists(flats),
                lambda: [None if f is None else ids_digest(f) for f in flats],
                lambda: [None if f is None else worker.decode_flat(f) for f in flats],
            )
            return [make() for n, make in zip(names, makers, strict=True) if n]

        return work

    return map_text(docs, build, ", ".join(kinds), keep, text, rows=64)


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = ("doc_id",), name: str = "text") -> DataFrame:
    """Kept columns plus the text spelled by `ids`."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c for c in keep if c != name]
    source = encoded.select(*[F.col(f"`{c}`") for c in names], F.col("ids").alias("_ids"))
    schema = source.drop("_ids").schema.add(name, "string")

    def run(batches):
        worker = codec(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                texts = [None if v is None else worker.decode(v) for v in batch.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, name])

    return source.mapInArrow(run, schema)
