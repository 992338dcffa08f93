"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding.

Pre-tokenisation follows the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without running it. Every code point gets a class; a class is a function on the states of a small
automaton; these functions and all their compositions are a finite monoid, so a prefix scan with one
table lookup per code point gives the state before each code point, and with it where pieces begin.
The slices then go through a cache of merged pieces.

Defined results: null and empty texts have no ids; rows are independent, so repeated rows repeat their
result; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm import common

# Classes of a code point at its place in a text. WL, SL: the last white space before something else (SL: a
# space); WI: other white space; A2, A3: an apostrophe that begins a contraction of so many characters.
L, N, P, A2, A3, SL, WL, WI, Z = range(9)
# What is open before a code point: nothing, letters, digits, other signs, a space that goes with what follows,
# white space, the last code point or the last two code points of a contraction.
OPEN, LETTERS, DIGITS, SIGNS, SPACE, WHITE, ONE_LEFT, TWO_LEFT = range(8)
#: The code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SENTINEL = 0x110000
BLOCK = 128


@functools.cache
def point_classes() -> np.ndarray:
    """L, N, P or WI of each code point; Z of the sentinel between texts."""
    first = {"L": L, "N": N}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], P) for c in range(SENTINEL)), np.uint8, SENTINEL)
    out[WHITE_SPACE] = WI
    return np.append(out, np.uint8(Z))


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of this class, and whether a piece begins with it."""
    if kind == Z:
        return OPEN, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return OPEN, False
    runs = {L: LETTERS, N: DIGITS, P: SIGNS, A2: SIGNS, A3: SIGNS}
    if kind in runs:
        if state == SPACE or state == runs[kind]:
            return runs[kind], False
        return {A2: ONE_LEFT, A3: TWO_LEFT}.get(kind, runs[kind]), True
    if kind == WI:
        return WHITE, state != WHITE
    return (SPACE if kind == SL else OPEN), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions of the transition monoid (by state), their table of composition, and whether a piece begins (by state and class).

    The first 9 functions are those of the classes; function 9 or one of these is the identity's place.
    """
    classes = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    known: dict[tuple, int] = {}
    order: list[tuple] = []
    for f in [tuple(range(8)), *classes]:
        if f not in known:
            known[f] = len(order)
            order.append(f)
    i = 0
    while i < len(order):
        for g in classes:
            h = tuple(g[s] for s in order[i])
            if h not in known:
                known[h] = len(order)
                order.append(h)
        i += 1
    functions = np.array(order, np.uint8)
    then = np.array([[known[tuple(g[s] for s in f)] for g in order] for f in order], np.uint16)
    begins = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return functions, then, begins, np.array([known[f] for f in classes], np.uint16)


def states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each code point, by a blocked scan over the monoid."""
    functions, then, _, of_class = automaton()
    n = len(kinds)
    rows = -(-n // BLOCK)
    ids = np.zeros(rows * BLOCK, np.uint16)
    ids[:n] = of_class[kinds]
    columns = ids.reshape(rows, BLOCK).T
    before = np.empty((BLOCK, rows), np.uint16)
    acc = np.zeros(rows, np.uint16)  # 0 is the identity
    for j in range(BLOCK):
        before[j] = acc
        acc = then[acc, columns[j]]
    reach = 1
    while reach < rows:  # inclusive scan over the blocks
        acc = np.concatenate([acc[:reach], then[acc[:-reach], acc[reach:]]])
        reach *= 2
    entry = np.concatenate([[OPEN], functions[acc[:-1], OPEN]])
    return functions[before, entry[None, :]].T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Byte offsets at which pieces of the joined texts begin, those of the separators after each text, and the joined bytes."""
    end = np.array([SENTINEL], np.uint32)
    parts: list[np.ndarray] = []
    for t in texts:
        parts += [np.frombuffer(t.encode("utf-32-le"), np.uint32), end]
    points = np.concatenate(parts)
    kinds = point_classes()[points]
    white = kinds == WI
    more = np.append(points[1:], [SENTINEL])
    solid = white & ~np.append(white[1:], [True]) & (more != SENTINEL)
    kinds[solid] = np.where(points[solid] == 0x20, SL, WL)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        third = np.append(more[1:], [SENTINEL])
        a, b = more[marks], third[marks]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        kinds[marks[two]] = A2
        kinds[marks[three]] = A3
    starts = np.flatnonzero(automaton()[2][states(kinds), kinds])
    wide = np.ones(len(points), np.int64)
    for bound in (0x7F, 0x7FF, 0xFFFF):
        wide += points > bound
    ends = np.flatnonzero(points == SENTINEL)
    wide[ends] = 1
    at = np.cumsum(wide) - wide
    return at[starts], at[ends], b"\n".join([*(t.encode() for t in texts), b""])


class Vocabulary:
    """Ranks of a tiktoken file; merges pieces, and gives back their bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        top = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.digits = [b"%d" % i for i in range(top)]
        self.cache = common.PieceCache(lambda pieces: [self.merge(p) for p in pieces])

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 48:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(parts[i] + parts[i + 1], SENTINEL) for i in range(len(parts) - 1)]
        while scores and (least := min(scores)) < SENTINEL:
            i = scores.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], SENTINEL)
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], SENTINEL)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs: n log n for pieces without end."""
        ranks, n = self.ranks, len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[piece[i : i + 2]], i, 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j < 0 or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = b""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (both := part[a] + part[b]) in ranks:
                    heapq.heappush(heap, (ranks[both], a, len(both)))
        return [ranks[p] for p in part if p]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each text, and the byte at which each token ends in its text."""
        starts, ends, joined = boundaries(texts)
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
        inner = np.isin(starts, ends, assume_unique=True, invert=True)
        kept = np.flatnonzero(inner)
        ids, lens = self.cache([pieces[i] for i in kept.tolist()])
        pieces_each = np.diff(np.searchsorted(starts[kept], np.concatenate([[0], ends])))
        each = common.sums(lens, pieces_each)
        until = np.cumsum(self.sizes[ids])
        base = np.concatenate([[0], until])[np.cumsum(each) - each]
        return ids, each, until - np.repeat(base, each)

    def decode(self, ids: np.ndarray, each: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and the number of bytes of each. until: the byte of its text at which each token ends.

        Every token's bytes go to the place its offset names, so tokens may come in any order within their text.
        """
        sizes = self.sizes[ids]
        last = np.zeros(len(each), np.int64)
        some = each > 0
        if len(until):
            last[some] = np.maximum.reduceat(until, (np.cumsum(each) - each)[some])
        if not np.array_equal(common.sums(sizes, each), last):
            raise ValueError("the ids do not fit their offsets")
        out = np.zeros(int(last.sum()), np.uint8)
        out[common.csr(sizes, np.repeat(np.cumsum(last) - last, each) + until - sizes)] = self.bytes[common.csr(sizes, self.at[ids])]
        return out, last


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, ends array<int> (the byte of the text at which each token ends)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch, values in common.batches(it):
            ids, each, until = vocab.encode(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), common.list_array(ids, each, pa.int32()), common.list_array(until, each, pa.int32())],
                names=["doc_id", "ids", "ends"],
            )

    docs = common.texts(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, ends array<int>")


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def decode(df: DataFrame, path: str) -> DataFrame:
    """The rows of encode() with bytes: what their ids stand for, put where ends says."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in it:
            column, ends = batch.column("ids"), batch.column("ends")
            ids, until = (c.flatten().to_numpy(zero_copy_only=False) for c in (column, ends))
            made = vocab.decode(ids, np.asarray(column.value_lengths().fill_null(0)), until)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, ends, _binary(*made)], names=["doc_id", "ids", "ends", "bytes"])

    return df.select("doc_id", "ids", "ends").mapInArrow(run, f"doc_id {kind}, ids array<int>, ends array<int>, bytes binary")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded texts.

    encode() and decode() of a batch one after the other in one pass, of which only the digests leave the worker.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch, values in common.batches(it):
            ids, each, until = vocab.encode(values)
            data, sizes = vocab.decode(ids, each, until)
            whole, at, to = data.tobytes(), (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist()
            texts = list(map(vocab.digits.__getitem__, ids.tolist()))
            first, end = (np.cumsum(each) - each).tolist(), np.cumsum(each).tolist()
            columns = [
                pa.array(each, pa.int64()),
                pa.array([hashlib.sha256(b",".join(texts[a:b])).hexdigest() for a, b in zip(first, end)], pa.string()),
                pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at, to)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = common.texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
