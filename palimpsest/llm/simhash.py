"""SimHash fingerprints and their links, by an inverted index over byte positions.

A fingerprint is eight positional bytes. Two that differ in at most two bits share at least six of them: that is the
least tally of shared postings that a link can have. Lists of one byte would hold a 256th of all fingerprints each,
and tallies over them would grow with the square of the table; so every list is split by further positions until it
has six. A distinct fingerprint is posted under each six of its positions (28 lists), and fingerprints meet in a list
just where their tally reaches six: count filtering is what the lists are. Those of a list differ in two bytes alone,
so a list has 65,536 members at most, however large a group of copies is. Members are verified in full by looking up,
in the sorted list, the 136 others that one or two bits lead to: never all pairs of a list. Fingerprints with a tally
of seven meet in seven lists; one of these, named by the positions, reports them.

Components come from repeated min-label exchanges over the links between distinct fingerprints.

Defined results: null, empty and blank texts have the fingerprint zero, linked like any other; texts of one
or two words are one shingle; rows that repeat are linked by their equal fingerprints; a null doc_id is a
node like any other but never names a component with other doc_ids; an empty table gives no rows; other
columns of the input are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

WORDS, SEED, BITS = 3, 42, 2
#: The two byte positions that each kind of list leaves open; the others are its key.
OPEN = list(itertools.combinations(range(8), 2))
#: One or two of the sixteen open bits.
MASKS = [sum(1 << b for b in bits) for n in range(1, BITS + 1) for bits in itertools.combinations(range(16), n)]
#: Members of lists verified together, about.
TOGETHER = 50_000


def hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of the text's shingles, repeats included."""
    tokens = text.encode().lower().split()
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), seed)] if tokens else []
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[words - 1 :]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())]


def fingerprint(values: list[int]) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not values:
        return 0
    bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = bits.sum(axis=0, dtype=np.int64) * 2 > len(values)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    docs = common.texts(df, id_col, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in common.batches(it):
            fps = np.array([fingerprint(hashes(t)) for t in values], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def verified(lists: np.ndarray, kinds: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that differ in at most two bits of fingerprints in the same lists; of each, the list's number and its kind."""
    first, second = np.array(OPEN, np.uint64)[kinds].T
    byte = np.uint64(0xFF)
    high, low = fps >> (first * np.uint64(8)) & byte, fps >> (second * np.uint64(8)) & byte
    key = lists.astype(np.int64) << 16 | (high << np.uint64(8) | low).astype(np.int64)
    by = np.argsort(key)
    key, fps, first, second = key[by], fps[by], first[by], second[by]
    # Of the lists where a pair with seven equal bytes meets, the one that leaves the first other position open.
    alone = {True: (first == 0) & (second == 1), False: first == 0}
    left, right = [], []
    for mask in MASKS:
        other = key ^ mask
        ask = other > key
        if not mask & 0xFF or not mask >> 8:
            ask &= alone[not mask & 0xFF]
        ask = np.flatnonzero(ask)
        at = np.minimum(np.searchsorted(key, other[ask]), len(key) - 1)
        hit = key[at] == other[ask]
        left.append(fps[ask[hit]])
        right.append(fps[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame) -> DataFrame:
    """a, b: the linked pairs (a < b) of the distinct fingerprints in column fp, each once."""
    keys = [F.lit(_signed(~(0xFF << 8 * i | 0xFF << 8 * j) & (1 << 64) - 1)) for i, j in OPEN]
    lists = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("kind"), F.col("fp").bitwiseAND(m).alias("bytes")) for k, m in enumerate(keys)))
    posted = fps.select("fp", F.explode(lists).alias("l")).select("l.kind", "l.bytes", "fp")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[tuple] = []
        held = number = 0

        def done() -> pa.RecordBatch:
            a, b = verified(*(np.concatenate(x) for x in zip(*waiting)))
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in itertools.chain(it, [None]):
            if batch is not None:
                rest = tuple(np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
            kind, value, fp = rest
            begins = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])])) if len(fp) else np.zeros(0, np.int64)
            # The last list may go on in the next batch.
            ends = len(fp) if batch is None or not len(begins) else int(begins[-1])
            begins = begins[begins < ends]
            sizes = np.diff(np.append(begins, ends))
            shared = np.repeat(sizes > 1, sizes)
            if shared.any():
                lists = np.repeat(np.arange(number, number + len(sizes)), sizes)
                waiting.append((lists[shared], kind[:ends][shared], fp[:ends][shared].view(np.uint64)))
                number, held = number + len(sizes), held + int(shared.sum())
            rest = tuple(r[ends:] for r in rest)
            if held >= TOGETHER or (batch is None and waiting):
                yield done()
                waiting, held, number = [], 0, 0

    dealt = posted.repartition(common.partitions(fps.sparkSession), "kind", "bytes").sortWithinPartitions("kind", "bytes")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of the edges a, b.

    Large-star and small-star steps in turn: each round keeps the components and at least halves long
    chains, so the rounds grow with the logarithm of a component's size. Every round is a table.
    """
    now = common.table(edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct().transform(common.narrow), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            # Stars: the centre has no edge to a smaller node, and names itself.
            centres = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)
        seen = mark
        # Large star: every node's larger neighbours go to the smallest of its neighbourhood.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = common.attach(both.filter("b > a"), least, "a", 2 * mark["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.table(common.narrow(large), "edges")
        # Small star: every node's smaller neighbours, and it, go to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        down = common.attach(large, least, "a", mark["n"])
        small = down.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = common.table(common.narrow(small.distinct()), "edges")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row."""
    docs = common.table(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = common.table(common.narrow(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))), "distinct")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    labels = components(links(distinct.select("fp")))
    linked = distinct.join(labels, distinct["fp"] == labels["node"])
    # Only linked fingerprints have another's name: few rows, as most have no link.
    smallest = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = common.attach(linked.select("fp", "n", "label"), smallest.withColumnRenamed("m", "n_label"), "label", total, "n_label").select("fp", "component_id")
    names = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return common.narrow(common.attach(docs, names, "fp", total)).select("doc_id", digits.alias("fingerprint"), "component_id")
