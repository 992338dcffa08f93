"""Best-fit packing of token sequences, planned on a histogram of lengths.

The plan looks at counts of lengths alone: bins that are alike are an interval of bin numbers, and a step
places many pieces of one length at a time, always in the fullest bins that can take them, longest pieces
first. The plan then has slots for the pieces of each length by their rank. Ranks come without a sort: a
task numbers its own pieces of each length, and sums over tasks give where each task's ranks begin.

Defined results: null and empty texts are one piece with the end id alone; equal texts are separate
documents; repeated rows are packed as often as they come; an empty table gives no pieces; other
columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common, subword

PIECES = "doc_id {kind}, piece int, start long, length int, ids binary, task int, nth long"


def pieces(df: DataFrame, path: str, end: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents, each cut into pieces of at most `size` ids (the first takes the odd rest).

    ids: little-endian unsigned 32-bit; task and nth: the task that made the row, and the row's number among
    those of its length there. These hold only once the rows are written, so the result is a table.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = subword.tokenizer("byte", path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch, values in common.batches(it):
            ids, each = subword.with_end(*tokens.encode(values), end)
            count = -(-each // size)
            doc = np.repeat(np.arange(len(each)), count)
            number = common.csr(count, np.zeros(len(count), np.int64))
            first = each - (count - 1) * size
            length = np.where(number == 0, first[doc], size)
            start = np.where(number == 0, 0, first[doc] + (number - 1) * size)
            order = np.argsort(length, kind="stable")
            runs = np.bincount(length, minlength=size + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = common.csr(runs, seen)
            seen += runs
            offsets = np.zeros(len(length) + 1, np.int32)
            np.cumsum(length * 4, out=offsets[1:])
            data = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length, pa.int32()), data, pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    docs = common.texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.table(docs.mapInArrow(run, PIECES.format(kind=kind)), "pieces")


def plan(counts: dict[int, int], size: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Returns (length, first rank, pieces, pieces per bin, first bin, offset in the bins): ranks from the first
    on fill bin after bin. As many rows as the lengths and the kinds of bins ask for, whatever the counts.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # space left: intervals of bins (first, number)
    spaces: list[int] = []  # the keys of room, in order
    bins = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                n = -(-left // (size // length))
                put(size, bins, n)
                bins += n
                k = bisect.bisect_left(spaces, length)
            space = spaces[k]
            first, n = room[space].pop()
            if not room[space]:
                del room[space], spaces[k]
            per = space // length
            full, rest = min(n, left // per), 0
            if full:
                out.append((length, rank, full * per, per, first, size - space))
                put(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:
                rest, used = left, full
                out.append((length, rank, rest, rest, first + used, size - space))
                put(space - rest * length, first + used, 1)
                rank, left, full = rank + rest, 0, full + 1
            put(space, first + full, n - full)
    return out


def place(rows: DataFrame, size: int = 2048) -> DataFrame:
    """The rows of pieces() with sequence_id and offset."""
    counts = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # At most `size` rows reach the driver, however many pieces there are.
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(plan(hist, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    ranked = rows.join(begins, ["length", "task"]).withColumn("rank", F.col("begins") + F.col("nth")).drop("begins", "task", "nth")
    lengths, ranks, _, per, firsts, offsets = (np.array([s[i] for s in slots], np.int64) for i in range(6))
    keys = (lengths << 48) | ranks

    def take(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy()
            s = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            nth = rank - ranks[s]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(firsts[s] + nth // per[s]), pa.array(offsets[s] + nth % per[s] * length)],
                names=[*kept, "sequence_id", "offset"],
            )

    kept = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in kept)
    return common.narrow(ranked).mapInArrow(take, f"{schema}, sequence_id long, offset long")


def pack(df: DataFrame, path: str, end: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; see pieces() for the ids themselves."""
    rows = pieces(df, path, end, size, id_col, text_col)
    keys = rows.select("doc_id", "piece", "start", F.col("length"), F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return place(keys, size).withColumn("length", F.col("length").cast("long")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
