"""Exact deduplication by content sort.

Texts are equal when they are the same without ASCII white space. Tasks first fold equal texts within WINDOW bytes of
different ones (a hot text then has a row for each window, not for each copy). Splitters of the normalised bytes come
from a sample of the rows and deal the folded texts out by range; each range is sorted externally by the bytes
themselves, and one pass compares neighbours in full and counts. Splitters look at a bounded key (the first bytes
and a hash of all), so sampling moves no long texts; the key is a function of the text, so equal texts meet.

Of equal texts the row with the most code points stays, then the smallest doc_id.

Defined results: null counts as empty, and empty and blank texts are equal to one another; a null doc_id
is kept only if all doc_ids of its group's longest rows are null; rows that repeat doc_id and text are one
group, of which one row stays; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of the normalised text that splitters look at, before the hash.
KEY_BYTES = 32
#: Rows sampled for each range, about; bytes of different texts, and rows, that a task folds together.
SAMPLED, WINDOW, ROWS = 60, 8_000_000, 200_000


def normalised(text: str) -> bytes:
    return text.encode().translate(None, BLANK)


def _best(member: tuple) -> tuple:
    """Sorts the row that stays first; nulls last."""
    doc_id, chars = member
    return -chars, doc_id is None, doc_id if doc_id is not None else 0


def _key(norm: bytes) -> bytes:
    return norm[:KEY_BYTES].ljust(KEY_BYTES, b"\0") + xxhash.xxh64_digest(norm)


def splitters(docs: DataFrame, ranges: int) -> list[bytes]:
    """Where ranges begin: about SAMPLED rows a range are looked at, whatever the table's size; only keys reach the driver."""
    n = docs.count()
    share = min(1.0, SAMPLED * ranges / max(n, 1))
    if ranges < 2:
        return []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([_key(normalised(t)) for t in batch.column("text").to_pylist()], pa.binary())], names=["key"])

    keys = sorted({bytes(r["key"]) for r in docs.select("text").sample(share, seed=0).mapInArrow(run, "key binary").collect()})
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if len(keys) >= ranges else keys[1:]


def fold(df: DataFrame, cuts: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text of each window: its range, its bytes, the best row, and all its rows, the best first."""
    docs = common.texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["range", "norm", "best_id", "chars", "members"]

    def rows(groups: dict[bytes, list], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(groups.items(), common.BATCH_ROWS):
            for _, g in some:
                g.sort(key=_best)
            ids = pa.array([m[0] for _, g in some for m in g], id_type)
            offsets = pa.array([0, *_running([len(g) for _, g in some])], pa.int32())
            columns = [
                pa.array([bisect.bisect_right(cuts, _key(norm)) for norm, _ in some], pa.int32()),
                pa.array([norm for norm, _ in some], pa.binary()),
                pa.array([g[0][0] for _, g in some], id_type),
                pa.array([g[0][1] for _, g in some], pa.int64()),
                pa.ListArray.from_arrays(offsets, ids),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, list] = {}
        size = n = 0
        id_type = None
        for batch in it:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                norm = normalised(text)
                if norm not in groups:
                    groups[norm] = []
                    size += len(norm)
                groups[norm].append((doc_id, len(text)))
            n += len(batch)
            if size > WINDOW or n > ROWS:
                yield from rows(groups, id_type)
                groups, size, n = {}, 0, 0
        if groups:
            yield from rows(groups, id_type)

    return docs.mapInArrow(run, f"range int, norm binary, best_id {kind}, chars long, members array<{kind}>")


def _running(counts: list[int]) -> list[int]:
    total, out = 0, []
    for n in counts:
        total += n
        out.append(total)
    return out


def neighbours(rows: DataFrame) -> DataFrame:
    """Compares each sorted row with the one before it, in full; a group's first row names its keeper.

    alone: the group's size, where it has one row; size: the number of the row's members.
    """
    kind = rows.schema["best_id"].dataType.simpleString()
    names = ["members", "leads", "keep_id", "digest", "alone", "size"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keep, digest, waiting = None, None, b"", None
        for batch in itertools.chain(it, [None]):
            # The last row of a batch waits for the next one: whether its group is alone depends on it.
            now = waiting if batch is None else batch if waiting is None else pa.concat_batches([waiting, batch])
            if now is None:
                continue
            n = len(now) if batch is None else len(now) - 1
            norms, best = now.column("norm").to_pylist(), now.column("best_id").to_pylist()
            sizes = now.column("members").value_lengths().to_pylist()
            leads, keeps, digests, alone = [], [], [], []
            for i in range(n):
                first = norms[i] != last
                if first:
                    last, keep, digest = norms[i], best[i], hashlib.sha256(norms[i]).digest()
                leads.append(first)
                keeps.append(keep)
                digests.append(digest)
                alone.append(sizes[i] if first and (i + 1 == len(norms) or norms[i + 1] != norms[i]) else None)
            waiting = None if batch is None else now.slice(n)
            yield pa.RecordBatch.from_arrays(
                [now.column("members").slice(0, n), pa.array(leads, pa.bool_()), pa.array(keeps, now.schema.field("best_id").type), pa.array(digests, pa.binary()), pa.array(alone, pa.int64()), pa.array(sizes[:n], pa.int64())],
                names=names,
            )

    return rows.mapInArrow(run, f"members array<{kind}>, leads boolean, keep_id {kind}, digest binary, alone long, size long")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    ranges = common.partitions(df.sparkSession)
    cuts = splitters(common.texts(df, id_col, text_col), ranges)
    dealt = (
        fold(df, cuts, id_col, text_col)
        .repartitionById(ranges, F.col("range"))
        .sortWithinPartitions("norm", F.desc("chars"), F.asc_nulls_last("best_id"))
        .select("norm", "best_id", "members")
    )
    # Without texts from here on.
    found = common.table(neighbours(dealt), "groups")
    whole = found.filter("alone is not null").withColumn("group_size", F.col("alone"))
    # Groups of several rows, which are as many as the windows that hold one of their texts.
    parts = found.filter("alone is null")
    sizes = parts.groupBy("digest").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("n"))
    more = common.attach(parts, sizes, "digest", parts.count()).select(*whole.columns)
    return whole.unionByName(more).select("*", F.posexplode("members").alias("place", "doc_id")).select(
        "doc_id", "keep_id", "group_size", (F.col("leads") & (F.col("place") == 0)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as txt,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
g as (
  select doc_id, norm,
         first_value(doc_id) over (partition by norm order by length(txt) desc, doc_id
                                   rows between unbounded preceding and unbounded following) as keep_id,
         count(*) over (partition by norm) as group_size
  from t)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept,
       sha256(norm) as text_sha256
from g
"""
