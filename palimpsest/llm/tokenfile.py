"""Token ids in Arrow IPC files of equal-length sequences, and their random access.

A shard is one Arrow file: record batches of `ids` and `mask`, both fixed-size lists of SEQUENCE values, so
sequence s of a shard is row s % ROWS of batch s // ROWS and a slice of a mapped buffer. Ids are uint16 where
the vocabulary allows it. Documents run on across sequences; the last sequence of a shard is padded, and the
mask says so. Shards hold ascending ranges of doc_id; the index has where each document lies.

Defined results: null and empty texts are the end id alone; rows with a null doc_id come first; rows that
repeat a doc_id follow one another by the hash of their text; an empty table gives an index without rows;
other columns of the input are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common, subword

SEQUENCE, ROWS = 2048, 64


def _shard(number: int) -> str:
    return f"ids-{number:06d}.arrow"


class ShardWriter:
    """Writes a shard under a name of its own, then renames it: an attempt that ends early leaves no shard."""

    def __init__(self, folder: str, number: int, wide: bool):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.kind = np.uint32 if wide else np.uint16
        self.path, self.part = f"{self.folder}/{_shard(number)}", f"{self.folder}/.{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.sink = self.files.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest = np.zeros(0, self.kind)
        self.size = 0

    def _put(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        rows = [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(rows, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.size += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(self.kind)])
        step = SEQUENCE * ROWS
        for _ in range(len(self.rest) // step):
            self._put(self.rest[:step], step)
            self.rest = self.rest[step:]

    def close(self) -> None:
        if n := len(self.rest):
            self._put(np.append(self.rest, np.zeros(-n % SEQUENCE, self.kind)), n)
        self.out.close()
        self.sink.close()
        common.publish(self.files, self.part, self.path)


class ShardReader:
    """Random access to the sequences of a shard; ids are views of the mapped file where it is local."""

    def __init__(self, folder: str, number: int):
        files, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{_shard(number)}"
        self.source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.batch, self.at = None, -1

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.batch, self.at = self.file.get_batch(k), k
        return self.batch

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence s."""
        batch, row = self._batch(s // ROWS), s % ROWS
        ids, mask = (batch.column(i).values[row * SEQUENCE : (row + 1) * SEQUENCE] for i in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from the shard's id `start` on."""
        step, parts = SEQUENCE * ROWS, []
        while n > 0:
            k, at = divmod(start, step)
            parts.append(self._batch(k).column(0).values[at : at + n].to_numpy())
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write(df: DataFrame, folder: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards into `folder`, which all machines share, and returns their index.

    The index is a table: doc_id, shard, at (the document's first id in its shard), start (the same in all shards), n_tokens.
    """
    spark = df.sparkSession
    docs = common.texts(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm_path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard, out = subword.tokenizer("word", path), TaskContext.get().partitionId(), None
        for batch, values in common.batches(it):
            if out is None:
                out = ShardWriter(folder, shard, tokens.library.get_vocab_size() > 1 << 16)
            ids, each = subword.with_end(*tokens.encode(values), end)
            at = out.size + np.cumsum(each) - each
            out.add(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(each), shard), pa.int32()), pa.array(at), pa.array(each)],
                names=["doc_id", "shard", "at", "n_tokens"],
            )
        if out is not None:
            out.close()

    dealt = docs.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    index = common.table(dealt.mapInArrow(run, f"doc_id {kind}, shard int, at long, n_tokens long"), "ids-index")
    # One row per shard, a number that the session's setting of partitions bounds.
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(F.broadcast(bases), "shard").select(
        "doc_id", "shard", "at", (F.col("base") + F.col("at")).alias("start"), "n_tokens"
    )


def read(index: DataFrame, folder: str) -> DataFrame:
    """The index with the documents' ids (little-endian unsigned 32-bit) from the files."""
    kinds = [(c, index.schema[c].dataType.simpleString()) for c in index.columns]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, open_shard = None, None
        for batch in it:
            out = []
            for shard, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "n_tokens")), strict=True):
                if shard != open_shard:
                    reader, open_shard = ShardReader(folder, shard), shard
                out.append(reader.span(at, n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "ids"])

    return index.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds) + ", ids binary")


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(df: DataFrame, path: str, end: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what the written files give back."""
    folder = common.work_path(df.sparkSession, "ids")
    return read(write(df, folder, path, end), folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
