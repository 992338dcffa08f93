"""What the corpus operators share: folds, working tables, batches of text and a cache of encoded pieces."""

from __future__ import annotations

import atexit
import gc
import itertools
import os
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that a worker holds as arrays at a time; one longer text is a batch of its own.
BATCH_CHARS = 400_000
#: Rows per Arrow batch: texts are long, so Spark's default of 10,000 rows would hold tens of megabytes.
BATCH_ROWS = 1000

_made: list[tuple[SparkSession, str]] = []


def session(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for rows that hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: str | Column, k: int) -> Column:
    """crc32 of the key as text, modulo k; null keys are in fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % k, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the warehouse.

    Only a local session without the setting (a test) gets a folder of this machine.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and spark.sparkContext.master.startswith("local["):
        told = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(told)
        spark.conf.set("spark.checkpoint.dir", told)
    return (told or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's Python ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}")
    # With its scheme, so that Spark and Arrow mean the same file system by it.
    path = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: later reads do not depend on any executor that made it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop(made: DataFrame) -> None:
    """Removes the files of a table that is not read any more."""
    for folder in {f.rpartition("/")[0] for f in made.inputFiles()}:
        remove(made.sparkSession, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str | Column) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no other column can clash with what operators add."""
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more
    )


def batches(it: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the record batches that hold about `limit` characters, and their texts."""
    for batch in it:
        values = batch.column(column).to_pylist()
        lo, size = 0, 0
        for i, v in enumerate(values):
            if size and size + len(v) > limit:
                yield batch.slice(lo, i - lo), values[lo:i]
                lo, size = i, 0
            size += len(v)
        if lo < len(values):
            yield batch.slice(lo), values[lo:]


def csr(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 for each i, one after another."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Numbered(defaultdict):
    """Numbers keys as they are asked for."""

    def __init__(self):
        super().__init__(itertools.count().__next__)

    def new(self, before: int) -> list:
        """The keys numbered since there were `before` of them, in order."""
        return [*itertools.islice(reversed(self), len(self) - before)][::-1]


class PieceCache:
    """Encoded pieces of text by their bytes, as one flat array of ids; emptied when it holds too many.

    encode takes a list of distinct pieces and gives the ids of each.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 250_000):
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.at = Numbered()
        self.flat = np.zeros(1024, np.int32)
        self.starts = np.zeros(1024, np.int64)
        self.lens = np.zeros(1024, np.int64)
        self.used = self.held = self.done = 0

    def known(self, piece: bytes) -> list[int] | None:
        """The ids of a piece, if they are remembered."""
        k = self.at.get(piece, -1)
        return self.flat[self.starts[k] : self.starts[k] + self.lens[k]].tolist() if 0 <= k < self.done else None

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and the number of ids of each piece."""
        if len(self.at) > self.most or self.held > 40 * self.most:
            self._empty()
        at, n = self.at, len(self.at)
        which = np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))
        if missing := at.new(n):
            self.held += sum(map(len, missing))
            self.starts, self.lens = self._room(self.starts, len(at)), self._room(self.lens, len(at))
            encoded = self.encode(missing)
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            total = int(sizes.sum())
            self.flat = self._room(self.flat, self.used + total)
            self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(encoded), np.int32, total)
            self.starts[n : len(at)] = self.used + np.cumsum(sizes) - sizes
            self.lens[n : len(at)] = sizes
            self.used += total
            self.done = len(at)
        lens = self.lens[which]
        return self.flat[csr(lens, self.starts[which])], lens


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; 0 for empty runs."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys with more than a HOT-th of all rows: there are fewer than HOT of these, whatever the rows.
HOT = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows with the columns of facts, which has one row a key and in column n about how many of rows have it, of `total` in all.

    Frequent keys go by broadcast (their number is bounded by that of their rows), so that none is one task's.
    """
    often = F.col(n) * HOT > total
    hot = F.broadcast(facts.filter(often).drop(n))
    others = rows.join(F.broadcast(facts.filter(often).select(key)), key, "left_anti").join(facts.filter(~often).drop(n), key)
    return rows.join(hot, key).unionByName(others)


def narrow(df: DataFrame) -> DataFrame:
    """df, whose rows hold no texts, in an eighth of the partitions that shuffles make (8 at least): fewer and larger files."""
    return df.coalesce(max(8, partitions(df.sparkSession) // 8))


def publish(files: fs.FileSystem, part: str, path: str) -> None:
    """Renames a finished file; where another attempt was first, its file, which has the same bytes, stays."""
    if files.get_file_info(path).type == fs.FileType.NotFound:
        try:
            files.move(part, path)
            return
        except OSError:
            if files.get_file_info(path).type == fs.FileType.NotFound:
                raise
    files.delete_file(part)
