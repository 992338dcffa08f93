"""Files as rows: which ones are documents, which are done, and where results go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes that can be read, and artifacts that can be recovered.
PICTURES = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tiff", ".webp", ".jp2"]
SUPPORTED = [".json", ".xlsx", ".pdf", ".docx", ".pptx", *PICTURES]
ARTIFACTS = ["sanitized.md", "redacted.json", "redacted.xlsx", "redacted.pdf"]
STRUCTURED = [".json", ".xlsx"]


def scan(spark: SparkSession, root: str, *suffixes: str) -> DataFrame:
    """path, length, modificationTime, content of all files below a folder, or of those with the suffixes, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes:
        either = ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
        files = files.option("pathGlobFilter", "{" + either + "}")
    return files.load(root)


def qualified(spark: SparkSession, root: str) -> str:
    """A folder as the paths of its files name it, with their scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Writes each row's content as the file that its path names, and returns the rows with `size` instead of it.

    A file gets its name when it is whole, so an attempt that ends early leaves none, and one that is repeated
    replaces it by the same bytes.
    """
    others = [c for c in rows.columns if c != content]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = []
            for to, data in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist(), strict=True):
                files, name = fs.FileSystem.from_uri(to if "://" in to else "file://" + to.removeprefix("file:"))
                folder, _, base = name.rpartition("/")
                files.create_dir(folder, recursive=True)
                part = f"{folder}/.{base}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(data or b"")
                files.move(part, name)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sizes, pa.int64())], names=[*others, "size"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{schema}, size long")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]+)?$", 1)


def relative(path: Column, root: str) -> Column:
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def documents(files: DataFrame, root: str, out_root: str | None = None) -> DataFrame:
    """files with rel and supported, hidden ones, those in folders that begin with two underscores, and results left out."""
    rel = relative(F.col("path"), root)
    hidden = F.exists(F.split(rel, "/"), lambda part: part.startswith(".") | part.startswith("__"))
    own = F.col("path").startswith(out_root.rstrip("/") + "/") if out_root else F.lit(False)
    return files.filter(~hidden & ~own).withColumn("rel", rel).withColumn("supported", suffix(F.col("path")).isin(SUPPORTED))


def artifacts(files: DataFrame, root: str, out_root: str | None = None) -> DataFrame:
    """Artifacts of earlier runs, by their exact names."""
    return documents(files, root, out_root).filter(F.element_at(F.split("path", "/"), -1).isin(ARTIFACTS)).drop("supported")


def newest(files: DataFrame, key: list[str]) -> DataFrame:
    """Of the files of each key the one modified last; of several, the last by path."""
    return files.groupBy(*key).agg(F.max(F.struct("modificationTime", "path")).alias("m")).select(*key, F.col("m.path").alias("path"), F.col("m.modificationTime").alias("modificationTime"))


def job_dirs(docs: DataFrame, out_root: str) -> DataFrame:
    """docs (rel) with job_dir, one for each: the mirrored folder and stem; of equal stems all but the first add their suffix."""
    base = F.regexp_replace("rel", r"(\.[^./]+)$", "")
    nth = F.row_number().over(Window.partitionBy("base").orderBy("rel"))
    own = F.when(nth > 1, F.concat(F.lit("-"), F.regexp_extract("rel", r"\.([^./]+)$", 1))).otherwise("")
    return docs.withColumn("base", base).withColumn("job_dir", F.concat(F.lit(out_root.rstrip("/") + "/"), F.col("base"), own)).drop("base")


def pending(docs: DataFrame, done: DataFrame, key: str = "rel") -> DataFrame:
    """Documents that no finished run has."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def finished(audits: DataFrame, written: DataFrame) -> DataFrame:
    """rel of runs whose audit (rel, job_dir, names: what it says it wrote) has all its artifacts among written (job_dir, name)."""
    named = audits.select("rel", "job_dir", F.explode_outer("names").alias("name"))
    have = written.select("job_dir", "name", F.lit(1).alias("there")).distinct()
    missing = named.join(have, ["job_dir", "name"], "left").filter("name is not null and there is null").select("rel").distinct()
    return audits.select("rel").distinct().join(missing, "rel", "left_anti")


def source_for(found: DataFrame, originals: DataFrame) -> DataFrame:
    """The original behind each redacted artifact. found: rel of artifacts; originals: rel of sources.

    The folder's name is the source's stem, or that with -suffix where two stems met; suffixes in any case.
    """
    parts = found.withColumn("name", F.regexp_extract("rel", r"([^/]+)$", 1)).filter(F.col("name").isin("redacted.json", "redacted.xlsx"))
    parts = parts.withColumn("ext", suffix(F.col("name"))).withColumn("job", F.lower(F.regexp_replace("rel", r"/[^/]+$", "")))
    known = originals.select(F.col("rel").alias("source"), F.lower(F.regexp_replace("rel", r"(\.[^./]+)$", "")).alias("stem"), suffix(F.col("rel")).alias("ext"))
    known = known.groupBy("stem", "ext").agg(F.min("source").alias("source"))
    short = F.expr("case when job like concat('%-', substr(ext, 2)) then left(job, length(job) - length(ext)) end")
    first = parts.withColumn("short", short).join(known.select(F.col("stem").alias("job"), "ext", F.col("source").alias("first")), ["job", "ext"], "left")
    both = first.join(known.select(F.col("stem").alias("short"), "ext", F.col("source").alias("second")), ["short", "ext"], "left")
    return found.join(both.select("rel", F.coalesce("first", "second").alias("source")), "rel", "left")


def recoverable(audits: DataFrame) -> DataFrame:
    """artifact, reason (null: it can be recovered). audits: artifact, audit (its JSON, null where there is none)."""
    whole = F.try_parse_json("audit")
    on = F.get_json_object("audit", "$.recovery.enabled")
    reason = F.when(F.col("audit").isNull(), "no audit beside the artifact").when(whole.isNull(), "the audit is not valid JSON").when(F.coalesce(on, F.lit("")) != "true", "the run kept nothing to recover from")
    return audits.select("artifact", reason.alias("reason"))


def totals(statuses: DataFrame) -> DataFrame:
    """Runs by status."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def summary(statuses: DataFrame, state: str = "complete") -> DataFrame:
    """One row of JSON: the state, and how many documents have each status."""
    counts = totals(statuses).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("totals"))
    return counts.select(F.to_json(F.struct(F.lit(state).alias("state"), "totals")).alias("summary"))
