"""Whole runs over folders: read, detect, mask, write with an audit; and back. Finished documents are passed over.

Every run writes its rows below folders of its own (run=...), and its status last: what a run without a status left
behind is never read, and of several runs of a document the last one counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import crypto
from palimpsest.operators import audit, detect, documents, models, recover, resolve
from palimpsest.operators.specs import Field, load, select
from palimpsest.sources import files, jsonleaves, layout, workbook

TEXTS = [".txt", ".md"]
#: Kinds that a layout parser reads.
LAID_OUT = [s for s in files.SUPPORTED if s not in files.STRUCTURED]


@dataclass
class Options:
    """fields, fields_file, surnames, verify_checksums: what is looked for. recoverable, passphrase, keyfile: whether and how
    values can come back. skip_existing: whether finished documents are passed over. parsed: a folder of a layout parser's
    output; parser: a function that makes such output from a file's bytes and suffix (page model, content list; JSON texts or
    None). findings: a column from texts to spans of another detector, beside the rules. provider,
    requirements, chunk_size: makes a language model that is asked about texts in chunks, beside the rules; a text of which
    a chunk got no answer is `failed`."""

    fields: list[str] | None = None
    fields_file: str | None = None
    verify_checksums: bool = True
    recoverable: bool = False
    passphrase: str | None = None
    keyfile: str | None = None
    skip_existing: bool = True
    surnames: str | None = None
    parsed: str | None = None
    parser: Callable[[bytes, str], tuple[str | None, str | None]] | None = None
    findings: Callable[[Column], Column] | None = None
    provider: Callable[[], models.Provider] | None = None
    requirements: str = ""
    chunk_size: int = 6000

    def chosen(self) -> list[Field]:
        return select(load(self.fields_file), self.fields)

    def detecting(self) -> dict:
        from palimpsest.operators.lexicon import Lexicon, read_surnames

        how = {"fields": self.chosen(), "verify": self.verify_checksums, "lexicon": Lexicon(read_surnames(self.surnames)) if self.surnames else None}
        return how | ({"findings": self.findings(F.col("text"))} if self.findings else {})

    def kept(self, spark: SparkSession, out: str) -> crypto.KeyFile:
        return crypto.KeyFile(spark, self.keyfile or f"{out}/{crypto.KEYFILE}")


def run(spark: SparkSession, source: str, out: str, options: Options | None = None) -> DataFrame:
    """Masks all documents below `source` and returns the latest status of each: rel, status, spans, run.

    Text files, JSON and workbooks are read here; documents of pages need a layout parser's output and are `unsupported`
    without it. Tables below `out`: artifacts (rel, kind, content), audit_spans, status.
    """
    options = options or Options()
    root, how = files.qualified(spark, source), options.detecting()
    done = _table(spark, out, "status")
    done = done.filter("status = 'ok'").select("rel").distinct() if done is not None and options.skip_existing else None

    def found(*suffixes: str) -> DataFrame:
        some = files.documents(files.scan(spark, source, *suffixes), root, files.qualified(spark, out)).withColumn("kind", files.suffix(F.col("path")))
        return files.pending(some, done) if done is not None else some

    number = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    # What was found, with the rows it is in: for the artifacts and for the audit.
    kept: list[DataFrame] = []
    parts = [_texts(found(*TEXTS), how, kept, options), _json(found(".json"), how, kept), _books(found(".xlsx"), how, kept)]
    pages = _outputs(spark, found(*LAID_OUT), options)
    if pages is not None:
        parts.append(_pages(pages, how, kept))
    artifacts, spans = parts[0]
    for a, s in parts[1:]:
        artifacts, spans = artifacts.unionByName(a), spans.unionByName(s)
    try:
        _write(spark, out, number, artifacts, spans, options)
    finally:
        for df in kept:
            df.unpersist()
    made = spark.read.parquet(f"{out}/artifacts/run={number}").select("rel", F.lit(True).alias("there"))
    counts = spark.read.parquet(f"{out}/audit_spans/run={number}").groupBy("rel").agg(F.count(F.lit(1)).alias("spans"))
    readable = F.col("kind").isin(*TEXTS, *files.STRUCTURED) | (F.col("kind").isin(LAID_OUT) & F.lit(pages is not None))
    status = F.when(F.col("there"), "ok").when(readable, "failed").otherwise("unsupported")
    rows = found().select("rel", "kind").join(made, "rel", "left").join(counts, "rel", "left")
    # The last step: from here on the run counts.
    rows.select("rel", status.alias("status"), F.coalesce("spans", F.lit(0)).alias("spans"), F.lit(number).alias("run")).write.mode("append").parquet(f"{out}/status")
    return latest(spark, out)


def _write(spark: SparkSession, out: str, number: str, artifacts: DataFrame, spans: DataFrame, options: Options) -> None:
    artifacts.write.parquet(f"{out}/artifacts/run={number}")
    token, told = F.lit(None).cast("string"), F.lit(None).cast("string")
    if options.recoverable:
        salt = _salt(spark, out) or crypto.new_salt()
        key = crypto.derive_key(crypto.to_seal(options.passphrase, options.kept(spark, out)), salt)
        token, told = crypto.token(F.col("value"), key), F.lit(json.dumps(crypto.public_parameters(salt)))
    spans.withColumn("encrypted_value", token).withColumn("recovery", told).drop("value").write.parquet(f"{out}/audit_spans/run={number}")


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last status of each document; one that was ever finished keeps that until a later run finishes it again."""
    good = F.struct((F.col("status") == "ok").alias("ok"), "run", "status", "spans")
    return spark.read.parquet(f"{out}/status").groupBy("rel").agg(F.max(good).alias("s")).select("rel", "s.status", "s.spans", "s.run")


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of a table below `out` that belong to the latest finished run of their document."""
    live = latest(spark, out).filter("status = 'ok'").select("rel", "run")
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").withColumn("run", F.col("run").cast("string")).join(live, ["rel", "run"])


def _salt(spark: SparkSession, out: str) -> str | None:
    """The salt of earlier runs, so that one key opens them all."""
    if (told := _table(spark, out, "audit_spans")) is None:
        return None
    first = told.filter("recovery is not null").select("recovery").limit(1).collect()
    return json.loads(first[0]["recovery"])["kdf_salt"] if first else None


def _table(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(f"{out}/{name}") if there else None


PATH = jsonleaves.PATH


def _spans(df: DataFrame, unit: Column, path: Column | None = None) -> DataFrame:
    s = df.select(F.col("doc_id").alias("rel"), unit.alias("unit"), (path if path is not None else F.lit(None).cast(PATH)).alias("path"), (F.col("kind") if "kind" in df.columns else F.lit("str")).alias("kind"), F.explode("spans").alias("s"))
    return s.select("rel", "unit", "path", "kind", F.col("s.field_type").alias("field_type"), F.col("s.source").alias("source"), F.col("s.value").alias("value"), F.col("s.masked").alias("masked_value"), F.col("s.out_start").alias("masked_start"), F.col("s.out_end").alias("masked_end"))


def _kept(df: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """df, made once and on disk until the run ends; a lost executor's part is made again."""
    kept.append(df.persist(StorageLevel.DISK_ONLY))
    return kept[-1]


def _texts(found: DataFrame, how: dict, kept: list[DataFrame], options: Options) -> tuple[DataFrame, DataFrame]:
    docs = found.select(F.col("rel").alias("doc_id"), F.decode("content", "utf-8").alias("text"))
    if options.provider is not None:
        asked = _kept(models.ask(models.text_chunks(docs, options.chunk_size), options.provider, how["fields"], options.requirements), kept)
        docs = docs.join(asked.filter("error is not null").select("doc_id").distinct(), "doc_id", "left_anti")
        docs = models.hybrid(docs, asked, how["fields"])
        more = how.get("findings")
        how = how | {"findings": F.col("findings") if more is None else F.concat(more, "findings")}
    clean = _kept(resolve.sanitize(docs, **how).drop("text"), kept)
    return clean.select(F.col("doc_id").alias("rel"), F.lit("text").alias("kind"), F.encode("masked_text", "utf-8").alias("content")), _spans(clean, F.lit("text"))


def _json(found: DataFrame, how: dict, kept: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    docs = found.select(F.col("rel").alias("doc_id"), F.decode("content", "utf-8").alias("json"))
    # A file may be one huge array: its elements are work for all.
    parts = docs.sparkSession.sparkContext.defaultParallelism * 2
    edits = _kept(resolve.masked_only(resolve.sanitize(jsonleaves.leaves(docs, parts=parts).filter("error is null"), **how)), kept)
    red = jsonleaves.redact(docs, edits, parts=parts).filter("json is not null")
    return red.select(F.col("doc_id").alias("rel"), F.lit("json").alias("kind"), F.encode("json", "utf-8").alias("content")), _spans(edits, jsonleaves.path_text(F.col("path")), F.col("path"))


def _books(found: DataFrame, how: dict, kept: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    docs = found.select("rel", "content")
    cells = workbook.cells(docs, "rel")
    edits = _kept(resolve.masked_only(resolve.sanitize(cells.filter("error is null"), **how)), kept)
    values = edits.select("doc_id", F.explode("spans.value").alias("value"))
    readable = docs.join(cells.filter("error is not null").select(F.col("doc_id").alias("rel")), "rel", "left_anti")
    red = workbook.redact(readable, edits, values, "rel")
    unit = F.concat_ws(":", F.col("sheet_idx").cast("string"), F.col("row").cast("string"), F.col("col").cast("string"))
    return red.select(F.col("doc_id").alias("rel"), F.lit("xlsx").alias("kind"), "content"), _spans(edits, unit)


def _outputs(spark: SparkSession, found: DataFrame, options: Options) -> DataFrame | None:
    """doc_id, middle, content of documents of pages, from a parser's files or a parser of one's own; None without either."""
    if options.parser is not None:
        return layout.parsed_by(found.select(F.col("rel").alias("doc_id"), "kind", F.col("content").alias("data")), options.parser)
    if options.parsed is None:
        return None
    told = files.scan(spark, options.parsed, ".json").withColumn("rel", files.relative(F.col("path"), files.qualified(spark, options.parsed)))
    return layout.parsed_files(found.select("rel"), told)


def _pages(outputs: DataFrame, how: dict, kept: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    fields, others = how["fields"], {k: v for k, v in how.items() if k != "fields"}
    found = detect.detect(layout.blocks(outputs), "text", fields, **others)
    found = _kept(found.withColumn("spans", resolve.resolve(F.col("spans"), fields)), kept)
    whole, places = documents.markdown(documents.markdown_parts(documents.masked_blocks(found, fields=fields)))
    every = outputs.select("doc_id").distinct().join(whole, "doc_id", "left")
    artifacts = every.select(F.col("doc_id").alias("rel"), F.lit("markdown").alias("kind"), F.encode(F.coalesce("markdown", F.lit("")), "utf-8").alias("content"))
    spans = places.select(F.col("doc_id").alias("rel"), F.lit("text").alias("unit"), F.lit(None).cast(PATH).alias("path"), F.lit("str").alias("kind"), "field_type", "source", "value", F.col("masked").alias("masked_value"), F.col("md_start").cast("int").alias("masked_start"), F.col("md_end").cast("int").alias("masked_end"))
    return artifacts, spans


def restore(spark: SparkSession, out: str, passphrase: str | None = None, keyfile: str | None = None) -> DataFrame:
    """rel, content, restored, unresolved of the artifacts below `out`; needs the audit and the passphrase only.

    Each span is opened with the key of its own run's parameters.
    """
    spans = committed(spark, out, "audit_spans")
    # As many rows as runs with a salt of their own.
    told = [r["recovery"] for r in spark.read.parquet(f"{out}/audit_spans").filter("recovery is not null").select("recovery").distinct().collect()]
    if not told and spans.limit(1).count():
        raise ValueError("this run kept nothing to recover from")
    key = crypto.keys_of(F.col("recovery"), told, crypto.to_open(passphrase, crypto.KeyFile(spark, keyfile or f"{out}/{crypto.KEYFILE}")))
    made = committed(spark, out, "artifacts").drop("run")
    texts = made.filter("kind in ('text', 'markdown')").select(F.col("rel").alias("doc_id"), F.decode("content", "utf-8").alias("masked_text"))
    told = spans.select(F.col("rel").alias("doc_id"), "unit", "path", "kind", "masked_value", "masked_start", "masked_end", "encrypted_value", "recovery")
    text = recover.markdown(texts, told.filter("unit = 'text'").withColumnsRenamed({"masked_start": "md_start", "masked_end": "md_end"}), key)
    docs = made.filter("kind = 'json'").select(F.col("rel").alias("doc_id"), F.decode("content", "utf-8").alias("json"))
    back = jsonleaves.recover(docs, told.filter("path is not null"), key)
    place = F.split("unit", ":")
    cells = told.filter("path is null and unit <> 'text'").select("*", *(place[i].cast("int").alias(c) for i, c in enumerate(("sheet_idx", "row", "col"))))
    books = workbook.recover(made.filter("kind = 'xlsx'").select(F.col("rel").alias("doc_id"), "content"), cells, key)
    return text.select(F.col("doc_id").alias("rel"), F.encode("text", "utf-8").alias("content"), "restored", "unresolved").unionByName(
        back.select(F.col("doc_id").alias("rel"), F.encode("json", "utf-8").alias("content"), "restored", "unresolved")
    ).unionByName(books.withColumnRenamed("doc_id", "rel"))


def export(spark: SparkSession, out: str, folder: str) -> DataFrame:
    """Writes each document's artifact and audit.json into a folder of its own below `folder`; returns rel, path, size.

    The folders mirror the source's; of documents that share a stem all but the first add their suffix.
    """
    names = F.create_map(*(F.lit(x) for x in ("text", "sanitized.md", "markdown", "sanitized.md", "json", "redacted.json", "xlsx", "redacted.xlsx")))
    made = committed(spark, out, "artifacts")
    dirs = files.job_dirs(made.select("rel"), folder)
    one = F.struct("unit", "field_type", "source", "masked_value", "masked_start", "masked_end", "encrypted_value")
    spans = committed(spark, out, "audit_spans").groupBy("rel").agg(F.array_sort(F.collect_list(one)).alias("masked_spans"), F.max("recovery").alias("recovery"))
    told = made.select("rel", names[F.col("kind")].alias("name")).join(spans, "rel", "left")
    recovery = F.from_json("recovery", "enabled boolean, algorithm string, kdf string, kdf_salt string, kdf_params struct<n:int,r:int,p:int>, ciphertext_format string")
    text = F.to_json(F.struct(F.col("rel").alias("source"), F.array("name").alias("artifacts"), F.coalesce(F.size("masked_spans"), F.lit(0)).alias("total"), "masked_spans", recovery.alias("recovery")))
    rows = made.select("rel", names[F.col("kind")].alias("name"), "content").unionByName(told.select("rel", F.lit("audit.json").alias("name"), F.encode(text, "utf-8").alias("content")))
    return files.write(rows.join(dirs, "rel").select("rel", F.concat("job_dir", F.lit("/"), "name").alias("path"), "content"))


def export_restored(restored: DataFrame, folder: str) -> DataFrame:
    """Writes what restore() gave back as files name_recovered.ext below `folder`; returns rel, restored, unresolved, path, size."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), recover.recovered_name(F.col("rel")))
    return files.write(restored.withColumn("path", path))


def sensitive_report(spark: SparkSession, docs: DataFrame, options: Options | None = None) -> DataFrame:
    """Raw values with offsets of a table of texts (doc_id, text), for a place of its own."""
    return audit.sensitive(resolve.sanitize(docs, **(options or Options()).detecting()))
