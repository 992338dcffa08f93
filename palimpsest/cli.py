"""spark-submit entry: mask a folder of documents, or restore what a run masked."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from palimpsest.operators import models
from palimpsest.plans import config, pipeline
from palimpsest.sources import files


def _list(text: str | None) -> list[str] | None:
    return None if text is None else [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("source", help="folder of documents, or with --recover of a run's results")
    p.add_argument("out", nargs="?", help="folder of results")
    p.add_argument("--fields", help="comma-separated names; default: all enabled ones")
    p.add_argument("--fields-file", help="YAML file of fields")
    p.add_argument("--surnames", help="file of surname characters")
    p.add_argument("--no-checksums", action="store_true")
    p.add_argument("--recoverable", action="store_true")
    p.add_argument("--recover", action="store_true")
    p.add_argument("--key", help="passphrase; default: the environment's, the key file's, or a new one")
    p.add_argument("--key-file", help="where the passphrase is kept; default: among the results")
    p.add_argument("--redo", action="store_true", help="also documents that are done")
    p.add_argument("--parsed", help="folder of a layout parser's output, for documents of pages")
    p.add_argument("--parser", help="module:function that makes such output from a file's bytes and suffix")
    p.add_argument("--findings", help="module:function from a column of texts to a column of spans of another detector")
    p.add_argument("--models", help="YAML file of language models (models: {name: {url, model, key, ...}}, default: name)")
    p.add_argument("--model", help="name of the model that is asked about texts, beside the rules; default: the file's")
    p.add_argument("--requirements", default="", help="further requirements for the model")
    p.add_argument("--chunk-size", type=int, default=6000, help="characters of text in a call, about")
    p.add_argument("--files", help="folder for the results as files: artifacts with their audits, or what was restored")
    p.add_argument("--summary", action="store_true", help="print the totals as JSON")
    return p


def _named(what: str | None):
    """The object that module:name means."""
    if what is None:
        return None
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    if args.recover:
        back = pipeline.restore(spark, args.source, args.key, args.key_file)
        if args.out:
            back.write.mode("overwrite").parquet(args.out)
            back = spark.read.parquet(args.out)
        if args.files:
            back = pipeline.export_restored(back, args.files)
        left = back.selectExpr("coalesce(sum(unresolved), 0) as n").first()["n"]
        print(f"unresolved: {left}")
        return int(left > 0)
    if not args.out:
        print("a folder of results is needed", file=sys.stderr)
        return 2
    options = pipeline.Options(
        _list(args.fields), args.fields_file, not args.no_checksums, args.recoverable, args.key, args.key_file, not args.redo, args.surnames,
        args.parsed, _named(args.parser), _named(args.findings),
        models.chat(**config.models(args.models, args.model)) if args.models else None, args.requirements, args.chunk_size,
    )
    status = pipeline.run(spark, args.source, args.out, options)
    if args.files:
        pipeline.export(spark, args.out, args.files).write.format("noop").mode("overwrite").save()
    totals = {r["status"]: r["n"] for r in files.totals(status).collect()}
    print(files.summary(status).first()["summary"] if args.summary else " ".join(f"{k}: {v}" for k, v in sorted(totals.items())))
    return int(totals.get("failed", 0) > 0)


if __name__ == "__main__":
    sys.exit(main())
