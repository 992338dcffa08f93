"""Audits: what was masked where, without the values themselves; with tokens where recovery is wanted."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import crypto


def spans_of(sanitized: DataFrame, id_col: str = "doc_id", key: bytes | None = None) -> DataFrame:
    """A row for each masked span of sanitize()'s result; with a key, the token of its value and where to put it back.

    No raw value is in any column.
    """
    s = sanitized.select(F.col(id_col).alias("doc_id"), F.explode("spans").alias("s"))
    cols = ["doc_id", F.col("s.field_type").alias("field_type"), F.col("s.source").alias("source"), F.col("s.masked").alias("masked_value")]
    if key is not None:
        cols += [crypto.token(F.col("s.value"), key).alias("encrypted_value"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.out_start").alias("md_start"), F.col("s.out_end").alias("md_end")]
    return s.select(*cols)


def field_counts(sanitized: DataFrame, *by: str) -> DataFrame:
    """Spans by field, and by further columns."""
    return sanitized.select(*by, F.explode("spans.field_type").alias("field_type")).groupBy(*by, "field_type").agg(F.count(F.lit(1)).alias("n"))


def _counts() -> Column:
    """Spans by field, counted within the row: no shuffle."""
    kinds = F.array_sort(F.array_distinct("spans.field_type"))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("spans", lambda s: s["field_type"] == k))))


def by_document(sanitized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, total, by_field of every document, also those without a span."""
    return sanitized.select(F.col(id_col).alias("doc_id"), F.size("spans").alias("total"), _counts().alias("by_field"))


def public_json(sanitized: DataFrame, id_col: str = "doc_id", salt: str | None = None, key: bytes | None = None) -> DataFrame:
    """doc_id, audit: one JSON text for each document."""
    def entry(s):
        parts = [s["field_type"].alias("field_type"), s["source"].alias("source"), s["masked"].alias("masked_value")]
        if key is not None:
            parts += [crypto.token(s["value"], key).alias("encrypted_value"), s["start"].alias("start"), s["end"].alias("end"), F.array(s["out_start"], s["out_end"]).alias("md")]
        return F.struct(*parts)

    recovery = [F.lit(json.dumps(crypto.public_parameters(salt))).alias("recovery")] if key is not None else []
    whole = F.struct(F.col(id_col).alias("doc"), F.struct(F.size("spans").alias("total"), _counts().alias("by_field")).alias("findings"), F.transform("spans", entry).alias("masked_spans"), *recovery)
    return sanitized.select(F.col(id_col).alias("doc_id"), F.to_json(whole).alias("audit"))


def sensitive(sanitized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The raw values and offsets, for a restricted place of its own."""
    s = sanitized.select(F.col(id_col).alias("doc_id"), F.explode("spans").alias("s"))
    return s.select("doc_id", *(F.col(f"s.{c}").alias(c) for c in ("field_type", "value", "start", "end", "source", "confidence", "masked")))
