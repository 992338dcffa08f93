"""The same transformation on streams: it looks at one row at a time, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.detect import rule_spans
from palimpsest.operators.resolve import resolve, sanitize
from palimpsest.operators.specs import DEFAULTS, select


def stream(df: DataFrame, out: str, checkpoint: str, text_col: str = "text", fields=None, once: bool = True) -> StreamingQuery:
    """Writes the masked rows of a stream as Parquet, exactly once; raw values are not written."""
    clean = sanitize(df, text_col, fields).withColumn("spans", F.transform("spans", lambda s: s.dropFields("value"))).drop(text_col)
    writer = clean.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(df: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour", text_col: str = "text", fields=None) -> DataFrame:
    """Spans by time window and field; rows later than `late` are left out. For batches and streams alike."""
    fields = select(DEFAULTS) if fields is None else list(fields)
    found = resolve(rule_spans(F.col(text_col), fields), fields)
    spans = df.withWatermark(time_col, late).select(time_col, F.explode(F.transform(found, lambda s: s["field_type"])).alias("field_type"))
    return spans.groupBy(F.window(time_col, window).alias("w"), "field_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "field_type", "n")
