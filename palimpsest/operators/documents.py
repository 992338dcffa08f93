"""Documents of blocks: offsets, block lookups, splits at block edges, Markdown, chunks.

blocks: doc_id, ord, type, text, page, level and whatever else; char_start and char_end come from here.
Joins are on doc_id, with the range beside it, so that every one is an equi-join.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.resolve import mask, splice
from palimpsest.operators.specs import DEFAULTS, Field

#: Blocks that are page furniture and no part of the text, and blocks that are pictures.
FURNITURE = ["header", "footer", "page_number", "page_header", "page_footer", "page_aside_text", "page_footnote"]
PICTURES = ["image", "chart"]
GAP = 2


def placed(blocks: DataFrame) -> DataFrame:
    """blocks with char_start and char_end in the document's text (blocks joined by a blank line); -1 for furniture."""
    before = Window.partitionBy("doc_id", "meta").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + GAP).over(before), F.lit(0)).cast("int")
    out = blocks.withColumn("meta", F.coalesce(F.col("type").isin(FURNITURE), F.lit(False))).withColumn("char_start", start)
    out = out.withColumn("char_end", F.when(F.col("meta"), -1).otherwise(F.col("char_start") + F.length("text")).cast("int"))
    return out.withColumn("char_start", F.when(F.col("meta"), -1).otherwise(F.col("char_start")).cast("int")).drop("meta")


def ordered_texts(ord_col: str = "ord", text: Column | str = "text", sep: str = "\n\n") -> Column:
    """An aggregate: texts joined in order."""
    pair = F.struct(F.col(ord_col).alias("o"), (F.col(text) if isinstance(text, str) else text).alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["t"]), sep)


def documents(blocks: DataFrame) -> DataFrame:
    """doc_id, text, pages, n_blocks of placed blocks. A document must fit a row; corpora go by blocks instead."""
    body = blocks.filter("char_start >= 0")
    texts = body.groupBy("doc_id").agg(ordered_texts().alias("text"))
    counts = blocks.groupBy("doc_id").agg(F.greatest(F.max("page"), F.lit(1)).alias("pages"), F.count(F.lit(1)).alias("n_blocks"))
    return counts.join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def statistics(blocks: DataFrame, fields: list[Field] | None = None) -> DataFrame:
    """doc_id, pages, n_blocks, chars, regions, total, by_field of placed blocks that carry their own spans.

    chars: the document's text with its gaps; regions: blocks with a span; by_field has all the fields asked for.
    """
    names = [f.name for f in (DEFAULTS if fields is None else fields)]
    body = F.col("char_start") >= 0
    count = lambda name: F.coalesce(F.sum(F.when(body, F.size(F.filter("spans", lambda s: s["field_type"] == name)))), F.lit(0))
    return blocks.groupBy("doc_id").agg(
        F.greatest(F.max("page"), F.lit(1)).alias("pages"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.coalesce(F.max(F.when(body, F.col("char_end"))), F.lit(0)).cast("long").alias("chars"),
        F.count_if(body & (F.size("spans") > 0)).alias("regions"),
        F.coalesce(F.sum(F.when(body, F.size("spans"))), F.lit(0)).alias("total"),
        F.create_map(*(x for name in names for x in (F.lit(name), count(name)))).alias("by_field"),
    )


def block_at(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """spans (doc_id, start) with the ord and page of the block that holds the start; page 1 where none does."""
    b = blocks.filter("char_start >= 0").select("doc_id", F.col("ord").alias("block_ord"), F.col("page").alias("block_page"), "char_start", "char_end")
    s = spans.alias("s")
    found = s.join(b.alias("b"), (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.start") >= F.col("char_start")) & (F.col("s.start") < F.col("char_end")), "left")
    return found.select("s.*", "block_ord", F.coalesce("block_page", F.lit(1)).alias("page"))


def overlaps(spans: DataFrame, blocks: DataFrame, *more: str) -> DataFrame:
    """A row for each span and block that share characters, with the part they share (lo, hi in the document), and more of the block's columns."""
    b = blocks.filter("char_start >= 0").select("doc_id", "ord", "type", "char_start", "char_end", *more)
    # Spans are as many as texts have, whatever the size of the files they come from says: never broadcast.
    both = spans.hint("merge").alias("s").join(b.alias("b"), (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.start") < F.col("char_end")) & (F.col("char_start") < F.col("s.end")))
    return both.select("s.*", "b.ord", "b.type", "char_start", "char_end", F.greatest("s.start", "char_start").alias("lo"), F.least("s.end", "char_end").alias("hi"), *(f"b.{c}" for c in more))


def split_at_blocks(spans: DataFrame, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans cut at block edges: each part has its own value; what lies in the gaps between blocks goes."""
    parts = overlaps(spans, blocks).filter("hi > lo").join(texts.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    keep = [c for c in spans.columns if c not in ("start", "end", "value")]
    return parts.select(*keep, "ord", F.col("lo").alias("start"), F.col("hi").alias("end"), F.expr("substring(doc_text, lo + 1, hi - lo)").alias("value"))


def masked_blocks(blocks: DataFrame, spans_col: str = "spans", fields: list[Field] | None = None) -> DataFrame:
    """Blocks that carry their own disjoint spans (block-relative), with masks placed and masked_text."""
    fields = list(DEFAULTS) if fields is None else fields
    out = blocks.withColumn(spans_col, mask(F.col("text"), F.col(spans_col), fields))
    return out.withColumn("masked_text", splice(F.col("text"), F.col(spans_col)))


def markdown_parts(blocks: DataFrame, images: Column | None = None) -> DataFrame:
    """Masked blocks with `part` (their Markdown; null: left out) and `shift` (where masked_text begins in it).

    Titles get as many # as their level; pictures become links where `images` (a column: the picture's path, or
    null) has one, with their text as caption, and go otherwise; blank blocks go.
    """
    level = F.coalesce(F.col("level"), F.lit(0)) if "level" in blocks.columns else F.lit(0)
    prefix = F.when((F.col("type") == "title") & (level > 0), F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).otherwise("")
    text = F.concat(prefix, F.col("masked_text"))
    blank = F.trim(F.translate(text, "\n\r\t", "   ")) == ""
    lead = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
    link = F.concat(F.lit("!["), F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("]("), images, F.lit(")")) if images is not None else F.lit(None).cast("string")
    picture = F.col("type").isin(PICTURES)
    part = F.when(F.col("type").isin(FURNITURE), None).when(picture, link).when(~blank, text)
    shift = F.when(picture, F.length(prefix) + 2 - lead).otherwise(F.length(prefix))
    return blocks.withColumn("part", part).withColumn("shift", shift)


def markdown(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' Markdown (doc_id, markdown), and where each mask is in it (doc_id, ord, start, end, masked, md_start, md_end)."""
    live = parts.filter("part is not null")
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    at = live.withColumn("md_at", F.coalesce(F.sum(F.length("part") + GAP).over(before), F.lit(0)).cast("int"))
    whole = live.groupBy("doc_id").agg(ordered_texts("ord", "part").alias("markdown"))
    places = at.select("doc_id", "ord", (F.col("md_at") + F.col("shift")).alias("base"), F.explode("spans").alias("s"))
    cols = [F.col(f"s.{c}").alias(c) for c in ("field_type", "source", "value", "start", "end", "masked")]
    return whole, places.select("doc_id", "ord", *cols, (F.col("base") + F.col("s.out_start")).alias("md_start"), (F.col("base") + F.col("s.out_end")).alias("md_end"))


def title_level(blocks: DataFrame, chunk: int = 6000, least: int = 3) -> DataFrame:
    """doc_id, level: the coarsest title level with `least` titles up to it and sections of a quarter chunk on average; null if none."""
    chars = blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    counts = blocks.filter("type = 'title' and level is not null").groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("level")))
    fit = upto.join(chars, "doc_id").filter((F.col("upto") >= least) & (F.col("chars") / F.col("upto") >= chunk / 4))
    return chars.select("doc_id").join(fit.groupBy("doc_id").agg(F.min("level").alias("level")), "doc_id", "left")


SENTENCE = re.compile(r"[。！？；\n]")
#: How far past its budget a cut may look for a good place.
MARGIN = 200


def cuts(text: str, size: int) -> list[tuple[int, int]]:
    """Pieces of a text of about `size` characters, cut at a blank line or a sentence's end just past the budget."""
    out, lo, n = [], 0, len(text)
    while lo < n:
        hi = lo + size
        if hi < n:
            window_end = min(hi + MARGIN, n)
            at = text.rfind("\n\n", hi, window_end)
            if at < 0:
                at = max((m.end() for m in SENTENCE.finditer(text, hi - 1, window_end)), default=-1)
            hi = at if at > 0 else hi
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out


def chunks(blocks: DataFrame, size: int = 6000, level_limit: int | None = 1) -> DataFrame:
    """doc_id, base, chunk of placed blocks: slices of the document's text for a model.

    A table is a chunk of its own; a title up to the level limit (or without a level) opens one; blocks gather up
    to the budget; furniture is left out. Documents are independent, one group each.
    """

    def per_document(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        doc = pdf["doc_id"].iloc[0]
        run: list = []

        def close() -> None:
            if run:
                text = "\n\n".join(b.text for b in run)
                pieces = cuts(text, size) if len(text) > size else [(0, len(text))]
                rows.extend((doc, run[0].char_start + a, text[a:b]) for a, b in pieces if text[a:b].strip())
                run.clear()

        for b in pdf[pdf["char_start"] >= 0].sort_values("ord").itertuples():
            table = b.type == "table"
            major = b.type == "title" and level_limit is not None and (pd.isna(b.level) or b.level <= level_limit)
            if table or major or (run and b.char_end - run[0].char_start > size):
                close()
            run.append(b)
            if table:
                close()
        close()
        return pd.DataFrame(rows, columns=["doc_id", "base", "chunk"])

    kind = blocks.schema["doc_id"].dataType.simpleString()
    given = blocks if "level" in blocks.columns else blocks.withColumn("level", F.lit(None).cast("int"))
    return given.select("doc_id", "ord", "type", "text", "level", "char_start", "char_end").groupBy("doc_id").applyInPandas(per_document, f"doc_id {kind}, base int, chunk string")
