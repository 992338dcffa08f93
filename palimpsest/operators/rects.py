"""Where masked spans are on pages: rectangles from the lines and boxes of layout blocks. Drawing is for others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import clamped, line_boxes
from palimpsest.operators.documents import overlaps

#: Points an inch of a page, and dots an inch of its mosaic.
POINTS, DOTS = 72, 150


def plan(spans: DataFrame, blocks: DataFrame, pad: float = 1.0) -> DataFrame:
    """doc_id, start, end, page (from 0), box for each part of a span. blocks: placed(), with layout.BLOCK's columns.

    Within lines by the share of characters, padded; the whole block where it has no lines (tables); none where it has
    no box. Boxes stay on their page where its size is known.
    """
    parts = overlaps(spans.select("doc_id", "start", "end"), blocks, "page", "box", "lines", "width", "height").filter("hi > lo")
    in_lines = line_boxes(F.col("lines"), F.col("lo") - F.col("char_start"), F.col("hi") - F.col("char_start"), pad)
    boxes = F.when(F.size("lines") > 0, in_lines).when(F.col("box").isNotNull(), F.array("box"))
    found = parts.withColumn("box", F.explode(boxes))
    on_page = F.when((F.col("width") > 0) & (F.col("height") > 0), clamped(F.col("box"), F.col("width"), F.col("height"))).otherwise(F.col("box"))
    return found.select("doc_id", "start", "end", (F.col("page") - 1).alias("page"), on_page.alias("box")).filter("box is not null")


def mosaic_block(factor: int) -> int:
    """Pixels of a mosaic's squares on a page drawn at DOTS an inch."""
    return max(2, factor * DOTS // POINTS)


def per_page(rects: DataFrame) -> DataFrame:
    """doc_id, page, regions."""
    return rects.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("regions"))


def of_images(images: DataFrame, share: float = 0.8) -> Column:
    """Whether a picture (image_box, width, height) fills its page, so that masking its text is left to the page."""
    from palimpsest.functions.geometry import near_full_page

    return near_full_page(images["image_box"], images["width"], images["height"], share)
