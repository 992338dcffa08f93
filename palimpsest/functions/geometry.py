"""Boxes and their arithmetic, as expressions. A box is struct<x0, y0, x1, y1> with x0 <= x1 and y0 <= y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def scaled(b: Column, width: Column, height: Column) -> Column:
    """A box in shares of a page; null where the page has no size."""
    return F.when((width > 0) & (height > 0), box(b["x0"] / width, b["y0"] / height, b["x1"] / width, b["y1"] / height))


def padded(b: Column, by: float) -> Column:
    return F.struct((b["x0"] - by).alias("x0"), (b["y0"] - by).alias("y0"), (b["x1"] + by).alias("x1"), (b["y1"] + by).alias("y1"))


def clamped(b: Column, width: Column, height: Column) -> Column:
    """A box within a page; null if nothing of it is left."""
    x0, y0 = F.greatest(b["x0"], F.lit(0)), F.greatest(b["y0"], F.lit(0))
    x1, y1 = F.least(b["x1"], width), F.least(b["y1"], height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    """Area in common over area in either; 0 where that is none."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    either = area(a) + area(b) - w * h
    return F.when(either > 0, w * h / either).otherwise(F.lit(0.0))


def near_full_page(b: Column, width: Column, height: Column, share: float = 0.8) -> Column:
    """Whether a box is over this share of its page both ways; false without a box or a page."""
    return F.coalesce((width > 0) & (height > 0) & ((b["x1"] - b["x0"]) / width > share) & ((b["y1"] - b["y0"]) / height > share), F.lit(False))


def line_boxes(lines: Column, lo: Column, hi: Column, pad: float = 1.0) -> Column:
    """Of each line (box, start, end) that [lo, hi) overlaps, the part in proportion to its characters, padded."""

    def part(line: Column) -> Column:
        b, n = line["box"], line["end"] - line["start"]
        w = b["x1"] - b["x0"]
        left = b["x0"] + w * (F.greatest(lo, line["start"]) - line["start"]) / n
        right = b["x0"] + w * (F.least(hi, line["end"]) - line["start"]) / n
        return padded(F.struct(left.alias("x0"), b["y0"].alias("y0"), right.alias("x1"), b["y1"].alias("y1")), pad)

    return F.transform(F.filter(lines, lambda x: (x["end"] > x["start"]) & (x["start"] < hi) & (lo < x["end"])), part)
