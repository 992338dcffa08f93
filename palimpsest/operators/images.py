"""Pixel mosaics and the mapping of line text to boxes. Pixels are numpy arrays (height, width, channels); readers of
image files, text recognition and object models are functions of one's own, run by Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import line_boxes
from palimpsest.operators.detect import rule_spans

KEPT = ("image", "height", "width", "channels")
OBJECT = "struct<x0:int,y0:int,x1:int,y1:int,label:string,confidence:double>"


def clipped(box: tuple[int, int, int, int], width: int, height: int) -> tuple[int, int, int, int]:
    """A box within an image; empty where it lies outside."""
    x0, y0, x1, y1 = box
    x0, y0 = min(max(x0, 0), width), min(max(y0, 0), height)
    return x0, y0, max(x0, min(x1, width)), max(y0, min(y1, height))


def _nearest(n: int, m: int) -> np.ndarray:
    """The source index of each of m samples of n places, at the samples' centres."""
    return np.minimum(((np.arange(m) + 0.5) * n / m).astype(int), n - 1)


def mosaic(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], factor: int = 16) -> np.ndarray:
    """A copy with each box's region at one sample for `factor` pixels; later boxes see what earlier ones did.

    pixels may have further axes in front: images of one size with the same boxes.
    """
    out = pixels.copy()
    for box in boxes:
        x0, y0, x1, y1 = clipped(box, out.shape[-2], out.shape[-3])
        w, h = x1 - x0, y1 - y0
        if w <= 0 or h <= 0:
            continue
        sw, sh = max(1, w // factor), max(1, h // factor)
        rows, cols = _nearest(h, sh)[_nearest(sh, h)], _nearest(w, sw)[_nearest(sw, w)]
        out[..., y0:y1, x0:x1, :] = out[..., y0:y1, x0:x1, :][..., rows, :, :][..., cols, :]
    return out


def mosaics(df: DataFrame, factor: int = 16) -> DataFrame:
    """image, height, width, channels, pixels of each row with its boxes (array<OBJECT>) pixelated; pixels: BINARY, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, boxes = batch.column("pixels").cast(pa.binary()), batch.column("boxes")
            data, ends = _bytes(pixels)
            corners = np.stack([boxes.values.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], 1)
            has = boxes.is_valid().to_pylist()
            at = boxes.offsets.to_numpy()
            alike: dict[tuple, list[int]] = {}
            for i, shape in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", "channels")))):
                alike.setdefault((shape, corners[at[i] : at[i + 1]].tobytes() if has[i] else b""), []).append(i)
            out = data.copy()
            for (shape, _), rows in alike.items():
                i = rows[0]
                images = np.stack([data[ends[r] : ends[r + 1]] for r in rows]).reshape(-1, *shape)
                made = mosaic(images, corners[at[i] : at[i + 1]].tolist() if has[i] else [], factor).reshape(len(rows), -1)
                for r, image in zip(rows, made):
                    out[ends[r] : ends[r + 1]] = image
            done = pa.Array.from_buffers(pa.binary(), len(pixels), [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEPT), done], [*KEPT, "pixels"])

    return df.select(*KEPT, "pixels", "boxes").mapInArrow(run, "image string, height int, width int, channels int, pixels binary")


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values one after the other, and where each begins, with the last one's end."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def detect_objects(df: DataFrame, model: Callable[[bytes], list[dict]], classes: list[str] | None = None) -> DataFrame:
    """df with `boxes` from a model of one's own (image bytes to dicts of OBJECT), of these classes, and `error`.

    An image that the model fails on has no boxes (null, not an empty list) and says why: nobody may take it for one with
    nothing to hide. One image's failure is no other's.
    """

    @F.pandas_udf(f"struct<boxes:array<{OBJECT}>,error:string>")
    def run(content: pd.Series) -> pd.DataFrame:
        found, errors = [], []
        for data in content:
            boxes, error = None, None
            try:
                boxes = list(model(bytes(data)))
            except Exception as e:  # noqa: BLE001  whatever the model raises
                error = f"{type(e).__name__}: {e}"
            found.append(boxes)
            errors.append(error)
        return pd.DataFrame({"boxes": found, "error": errors})

    # Once for both columns.
    told = df.withColumn("told", F.explode(F.array(run("content"))))
    boxes = F.filter("told.boxes", lambda b: b["label"].isin(classes)) if classes else F.col("told.boxes")
    return told.withColumn("boxes", boxes).withColumn("error", F.col("told.error")).drop("told")


def text_boxes(lines: DataFrame, fields=None, least: float = 0.0) -> DataFrame:
    """image, field_type, boxes of the sensitive parts of recognised lines (image, line_no, text, score, box)."""
    one = F.struct("line_no", "text", F.col("box"))
    docs = lines.filter(F.col("score") >= least).groupBy("image").agg(F.array_sort(F.collect_list(one)).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    size = lambda n: F.aggregate(F.slice("l", 1, n), F.lit(0), lambda a, x: a + F.length(x["text"]) + 1)
    placed = F.transform("l", lambda x, i: F.struct(x["box"].alias("box"), size(i).alias("start"), (size(i) + F.length(x["text"])).alias("end")))
    found = docs.select("image", placed.alias("lines"), rule_spans(text, fields).alias("spans")).select("image", "lines", F.explode("spans").alias("s"))
    return found.select("image", F.col("s.field_type").alias("field_type"), line_boxes(F.col("lines"), F.col("s.start"), F.col("s.end")).alias("boxes"))
