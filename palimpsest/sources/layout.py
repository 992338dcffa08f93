"""Blocks from the JSON that layout parsers leave behind: a page model with lines and boxes ("middle"), or a
content list, paginated or flat. The parsers themselves are not called."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.html import table_to_markdown

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = (
    f"ord int, type string, text string, page int, level int, box {BOX}, "
    f"lines array<struct<text:string,box:{BOX},start:int,end:int>>, image string, image_box {BOX}, width double, height double"
)
COLUMNS = [c.split()[0] for c in "ord type text page level box lines image image_box width height".split()]
#: Parts of a table that hold its text, and content fields that do not follow their block's name.
CAPTIONS = ("table_caption", "table_footnote")
FIELDS = {"code": "code_content", "algorithm": "algorithm_content", "equation_interline": "math_content"}
IOU_LEAST = 0.5


def box(value: Any) -> dict | None:
    """A box from four numbers in any order of corners."""
    try:
        a, b, c, d = (float(x) for x in value[:4])
    except (TypeError, ValueError, KeyError):
        return None
    return {"x0": min(a, c), "y0": min(b, d), "x1": max(a, c), "y1": max(b, d)}


def scaled(b: dict | None, size: list) -> dict | None:
    if b is None or len(size) < 2 or size[0] <= 0 or size[1] <= 0:
        return None
    return {k: v / size[0 if k[0] == "x" else 1] for k, v in b.items()}


def iou(a: dict, b: dict) -> float:
    w = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    h = max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    either = sum((x["x1"] - x["x0"]) * (x["y1"] - x["y0"]) for x in (a, b)) - w * h
    return w * h / either if either else 0.0


def plain(value: Any, strip: bool = True) -> str:
    """Text of a string, a span, or a list of spans; equations within a line get a space on each side."""
    match value:
        case None:
            return ""
        case str():
            return value
        case dict():
            return plain(value.get("content"))
        case list():
            parts = []
            for x in value:
                text = str(x.get("content") or "") if isinstance(x, dict) else str(x)
                inline = isinstance(x, dict) and x.get("type") == "span_equation_inline"
                parts.append(f" {text} " if inline and text else text)
            return "".join(parts).strip() if strip else "".join(parts)
    return str(value)


def bullets(items: Any) -> str:
    texts = [plain(x.get("item_content")) for x in items or [] if isinstance(x, dict)]
    return "\n".join(f"- {t}" for t in texts if t.strip())


def captions(values: Any) -> str:
    return "\n".join(t for t in map(plain, values or []) if t.strip())


def _nodes(node: Any) -> Iterator[dict]:
    if isinstance(node, dict):
        yield node
    for x in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _nodes(x)


def _paragraph(p: dict) -> dict | None:
    kind, out = p.get("type"), {"box": box(p.get("bbox"))}
    if kind == "index":
        return {"type": "index", "text": ""}
    if kind == "table":
        subs = [s for s in p.get("blocks") or [] if isinstance(s, dict) and s.get("type") in CAPTIONS]
        return out | {"type": kind, "text": "\n".join(plain([s for s in x.get("spans") or [] if isinstance(s, dict)], False) for s in subs for x in s.get("lines") or [] if isinstance(x, dict))}
    if kind in ("image", "chart"):
        nodes = [*_nodes(p)]
        pictures = [n for n in nodes if n.get("image_path")]
        boxes = [b for n in pictures if (b := box(n.get("bbox")))]
        text = "\n".join(str(n["content"]) for n in nodes if str(n.get("type", "")).startswith("span_") and n.get("content"))
        where = boxes[-1] if boxes else None
        return {"type": kind, "text": text, "box": where or out["box"], "image": pictures[-1]["image_path"] if pictures else None, "image_box": where}
    if not isinstance(p.get("lines"), list):
        return None
    lines, at, texts = [], 0, []
    for x in (x for x in p["lines"] if isinstance(x, dict)):
        text = plain([s for s in x.get("spans") or [] if isinstance(s, dict)], False)
        if text and (b := box(x.get("bbox")) or out["box"]):
            lines.append({"text": text, "box": b, "start": at, "end": at + len(text)})
        at += len(text) + 1
        texts.append(text)
    level = int(p["level"]) if kind == "title" and p.get("level") is not None else None
    return out | {"type": "paragraph" if kind == "text" else kind, "text": "\n".join(texts), "lines": lines or None, "level": level}


def _html(record: Any) -> str:
    content = record.get("content") if isinstance(record, dict) and record.get("type") == "table" else None
    html = content.get("html") if isinstance(content, dict) else None
    return html if isinstance(html, str) else ""


def _tables(found: list[dict | None], records: list[dict], size: list) -> None:
    """Puts each table's cells in from the content list: the free record of the best overlap, else one beside its place."""
    free = dict(enumerate(records))
    for i, block in enumerate(found):
        if not block or block["type"] != "table":
            continue
        own = scaled(block.get("box"), size)
        near = [(iou(own, theirs), -j) for j, r in free.items() if own and r.get("type") == "table" and (theirs := scaled(box(r.get("bbox")), [1000.0, 1000.0]))]
        best = max((x for x in near if x[0] > IOU_LEAST), default=None)
        html = _html(records[-best[1]]) if best else ""
        if html:
            del free[-best[1]]
        else:
            html = next((h for j in (i, i - 1, i + 1) if 0 <= j < len(records) and (h := _html(records[j]))), "")
        if html:
            block["text"] = table_to_markdown(html)


def middle_blocks(middle: dict, pages: list | None = None) -> list[dict]:
    out = []
    for info in (p for p in middle.get("pdf_info") or [] if isinstance(p, dict)):
        page, size = int(info.get("page_idx", 0)) + 1, [float(x) for x in info.get("page_size") or []]
        found = [_paragraph(p) for p in info.get("para_blocks") or [] if isinstance(p, dict)]
        if pages and page <= len(pages):
            _tables(found, [r for r in pages[page - 1] if isinstance(r, dict)], size)
        out += [b | {"page": page, "width": size[0] if len(size) > 1 else None, "height": size[1] if len(size) > 1 else None} for b in found if b]
    return out


def _record(rec: Any, page: int) -> dict | None:
    kind = rec.get("type") if isinstance(rec, dict) else None
    if not isinstance(kind, str):
        return None
    content = rec.get("content")
    if isinstance(content, dict):
        text = {
            "table": lambda: table_to_markdown(content.get("html") or ""), "list": lambda: bullets(content.get("list_items")), "index": lambda: bullets(content.get("list_items")),
            "image": lambda: captions(content.get("image_caption")), "chart": lambda: captions(content.get("chart_caption")),
        }.get(kind, lambda: plain(content.get(FIELDS.get(kind, f"{kind}_content"))))()
        image = (content.get("image_source") or {}).get("path")
        return {"type": kind, "text": text, "page": page, "level": content.get("level") if kind == "title" else None, "image": image if isinstance(image, str) and image else None}
    if kind == "table":
        text = "\n\n".join(filter(None, ["\n".join(rec.get("table_caption") or []), table_to_markdown(rec.get("table_body") or "")]))
    elif kind == "list":
        text = bullets(rec.get("list_items"))
    else:
        text = captions(rec.get("image_caption") or rec.get("chart_caption")) if kind in ("image", "chart") else plain(rec.get("text"))
    return {"type": kind, "text": text, "page": page, "level": rec.get("text_level")}


def content_blocks(records: list) -> list[dict]:
    """Blocks of a content list: pages of records, or records that say their page."""
    if records and isinstance(records[0], list):
        found = [_record(r, k + 1) for k, page in enumerate(records) for r in page]
    else:
        found = [_record(r, int(r.get("page_idx", 0)) + 1) for r in records if isinstance(r, dict)]
    return [b for b in found if b]


def blocks(df: DataFrame, id_col: str = "doc_id", middle_col: str | None = "middle", content_col: str | None = "content") -> DataFrame:
    """doc_id and BLOCK of each document: from its page model, with tables from its content list, or from that alone."""
    none = F.lit(None).cast("string")
    given = df.select(F.col(id_col).alias("doc_id"), (F.col(middle_col) if middle_col else none).alias("middle"), (F.col(content_col) if content_col else none).alias("content"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, middle, content in zip(pdf["doc_id"], pdf["middle"], pdf["content"]):
                records = json.loads(content) if content else []
                paged = records if records and isinstance(records[0], list) else None
                found = middle_blocks(json.loads(middle), paged) if middle else content_blocks(records)
                rows += [(doc, *(dict(b, ord=k).get(c) for c in COLUMNS)) for k, b in enumerate(found)]
            out = pd.DataFrame(rows, columns=["doc_id", *COLUMNS])
            yield out.astype({"level": "Int32", "ord": "Int32", "page": "Int32"})

    return given.mapInPandas(run, f"doc_id {kind}, {BLOCK}")


def pair_images(found: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with the path of their image file (files: doc_id, path), and the files that no block names, on page 1."""
    base = F.element_at(F.split("path", "/"), -1)
    f = files.select("doc_id", "path", base.alias("name"))
    b = found.withColumn("name", F.element_at(F.split("image", "/"), -1))
    paired = b.join(f.groupBy("doc_id", "name").agg(F.min("path").alias("image_path")), ["doc_id", "name"], "left").drop("name")
    rest = f.join(b.filter("name is not null").select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti")
    return paired, rest.select("doc_id", F.lit(1).alias("page"), "path")


def parsed_files(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, middle, content of each document from a parser's files. docs: rel; told: rel, modificationTime, content.

    A document's files are those below <its folder>/<its stem>/ that are named <stem>_middle.json, <stem>_content_list.json
    or <stem>_content_list_v2.json; of several of a kind the one modified last, and of lists the second version.
    """
    name = F.regexp_extract("rel", r"([^/]+)$", 1)
    kind = F.regexp_extract(name, r"_(middle|content_list_v2|content_list)\.json$", 1)
    stem = F.regexp_replace(name, r"_(middle|content_list_v2|content_list)\.json$", "")
    at = F.instr(F.concat(F.lit("/"), "rel"), F.concat(F.lit("/"), stem, F.lit("/")))
    home = F.expr("left(rel, at + length(stem) - 1)")
    mine = told.withColumn("kind", kind).filter("kind <> ''").withColumn("stem", stem).withColumn("at", at).filter("at > 0").withColumn("home", home)
    last = mine.groupBy("home", "kind").agg(F.max_by(F.decode("content", "utf-8"), F.struct("modificationTime", "rel")).alias("json"))
    text = {k: F.max(F.when(F.col("kind") == k, F.col("json"))) for k in ("middle", "content_list", "content_list_v2")}
    both = last.groupBy("home").agg(text["middle"].alias("middle"), F.coalesce(text["content_list_v2"], text["content_list"]).alias("content"))
    return docs.select(F.col("rel").alias("doc_id"), F.regexp_replace("rel", r"(\.[^./]+)$", "").alias("home")).join(both, "home").drop("home")


def parsed_by(docs: DataFrame, parser: Callable[[bytes, str], tuple[str | None, str | None]]) -> DataFrame:
    """The same by a parser of one's own: (bytes, suffix) to the page model and the content list, as JSON texts or None.

    docs: doc_id, kind (the suffix), data. A document that it fails on has no row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, kind, data in zip(pdf["doc_id"], pdf["kind"], pdf["data"]):
                try:
                    rows.append((doc, *parser(bytes(data), kind)))
                except Exception:  # noqa: BLE001  one document's failure is no run's; its status says so
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "middle", "content"])

    return docs.select("doc_id", "kind", "data").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, middle string, content string")
