"""Workbooks (.xlsx) as cell rows, and back with masked cells; from the zip and its XML alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Consecutive rows without a value after which a sheet ends.
EMPTY_RUN = 200
#: Number formats of dates that need no entry of their own.
DATE_FORMATS = {14: "d", 15: "d", 16: "d", 17: "d", 18: "h", 19: "h", 20: "h", 21: "h", 22: "dh", 45: "h", 46: "h", 47: "h"}
CELL = "sheet string, sheet_idx int, row int, col int, text string, kind string"
_q = lambda tag: f"{{{MAIN}}}{tag}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _joined(node) -> str:
    return "".join(t.text or "" for t in node.iter(_q("t")))


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = []
        for s in book.iter(_q("sheet")):
            target = rels[s.get(f"{{{RELS}}}id")].lstrip("/")
            self.sheets.append((s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
        self.strings = [_joined(si) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(_q("si"))] if "xl/sharedStrings.xml" in names else []
        self.formats: list[str] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(_q("numFmt"))}
            for xf in (styles.find(_q("cellXfs")) if styles.find(_q("cellXfs")) is not None else ()):
                k = int(xf.get("numFmtId") or 0)
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, ""))
                self.formats.append(("d" if re.search("[yd]", code, re.I) else "") + ("h" if re.search("[hHsS]", code) else "") if k in own else DATE_FORMATS.get(k, ""))

    def value(self, c) -> tuple[str, str] | None:
        """Text and kind of a cell: its value, or its formula where no value is kept."""
        v, f, kind = c.find(_q("v")), c.find(_q("f")), c.get("t", "n")
        if kind == "inlineStr":
            return _joined(c), "str"
        if v is None or v.text is None:
            return ("=" + (f.text or ""), "formula") if f is not None else None
        if kind == "s":
            return self.strings[int(v.text)], "str"
        if kind in ("str", "e"):
            return v.text, "str"
        if kind == "b":
            return ("TRUE" if v.text == "1" else "FALSE"), "bool"
        number = float(v.text)
        style = self.formats[int(c.get("s"))] if c.get("s") and int(c.get("s")) < len(self.formats) else ""
        if "d" in style:
            when = datetime(1899, 12, 30) + timedelta(days=number)
            return (when.strftime("%Y-%m-%d %H:%M:%S"), "datetime") if "h" in style else (when.strftime("%Y-%m-%d"), "date")
        if style == "h" and number < 1:
            return (datetime(1899, 12, 30) + timedelta(days=number)).strftime("%H:%M:%S"), "time"
        return (str(int(number)), "int") if number.is_integer() else (repr(number), "float")

    def cells(self) -> Iterator[tuple[str, int, int, int, str, str]]:
        for k, (name, path) in enumerate(self.sheets):
            last = 0
            for row in ET.fromstring(self.zip.read(path)).iter(_q("row")):
                number = int(row.get("r") or last + 1)
                if number - last > EMPTY_RUN:
                    break
                found = [(c, x) for c in row.iter(_q("c")) if (x := self.value(c)) is not None]
                for c, (text, kind) in found:
                    yield name, k, number, _column(c.get("r")), text.replace("\r", " ").replace("\n", " "), kind
                last = number if found else last

    def rewritten(self, edits: dict[tuple[int, int, int], str], values: list[str]) -> bytes:
        """The workbook with these texts in its cells (by sheet, row, column), and the values gone elsewhere.

        Comments, formulas and shared strings lose the values, longest first; sheet names that hold one are
        blanked; chart caches and descriptive properties are emptied; results are computed anew on opening.
        """
        values = sorted({v for v in values if v}, key=len, reverse=True)
        paths = {p: k for k, (_, p) in enumerate(self.sheets)}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.zip.infolist():
                data = self.zip.read(info.filename)
                name = info.filename
                if name in paths:
                    data = self._sheet(data, {k[1:]: t for k, t in edits.items() if k[0] == paths[name]}, values)
                elif name == "xl/workbook.xml":
                    data = self._book(data, values)
                elif name.startswith("docProps/") and name.endswith(".xml"):
                    data = re.sub(rb"(<(?:\w+:)?(?:title|subject|description|keywords|category|creator|lastModifiedBy)\b[^>]*>)[^<]*(</)", rb"\1\2", data)
                elif name.startswith("xl/charts/") and name.endswith(".xml"):
                    data = re.sub(rb"<c:(num|str)Cache>.*?</c:\1Cache>", b"", data, flags=re.S)
                elif name.endswith(".xml") and name.startswith("xl/") and "style" not in name:
                    data = self._without(data, values)
                z.writestr(info, data)
        return out.getvalue()

    def raw_texts(self) -> Iterator[tuple[int, int, int, str]]:
        """Sheet, row, column and text, line breaks and all, of cells that hold text."""
        for k, (_, path) in enumerate(self.sheets):
            for row in ET.fromstring(self.zip.read(path)).iter(_q("row")):
                for c in row.iter(_q("c")):
                    if (x := self.value(c)) is not None and x[1] == "str":
                        yield k, int(row.get("r")), _column(c.get("r")), x[0]

    def with_values(self, values: dict[tuple[int, int, int], tuple[str, str]]) -> bytes:
        """The workbook with these values (text and kind) in its cells, all else as it is."""
        paths, out = {p: k for k, (_, p) in enumerate(self.sheets)}, io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.zip.infolist():
                data = self.zip.read(info.filename)
                if info.filename in paths:
                    root = ET.fromstring(data)
                    for row in root.iter(_q("row")):
                        for c in row.iter(_q("c")):
                            if (v := values.get((paths[info.filename], int(row.get("r")), _column(c.get("r"))))) is not None:
                                self._set(c, *v)
                    data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
                z.writestr(info, data)
        return out.getvalue()

    @staticmethod
    def _set(c, text: str, kind: str = "str") -> None:
        """Puts a value into a cell, as what it was where that can be read."""
        for child in list(c):
            c.remove(child)
        c.attrib.pop("t", None)
        try:
            match kind:
                case "int" | "float":
                    number = repr(float(text)) if kind == "float" else str(int(text))
                case "bool":
                    c.set("t", "b")
                    number = "1" if text == "TRUE" else "0"
                case "date" | "datetime":
                    since = datetime.fromisoformat(text) - datetime(1899, 12, 30)
                    number = repr(since.total_seconds() / 86400)
                case "time":
                    h, m, s = map(int, text.split(":"))
                    number = repr((h * 3600 + m * 60 + s) / 86400)
                case _:
                    raise ValueError(kind)
            ET.SubElement(c, _q("v")).text = number
        except ValueError:
            c.set("t", "inlineStr")
            t = ET.SubElement(ET.SubElement(c, _q("is")), _q("t"))
            t.text = text
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")

    @staticmethod
    def _without(data: bytes, values: list[str]) -> bytes:
        root = ET.fromstring(data)
        for node in root.iter():
            for v in values:
                if node.text and v in node.text:
                    node.text = node.text.replace(v, "***")
        return ET.tostring(root, encoding="utf-8", xml_declaration=True)

    @staticmethod
    def _book(data: bytes, values: list[str]) -> bytes:
        root, used = ET.fromstring(data), set()
        for s in root.iter(_q("sheet")):
            name = s.get("name")
            for v in values:
                name = name.replace(v, "□□□")
            base, n = name[:31], 1
            while name[:31] in used:
                n += 1
                name = f"{base[: 31 - len(str(n))]}{n}"
            used.add(name[:31])
            s.set("name", name[:31])
        calc = root.find(_q("calcPr"))
        calc = ET.SubElement(root, _q("calcPr")) if calc is None else calc
        calc.set("fullCalcOnLoad", "1")
        return ET.tostring(root, encoding="utf-8", xml_declaration=True)

    @staticmethod
    def _sheet(data: bytes, edits: dict[tuple[int, int], str], values: list[str]) -> bytes:
        root, last = ET.fromstring(data), 0
        for row in root.iter(_q("row")):
            last = int(row.get("r") or last + 1)
            for c in row.iter(_q("c")):
                f = c.find(_q("f"))
                if f is not None and f.text:
                    for v in values:
                        f.text = f.text.replace(v, "***")
                if (text := edits.get((last, _column(c.get("r"))))) is not None:
                    Workbook._set(c, text)
        return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def cells(files: DataFrame, id_col: str = "path", data_col: str = "content") -> DataFrame:
    """doc_id, sheet, sheet_idx, row, col, text, kind, error of every cell with a value, of hidden sheets too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows: list[tuple] = []
            for doc, data in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows += [(doc, *c, None) for c in Workbook(bytes(data)).cells()]
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows.append((doc, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["doc_id", "sheet", "sheet_idx", "row", "col", "text", "kind", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(F.col(id_col).alias("doc_id"), F.col(data_col).alias("content")).mapInPandas(run, f"doc_id {kind}, {CELL}, error string")


def table_text(found: DataFrame) -> DataFrame:
    """cells with start and end in the sheet's Markdown table (a line to a row, a rule after the first)."""
    by_row = Window.partitionBy("doc_id", "sheet_idx", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    in_row = F.lit(2) + F.coalesce(F.sum(F.length("text") + 3).over(by_row), F.lit(0))
    rows = found.groupBy("doc_id", "sheet_idx", "row").agg((F.sum(F.length("text") + 3) + 2).alias("size"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("doc_id", "sheet_idx").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rule = F.when(F.row_number().over(Window.partitionBy("doc_id", "sheet_idx").orderBy("row")) > 1, F.first("n").over(above) * 6 + 2).otherwise(0)
    rows = rows.withColumn("above", F.coalesce(F.sum("size").over(above), F.lit(0)) + rule).select("doc_id", "sheet_idx", "row", "above")
    placed = found.withColumn("in_row", in_row).join(rows, ["doc_id", "sheet_idx", "row"])
    start = (F.col("above") + F.col("in_row")).cast("int")
    return placed.withColumn("start", start).withColumn("end", start + F.length("text")).drop("in_row", "above")


def redact(files: DataFrame, edits: DataFrame, values: DataFrame, id_col: str = "path", data_col: str = "content") -> DataFrame:
    """doc_id, content. edits: doc_id, sheet_idx, row, col, masked_text; values: doc_id, value (what must be gone)."""
    changes = edits.groupBy("doc_id").agg(F.collect_list(F.struct("sheet_idx", "row", "col", "masked_text")).alias("edits"))
    gone = values.groupBy("doc_id").agg(F.collect_set("value").alias("gone"))
    both = files.select(F.col(id_col).alias("doc_id"), F.col(data_col).alias("content")).join(changes, "doc_id", "left").join(gone, "doc_id", "left")
    kind = files.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for data, todo, names in zip(pdf["content"], pdf["edits"], pdf["gone"]):
                edits = {(e["sheet_idx"], e["row"], e["col"]): e["masked_text"] for e in (todo if todo is not None else [])}
                out.append(Workbook(bytes(data)).rewritten(edits, list(names) if names is not None else []))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": out})

    return both.mapInPandas(run, f"doc_id {kind}, content binary")


def recover(files: DataFrame, spans: DataFrame, key: bytes | Column, sources: DataFrame | None = None) -> DataFrame:
    """doc_id, content, restored, unresolved. files: doc_id, content as masked; spans: doc_id, sheet_idx, row, col, kind,
    masked_value, masked_start, masked_end, encrypted_value.

    All masks of a cell come back, or none; a number, boolean or date that was masked whole is one again; with sources
    (doc_id, content), a text that equals its source but for line breaks takes these.
    """
    from palimpsest.functions import crypto

    one = F.struct("sheet_idx", "row", "col", "kind", "masked_value", F.col("masked_start").alias("start"), F.col("masked_end").alias("end"), crypto.opened(F.col("encrypted_value"), key).alias("value"))
    both = files.select("doc_id", "content").join(spans.groupBy("doc_id").agg(F.collect_list(one).alias("told")), "doc_id", "left")
    origin = sources.select("doc_id", F.col("content").alias("source")) if sources is not None else None
    both = both.join(origin, "doc_id", "left") if origin is not None else both.withColumn("source", F.lit(None).cast("binary"))
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, data, told, source in zip(pdf["doc_id"], pdf["content"], pdf["told"], pdf["source"]):
                told = [] if told is None else list(told)
                content, n = _restored(bytes(data), told, bytes(source) if source is not None else None)
                rows.append((doc, content, n, len(told) - n))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "restored", "unresolved"])

    return both.mapInPandas(run, f"doc_id {kind}, content binary, restored int, unresolved int")


def _restored(data: bytes, told: list, source: bytes | None) -> tuple[bytes, int]:
    from palimpsest.sources.jsonleaves import splice

    book = Workbook(data)
    now = {(k, r, c): t for _, k, r, c, t, _ in book.cells()}
    raw = {(k, r, c): t for k, r, c, t in Workbook(source).raw_texts()} if source else {}
    cells: dict[tuple, list] = {}
    for s in told:
        if s["value"] is not None:
            cells.setdefault((s["sheet_idx"], s["row"], s["col"]), []).append(s)
    values, done = {}, 0
    for at, parts in cells.items():
        text = now.get(at, "")
        if any(text[p["start"] : p["end"]] != p["masked_value"] for p in parts):
            continue
        text = splice(text, [{"start": p["start"], "end": p["end"], "masked": p["value"]} for p in parts])
        whole = len(parts) == 1 and text == parts[0]["value"]
        if at in raw and raw[at].replace("\r", " ").replace("\n", " ") == text:
            text = raw[at]
        values[at] = (text, parts[0]["kind"] if whole else "str")
        done += len(parts)
    return book.with_values(values), done
