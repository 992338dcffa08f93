"""JSON documents as leaf rows, and back with masked leaves in place.

JSON stays text until a row of it is walked: no schema is inferred, keys keep their order, and of repeated
keys the last counts. A leaf's text is what detectors see: line breaks as spaces, whole numbers without a
fraction, true and false; null and containers have none. Its path keeps keys and indices apart.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH = "array<struct<key:string,idx:int>>"
LEAF = f"page int, leaf_no int, path {PATH}, text string, kind string"
#: Whole floats below this print as integers.
WHOLE = 1e16


def rendered(value: Any) -> tuple[str, str] | None:
    match value:
        case bool():
            return str(value).lower(), "bool"
        case str():
            return (value.translate({10: " ", 13: " "}), "str") if value else None
        case int():
            return str(value), "int"
        case float():
            whole = value.is_integer() and abs(value) < WHOLE
            return (str(int(value)), "int") if whole else (str(value), "float")
    return None


def walk(node: Any, path: tuple = ()) -> Iterator[tuple[tuple, str, str]]:
    """(path, text, kind) of the leaves, in document order, without recursion."""
    stack = [(path, node)]
    while stack:
        at, value = stack.pop()
        if isinstance(value, dict):
            stack += [((*at, k), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [((*at, k), v) for k, v in reversed([*enumerate(value)])]
        elif (leaf := rendered(value)) is not None:
            yield at, *leaf


ELEMENT = "page int, many boolean, json string, indent string, ending string, error string"
COLUMNS = ["page", "many", "json", "indent", "ending", "error"]
ELEMENT_ARROW = dict(zip(COLUMNS, (pa.int32(), pa.bool_(), *[pa.string()] * 4)))
LEAF_ARROW = {"page": pa.int32(), "leaf_no": pa.int32(), "path": pa.list_(pa.struct({"key": pa.string(), "idx": pa.int32()})), "text": pa.string(), "kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "error": pa.string()}
#: Rows of a batch on its way out of Python, and their characters: a batch has rows of many documents, and a document's may be in many.
ROWS, CHARS = 4_000, 4_000_000
BOM = "﻿"
BLANK = re.compile(r"[ \t\n\r]*")


def _split(raw: str) -> tuple[list[str] | None, Any]:
    """The texts of a top-level array's elements; None and the value for other roots and for an array without any. ValueError: no JSON."""
    decode, text = json.JSONDecoder().raw_decode, raw.removeprefix(BOM)
    at = BLANK.match(text).end()
    if not text.startswith("[", at):
        return None, json.loads(text)
    out: list[str] = []
    at = BLANK.match(text, at + 1).end()
    while not text.startswith("]", at):
        _, end = decode(text, at)
        out.append(text[at:end])
        at = BLANK.match(text, end).end()
        if text.startswith(",", at):
            at = BLANK.match(text, at + 1).end()
            if text.startswith("]", at):
                raise ValueError(f"no element after a comma: char {at}")
        elif not text.startswith("]", at):
            raise ValueError(f"no comma between elements: char {at}")
    if (at := BLANK.match(text, at + 1).end()) < len(text):
        raise ValueError(f"text after the end: char {at}")
    return (out, None) if out else (None, [])


def elements(df: DataFrame, id_col: str = "doc_id", json_col: str = "json", parts: int | None = None) -> DataFrame:
    """doc_id and ELEMENT: a row for each element of a top-level array (page from 1, many), and one for any other root.

    So a file that is one huge array is many rows. With `parts` they are dealt into that many partitions: what comes
    after the split is then work for all. Text that is no JSON gives one row with the error.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, chars = [], [], 0
            for n, raw in enumerate(batch.column(1).to_pylist()):
                for row in _elements(raw) if raw is not None else ():
                    at.append(n)
                    rows.append(row)
                    chars += len(row[2])
                    if len(rows) == ROWS or chars >= CHARS:
                        yield _batch(batch, at, ELEMENT_ARROW, zip(*rows))
                        at, rows, chars = [], [], 0
            if rows:
                yield _batch(batch, at, ELEMENT_ARROW, zip(*rows))

    out = df.select(F.col(id_col).alias("doc_id"), F.col(json_col).alias("json")).mapInArrow(run, f"doc_id {kind}, {ELEMENT}")
    return out.repartition(parts) if parts else out


def _elements(raw: str) -> list[tuple]:
    """The values of ELEMENT of a text's elements."""
    look = style(raw.removeprefix(BOM))
    try:
        found, _ = _split(raw)
    except (ValueError, RecursionError) as e:
        return [(None, False, raw, *look, str(e)[:200])]
    return [(1, False, raw, *look, None)] if found is None else [(k, True, x, *look, None) for k, x in enumerate(found, 1)]


def _batch(source: pa.RecordBatch, at: list[int], columns: dict[str, pa.DataType], values: Iterable) -> pa.RecordBatch:
    """Rows of many documents in one batch: the doc_id of the source's rows `at`, and the columns' values or arrays."""
    made = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(values, columns.values())]
    return pa.RecordBatch.from_arrays([source.column(0).take(pa.array(at, pa.int64())), *made], ["doc_id", *columns])


def assembled(parts: DataFrame, *sums: str) -> DataFrame:
    """doc_id, json of documents from their elements' texts (doc_id and ELEMENT), with the sums of further columns."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "json"))), lambda p: p["json"])
    whole = parts.groupBy("doc_id").agg(texts.alias("t"), *(F.max(c).alias(c) for c in ("many", "indent", "ending")), *(F.sum(c).cast("int").alias(c) for c in sums))
    lines = F.concat(F.lit("[\n"), "indent", F.array_join("t", ",\n\0"), F.lit("\n]"))
    laid = F.when(F.col("indent").isNull(), F.concat(F.lit("["), F.array_join("t", ", "), F.lit("]"))).otherwise(F.replace(lines, F.lit("\0"), F.col("indent")))
    one = F.get("t", F.lit(0))
    return whole.select("doc_id", F.when(F.col("many"), F.concat(laid, "ending")).otherwise(one).alias("json"), *sums)


def _element_dump(data: Any, raw: str, many: bool, indent: str | None) -> str:
    """An element as it stands in its array; any other root with its own final line break."""
    if not many:
        return _dump(data, raw)
    text = json.dumps(data, ensure_ascii=False, indent=indent)
    return text.replace("\n", "\n" + indent) if indent else text


def leaves(df: DataFrame, id_col: str = "doc_id", json_col: str = "json", parts: int | None = None) -> DataFrame:
    """doc_id, page, leaf_no, path, text, kind, start, end, error of every leaf.

    Each element of a top-level array is a page of its own (numbered from 1, also past elements without leaves);
    any other root is page 1. Offsets are those in the page's text, its leaves one to a line. Text that is no JSON
    gives one row with the error and nothing else. parts: see elements().
    """
    kind = df.schema[id_col].dataType.simpleString()
    # Dealt elements are rows of their own; else a text is taken apart and walked in one go.
    found = elements(df, id_col, json_col, parts) if parts else df.select(F.col(id_col).alias("doc_id"), F.col(json_col).alias("json")).filter("json is not null")

    def roots(batch: pa.RecordBatch) -> Iterator[tuple]:
        if parts:
            for i, (page, many, raw, error) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "many", "json", "error")))):
                yield i, page, many, None if error is not None else json.loads(raw.removeprefix(BOM)), error
            return
        for i, raw in enumerate(batch.column("json").to_pylist()):
            try:
                texts, data = _split(raw)
            except (ValueError, RecursionError) as e:
                yield i, None, False, None, str(e)[:200]
                continue
            if texts is None:
                yield i, 1, False, data, None
            else:
                for page, text in enumerate(texts, 1):
                    yield i, page, True, json.loads(text), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Leaves(batch)
            for i, page, many, data, error in roots(batch):
                if error is not None:
                    out.add(i, None, None, None, None, None, None, None, error)
                    continue
                at = 0
                for n, (p, text, k) in enumerate(walk(data, (page - 1,) if many else ())):
                    out.add(i, page, n, p, text, k, at, at + len(text), None)
                    at += len(text) + 1
                    if out.full():
                        yield out.batch()
            if out.rows:
                yield out.batch()

    return found.mapInArrow(run, f"doc_id {kind}, {LEAF}, start int, `end` int, error string")


class _Leaves:
    """Rows of leaves() on their way into batches."""

    def __init__(self, source: pa.RecordBatch):
        self.source = source
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.chars, self.steps = 0, 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += len(row[4] or "")
        self.steps += len(row[3] or ())

    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.chars >= CHARS or self.steps >= 16 * ROWS

    def batch(self) -> pa.RecordBatch:
        at, page, n, paths, *rest = zip(*self.rows)
        out = _batch(self.source, at, LEAF_ARROW, [page, n, _paths(paths), *rest])
        self.clear()
        return out


def _paths(paths: Iterable[tuple | None]) -> pa.Array:
    """Paths as PATH, without an object for each step."""
    keys: list[str | None] = []
    places: list[int | None] = []
    ends: list[int | None] = []
    for path in paths:
        ends.append(None if path is None else len(keys))
        for p in path or ():
            is_key = isinstance(p, str)
            keys.append(p if is_key else None)
            places.append(None if is_key else p)
    ends.append(len(keys))
    steps = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32())], ["key", "idx"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)


def units(df: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """doc_id, place, text of every leaf and every key, to look for values that must be gone."""
    found = leaves(df, id_col, json_col).filter("error is null")
    named = found.select("doc_id", path_text(F.col("path")).alias("place"), "text", F.explode("path.key").alias("key"))
    keys = named.filter("key is not null").groupBy("doc_id", F.col("key").alias("text")).agg(F.min("place").alias("place"))
    return found.select("doc_id", path_text(F.col("path")).alias("place"), "text").unionByName(keys.select("doc_id", "place", "text"))


def path_text(path: Column) -> Column:
    """$.users[3].phone"""
    return F.aggregate(path, F.lit("$"), lambda acc, p: F.concat(acc, F.when(p["idx"].isNull(), F.concat(F.lit("."), p["key"])).otherwise(F.concat(F.lit("["), p["idx"].cast("string"), F.lit("]")))))


def style(raw: str) -> tuple[str | None, str]:
    """Indent and final line break of a JSON text, by its head."""
    second = re.match(r"[^\n]*\n([ \t]+)", raw)
    return second[1] if second else None, "\n" if raw.endswith("\n") else ""


def _dump(data: Any, like: str) -> str:
    indent, end = style(like.removeprefix(BOM))
    return json.dumps(data, ensure_ascii=False, indent=indent) + end


def _put(data: Any, path: list, change) -> Any:
    """Replaces what is at the path by change(it); the root where the path is empty."""
    if not path:
        return change(data)
    node = data
    for step in path[:-1]:
        node = node[step]
    node[path[-1]] = change(node[path[-1]])
    return data


def _plain(path) -> list:
    return [p["key"] if p["idx"] is None else p["idx"] for p in path]


def splice(text: str, parts: list) -> str:
    out, at = [], 0
    for p in sorted(parts, key=lambda p: p["start"]):
        if p["start"] >= at:
            out += [text[at : p["start"]], p["masked"]]
            at = p["end"]
    return "".join([*out, text[at:]])


def redact(df: DataFrame, edits: DataFrame, id_col: str = "doc_id", json_col: str = "json", parts: int | None = None) -> DataFrame:
    """doc_id, json with masks in place. edits: doc_id, page, path, spans (leaf-relative, with start, end, masked).

    Masks go into the leaf as it was where its flat form is what detectors saw, so its line breaks stay, and into
    its rendering otherwise; numbers and booleans become text. The source's indent and final line break stay. Nothing
    of a text that can't be read leaves: its json is null.
    """
    kind = df.schema[id_col].dataType.simpleString()
    slim = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["masked"].alias("masked")))
    grouped = edits.groupBy("doc_id", "page").agg(F.collect_list(F.struct("path", slim.alias("spans"))).alias("edits"))
    both = elements(df, id_col, json_col, parts).join(grouped, ["doc_id", "page"], "left").select("doc_id", *COLUMNS, "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for many, raw, indent, error, changes in zip(*(batch.column(c).to_pylist() for c in ("many", "json", "indent", "error", "edits"))):
                if error is not None:
                    out.append(None)
                    continue
                data = json.loads(raw.removeprefix(BOM))
                for e in changes or []:
                    spans = e["spans"]
                    data = _put(data, _plain(e["path"])[int(many) :], lambda v: splice(v if isinstance(v, str) else rendered(v)[0], spans))
                out.append(_element_dump(data, raw, many, indent))
            yield _changed(batch, out)

    return assembled(both.mapInArrow(run, f"doc_id {kind}, {ELEMENT}"))


def _changed(batch: pa.RecordBatch, texts: list[str | None], **more: pa.Array) -> pa.RecordBatch:
    """doc_id and ELEMENT of a batch with other texts, and further columns."""
    made = {c: batch.column(c) for c in ("doc_id", *COLUMNS)} | {"json": pa.array(texts, pa.string())} | more
    return pa.RecordBatch.from_arrays([*made.values()], [*made])


def _back(data: Any, told: list, source: Any, skip: int) -> tuple[Any, int]:
    """An element with its values back, all of a leaf or none, and how many came back."""
    leaves: dict[str, list] = {}
    for s in told:
        if s["value"] is not None:
            leaves.setdefault(json.dumps(_plain(s["path"])[skip:]), []).append(s)
    done = 0
    for at, parts in leaves.items():
        path = json.loads(at)
        try:
            node = data
            for step in path:
                node = node[step]
        except (KeyError, IndexError, TypeError):
            continue
        if not isinstance(node, str) or any(node[p["start"] : p["end"]] != p["masked_value"] for p in parts):
            continue
        text = splice(node, [{"start": p["start"], "end": p["end"], "masked": p["value"]} for p in parts])
        value: Any = text
        if source is not None:
            try:
                raw = source
                for step in path:
                    raw = raw[step]
                value = raw if isinstance(raw, str) and rendered(raw) == (text, "str") else text
            except (KeyError, IndexError, TypeError):
                pass
        if len(parts) == 1 and text == parts[0]["value"]:
            try:
                value = {"int": int, "float": float, "bool": lambda t: t == "true"}.get(parts[0]["kind"], lambda t: value)(text)
            except ValueError:
                pass
        data = _put(data, path, lambda _: value)
        done += len(parts)
    return data, done


def recover(df: DataFrame, spans: DataFrame, key: bytes | Column, sources: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """doc_id, json, restored, unresolved. df: doc_id, json as masked; spans: edit_spans() of the audit.

    All masks of a leaf come back, or none. A number or boolean that was masked whole is one again. With sources
    (doc_id, json), a leaf that equals its source but for line breaks takes these.
    """
    from palimpsest.functions import crypto

    one = F.struct("path", F.col("masked_start").alias("start"), F.col("masked_end").alias("end"), "masked_value", "kind", crypto.opened(F.col("encrypted_value"), key).alias("value"))
    # An element of a top-level array has its number first in its leaves' paths; of other roots, page 1 has them all.
    page = F.coalesce(F.get("path", F.lit(0))["idx"] + 1, F.lit(1)).alias("page")
    told = spans.groupBy("doc_id", page).agg(F.collect_list(one).alias("told"))
    counts = spans.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("all"))
    both = elements(df, parts=parts).join(told, ["doc_id", "page"], "left")
    if sources is not None:
        both = both.join(elements(sources).select("doc_id", "page", F.col("json").alias("source"), F.col("many").alias("same")), ["doc_id", "page"], "left")
    else:
        both = both.withColumn("source", F.lit(None).cast("string")).withColumn("same", F.lit(None).cast("boolean"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, restored = [], []
            for many, raw, indent, error, told, src, same in zip(*(batch.column(c).to_pylist() for c in ("many", "json", "indent", "error", "told", "source", "same"))):
                if error is not None or not told:
                    data, n = (None if error is not None else json.loads(raw.removeprefix(BOM))), 0
                else:
                    data, n = _back(json.loads(raw.removeprefix(BOM)), told, json.loads(src) if src and same == many else None, int(many))
                out.append(raw if error is not None else _element_dump(data, raw, many, indent))
                restored.append(n)
            yield _changed(batch, out, restored=pa.array(restored, pa.int32()))

    whole = assembled(both.select("doc_id", *COLUMNS, "told", "source", "same").mapInArrow(run, f"doc_id {kind}, {ELEMENT}, restored int"), "restored")
    return whole.join(counts, "doc_id", "left").select("doc_id", "json", "restored", (F.coalesce("all", F.lit(0)) - F.col("restored")).alias("unresolved"))


def edit_spans(edits: DataFrame, key: bytes) -> DataFrame:
    """The audit's rows of masked leaves: path, kind, place in the masked leaf, and the value's token."""
    from palimpsest.functions import crypto

    s = edits.select("doc_id", "page", "path", "kind", F.explode("spans").alias("s"))
    return s.select("doc_id", "page", "path", "kind", F.col("s.field_type").alias("field_type"), F.col("s.masked").alias("masked_value"), F.col("s.out_start").alias("masked_start"), F.col("s.out_end").alias("masked_end"), crypto.token(F.col("s.value"), key).alias("encrypted_value"))
