"""Which known values are still in texts, exactly.

Up to FEW values (counted first) are one automaton that every task holds. More go by an equi-join on rare marks. The
marks of a text are, of each window of as many characters as its class says, the gram with the least hash: a text
that holds a value has all windows of the value, so it has all its marks too, and these are few of its grams. A value is of
the class with the longest window that it fills, and is posted under the one of its marks that the fewest texts have;
texts meet values by their marks, and the value is then looked for in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values, and their characters together, up to which they go to the driver and from there to every task.
FEW, FEW_CHARS = 5_000, 250_000
#: Classes of values: the characters of a window, and of its grams.
GRAM = {64: 8, 32: 8, 16: 8, 8: 4, 4: 4, 2: 2, 1: 1}
#: Rows of a batch of marks.
ROWS = 100_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose order says nothing of the text's."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def marks(text: str, window: int) -> np.ndarray:
    """The distinct least hashes of the grams of all windows of a text; none of a text that fills no window."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(h) < window:
        return np.empty(0, np.int64)
    h, n = _mixed(h + np.uint64(1)), 1
    while n < GRAM[window]:
        h, n = _mixed(h[:-n] * np.uint64(0xD6E8FEB86659FD93) + h[n:]), 2 * n
    grams, n = window - GRAM[window] + 1, 1
    while n < grams:
        step = min(n, grams - n)
        h, n = np.minimum(h[:-step], h[step:]), n + step
    # Windows side by side nearly always share theirs.
    return np.unique(h[np.flatnonzero(np.append(True, h[1:] != h[:-1]))]).view(np.int64)


def _marked(df: DataFrame, key: str, text: str, windows: list[int], own: bool) -> DataFrame:
    """key, window, mark of every row, for all of the windows or (own) for that of its class."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(source, at, found):
            sizes = [len(m) for _, m in found]
            wide = np.repeat(np.array([w for w, _ in found], np.int32), sizes)
            return pa.RecordBatch.from_arrays([source.column(0).take(pa.array(np.repeat(at, sizes))), pa.array(wide), pa.array(np.concatenate([m for _, m in found]))], [key, "window", "mark"])

        for batch in batches:
            at, found, n = [], [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                for w in (() if not t else [next(w for w in GRAM if w <= len(t))] if own else windows):
                    if len(m := marks(t, w)):
                        at.append(i)
                        found.append((w, m))
                        n += len(m)
                if n >= ROWS:
                    yield batch_of(batch, at, found)
                    at, found, n = [], [], 0
            if found:
                yield batch_of(batch, at, found)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, window int, mark long")


def by_grams(texts: DataFrame, values: DataFrame, id_col: str, text_col: str) -> DataFrame:
    known = values.select("value").filter("length(value) > 0").distinct().withColumn("name", F.unhex(F.sha2(F.col("value"), 256)))
    fills = F.coalesce(*(F.when(F.length("value") >= w, w) for w in GRAM))
    # As many rows as there are classes.
    windows = sorted(r["w"] for r in known.select(fills.alias("w")).distinct().collect())
    marks = _marked(known, "name", "value", windows, own=True)
    held = _marked(texts, id_col, text_col, windows, own=False).join(marks.select("window", "mark").distinct(), ["window", "mark"], "left_semi")
    often = held.groupBy("window", "mark").agg(F.count(F.lit(1)).alias("n"))
    rarest = marks.join(often, ["window", "mark"]).groupBy("name").agg(F.min(F.struct("n", "mark", "window")).alias("m"))
    posted = rarest.select("name", F.col("m.mark").alias("mark"), F.col("m.window").alias("window"))
    pairs = held.join(posted, ["window", "mark"]).select(id_col, "name").distinct().join(known, "name").drop("name")
    return texts.select(id_col, text_col).join(pairs, id_col).withColumn("at", F.expr(f"locate(value, `{text_col}`)") - 1).filter("at >= 0").select(id_col, "value", "at")


def by_automaton(texts: DataFrame, values: list[str], id_col: str, text_col: str) -> DataFrame:
    import ahocorasick

    rows = texts.select(id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for v in values:
            automaton.add_word(v, v)
        automaton.make_automaton()
        for pdf in frames:
            out = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                first: dict[str, int] = {}
                for end, v in automaton.iter(text or ""):
                    first.setdefault(v, end + 1 - len(v))
                out += [(key, v, at) for v, at in first.items()]
            yield pd.DataFrame(out, columns=[id_col, "value", "at"])

    return rows.mapInPandas(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, value string, at int")


def contained(texts: DataFrame, values: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, value, at (first place, from 0) for every text that holds a value; values: a column `value`."""
    known = values.select("value").filter("length(value) > 0").distinct()
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("chars")).first()
    if 0 < size["n"] <= FEW and size["chars"] <= FEW_CHARS:
        return by_automaton(texts, [r["value"] for r in known.collect()], id_col, text_col)
    return by_grams(texts, known, id_col, text_col)


def leftovers(units: DataFrame, values: DataFrame, group: str = "doc_id") -> DataFrame:
    """Values that are still in redacted units (group, place, text): the first place of each by group."""
    keyed = units.select(F.to_json(F.struct(F.col(group).alias("g"), F.col("place").alias("p"))).alias("unit"), "text")
    unit = F.from_json("unit", f"g {units.schema[group].dataType.simpleString()}, p {units.schema['place'].dataType.simpleString()}")
    found = contained(keyed, values, "unit", "text").withColumn("u", unit)
    return found.groupBy(F.col("u.g").alias(group), "value").agg(F.min("u.p").alias("place"), F.count(F.lit(1)).alias("n"))
