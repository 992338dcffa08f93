"""From overlapping spans to disjoint ones, and the masks in their place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import patterns
from palimpsest.operators.specs import DEFAULTS, OWN_RANK, Field, rank

MASKED = "struct<field_type:string,value:string,start:int,end:int,source:string,confidence:double,masked:string,out_start:int,out_end:int>"


def score(span: Column, fields: Iterable[Field] = DEFAULTS) -> Column:
    """Rank of the field, then the source, then the confidence; fields of one's own rank above those built in."""
    ranks = F.create_map(*(F.lit(x) for f in fields for x in (f.name, rank(f.name))))
    by_rules = F.when(span["source"] == "rules", 100).otherwise(0)
    return F.coalesce(ranks[span["field_type"]], F.lit(OWN_RANK)) * 1000.0 + by_rules + span["confidence"]


def resolve(spans: Column, fields: Iterable[Field] = DEFAULTS) -> Column:
    """Disjoint spans in order. Touching spans stay apart; contained ones go; partial overlaps become one span.

    The joined span takes the identity of the higher score, but a field whose mask shows part of the value gives
    way to one whose mask shows none. Among equal spans of a field the best score stays, and of equal scores the
    first: after the sort the others are contained in it.
    """
    fields = list(fields)
    hidden = F.create_map(*(F.lit(x) for f in fields for x in (f.name, bool(f.mask.template))))

    def hides(span: Column) -> Column:
        return F.coalesce(hidden[span["field_type"]], F.lit(False))

    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-score(s, fields)).alias("c"), i.alias("i"), s.alias("span")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["span"])
    none = F.lit(None).cast(patterns.SPAN)

    def grown(last: Column, s: Column) -> Column:
        first_wins = score(last, fields) >= score(s, fields)
        takes_last = F.when(first_wins, hides(last) | ~hides(s)).otherwise(hides(last) & ~hides(s))
        pick = lambda name: F.when(takes_last, last[name]).otherwise(s[name])
        tail = F.substring(s["value"], last["end"] - s["start"] + 1, s["end"] - last["end"])
        return F.struct(pick("field_type").alias("field_type"), F.concat(last["value"], tail).alias("value"), last["start"].alias("start"), s["end"].alias("end"), pick("source").alias("source"), pick("confidence").alias("confidence"))

    def step(acc: Column, s: Column) -> Column:
        last, done = acc["last"], acc["done"]
        apart = F.struct(F.concat(done, F.array(last)).alias("done"), s.alias("last"))
        joined = F.struct(done.alias("done"), grown(last, s).alias("last"))
        first = F.struct(done.alias("done"), s.alias("last"))
        return F.when(last.isNull(), first).when(s["start"] >= last["end"], apart).when(s["end"] <= last["end"], acc).otherwise(joined)

    start = F.struct(F.array().cast(f"array<{patterns.SPAN}>").alias("done"), none.alias("last"))
    folded = F.aggregate(ordered, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
    return F.when(F.size(spans) < 2, spans).otherwise(folded)


def mask(text: Column, spans: Column, fields: Iterable[Field] = DEFAULTS) -> Column:
    """Of disjoint spans in order: array<MASKED>, with the masks and where they are in the masked text."""
    fields = list(fields)

    def masked(s: Column) -> Column:
        out = F.lit("***")
        for f in fields:
            out = F.when(s["field_type"] == f.name, f.mask.expression(s["value"])).otherwise(out)
        return out

    with_masks = F.transform(spans, lambda s: s.withField("masked", masked(s)))
    start = F.struct(F.lit(0).alias("shift"), F.array().cast(f"array<{MASKED}>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        lo = s["start"] + acc["shift"]
        hi = lo + F.length(s["masked"])
        placed = s.withField("out_start", lo).withField("out_end", hi)
        return F.struct((hi - s["end"]).alias("shift"), F.concat(acc["out"], F.array(placed)).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(with_masks, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{MASKED}>"))


def splice(text: Column, spans: Column, by: str = "masked") -> Column:
    """The text with what stands in field `by` in place of each of the disjoint spans."""
    parts = F.transform(
        spans,
        lambda s, i: F.concat(
            F.substring(text, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1, s["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)),
            s[by],
        ),
    )
    tail = F.element_at(spans, -1)["end"]
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substring(text, tail + 1, F.length(text)))).otherwise(text)


def apply_replacements(text: Column, repls: Column) -> Column:
    """Splices struct<start, end, rep> as recorded: of equal ranges the last wins; one that ends before the place
    reached is skipped; one that begins before it still goes in and moves the place."""
    keyed = F.transform(repls, lambda r, i: F.struct(r["start"].alias("a"), r["end"].alias("b"), i.alias("i"), r["rep"].alias("rep")))
    ordered = F.array_sort(keyed)
    last = F.filter(ordered, lambda r, i: F.coalesce((F.get(ordered, i + 1)["a"] != r["a"]) | (F.get(ordered, i + 1)["b"] != r["b"]), F.lit(True)))

    def step(acc: Column, r: Column) -> Column:
        gap = F.when(r["a"] > acc["at"], F.substring(text, acc["at"] + 1, r["a"] - acc["at"])).otherwise("")
        moved = F.struct(F.concat(acc["parts"], F.array(gap, r["rep"])).alias("parts"), r["b"].alias("at"))
        return F.when(r["b"] <= acc["at"], acc).otherwise(moved)

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    return F.aggregate(last, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitize(df: DataFrame, text_col: str = "text", fields: Iterable[Field] | None = None, **options) -> DataFrame:
    """df with `spans` (array<MASKED>, disjoint) and `masked_text`: no shuffle, and no Python for regular-expression fields."""
    from palimpsest.operators.detect import detect
    from palimpsest.operators.specs import select

    fields = select(DEFAULTS) if fields is None else list(fields)
    found = detect(df, text_col, fields, **options)
    text = F.col(text_col)
    found = found.withColumn("spans", resolve(F.col("spans"), fields)).withColumn("spans", mask(text, F.col("spans"), fields))
    return found.withColumn("masked_text", splice(text, F.col("spans")))


def masked_only(df: DataFrame, col: str = "spans") -> DataFrame:
    """The rows with a span. A filter would be pushed below the projection that makes the spans and make them once more
    for itself; a generator of one row or none is not."""
    return df.withColumn(col, F.explode(F.filter(F.array(col), lambda s: F.size(s) > 0)))


def best_of_equal(rows: DataFrame, key: list[str], score_col: str, order_col: str) -> DataFrame:
    """The row form of the first step: of rows that share the key, the best score, and of equal scores the first."""
    w = Window.partitionBy(*key).orderBy(F.desc(score_col), order_col)
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def islands(rows: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The row form of the extents: overlapping spans of a group as one, touching ones apart."""
    w = Window.partitionBy(*group).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("reach", F.max(end).over(w)).withColumn("new", F.when(F.col("reach").isNull() | (F.col("reach") <= F.col(start)), 1).otherwise(0))
    island = F.sum("new").over(Window.partitionBy(*group).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("island", island).groupBy(*group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


def outermost(rows: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans that no other of their group contains (of equal ones, one)."""
    w = Window.partitionBy(*group).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(w)
    return rows.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col(end) > F.col("reach"))).drop("reach")
