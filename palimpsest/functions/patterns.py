"""Regular-expression hits with exact code-point offsets, as Catalyst expressions.

Java patterns get (?U), so that classes such as \\d and \\w are Unicode's. Offsets come from the lengths of
what lies between hits (split) and of the hits themselves: regexp_instr would count UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Struct fields of a span.
SPAN = "struct<field_type:string,value:string,start:int,end:int,source:string,confidence:double>"


def unicode_pattern(pattern: str) -> str:
    return pattern if pattern.startswith("(?U)") else "(?U)" + pattern


def hits(text: Column, pattern: str) -> Column:
    """array<struct<value, start, end>> of all non-overlapping matches, in order; empty where there are none."""
    p = F.lit(unicode_pattern(pattern))
    pairs = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        lo = acc["at"] + F.length(pair["gap"])
        hi = lo + F.length(pair["hit"])
        found = F.concat(acc["found"], F.array(F.struct(pair["hit"].alias("value"), lo.alias("start"), hi.alias("end"))))
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(hi.alias("at"), found.alias("found")))

    # Texts without a match, nearly all of them, stop at the first look.
    return F.when(F.rlike(text, p), F.aggregate(pairs, start, step, lambda acc: acc["found"])).otherwise(empty)


def literal(value: Column) -> Column:
    """A pattern that matches a column's text as it stands."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, value: Column) -> Column:
    """array<struct<start, end>> of all non-overlapping occurrences of a literal value, left to right."""
    gaps = F.split(text, literal(value), -1)
    n = F.length(value)

    def step(acc: Column, gap: Column) -> Column:
        lo = acc["at"] + F.length(gap)
        return F.struct((lo + n).alias("at"), F.concat(acc["found"], F.array(F.struct(lo.alias("start"), (lo + n).alias("end")))).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    all_but_last = F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when((n > 0) & F.contains(text, value), F.aggregate(all_but_last, start, step, lambda acc: acc["found"])).otherwise(none)


def flatten_newlines(text: Column) -> Column:
    """Carriage returns and line feeds as one space each, so that offsets stay."""
    return F.translate(text, "\r\n", "  ")


def restore_newlines(text: Column, source: Column) -> Column:
    """The source text where it differs from text in line breaks alone."""
    return F.when(flatten_newlines(source) == text, source).otherwise(text)


def split_runs_of_spaces(text: Column) -> Column:
    """Two and more spaces as a line break, in texts that have no line break yet."""
    return F.when(F.contains(text, F.lit("\n")), text).otherwise(F.regexp_replace(text, " {2,}", "\n"))
