"""Recovery: values back in the place of their masks, from an audit's tokens. Needs only the audit and the key.

Every mask is checked to be where the audit says; one that is not stays, and counts as unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import crypto

SUFFIX = "_recovered"


def recovered_name(path: Column) -> Column:
    """name.ext as name_recovered.ext, in the same folder."""
    return F.regexp_replace(path, r"^(.*/)?([^/]*?)(\.[^./]+)?$", f"$1$2{SUFFIX}$3")


def put_back(text: Column, told: Column) -> Column:
    """struct<text, restored, unresolved> of a masked text. told: array<struct<lo, hi, mask, value>> in order of place.

    A span that begins before the last one's end, whose value is null (a token that does not open), or whose mask is
    not there, is left.
    """

    def step(acc: Column, s: Column) -> Column:
        good = (s["lo"] >= acc["at"]) & s["value"].isNotNull() & (F.substring(text, s["lo"] + 1, s["hi"] - s["lo"]) == s["mask"])
        gap = F.substring(text, acc["at"] + 1, s["lo"] - acc["at"])
        done = F.struct(F.concat(acc["parts"], F.array(gap, s["value"])).alias("parts"), s["hi"].alias("at"), (acc["n"] + 1).alias("n"))
        return F.when(F.coalesce(good, F.lit(False)), done).otherwise(acc)

    def whole(acc: Column) -> Column:
        back = F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
        return F.struct(back.alias("text"), acc["n"].alias("restored"), (F.size(told) - acc["n"]).alias("unresolved"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    untouched = F.struct(text.alias("text"), F.lit(0).alias("restored"), F.lit(0).alias("unresolved"))
    return F.when(F.size(told) > 0, F.aggregate(told, start, step, whole)).otherwise(untouched)


def markdown(texts: DataFrame, spans: DataFrame, key: bytes | Column, text_col: str = "masked_text") -> DataFrame:
    """doc_id, text, restored, unresolved. texts: doc_id and the masked text; spans: audit.spans_of(..., key).

    All spans of the audit count; see put_back() for those that stay.
    """
    one = F.struct(F.col("md_start").alias("lo"), F.col("md_end").alias("hi"), F.col("masked_value").alias("mask"), crypto.opened(F.col("encrypted_value"), key).alias("value"))
    told = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("told"))
    both = texts.select("doc_id", F.col(text_col).alias("t")).join(told, "doc_id", "left")
    known = F.coalesce("told", F.array().cast(told.schema["told"].dataType))
    return both.select("doc_id", put_back(F.col("t"), known).alias("r")).select("doc_id", "r.*")


def leaves(units: DataFrame, spans: DataFrame, key: bytes | Column, by: list[str]) -> DataFrame:
    """Units of a structured document (by, text), all or nothing: text, restored, unresolved.

    spans: by, masked_start, masked_end, masked_value, encrypted_value. A unit whose masks are not all in place,
    or of which a token that opens does not fit, keeps its text.
    """
    one = F.struct(F.col("masked_start").alias("lo"), F.col("masked_end").alias("hi"), F.col("masked_value").alias("mask"), crypto.opened(F.col("encrypted_value"), key).alias("value"))
    told = spans.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("told"))
    both = units.join(told, by, "left")
    text, opened = F.col("text"), F.filter("told", lambda s: s["value"].isNotNull())
    fits = F.forall(opened, lambda s: F.substring(text, s["lo"] + 1, s["hi"] - s["lo"]) == s["mask"])
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["lo"] - acc["at"])
        return F.struct(F.concat(acc["parts"], F.array(gap, s["value"])).alias("parts"), s["hi"].alias("at"))

    spliced = F.aggregate(opened, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    good = F.coalesce(fits, F.lit(False))
    n = F.when(good, F.size(opened)).otherwise(0)
    return both.select(*by, F.when(good, spliced).otherwise(text).alias("text"), n.alias("restored"), (F.coalesce(F.size("told"), F.lit(0)) - n).alias("unresolved"))
