"""Line breaks that masking flattened, guessed back: runs of spaces, and Markdown tables by their rule's columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = re.compile(r"\|(?:[ \t]*:?-{3,}:?[ \t]*\|)+")
#: What every rule has in it.
SOME_RULE = r"\|[ \t]*:?-{3,}:?[ \t]*\|"
PIPE = re.compile(r"(?<!\\)(?:\\\\)*\|")
RUN = re.compile(r" {2,}")


def spaced(text: str, pairs: bool = False) -> str:
    """Runs of spaces as a line break each, or as one for every two spaces."""
    return RUN.sub((lambda m: "\n" * (len(m[0]) // 2) + " " * (len(m[0]) % 2)) if pairs else "\n", text)


def _table(text: str, rule: re.Match, floor: int) -> tuple[int, int, str] | None:
    """Where the table around a rule begins and ends, and its rows one to a line."""
    cells = len(re.findall("-{3,}", rule[0])) + 1
    pipes = [m.end() - 1 for m in PIPE.finditer(text)]
    before = [p for p in pipes if floor <= p < rule.start()][-cells:]
    if len(before) < cells or text[before[-1] + 1 : rule.start()].strip(" \t"):
        return None
    rows, at = [text[before[0] : before[-1] + 1], rule[0]], rule.end()
    after = [p for p in pipes if p >= at]
    ends = [(before[0], at)]
    while len(after) >= cells and not text[at : after[0]].strip(" \t") and not RULE.match(text, after[0]):
        rows.append(text[after[0] : after[cells - 1] + 1])
        at, after = after[cells - 1] + 1, after[cells:]
        ends.append((before[0], at))
    if len(rows) > 2 and after and not text[at : after[0]].strip(" \t") and RULE.match(text, after[0]):
        rows.pop()  # the next table's header
        at = ends[-2][1]
    return before[0], at, "\n".join(rows)


def restored(text: str, pairs: bool = False) -> str:
    """The text with its line breaks guessed; one that has a line break stays."""
    if "\n" in text or "\r" in text:
        return text
    out, at = "", 0
    for rule in RULE.finditer(text):
        if rule.start() < at or not (found := _table(text, rule, at)):
            continue
        lo, hi, rows = found
        lead = text[at:lo].rstrip(" \t")
        out += spaced(lead, pairs) + ("\n" if (out or lead) and not (out + lead).endswith("\n") else "") + rows
        at = hi + len(text[hi:]) - len(text[hi:].lstrip(" \t"))
        out += "\n" if at < len(text) else ""
    return out + spaced(text[at:], pairs)


def _made(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else restored(t)).astype(object)


def restore(text: Column, masks: Column) -> Column:
    """restored() of texts in which none of their masks (array<string>) is left; others stay.

    Only texts with a table's rule go to Python: for others an expression does the same.
    """
    make = F.pandas_udf(_made, T.StringType())
    masked = F.coalesce(F.exists(masks, lambda m: (m != "") & F.contains(text, m)), F.lit(False))
    stays = masked | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    tables = F.when(~stays & text.rlike(SOME_RULE), text)
    return F.when(stays, text).when(tables.isNotNull(), make(tables)).otherwise(F.regexp_replace(text, RUN.pattern, "\n"))
