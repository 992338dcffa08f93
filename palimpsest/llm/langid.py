"""Language identification by rank-order profiles.

A profile is the TOP most frequent n-grams (one to three characters; a space stands for a word's edges) in
order of frequency, ties in order of code points. A document's language is the one whose profile is nearest
by out-of-place distance: the sum over the document's n-grams of the difference of ranks, or TOP where the
profile lacks the n-gram. The score is 1 minus that distance over the largest possible one.

Profiles are fitted on all documents with a language, and the least score of a language is taken from all of
them. Fitting and prediction read whole texts.

Defined results: null texts and texts without a letter are `und` with score 0; a tie of distances goes to
the first language in alphabetical order; without any training document everything is `und`; rows are
independent, so repeated rows repeat their result; an empty table gives no rows; other columns than those
named are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

TOP = 400
#: Characters counted together in fitting; distinct n-grams that a task holds, about.
TOGETHER, HELD = 4 * common.BATCH_CHARS, 1_000_000
#: Ranges of scores that are counted on the way to a quantile.
RANGES = 1 << 16
UNKNOWN = "und"
#: A text is in none of the languages if its score is under SHARE of what all but LEAST of the fitting documents have.
SHARE, LEAST = 0.55, 0.001


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers (21 bits a character), sorted; n-grams across words are left out."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = np.concatenate([[False], _letters()[points], [False]])
    word = np.where(letter, np.concatenate([[0], points, [0]]), 0x20).astype(np.int64)
    keep = letter | np.append(letter[1:], [False]) | np.concatenate([[False], letter[:-1]])
    # One space before and after each word; two words share the space between them.
    keep[1:] &= letter[1:] | letter[:-1] | ~keep[:-1] | np.append(letter[2:], [False])
    word, letter = word[keep], letter[keep]
    if not letter.any():
        return np.zeros(0, np.int64)
    a, b = word[:-1], word[1:]
    two = (a << 21) | b
    three = (two[:-1] << 21) | word[2:]
    inner = letter[1:-1]
    out = np.concatenate([word[letter], two[letter[:-1] | letter[1:]], three[inner]])
    out.sort()
    return out


def counted(sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]]))
    return sorted_grams[starts], np.diff(np.append(starts, len(sorted_grams)))


def ranked(values: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    return values[np.lexsort((values, -counts))[:top]]


class Profiles:
    """The profiles of all languages as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.languages, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)  # the last row: in no profile
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        own = grams(text)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*counted(own), self.top)
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        theirs = self.ranks[at]
        away = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.languages[best], float(1 - away[best] / (self.top * len(own)))


def fitting(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that can be learnt from: doc_id, text, lang."""
    return common.texts(df, id_col, text_col, F.col(lang_col).alias("lang")).filter("lang is not null and text <> ''")


def at_rank(scores: DataFrame, rank: int) -> float:
    """The score at a rank (from 0) of all in column score (0 to 1), in ascending order."""
    place = F.least(F.floor(F.col("score") * RANGES), F.lit(RANGES - 1))
    # RANGES rows at most; then those of one range. Scores are fractions with denominators up to TOP * TOP in steps of TOP,
    # so there are fewer than a thousand different ones in a range, however many documents there are.
    before = 0
    for r in scores.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect():
        if before + r["n"] > rank:
            break
        before += r["n"]
    for s in scores.filter(place == r["place"]).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy("score").collect():
        before += s["n"]
        if before > rank:
            break
    return s["score"]


def quantile(scores: DataFrame, share: float) -> float:
    """The exact quantile of column score, between two scores in proportion; 0 if there are none."""
    n = scores.count()
    if not n:
        return 0.0
    at = share * (n - 1)
    low = at_rank(scores, int(at))
    return low + (at_rank(scores, min(int(at) + 1, n - 1)) - low) * (at - int(at))


def floor(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The least score of a text in one of the languages: far below those of the documents that profiles are fitted on."""
    scores = identify(fitting(df, id_col, text_col, lang_col), profiles).filter(F.col("lang_pred") != UNKNOWN).select("score")
    return SHARE * quantile(common.table(scores, "scores"), LEAST)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counts of n-grams."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(keys, kind="stable")
    keys, sizes = counted(keys[by])
    return keys, common.sums(counts[by], sizes)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """The profile of each language of the given training documents (rows without text or language are passed over)."""
    docs = fitting(df, id_col, text_col, lang_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

        for batch, values in common.batches(it, limit=TOGETHER):
            texts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(values, batch.column("lang").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(grams(text))
            for lang, found in texts.items():
                found = np.concatenate(found)
                if len(found):
                    found.sort()
                    held.setdefault(lang, []).append(counted(found))
                    size += len(held[lang][-1][0])
            if size > HELD:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if 2 * size > HELD:
                    yield from done()
                    held, size = {}, 0
        yield from done()

    parts = docs.mapInArrow(run, "lang string, gram long, n long")
    counts = common.table(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # As many rows as there are languages.
    languages = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    # `top` rows of each language reach the driver.
    return {
        lang: [r["gram"] for r in counts.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(top).collect()]
        for lang in languages
    }


def identify(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score of every row; only the text is looked at."""
    docs = common.texts(df, id_col, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, top)
        for batch, values in common.batches(it):
            found = [model.predict(t) for t in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: profiles from the documents outside fold 2 of 4, predictions for all."""
    profiles = fit(df.filter(common.fold("doc_id", 4) != 2))
    return identify(df, profiles).select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def keep(df: DataFrame, profiles: dict[str, list[int]], least: float, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text is in one of the languages: not `und`, and with a score of `least` at least (see floor())."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in it:
            found = [model.predict(t or "") for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
