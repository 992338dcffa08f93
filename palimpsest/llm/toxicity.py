"""Toxicity of documents, read through obfuscation.

Every token is a character lattice: each sign stands for itself, for letters it is used for, or for nothing, and a
letter that repeats the one before for itself or for nothing. Viterbi decoding over a character trigram model picks
the likeliest letters. (A token of letters none of which repeats has one path, itself, and needs no decoding; in one of
letters alone, each run of a letter is decided by itself, since the states before and after it are the same.)
Tokens of one or two signs in a row are one lattice besides, in which each space is noise or ends a word. What has no
letter is a word only if all trigrams of its likeliest letters are known. The restored words, and their first
letters, have weights of evidence from labelled documents, and a logistic regression over a document's strongest
evidence gives the score. A word is evidence if at least two toxic documents have it.

Fitting uses all labelled documents: trigrams, evidence and the sums of the regression's steps are counted within
tasks and added up. Fitting and scoring read whole texts. The model (trigrams, and words and beginnings that are
evidence) goes to every task, so it grows with the vocabulary of the toxic documents.

Defined results: null, empty and blank texts have no evidence and get the score of that; labels that are
null are not learnt from; of several labels of a doc_id the greatest counts; without both labels among the training rows all scores are 0; rows are
independent, so repeated rows repeat their result; an empty table gives no rows; other columns than those
named are not looked at.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Words that a task counts together, about.
HELD = 400_000
#: Letters at a word's start that are evidence of their own.
HEAD = 5
#: Rows that the base rate counts as in a word's evidence.
PRIOR = 4.0
#: What signs stand for besides themselves.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
#: Log-probabilities of the channel: a sign for a letter, a sign that is noise, a second or later letter of a run that is noise, a space within a word.
SWAP, NOISE, DOUBLE, REPEAT, GLUE = -1.0, -6.0, -3.0, -0.7, -1.0
EDGE = "\x02"
TWICE = re.compile(r"(.)\1")
RUN = re.compile(r"(.)\1+")
THRICE = re.compile(r"(.)\1\1")


class Letters:
    """A character trigram model, smoothed by its bigrams and letters."""

    def __init__(self, counts: dict[str, int]):
        self.three: Counter = Counter(counts)
        self.two: Counter = Counter()
        self.one: Counter = Counter()
        self.before: Counter = Counter()
        for g, n in counts.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.before[g[:2]] += n
        self.total = sum(self.one.values())
        self.first = Counter()
        for g, n in self.two.items():
            self.first[g[0]] += n
        self.known: dict[str, float] = {}

    def logp(self, history: str, c: str) -> float:
        """Of letter c after the two in history."""
        g = history + c
        if g not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            p = (self.one[c] + 0.1) / (self.total + 100)
            p = (self.two[g[1:]] + 5 * p) / (self.first[g[1]] + 5)
            p = (self.three[g] + 5 * p) / (self.before[history] + 5)
            self.known[g] = math.log(p)
        return self.known[g]

    def knows(self, word: str) -> bool:
        """Whether all trigrams of a word are known."""
        padded = EDGE * 2 + word + EDGE
        return all(self.three[padded[i : i + 3]] for i in range(len(padded) - 2))


def decode(token: str, letters: Letters) -> str:
    """The likeliest letters behind a token, or the words behind tokens with a space between them."""
    best: dict[str, tuple[float, tuple | None]] = {EDGE * 2: (0.0, None)}  # by the last two letters: score and letters, last first
    last, length = "", 0
    for sign in token:
        if sign == " ":
            following = {}
            for history, (score, path) in best.items():
                ways = [(history, score + GLUE, path)]
                if history != EDGE * 2:
                    ways.append((EDGE * 2, score + letters.logp(history, EDGE), (" ", path)))
                for now, s, p in ways:
                    if now not in following or s > following[now][0]:
                        following[now] = (s, p)
            best = following
            continue
        if sign.isalpha():
            options = [(sign, 0.0)]
            length = length + 1 if sign == last else 1
            if length > 1:
                options.append(("", DOUBLE if length == 2 else REPEAT))
        else:
            options = [*((c, SWAP) for c in STANDS_FOR.get(sign, "")), ("", NOISE if sign in STANDS_FOR or sign.isalnum() else -0.1)]
        last = sign if sign.isalpha() else ""
        following: dict[str, tuple[float, tuple | None]] = {}
        for history, (score, path) in best.items():
            for c, cost in options:
                if not c and sign == last and history[1] != sign:
                    continue  # a space ended the word
                if c:
                    now, s, p = history[1] + c, score + cost + letters.logp(history, c), (c, path)
                else:
                    now, s, p = history, score + cost, path
                if now not in following or s > following[now][0]:
                    following[now] = (s, p)
        best = following
    path = max(((s + letters.logp(h, EDGE), p) for h, (s, p) in best.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def collapse(token: str, letters: Letters) -> str:
    """What decode() finds for a token of letters alone: of each run of a letter one, two or all are the likeliest."""
    out, at = [], 0
    for m in RUN.finditer(token):
        a, b = m.span()
        x, n = token[a], b - a
        start, after = (token[a - 1] if a else EDGE) + x, token[b] if b < len(token) else EDGE
        two = letters.logp(start, x) + letters.logp(x + x, after)
        best, kept = two + (n - 2) * REPEAT, 2
        # Between two and all, the score is in proportion to their number.
        if n > 2 and (every := two + (n - 2) * letters.logp(x + x, x)) > best:
            best, kept = every, n
        if letters.logp(start, after) + DOUBLE + (n - 2) * REPEAT > best:
            kept = 1
        out.append(token[at : a + kept])
        at = b
    return "".join([*out, token[at:]])


def restore(token: str, letters: Letters) -> str:
    """The word that a token without white space stands for; empty if none."""
    token = token.strip("%#&*.,;:?\"'()[]{}-_~…«»“”‘’")
    if token.isalpha():
        return collapse(token, letters) if TWICE.search(token) else token
    word = decode(token, letters) if token else ""
    return word if any(c.isalpha() for c in token) or word and letters.knows(word) else ""


def _runs(sizes: np.ndarray, most: int, least: int) -> Iterator[tuple[int, int]]:
    """Where the runs of tokens of at most `most` signs, `least` tokens or more, begin and end."""
    edge = np.diff(np.concatenate([[0], sizes <= most, [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    yield from zip(starts[long].tolist(), ends[long].tolist())


def _singles(found: list[str], sizes: np.ndarray) -> list[str]:
    """The runs of three or more single letters or digits, as one token each."""
    out = []
    for a, b in _runs(sizes, 1, 3):
        parts = itertools.groupby(found[a:b], str.isalnum)
        out += ["".join(p) for is_letter, p in ((k, [*g]) for k, g in parts) if is_letter and len(p) > 2]
    return out


def _short(found: list[str], sizes: np.ndarray) -> list[str]:
    return [" ".join(found[a:b]) for a, b in _runs(sizes, 2, 2)]


def _split(text: str) -> tuple[list[str], np.ndarray]:
    found = text.lower().split()
    return found, np.fromiter(map(len, found), np.int64, len(found))


def tokens(text: str) -> list[str]:
    """The tokens of a text, runs of single letters as one token besides."""
    found, sizes = _split(text)
    return found + _singles(found, sizes)


def runs(text: str) -> list[str]:
    """The runs of tokens of one or two signs, with one space between them."""
    return _short(*_split(text))


def split(run: str, letters: Letters) -> list[str]:
    """The words that a run stands for."""
    found = decode(run, letters).split()
    return found if any(c.isalpha() for c in run) else [w for w in found if letters.knows(w)]


class Restorer:
    """Restored words of many texts; each distinct token is restored once while it is remembered."""

    def __init__(self, trigrams: dict[str, int], weigh=None, most: int = 200_000):
        self.letters, self.weigh, self.most = Letters(trigrams), weigh, most
        self._empty()

    def _empty(self) -> None:
        self.at, self.words, self.weights = common.Numbered(), [], np.zeros((0, 2))
        self.heads: list[str] = []
        self.known: dict[str, str] = {}
        self.runs: dict[str, list[str]] = {}

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' tokens and of the words of their runs, and how many each text has."""
        if len(self.at) > self.most:
            self._empty()
        found, each = [], []
        for text in texts:
            mine, sizes = _split(text)
            more = _singles(mine, sizes)
            for run in _short(mine, sizes):
                if run not in self.runs:
                    if len(self.runs) > self.most:
                        self.runs.clear()
                    self.runs[run] = split(run, self.letters)
                more += self.runs[run]
            found += mine
            found += more
            each.append(len(mine) + len(more))
        n = len(self.at)
        at = np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))
        if new := [restore(t, self.letters) for t in self.at.new(n)]:
            self.words += new
            if self.weigh:
                self.weights = np.concatenate([self.weights, np.array([self.weigh(w) for w in new])])
            else:
                self.heads += [self.known.setdefault(h, h) for h in ("^" + w[:HEAD] for w in new)]
        return at, np.array(each, np.int64)

    def distinct(self, texts: list[str]) -> list[tuple[set[str], set[str]]]:
        """The restored words of each text, and their heads."""
        at, each = self.read(texts)
        ends = np.cumsum(each)
        ids = [[*set(at[a:b].tolist())] for a, b in zip(ends - each, ends)]
        return [(set(map(self.words.__getitem__, i)) - {""}, set(map(self.heads.__getitem__, i)) - {"^"}) for i in ids]


_restorers: dict[str, Restorer] = {}


def _restorer(key: str, make: Callable[[], Restorer]) -> Restorer:
    """One for all tasks of a worker that restore by the same model."""
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = make()
    return _restorers[key]


def evidence(toxic: float, clean: float, rate: float) -> float:
    """Log-odds that a word's documents are toxic, over the base rate's."""
    p = (toxic + PRIOR * rate) / (toxic + clean + PRIOR)
    return math.log(p / (1 - p)) - math.log(rate / (1 - rate))


#: Numbers that the regression sees of a document.
WIDTH = 8


def features(words: list[float], heads: list[float]) -> list[float]:
    """What the regression sees of a document's positive evidence."""
    w, h = sorted(words, reverse=True), sorted(heads, reverse=True)
    top = [*w[:3], 0.0, 0.0, 0.0][:3]
    return [1.0, *top, sum(w), float(sum(x > 2 for x in w)), *[*h[:2], 0.0, 0.0][:2]]


def moments(x: np.ndarray, y: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a step of the regression sums over rows (n: how often each counts): the curvature, then the gradient."""
    p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    return np.concatenate([((x * (n * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (n * (y - p))])


def regress(total: Callable[[np.ndarray], np.ndarray], width: int = WIDTH, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with ridge; total gives the moments of all rows for the weights so far."""
    b = np.zeros(width)
    pull = np.full(width, ridge)
    pull[0] = 1e-3
    for _ in range(40):
        m = total(b)
        step = np.linalg.solve(m[: width * width].reshape(width, width) + np.diag(pull), m[width * width :] - pull * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, trigrams: dict[str, int], lexicon: dict[str, tuple[int, int]], sizes: tuple[int, int], weights: list[float]):
        self.trigrams, self.lexicon, self.sizes, self.weights = trigrams, lexicon, sizes, weights
        self.key = uuid.uuid4().hex

    @property
    def rate(self) -> float:
        return self.sizes[1] / sum(self.sizes)

    def weigh(self, word: str, own: int | None = None) -> tuple[float, float]:
        """Evidence of a word and of its head; own: the label of a training document, whose count is left out."""
        out = []
        for key in (word, "^" + word[:HEAD]):
            t, c = self.lexicon.get(key, (0, 0))
            if own is not None:
                t, c = max(0, t - (own == 1)), max(0, c - (own == 0))
            out.append(max(0.0, evidence(t, c, self.rate)) if word and t else 0.0)
        return out[0], out[1]

    def restorer(self) -> Restorer:
        return _restorer(self.key, lambda: Restorer(self.trigrams, self.weigh))

    def score(self, texts: list[str]) -> list[float]:
        restorer = self.restorer()
        at, each = restorer.read(texts)
        hit = np.flatnonzero(restorer.weights[at].any(axis=1))
        cuts = np.searchsorted(hit, np.append(0, np.cumsum(each)))
        at = at[hit].tolist()
        out = []
        for a, b in zip(cuts, cuts[1:]):
            seen = {restorer.words[i]: restorer.weights[i].tolist() for i in set(at[a:b])}
            heads = {w[:HEAD]: x[1] for w, x in seen.items()}
            z = float(np.dot(features([x[0] for x in seen.values() if x[0]], [h for h in heads.values() if h]), self.weights))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def trigrams(words: Counter) -> tuple[list[str], np.ndarray]:
    """The distinct trigrams of the plain words among those counted, with edges, and their counts."""
    plain: Counter = Counter()
    for w, k in words.items():
        if (w := w.strip(".,;:?!")).isalpha() and not THRICE.search(w):
            plain[w] += k
    points = np.frombuffer("".join(f"{EDGE}{EDGE}{w}{EDGE}" for w in plain).encode("utf-32-le"), np.uint32).astype(np.int64)
    each = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
    at = common.csr(each, np.cumsum(each + 2) - each - 2)
    keys, which = np.unique(points[at] << 42 | points[at + 1] << 21 | points[at + 2], return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, which, np.repeat(np.fromiter(plain.values(), np.int64, len(plain)), each))
    return ["".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in keys.tolist()], counts


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learns from all labelled documents; labels has doc_id and the label (0, 1)."""
    told = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and label_id is not null").groupBy("label_id").agg(F.max("y").alias("y"))
    # Dealt by doc_id: labels grow with the documents, so they are no broadcast side.
    docs = common.texts(df, id_col, text_col).join(told.hint("merge"), F.col("doc_id") == F.col("label_id")).select("text", "y")
    docs = common.table(docs, "labelled", "zstd")
    common.release(df.sparkSession)
    sizes = {r["y"]: r["n"] for r in docs.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None

    def three(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in itertools.chain(it, [None]):
            if batch is not None:
                for t in batch.column("text").to_pylist():
                    words.update(t.lower().split())
            if len(words) > HELD or batch is None:
                found, n = trigrams(words)
                words.clear()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["gram", "n"])

    # As many rows as letters make trigrams.
    counts = docs.select("text").mapInArrow(three, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = {r["gram"]: r["n"] for r in counts.orderBy("gram").collect()}
    key = uuid.uuid4().hex

    def restored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(key, lambda: Restorer(table))
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        kinds = (pa.list_(pa.string()), pa.int32(), pa.string(), pa.int64(), pa.int64())
        names = ["words", "y", "key", "t", "c"]

        def done() -> pa.RecordBatch:
            keys = [*(seen[0] | seen[1])]
            columns = ([None] * len(keys), [None] * len(keys), keys, [seen[1][k] for k in keys], [seen[0][k] for k in keys])
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch, values in common.batches(it):
            found = restorer.distinct(values)
            for (words, heads), y in zip(found, batch.column("y").to_pylist(), strict=True):
                seen[y].update(words)
                seen[y].update(heads)
            rows = [pa.array([[*words] for words, _ in found], kinds[0]), batch.column("y"), *(pa.nulls(len(found), k) for k in kinds[2:])]
            yield pa.RecordBatch.from_arrays(rows, names=names)
            if len(seen[0]) + len(seen[1]) > HELD:
                yield done()
        yield done()

    # Restored once: rows of documents with their words, for the regression, and rows of words with their documents, for the evidence.
    both = common.table(docs.mapInArrow(restored, "words array<string>, y int, key string, t long, c long"), "restored", "zstd")
    common.drop(docs)
    common.release(df.sparkSession)
    seen = both.filter("key is not null").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rate = sizes[1] / (sizes[0] + sizes[1])
    odds = (F.col("t") + PRIOR * rate) / (F.col("c") + PRIOR * (1 - rate))
    # Words that at least two toxic documents have, and few others.
    strong = seen.filter("t >= 2").filter(odds > 1.5 * rate / (1 - rate)).orderBy("key").toArrow()
    lexicon = dict(zip(strong.column("key").to_pylist(), zip(strong.column("t").to_pylist(), strong.column("c").to_pylist())))
    model = Model(table, lexicon, (sizes[0], sizes[1]), [])

    def left_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = [pa.array(sorted(k), pa.string()) for k in ((k for k in lexicon if k[0] != "^"), (k[1:] for k in lexicon if k[0] == "^"))]
        for batch in it:
            words = batch.column("words").flatten()
            hit = pc.or_(pc.is_in(words, telling[0]), pc.is_in(pc.utf8_slice_codeunits(words, 0, HEAD), telling[1]))
            pairs: list[dict] = [{} for _ in range(len(batch))]
            ys, whose = batch.column("y").to_pylist(), pc.list_parent_indices(batch.column("words"))
            for d, w in zip(whose.filter(hit).to_pylist(), words.filter(hit).to_pylist(), strict=True):
                pairs[d][w] = model.weigh(w, ys[d])
            rows: Counter = Counter()
            for mine, y in zip(pairs, ys, strict=True):
                heads = {w[:HEAD]: p[1] for w, p in mine.items()}
                rows[y, *features([p[0] for p in mine.values() if p[0]], [h for h in heads.values() if h])] += 1
            x, y = pa.array([[*k[1:]] for k in rows], pa.list_(pa.float64())), pa.array([k[0] for k in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([x, y, pa.array([*rows.values()], pa.int64())], names=["x", "y", "n"])

    rows = common.table(both.filter("key is null").select("words", "y").mapInArrow(left_out, "x array<double>, y int, n long"), "features")

    def total(b: np.ndarray) -> np.ndarray:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros(WIDTH * WIDTH + WIDTH)
            for batch in it:
                x = batch.column("x").flatten().to_numpy().reshape(-1, WIDTH)
                m += moments(x, batch.column("y").to_numpy(), batch.column("n").to_numpy(), b)
            yield pa.RecordBatch.from_arrays([pa.array([m.tolist()], pa.list_(pa.float64()))], names=["m"])

        # A row of each task, whatever the number of documents.
        return np.sum([r["m"] for r in rows.mapInArrow(run, "m array<double>").collect()], axis=0)

    model.weights = regress(total).tolist()
    return model


def scores(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row; only the text is looked at."""
    docs = common.texts(df, id_col, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in common.batches(it):
            found = model.score(values) if model else [0.0] * len(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    out = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learnt(df: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled rows outside fold 0 of 5."""
    return fit(df, labels.filter(common.fold("doc_id", 5) != 0))


def held_out(df: DataFrame, labels: DataFrame) -> DataFrame:
    fold0: Column = common.fold("doc_id", 5) == 0
    return scores(df, learnt(df, labels)).select("doc_id", fold0.alias("held_out"), "score", "predicted")


def keep(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that are not predicted toxic."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = pa.RecordBatch.from_arrays([pa.array([t or "" for t in batch.column(text_col).to_pylist()], pa.large_string())], names=["text"])
            yield batch.filter(pa.array([not model or x < 0.5 for _, values in common.batches(iter([texts])) for x in (model.score(values) if model else values)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
