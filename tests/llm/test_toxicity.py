import random

import pytest

from palimpsest.llm import toxicity
from tests.llm.conftest import frame

WORDS = "the and of river stone walk table green idiot moron window people other school garden number".split()


@pytest.fixture(scope="module")
def letters():
    counts = {}
    for w in WORDS * 20:
        p = "\x02\x02" + w + "\x02"
        for i in range(len(p) - 2):
            counts[p[i : i + 3]] = counts.get(p[i : i + 3], 0) + 1
    return toxicity.Letters(counts)


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("m0r0n", "moron"), ("moronnnn", "moron"), ("iddddiot", "idiot"), ("iidiot", "idiot"), ("morron", "moron"), ("***idiot***", "idiot"), ("school", "school"), ("10.2.3.4", ""), ("", "")])
def test_restores(letters, token, word):
    assert toxicity.restore(token, letters) == word


def brute(token, letters):
    """All ways through the lattice."""
    best = {}

    def go(i, out, last, cost):
        if i == len(token):
            h, s = toxicity.EDGE * 2, cost
            for c in [*out, toxicity.EDGE]:
                s, h = s + letters.logp(h, c), (h + c)[-2:]
            best[out] = max(s, best.get(out, -1e9))
            return
        c = token[i]
        if c.isalpha():
            go(i + 1, out + c, c, cost)
            if c == last:
                go(i + 1, out, c, cost + (toxicity.REPEAT if token[i - 2 : i] == c + c and i > 1 else toxicity.DOUBLE))
        else:
            for x in toxicity.STANDS_FOR.get(c, ""):
                go(i + 1, out + x, "", cost + toxicity.SWAP)
            go(i + 1, out, "", cost + (toxicity.NOISE if c in toxicity.STANDS_FOR or c.isalnum() else -0.1))

    go(0, "", "", 0.0)
    return max(best.values()), best


def test_viterbi_finds_the_best_path(letters):
    rnd = random.Random(2)
    for _ in range(150):
        token = "".join(rnd.choice("idotmr10!.$@n") for _ in range(rnd.randint(1, 8)))
        top, ways = brute(token, letters)
        assert ways[toxicity.decode(token, letters)] == pytest.approx(top)


def test_runs_of_single_letters_are_tokens():
    assert toxicity.tokens("You i d i o t go") == ["you", "i", "d", "i", "o", "t", "go", "idiot"]
    assert toxicity.tokens("a b then") == ["a", "b", "then"]


def made(rnd, toxic):
    words = [rnd.choice(WORDS[:8] + WORDS[10:]) for _ in range(rnd.randint(5, 60))]
    if toxic:
        words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "moron", "id10t", "m0ron"]))
    return " ".join(words)


def test_learns_and_keeps_the_clean(spark):
    rnd = random.Random(4)
    truth = {i: int(i % 4 == 0) for i in range(400)}
    docs = frame(spark, [(i, made(rnd, y), "en") for i, y in truth.items()]).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, y in truth.items()] + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.held_out(docs, labels).collect()
    assert len(got) == 400
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    model = toxicity.learnt(docs, labels)
    left = {r.doc_id for r in toxicity.keep(docs, model).collect()}
    assert left == {r.doc_id for r in got if not r.predicted}


def test_the_greatest_of_several_labels_counts(spark):
    rnd = random.Random(4)
    docs = frame(spark, [(i, made(rnd, i % 4 == 0), "en") for i in range(200)])
    plain = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    more = plain.unionByName(plain.filter("toxic = 1").selectExpr("doc_id", "0 as toxic")).unionByName(plain)
    assert sorted(toxicity.held_out(docs, more).collect()) == sorted(toxicity.held_out(docs, plain).collect())


def plain_scores(rows, labels):
    """The whole query on lists: counters for the trigrams and the evidence, decoding by all ways, gradient steps for the regression."""
    import math
    import zlib
    from collections import Counter

    strip = "%#&*.,;:?\"'()[]{}-_~…«»“”‘’"
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d, _ in rows}
    known = [(t, labels[d]) for d, t in rows if d in labels and fold[d]]
    grams = Counter()
    for t, _ in known:
        for w in t.lower().split():
            w = w.strip(".,;:?!")
            if w.isalpha() and not any(a == b == c for a, b, c in zip(w, w[1:], w[2:])):
                p = "\x02\x02" + w + "\x02"
                grams.update(p[i : i + 3] for i in range(len(p) - 2))
    letters = toxicity.Letters(grams)

    def words(text):
        out = set()
        for t in text.lower().split():
            t = t.strip(strip)
            if t:
                ways = brute(t, letters)[1]
                out.add(max(ways, key=ways.get))
        return out - {""}

    seen = {d: words(t) for d, t in rows}
    t, c, n = Counter(), Counter(), Counter(y for _, y in known)
    for d, _ in rows:
        if d in labels and fold[d]:
            (t if labels[d] else c).update(seen[d] | {"^" + w[:5] for w in seen[d]})
    rate = n[1] / (n[0] + n[1])

    def weight(key, own):
        a, b = t[key], c[key]
        if a < 2 or (a + 4 * rate) / (b + 4 * (1 - rate)) <= 1.5 * rate / (1 - rate):
            return 0.0
        a, b = a - (own == 1), b - (own == 0)
        p = (a + 4 * rate) / (a + b + 4)
        return max(0.0, math.log(p / (1 - p)) - math.log(rate / (1 - rate))) if a > 0 else 0.0

    def vector(found, own=None):
        w = sorted((x for x in (weight(k, own) for k in found) if x), reverse=True)
        h = sorted((x for x in (weight("^" + k, own) for k in {k[:5] for k in found}) if x), reverse=True)
        return [1.0, *(w + [0.0] * 3)[:3], sum(w), float(sum(x > 2 for x in w)), *(h + [0.0] * 2)[:2]]

    x = [(vector(seen[d], labels[d]), labels[d]) for d, _ in rows if d in labels and fold[d]]
    import numpy as np

    a, y = np.array([v for v, _ in x]), np.array([float(v) for _, v in x])
    b, pull = np.zeros(8), np.array([1e-3, *[1.0] * 7])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b += np.linalg.solve(a.T @ np.diag(p * (1 - p)) @ a + np.diag(pull), a.T @ (y - p) - pull * b)
    return {d: 1 / (1 + math.exp(-float(np.dot(vector(seen[d]), b)))) for d, _ in rows}


def test_the_whole_query_is_that_on_lists(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(w for w in made(rnd, i % 4 == 0).split() if len(w) > 2)) for i in range(150)]
    labels = {i: int(i % 4 == 0) for i in range(0, 150) if i % 11}
    got = toxicity.held_out(frame(spark, [(*r, None) for r in rows]).repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    want = plain_scores(rows, labels)
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx(want, abs=1e-6)


def test_odd_rows_and_no_labels(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.held_out(odd, labels).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}
    assert toxicity.held_out(empty, labels).collect() == []
    some = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.held_out(odd, some).collect())
    assert toxicity.keep(odd, None).count() == odd.count()


@pytest.fixture(scope="module")
def english():
    counts = {}
    for w in [*WORDS, "you", "are", "an", "to", "be", "or", "not", "is", "it", "he", "we"] * 20:
        p = "\x02\x02" + w + "\x02"
        for i in range(len(p) - 2):
            counts[p[i : i + 3]] = counts.get(p[i : i + 3], 0) + 1
    return toxicity.Letters(counts)


@pytest.mark.parametrize(
    "text, words",
    [
        ("1 d ! 0 t", ["idiot"]), ("y o u i d i o t", ["you", "idiot"]), ("id io t", ["idiot"]), ("mo r0 n", ["moron"]), ("i d i i i o t", ["idiot"]),
        ("to be or", ["to", "be", "or"]), ("we  is\nit", ["we", "is", "it"]),
    ],
)
def test_spaces_are_noise_or_ends_of_words(english, text, words):
    assert [w for run in toxicity.runs(text) for w in toxicity.split(run, english)] == words


def test_tokens_without_letters(english):
    assert toxicity.restore("!5", english) == "is"
    assert toxicity.restore("2024", english) == ""


def spaced_brute(run, letters):
    """All ways through the lattice of a run: each space is noise or ends a word."""
    parts, best = run.split(" "), {}
    for cut in range(1 << (len(parts) - 1)):
        words, glued = [parts[0]], 0
        for i, p in enumerate(parts[1:]):
            if cut >> i & 1:
                words.append(p)
            else:
                words[-1], glued = words[-1] + p, glued + 1
        out = [brute(w, letters) for w in words]
        if all(max(ways, key=ways.get) for _, ways in out):
            text = " ".join(max(ways, key=ways.get) for _, ways in out)
            best[text] = max(best.get(text, -1e9), sum(top for top, _ in out) + glued * toxicity.GLUE)
    return best


def test_viterbi_finds_the_best_words_of_a_run(english):
    rnd = random.Random(6)
    for _ in range(80):
        run = " ".join("".join(rnd.choice("idotmrnyoue10$") for _ in range(rnd.randint(1, 2))) for _ in range(rnd.randint(2, 5)))
        ways = spaced_brute(run, english)
        assert ways[toxicity.decode(run, english)] == pytest.approx(max(ways.values()))


def test_learns_from_all_labelled_documents(spark, monkeypatch):
    """More labelled documents than any sample: counts are those of all of them, however they are put together."""
    from collections import Counter

    rnd = random.Random(11)
    rows = [(i, f"{rnd.choice(WORDS)} {rnd.choice(['idiot', 'mann', 'w' + 'x' * (i % 2) + 'yz']) if i % 10 == 0 else rnd.choice(WORDS)}") for i in range(24_000)]
    labels = {i: int(i % 10 == 0) for i, _ in rows}
    docs = frame(spark, [(*r, None) for r in rows]).repartition(3)
    told = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    grams, has = Counter(), (Counter(), Counter())
    for i, t in rows:
        for w in t.split():
            p = "\x02\x02" + w + "\x02"
            grams.update(p[j : j + 3] for j in range(len(p) - 2))
        has[labels[i]].update({*t.split(), *("^" + w[:5] for w in t.split())})
    for held in (toxicity.HELD, 10):
        monkeypatch.setattr(toxicity, "HELD", held)
        model = toxicity.fit(docs, told)
        assert model.sizes == (21_600, 2_400)
        assert model.trigrams == grams
        assert {"idiot", "^idiot", "mann"} <= model.lexicon.keys()
        assert all(model.lexicon[k] == (has[1][k], has[0][k]) for k in model.lexicon)


def test_runs_of_a_letter_are_decided_as_by_all_paths(letters, english):
    rnd = random.Random(12)
    for model in (letters, english):
        for _ in range(400):
            token = "".join(rnd.choice("idotmrnyou") * rnd.choice([1, 1, 1, 2, 2, 3, 5]) for _ in range(rnd.randint(1, 7)))
            assert toxicity.collapse(token, model) == toxicity.decode(token, model)


def test_runs_of_short_tokens_are_those_of_patterns():
    import re

    spaced, short = re.compile(r"(?<!\S)[^\W_](?:\s+[^\W_](?!\S)){2,}"), re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}(?!\S))+")
    rnd = random.Random(13)
    for _ in range(500):
        text = "".join(rnd.choice(["a", "b", "_", "é", "!", "two", "io", " ", " ", " ", "\n", "　", "\x1c", "7"]) for _ in range(rnd.randint(0, 30)))
        assert toxicity.tokens(text) == text.lower().split() + ["".join(m.split()) for m in spaced.findall(text.lower())]
        assert toxicity.runs(text) == [" ".join(m.split()) for m in short.findall(text.lower())]
