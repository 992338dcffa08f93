import math
import re
import zlib
from collections import Counter

import pytest

from palimpsest.llm import lm
from tests.llm.conftest import frame


def words(text):
    return ["<s>", *re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def brute(rows):
    """By counters of whole n-grams and the recursion of the smoothing, without states or arcs."""
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for i, (d, _) in enumerate(rows)}
    grams, contexts = Counter(), Counter()
    for i, (_, text) in enumerate(rows):
        if not held[i]:
            w = words(text)
            for j in range(1, len(w)):
                for k in range(3):
                    if j - k >= 0:
                        grams[tuple(w[j - k : j + 1])] += 1
                        contexts[tuple(w[j - k : j])] += 1
    ones = {g: c for g, c in grams.items() if len(g) == 1 and g != ("<s>",)}
    n = sum(ones.values())
    z = n + 0.5 * (len(ones) + 1)

    def p(h, x):
        if not h:
            return (grams[x,] + 0.5) / z
        if not contexts[h]:
            return p(h[1:], x)
        u = {1: 20, 2: 4}[len(h)] * contexts[h] ** {1: 0.7, 2: 0.5}[len(h)]
        return (grams[*h, x] + u * p(h[1:], x)) / (contexts[h] + u)

    for i, (doc_id, text) in enumerate(rows):
        w = words(text)
        at = range(1, len(w))
        base = sum(math.log10(p((), w[j])) for j in at)
        full = sum(math.log10(p(tuple(w[max(0, j - 2) : j]), w[j])) for j in at)
        yield doc_id, held[i], len(w) - 1, sum((x,) in ones for x in w[1:]), n, round(base, 6), round(full, 6)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_scores_are_those_of_counters(odd, docs):
    for df in (odd, docs):
        want = sorted(brute([tuple(r) for r in df.select("doc_id", "text").collect()]), key=key)
        got = sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm.held_out(df).collect()), key=key)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)


def test_better_than_words_alone_on_held_out_texts(docs):
    rows = [r for r in lm.held_out(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("text", ["a b a b c", "b a a", "", "c c c c a b"])
def test_probabilities_of_every_state_sum_to_one(text):
    """The next token after a text: its whole vocabulary, the end and what is unseen."""
    import numpy as np

    train = ["a b c", "a b a", "b c", "a", "c a b c a b"]
    asked = [*train, *(f"{text} {w}".strip() for w in "abc"), text, f"{text} zz".strip()]
    grams = lm.Grams(*lm.tokens(asked))
    learns = np.arange(len(asked)) < len(train)
    counts = grams.counts(learns)
    total, types = int(counts[0].sum() - counts[0][grams.start]), 4
    model = lm.Automaton(grams, counts, total, types)
    score = 10 ** model.walk(grams.starts, grams.each)
    # By subtraction of the end token's share: walks of the text, of it with each word, both with the end.
    without = {}
    for w, x in zip([*"abc", "zz"], [*score[5:8], score[9]]):
        t = f"{text} {w}".strip()
        ended = lm.Grams(*lm.tokens([*train, t, *(f"{t} {v}" for v in "abc"), f"{t} zz"]))
        m = lm.Automaton(ended, ended.counts(np.arange(10) < 5), total, types)
        last = int(np.cumsum(ended.each)[5] - 1)
        state = step(m, ended, 5)
        without[w] = x / 10 ** arc_weight(m, state, last)
    prefix = score[8] / 10 ** arc_weight(model, step(model, grams, 8), int(np.cumsum(grams.each)[8] - 1))
    assert (sum(without.values()) + score[8]) / prefix == pytest.approx(1)


def step(model, grams, text):
    """The state before a text's last token."""
    state = model.start
    for at in range(int(grams.starts[text]), int(grams.starts[text] + grams.each[text] - 1)):
        while not model.known[arc := model.arcs[model.level[state], at]]:
            state = model.shorter[state]
        state = model.to[arc]
    return state


def arc_weight(model, state, at):
    total = 0.0
    while not model.known[arc := model.arcs[model.level[state], at]]:
        total, state = total + model.failure[state], model.shorter[state]
    return total + model.weight[arc]


def test_blocks_of_any_size_give_the_same(odd, docs):
    for df in (odd, docs):
        a, b = (sorted((tuple(r) for r in lm.score(df, block_bytes=n).collect()), key=key) for n in (20_000, 10**9))
        assert [x[:4] for x in a] == [x[:4] for x in b]
        assert [x[4:] for x in a] == [pytest.approx(x[4:]) for x in b]


def test_blocks_cut_a_partition_by_bytes(spark, odd):
    docs = odd.coalesce(1).selectExpr("doc_id", "coalesce(text, '') as text", "true as trains")
    rows = lm.blocked(docs, 3000).collect()
    assert len(rows) == odd.count() and [r.block for r in rows] == sorted(r.block for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.block, []).append(len(r.text.encode()))
    assert len(sizes) > 2 and all(sum(x) <= 3000 or len(x) == 1 for x in sizes.values())


def test_answers_to_other_rows_are_an_error(docs, monkeypatch):
    from pyspark.sql import functions as F

    blocked = lm.blocked
    monkeypatch.setattr(lm, "blocked", lambda d, n: blocked(d.withColumn("text", F.concat("text", F.lit(" x"))), n))
    with pytest.raises(Exception, match="not those to this block"):
        lm.score(docs).collect()


def test_nothing_to_learn_from_and_empty_table(spark, empty):
    assert lm.held_out(empty).collect() == []
    from pyspark.sql import functions as F

    got = lm.score(frame(spark, [(1, "a b", None)]), F.lit(None).cast("boolean")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)]
