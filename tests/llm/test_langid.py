from palimpsest.llm import langid
from tests.llm.conftest import frame


def test_held_out_accuracy(docs):
    rows = docs.select("doc_id", "lang").join(langid.held_out(docs), "doc_id").filter("held_out").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_out_of_place_distance_by_hand():
    p = langid.Profiles({"x": langid.ranked(*langid.counted(langid.grams("ab ab"))).tolist()})
    assert p.predict("AB, ab!") == ("x", 1.0)
    assert p.predict("12 %") == ("und", 0.0)
    assert p.predict("")[0] == "und"
    lang, score = p.predict("zz")
    assert lang == "x" and score == 0.0


def test_grams_are_those_of_padded_words():
    def plain(text):
        out, words, word = [], [], ""
        for c in text.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                words, word = [*words, word], ""
        for w in words:
            p = f" {w} "
            out += [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]
        return sorted(out)

    def name(g):
        return "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF)

    for text in ("ab c", "a", "  x..y  zz9q ", "Été, un²", "", "1 2"):
        assert sorted(map(name, langid.grams(text).tolist())) == plain(text)


def plain_query(rows, parts=4):
    """The whole query on lists and dictionaries: profiles, distances, ties. With parts=None, all rows are learnt from."""
    import zlib
    from collections import Counter

    def grams(text):
        out, word = [], ""
        for c in text.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                p, word = f" {word} ", ""
                out += [*p[1:-1], *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]
        # A space between two words belongs to both.
        return Counter(out)

    def top(counts):
        return sorted(counts, key=lambda g: (-counts[g], number(g)))[:400]

    def number(g):
        out = 0
        for c in g:
            out = out << 21 | ord(c)
        return out

    held = {d: bool(parts) and zlib.crc32(str(d).encode()) % parts == 2 for d, *_ in rows}
    counts = {}
    for d, text, lang in rows:
        if lang is not None and text and not held[d]:
            counts.setdefault(lang, Counter()).update(grams(text))
    ranks = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in sorted(counts.items())}
    for d, text, _ in rows:
        mine = top(grams(text or ""))
        if not mine or not ranks:
            yield d, held[d], "und", 0.0
            continue
        away = {lang: sum(abs(r[g] - i) if g in r else 400 for i, g in enumerate(mine)) for lang, r in ranks.items()}
        best = min(away, key=lambda lang: (away[lang], lang))
        yield d, held[d], best, round(1 - away[best] / (400 * len(mine)), 9)


def test_the_whole_query_is_that_on_lists(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.held_out(docs).collect())
    assert got == sorted(plain_query(rows))


def test_the_floor_is_between_noise_and_the_languages(docs):
    import random

    rnd = random.Random(1)
    model = langid.fit(docs)
    least = langid.floor(docs, model)
    p = langid.Profiles(model)
    scores = sorted(p.predict(r.text)[1] for r in docs.filter("lang is not null").collect() if (r.text or "").strip())
    assert 0.2 < least < scores[len(scores) // 100]
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(600)) for _ in range(50)]
    assert max(p.predict(t)[1] for t in noise) < least
    assert p.predict("Съешь же ещё этих мягких французских булок, да выпей чаю")[1] < least


def test_odd_rows_and_empty_table(odd, empty, spark):
    model = langid.fit(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert langid.fit(empty) == {}
    assert langid.identify(empty, model).collect() == []
    assert {r.lang_pred for r in langid.held_out(frame(spark, [(1, "abc", None), (2, None, "en")])).collect()} == {"und"}


def test_profiles_are_of_all_documents(spark, monkeypatch):
    """More documents of a language than any sample: the profile is that of all texts, however the counts are put together."""
    import random

    import numpy as np

    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("abcdefghijk  ") for _ in range(30)), "xy"[i % 3 == 0]) for i in range(6000)]
    docs = frame(spark, rows).repartition(3)
    for held in (langid.HELD, 50):
        monkeypatch.setattr(langid, "HELD", held)
        got = langid.fit(docs)
        for lang in "xy":
            found = np.sort(np.concatenate([langid.grams(t) for _, t, x in rows if x == lang]))
            assert got[lang] == langid.ranked(*langid.counted(found)).tolist()


def test_the_floor_is_from_the_scores_of_all_documents(spark):
    import numpy as np

    rows = [(i, "ab cab bac" if i % 5 else f"{'ab ' * (i % 7)}{'cd' * (i % 11)}{'ef' * (i % 3)}", "x") for i in range(5000)]
    docs = frame(spark, rows).repartition(3)
    model = langid.fit(docs)
    p = langid.Profiles(model)
    scores = [s for lang, s in (p.predict(t) for _, t, _ in rows) if lang != "und"]
    assert abs(langid.floor(docs, model) - langid.SHARE * np.quantile(scores, langid.LEAST)) < 1e-12
    table = spark.createDataFrame([(float(x),) for x in scores], "score double")
    for share in (0.0, 0.001, 0.3, 0.77, 1.0):
        assert abs(langid.quantile(table, share) - np.quantile(scores, share)) < 1e-12
    assert langid.quantile(table.filter("score < 0"), 0.5) == 0.0
