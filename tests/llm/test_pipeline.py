from collections import Counter

import corpus_pipeline
from palimpsest.llm import toxicity
from tests.llm.conftest import frame
from tests.llm.test_dedup import brute, fingerprint
from tests.llm.test_langid import plain_query
from tests.llm.test_packing import best_fit


def stages(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        yield name, docs, out
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_stages_against_brute_force(spark, sf, docs):
    for name, before, after in stages(spark, docs, sf):
        rows, left = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert Counter(left) <= Counter(rows)
        ids = {r.doc_id for r in left}
        if name == "language_id":
            told = {d: (lang, score) for d, _, lang, score in plain_query([(r.doc_id, r.text, r.lang) for r in rows], None)}
            fitting = sorted(told[r.doc_id][1] for r in rows if r.lang is not None and r.text and told[r.doc_id][0] != "und")
            at = 0.001 * (len(fitting) - 1)
            least = 0.55 * (fitting[0] + (fitting[1] - fitting[0]) * at)
            assert 0 < at < 1 and ids == {d for d, (lang, score) in told.items() if lang != "und" and score >= least}
        elif name == "toxicity":
            model = toxicity.learnt(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {r.doc_id for r in rows} - {r.doc_id for r in toxicity.scores(before, model).collect() if r.predicted}
        elif name == "exact_dedup":
            groups = {}
            for r in sorted(rows, key=lambda r: (-len(r.text), r.doc_id)):
                groups.setdefault("".join(r.text.split()), r.doc_id)
            assert ids == set(groups.values())
        elif name == "near_dedup":
            labels = brute([fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
            assert ids == set(labels)
        else:
            assert ids == {r.doc_id for r in rows}
            assert len({r.sequence_id for r in left}) == best_fit([r.length for r in left], 2048)


def test_odd_rows(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    last = [(name, after.collect()) for name, _, after in stages(spark, docs, sf)]
    assert [n for n, _ in last] == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]
    kept = last[3][1]
    assert len({r.doc_id for r in kept}) == len(kept)


def test_empty_table(spark, empty, sf):
    for _, _, after in stages(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), sf):
        assert after.collect() == []


def test_rows_of_one_doc_id_are_one_document(spark, sf):
    docs = frame(spark, [(1, "one two three four", "en"), (1, "one two three four", "en"), (2, "one  two three four", "en")])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert [r.doc_id for r in corpus_pipeline.exact(spark, docs, sf).collect()] == [2]


def test_rows_without_or_with_one_doc_id_are_told_apart_by_their_texts(spark, sf):
    texts = ["one two three four five", "a river of stone beneath the tall old bridge", "green tables for every school garden", "numbers that nobody wrote down before noon"]
    ids = [None, None, 7, 7]
    docs = frame(spark, [*((i, t, "en") for i, t in zip(ids, texts)), (None, texts[0], "en"), (None, texts[0], None), (7, texts[2] + " ", "en"), (8, texts[3] + "  ", "en")])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    want = [("None", texts[0]), ("None", texts[1]), ("7", texts[2] + " "), ("8", texts[3] + "  ")]
    left = corpus_pipeline.exact(spark, docs, sf)
    assert left.columns == docs.columns
    assert Counter((str(r.doc_id), r.text) for r in left.collect()) == Counter(want)
    want = [("None", texts[0]), ("None", texts[1]), ("7", None), ("7", texts[3])]
    near = [(str(r.doc_id), r.text if r.text.strip() != texts[2] else None) for r in corpus_pipeline.near(spark, docs, sf).collect()]
    assert Counter(near) == Counter(want)
