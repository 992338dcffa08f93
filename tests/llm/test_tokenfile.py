import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import common, subword, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(path=PATH):
    return Tokenizer.from_file(path)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip(odd, docs):
    for df in (odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        rows, want, start = sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), [], 0
        for doc_id, text in rows:
            ids = [*library().encode(text, add_special_tokens=False).ids, 2]
            want.append((doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        assert sorted(map(tuple, tokenfile.round_trip(df, PATH).collect())) == want


def test_starts_have_no_gap_with_nulls_and_repeated_rows(odd):
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in tokenfile.round_trip(odd, PATH).collect())
    assert len(rows) == odd.count()
    assert [r[0] for r in rows] == [0, *np.cumsum([r[1] for r in rows]).tolist()[:-1]]
    assert [r[2] for r in rows[:2]] == [None, None]


def test_sequences_and_masks(spark, docs):
    folder = common.work_path(spark, "test-ids")
    index = tokenfile.write(docs, folder, PATH)
    for shard in {r.shard for r in index.collect()}:
        reader, ids = tokenfile.ShardReader(folder, shard), []
        total = sum(r.n_tokens for r in index.filter(f"shard = {shard}").collect())
        for s in range(-(-total // tokenfile.SEQUENCE)):
            values, mask = reader.sequence(s)
            assert len(values) == len(mask) == tokenfile.SEQUENCE
            ids += values[mask].tolist()
        assert len(ids) == total and ids == reader.span(0, total).tolist()


def test_empty_table(empty):
    assert tokenfile.round_trip(empty, PATH).collect() == []


def test_chunks_give_the_ids_of_whole_texts():
    for kind, name in (("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")):
        path = public_tokenizers.path(name)
        made = ["a  b", " a", "a ", "a\n b", "a\n  b c", "x y z", "it's 's", "a　 b", "\x1c a\x1cb", "e ́e", "<|endoftext|> a", "\n\na b\n"]
        made += ["see (above) here", "see (above), and then", "a - b", "a -, b"]
        ids, each = subword.tokenizer(kind, path).encode(made)
        assert ids.tolist() == [i for t in made for i in library(path).encode(t, add_special_tokens=False).ids]


SIGNS = [*"abcdeT  \n.,;:!?()-\"'*&19é世́Σ\t 　", "the", "And", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " .", "\x1c", "\x85", "st", " ß", "ﬁ"]


@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize("kind, name", [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")])
def test_one_warm_tokenizer_on_random_punctuation(kind, name, specials):
    path, rnd = public_tokenizers.path(name), random.Random(5)
    plain, own = library(path), subword.tokenizer(kind, path, specials)
    plain.encode_special_tokens = not specials
    for _ in range(20_000):
        text = "".join(rnd.choices(SIGNS, k=rnd.randint(0, 30)))
        assert own.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids, text
