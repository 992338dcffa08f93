import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from palimpsest.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_and_every_code_point_encode_as_the_library_does():
    rnd, signs = random.Random(3), "a b's\n'\t1é. vrelmd  x!\U0001f600 ́"
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    made += ["".join(f"x{c}1{c} {c}" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    ids, each, _ = bpe.vocabulary(PATH).encode(made)
    at, enc = 0, library()
    for text, n in zip(made, each.tolist()):
        assert ids[at : at + n].tolist() == enc.encode_ordinary(text)
        at += n


def test_long_pieces_merge_like_short_ones():
    v = bpe.Vocabulary(PATH)
    for piece in (b"ab" * 400, bytes(range(256)), b"thethethe" * 30, b"a" * 999):
        assert v._merge_long(piece) == library()._encode_bytes(piece) if piece in v.ranks else v._merge_long(piece) == library()._core_bpe.encode_single_piece(piece)


def expected(rows):
    enc = library()
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        yield doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def key(row):
    return tuple((x is not None, x) for x in row)


def test_digests(odd, docs):
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, bpe.digests(df, PATH).collect()), key=key) == sorted(expected(rows), key=key)


def test_offsets_cut_the_text(odd):
    for r in bpe.decode(bpe.encode(odd, PATH), PATH).collect():
        assert (r.ends[-1] if r.ends else 0) == len(r.bytes)
        assert r.ends == sorted(r.ends)


def test_decoding_goes_by_the_offsets():
    v = bpe.vocabulary(PATH)
    made = ["one two  three", "", "\U0001f600 été", "x" * 300]
    ids, each, until = v.encode(made)
    order = [j for lo, n in zip((each.cumsum() - each).tolist(), each.tolist()) for j in random.Random(1).sample(range(lo, lo + n), n)]
    for o in (list(range(len(ids))), order):
        data, sizes = v.decode(ids[o], each, until[o])
        assert data.tobytes() == "".join(made).encode() and sizes.tolist() == [len(t.encode()) for t in made]


def test_empty_table(empty):
    assert bpe.digests(empty, PATH).collect() == []
