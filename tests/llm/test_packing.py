import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from palimpsest.llm import packing
from tests.llm.test_tokenfile import library

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(size)
            fit = len(bins) - 1
        bins[fit] -= n
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    size = rnd.choice([10, 37, 100])
    lengths = [rnd.randint(1, size) if seed % 2 else min(size, 1 + int(rnd.expovariate(6 / size))) for _ in range(rnd.randint(0, 400))]
    bins = defaultdict(list)
    seen = Counter()
    for length, rank, n, per, first, offset in sorted(packing.plan(Counter(lengths), size)):
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            bins[first + i // per].append((offset + i % per * length, length))
    assert seen == Counter(lengths)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) == best_fit(lengths, size)


def test_plan_does_not_grow_with_counts():
    small = packing.plan({i: 10**3 for i in range(1, 2049)})
    large = packing.plan({i: 10**9 for i in range(1, 2049)})
    assert len(large) < 2 * len(small) + 10_000


@pytest.mark.parametrize("size", [2048, 16])
def test_pack(odd, docs, size):
    for df in (odd, docs):
        want = Counter()
        for doc_id, text in df.select("doc_id", "text").collect():
            ids = [*library(PATH).encode(text or "", add_special_tokens=False).ids, 0]
            count = -(-len(ids) // size)
            cuts = [0, *(len(ids) - (count - 1 - k) * size for k in range(count))]
            for k in range(count):
                part = ids[cuts[k] : cuts[k + 1]]
                want[doc_id, k, cuts[k], len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        rows = packing.pack(df, PATH, size=size).collect()
        assert Counter(tuple(r[:5]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= size
        assert len(bins) == best_fit([r.length for r in rows], size)


def test_empty_table(empty):
    assert packing.pack(empty, PATH).collect() == []
