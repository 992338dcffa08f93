import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from palimpsest.llm import exactdedup, simhash
from tests.llm.conftest import frame


def test_exact_dedup_is_the_sql(docs, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    want = sorted(con.sql(f"select {cols} from ({exactdedup.ORACLE})").fetchall())
    assert sorted(map(tuple, exactdedup.groups(docs).select(*cols.split(", ")).collect())) == want


@pytest.mark.parametrize("window", [1, 8_000_000])
def test_exact_dedup_of_odd_rows(odd, monkeypatch, window):
    monkeypatch.setattr(exactdedup, "WINDOW", window)
    groups = defaultdict(list)
    for doc_id, text in odd.select("doc_id", "text").collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = Counter()
    for norm, g in groups.items():
        for i, (*_, doc_id) in enumerate(sorted(g)):
            want[doc_id, min(g)[3], len(g), i == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    got = exactdedup.groups(odd).collect()
    assert sum(r.kept for r in got) == len(groups)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((k[0], k[1], k[2], k[4]) for k in want.elements())


def test_a_group_of_very_many_copies_has_a_row_for_each_window(spark):
    rows = [(i, "hot  text" if i % 3 else "hot text", None) for i in range(4000)] + [(i, f"cold {i}", None) for i in range(4000, 4400)]
    df = frame(spark, rows).repartition(2)
    folded = exactdedup.fold(df, []).filter("norm = binary('hottext')").collect()
    assert len(folded) <= 2 and sum(len(r.members) for r in folded) == 4000
    got = exactdedup.groups(df).collect()
    assert len(got) == 4400 and sum(r.kept for r in got) == 401
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 4000} == {(1, 4000)}


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(fps))]


def test_near_duplicates(odd, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        fps = [fingerprint(r.text or "") for r in rows]
        want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], brute(fps, [r.doc_id for r in rows])))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want


@pytest.mark.parametrize("together", [1, 50_000])
def test_links_and_components_of_clusters(spark, monkeypatch, together):
    """Chains, dense clusters, lists that go on over batches, and both signs."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    import random

    rnd = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(120):
            centre ^= (1 << rnd.randrange(64)) if rnd.random() < 0.2 else 0
            fps.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 2))))
    fps = sorted(fps)
    want = {tuple(sorted((a, b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3))
    assert got.count() == len(want)
    assert {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in got.collect()} == want
    labels = {r.node: r.label for r in simhash.components(got).collect()}
    comp = brute(fps, signed)
    for f, c in zip(signed, comp):
        assert labels.get(f, f) == c


def test_a_list_of_all_its_members():
    """Every value of two bytes, the others equal: 65,536 fingerprints in one list."""
    import numpy as np

    n = np.arange(65536, dtype=np.uint64)
    a, b = simhash.verified(np.zeros(65536, int), np.full(65536, simhash.OPEN.index((0, 5))), n & np.uint64(0xFF) | n >> np.uint64(8) << np.uint64(40))
    # 64 neighbours with a bit in each byte; 36 with bits in byte 5 alone, which this list reports; those in byte 0 alone are another's.
    assert len(a) == 65536 * (64 + 36) // 2
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)
    assert np.bitwise_count(a ^ b).max() == 2


def test_every_node_has_a_label(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (9, 5), (-4, 7), (3, -4)], "a long, b long")
    want = [(-4, -4), (0, 0), (1, 0), (2, 0), (3, -4), (5, 5), (7, -4), (9, 5)]
    assert sorted(map(tuple, simhash.components(edges).collect())) == want


def test_texts_that_differ_in_a_word_are_one_component(spark):
    """Linked but different fingerprints: whichever of them is the least, all rows have the smallest doc_id of all."""
    import random

    rnd = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(1500)]
        for i in rnd.sample(range(4), 4):
            at = rnd.randrange(1500)
            rows.append((4 * g + i, " ".join([*words[:at], f"other{i}", *words[at + 1 :]])))
    fps = [fingerprint(t) for _, t in rows]
    want = {d: c for (d, _), c in zip(rows, brute(fps, [d for d, _ in rows]))}
    assert sum(d != c for d, c in want.items()) > 5 and len(set(fps)) > 24
    got = simhash.near_duplicates(frame(spark, [(*r, None) for r in rows]).repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.label for r in simhash.components(edges).collect()} == {0}


def test_empty_tables(spark, empty):
    assert exactdedup.groups(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []
    assert frame(spark, []).count() == 0
