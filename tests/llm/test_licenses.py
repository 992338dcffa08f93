import random
import textwrap
from collections import Counter

import pytest

from palimpsest.llm import licenses
from tests.llm.conftest import frame


def brute(text):
    """Every template against every line, by the longest common subsequence of words; no compression."""
    scanner = licenses.Scanner()
    for k, line in enumerate(text.split("\n")):
        found = licenses.words(line)
        best = None
        for name in scanner.names:
            if (c := scanner.compare(name, found)) and (best is None or c[0] > best[1]):
                best = (name, c[0])
        if best:
            yield k, best[0]


def test_finds_what_a_full_comparison_finds(docs):
    want = Counter((r.doc_id, *hit) for r in docs.collect() for hit in brute(r.text or ""))
    got = licenses.scan(docs).collect()
    assert len(want) > 3
    assert Counter((r.doc_id, r.line, r.license) for r in got) == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.exact:
            assert [w for w, _, _ in licenses.words(texts[r.doc_id][r.start : r.end])] == licenses.Scanner().wording[r.license]


@pytest.mark.parametrize(
    "text, license, differences",
    [
        ("x\nfoo bar. Released under the MIT License. Next words", "MIT", ""),
        ("LICENSED under CC  BY-NC 4.0", "CC-BY-NC-4.0", ""),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0", ""),
        ("This work was licensed under the GNU General Public License, version 3.", "GPL-3.0", "-is +was"),
        ("no licence here at all", None, None),
        ("the rights of man were reserved", None, None),
        ("\U0001f600 All rights reserved.", "Proprietary", ""),
    ],
)
def test_wording(text, license, differences):
    got = [(h[3], h[6]) for h in licenses.Scanner().scan(text)]
    assert got == ([(license, differences)] if license else [])


def test_own_dictionary_takes_off_the_most():
    s = licenses.Scanner()
    for name, text in s.texts.items():
        reduction, first = s.ranked(text)[0]
        assert reduction > 0 and s.texts[first].lower().startswith(text.lower()[:40])


def test_whole_notices_by_a_plain_search(docs):
    """Independent of the scanner: every stretch of words that is a template's own is within a notice of at least its gain."""
    import re

    plain = {n: " " + " ".join(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t.lower())) + " " for n, t in licenses.TEMPLATES.items()}
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = 0
    for r in docs.collect():
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:[.-][^\W_]+)*", (r.text or "").lower())]
        joined = " " + " ".join((r.text or "").lower()[a:b] for a, b in spans) + " "
        for name, want in plain.items():
            at = joined.find(want)
            while at >= 0:
                seen += 1
                first = joined.count(" ", 0, at + 1) - 1
                lo, hi = spans[first][0], spans[first + want.count(" ") - 2][1]
                mine = [x for x in got.get(r.doc_id, []) if x.start < hi and x.end > lo]
                assert mine and (any(x.license == name and x.exact for x in mine) or any(x.end - x.start > hi - lo for x in mine))
                at = joined.find(want, at + 1)
    assert seen > 3


@pytest.mark.parametrize("name", ["BSD-2-Clause-full", "BSD-3-Clause-full", "GPL-2.0-or-later", "GPL-3.0-or-later", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MPL-2.0", "MPL-2.0-notice"])
def test_near_equal_templates_are_told_apart(name):
    assert found(f"a b c. {licenses.TEMPLATES[name]} d e f") == [(0, name, "")]


def test_odd_rows_and_empty_table(spark, odd, empty):
    assert licenses.scan(odd).collect() == []
    assert licenses.scan(empty).collect() == []
    row = (None, "All rights reserved.\n" * 2 + "x" * 100_000, None)
    assert [(r.doc_id, r.line, r.start) for r in licenses.scan(frame(spark, [row, row])).collect()] == [(None, 0, 0), (None, 1, 21)] * 2


MIT = licenses.TEMPLATES["MIT-full"]
GPL = licenses.TEMPLATES["GPL-3.0-or-later"]


def found(text):
    return [(h[0], h[3], h[6]) for h in licenses.Scanner().scan(text)]


def test_all_notices_of_a_long_line():
    assert found("Licensed under the Apache License, Version 2.0. All rights reserved.") == [(0, "Apache-2.0", ""), (0, "Proprietary", "")]
    filler = "the quick brown fox may use this software under other terms of the house " * 40
    names = sorted(n for n in licenses.TEMPLATES)
    text = filler + filler.join(licenses.TEMPLATES[n] + " " for n in names) + filler
    assert found(text) == [(0, n, "") for n in names]


def test_wrapped_notices():
    def wrapped(text, mark):
        return "\n".join(mark + x for x in textwrap.wrap(text, 60))

    text = f"{wrapped(MIT, ' * ')}\n\nint x;\n{wrapped(GPL, '# ')}\n"
    assert [x[1:] for x in found(text)] == [("MIT-full", ""), ("GPL-3.0-or-later", "")]
    assert found("a\n" + wrapped(licenses.TEMPLATES["MIT-text"], "// ").replace("hereby ", "")) == [(1, "MIT-text", "-hereby")]


def test_tags():
    assert found("// SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)\nx") == [(0, "MIT OR (Apache-2.0 AND BSD-3-Clause)", "")]
    assert found("a\n(SPDX-License-Identifier: GPL-2.0+). b") == [(1, "GPL-2.0+", "")]


def test_no_place_is_missed():
    """Against the least number of insertions and deletions of every stretch of words."""
    rnd = random.Random(3)
    scanner = licenses.Scanner()

    def differences(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] if x == y else 1 + min(last[j], row[j - 1]))
        return row[-1]

    for _ in range(60):
        name = rnd.choice([n for n in scanner.names if len(scanner.wording[n]) < 15])
        want = scanner.wording[name]
        have = [rnd.choice(want) for _ in range(rnd.randint(0, 8))]
        for w in want:
            have += [] if rnd.random() < 0.12 else [w, "odd"] if rnd.random() < 0.08 else [w]
        have += [rnd.choice(want) for _ in range(rnd.randint(0, 8))]
        least = min(differences(have[i:j], want) for i in range(len(have)) for j in range(i, len(have) + 1)) if have else len(want)
        got = [p[2] for lo, hi in scanner.near(have).get(name, []) for p in scanner.places(name, have[lo:hi])]
        assert bool(got) == (least <= scanner.most(name))
        assert not got or least <= min(got)
