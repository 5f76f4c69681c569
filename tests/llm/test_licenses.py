import random
from collections import Counter

import pytest

from strandlake.llm import licenses


def brute_best(text, template, t):
    """Best Dice of any run of bigrams with one template."""
    words, parts = licenses.normalised(text or ""), licenses.normalised(template)
    pairs, want = list(zip(words, words[1:])), Counter(zip(parts, parts[1:]))
    best = 0.0
    for i in range(len(pairs)):
        have = Counter()
        for j in range(i, len(pairs)):
            have[pairs[j]] += 1
            best = max(best, 2 * (have & want).total() / (want.total() + j - i + 1))
    return best if best >= t else None


TEXTS = [
    "Before. Released under the MIT License. After it.",
    "released under\nthe  M.I.T. license, or so",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY-SA 4.0; licensed under the apache licence version 2.0; This work is licensed under the GNU General Public License, version 3.",
    "the the the of under the license under the mit the mit license under the mit license",
    "nothing here",
    licenses.TEMPLATES["MIT"][2][:700],
    "x " + licenses.TEMPLATES["ISC"][1].replace("software", "program") + " y",
]


@pytest.mark.parametrize("text", TEXTS)
def test_best_passage_against_all_passages(text):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = {}
    for name, dice, _, _ in scanner.matches(text):
        found[name] = max(found.get(name, 0), dice)
    every = {n: max((d for x in ts if (d := brute_best(text, x, 0.8))), default=None) for n, ts in licenses.TEMPLATES.items()}
    every = {n: d for n, d in every.items() if d}
    assert bool(found) == bool(every)
    if found:
        assert max(found.values()) == pytest.approx(max(every.values()))
        assert all(d == pytest.approx(every[n]) for n, d in found.items())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    some = 0
    for r in docs.collect():
        want = {v for k, v in notices.items() if k in (r.text or "")}
        assert want <= {m.license for m in got[r.doc_id].matches}
        some += bool(want)
        if not want and "icen" not in (r.text or "").lower():
            assert got[r.doc_id].n_matches == 0
    assert some > 5


def test_edges(spark):
    schema = "doc_id long, text string, license string, dice int"
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, None), (1, ""), (1, ""), (2, "word"), (3, "MIT " * 50_000), (4, "under the mit license " * 9)]
    got = licenses.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)).collect()
    assert len(got) == 6 and [r.n_matches for r in got if r.doc_id != 4] == [0] * 5
    assert [r.license for r in got if r.doc_id == 4] == ["MIT"]


def brute_matches(text, templates, t):
    """Of all passages of all templates the best, then the best of those that do not overlap it, and so on."""
    words = licenses.normalised(text)
    pairs, every = list(zip(words, words[1:])), []
    for name, parts in ((n, licenses.normalised(x)) for n, xs in templates.items() for x in xs):
        want = Counter(zip(parts, parts[1:]))
        for i in range(len(pairs)):
            have = Counter()
            for j in range(i, len(pairs)):
                have[pairs[j]] += 1
                dice = 2 * (have & want).total() / (want.total() + j - i + 1)
                if dice >= t:
                    every.append((-dice, -want.total(), i, name, j + 1))
    kept = []
    for dice, _, first, name, last in sorted(every):
        if all(last < a or first > b for _, _, a, b in kept):
            kept.append((name, -dice, first, last))
    return kept


GPL = "This work is licensed under the GNU General Public License, version 3. Words between. This work is licensed under the GNU General Public License v2 or so."


def test_every_passage_of_a_template():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert [m[0] for m in scanner.matches("Released under the MIT License. Some words. " * 3)] == ["MIT"] * 3
    assert [m[0] for m in scanner.matches(GPL)] == ["GPL-3.0", "GPL-2.0"]
    some = {n: [x for x in xs if len(x) < 100] for n, xs in licenses.TEMPLATES.items()}
    rng = random.Random(5)
    words = "licensed under the mit license gnu general public version 3 2 cc by sa 4 0 released this work is x y".split()
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    notices = [x for xs in some.values() for x in xs]
    for _ in range(12):
        mixed = " ".join(rng.choices(notices, k=5)).split()
        texts.append(" ".join(rng.choice(words) if rng.random() < 0.08 else w for w in mixed))
    for text in [GPL, *texts]:
        for t in (0.8, 0.6):
            got, want = licenses.Scanner(some, t).matches(text), brute_matches(text, some, t)
            assert got == [(n, pytest.approx(d), a, b) for n, d, a, b in want]


def test_a_notice_many_times():
    text = "Licensed under the Apache License, Version 2.0. Next part. " * 3000
    assert len(licenses.Scanner(licenses.TEMPLATES).matches(text)) == 3000


CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""


def test_near_licences_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert [m[:2] for m in scanner.matches(f"Foo 1. {text} Bar.")] == [(name, 1.0)]
    disclaimer = licenses.TEMPLATES["BSD-2-Clause"][1].partition("THIS SOFTWARE")
    assert [m[0] for m in scanner.matches(CLAUSES + "".join(disclaimer[1:]))] == ["BSD-3-Clause"]
    notice = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    for what in ("library", "program", "tool"):
        for kind, version, name in (("Lesser", "3", "LGPL-3.0"), ("Lesser", "2.1", "LGPL-2.1"), ("Library", "2", "LGPL-2.0"), ("", "3", "GPL-3.0"), ("", "2", "GPL-2.0"), ("Affero", "3", "AGPL-3.0")):
            assert [m[0] for m in scanner.matches(notice.format(what, kind, version))] == [name]
    lgpl = "This work is licensed under the GNU Lesser General Public License, version {}."
    assert [m[0] for m in scanner.matches(lgpl.format("2.1") + " Words. " + lgpl.format("3"))] == ["LGPL-2.1", "LGPL-3.0"]
