import os
import random
import re

import pytest

from sievewright.llm import licenses


def test_alignment_is_increasing_and_finds_anchors():
    a, b = "x the a b c the d y".split(), "the a b q the d".split()
    assert [a[i] for i, _ in licenses.align(a, b)] == ["the", "a", "b", "the", "d"]
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[k] for i, k in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for k in range(len(b)):
                best[i + 1][k + 1] = best[i][k] + 1 if a[i] == b[k] else max(best[i][k + 1], best[i + 1][k])
        assert len(pairs) <= best[-1][-1]
        unique = list(dict.fromkeys(a))
        assert len(licenses.align(unique, unique)) == len(unique)


def test_planted_notices(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "of", "is", "under", "this", "work", "erst", "blion"]) for _ in range(n))
    t = licenses.TEMPLATES
    rows = [
        (1, None, []), (2, "", []), (3, prose(500), []),
        (4, prose(40) + "\n" + t["MIT"] + "\n" + prose(30), ["MIT"]),
        (5, t["GPL-3.0"].upper() + " " + prose(5000) + " " + t["CC-BY-NC-4.0"], ["GPL-3.0", "CC-BY-NC-4.0"]),
        (6, prose(9) + " " + t["MIT-text"].replace("person", "human").replace("associated", "its") + " " + prose(9), ["MIT-text"]),
        (7, t["Apache-2.0-header"] + prose(20), ["Apache-2.0-header"]),
        (None, (t["Apache-2.0"] + " " + prose(30) + " ") * 3, ["Apache-2.0"] * 3),
        (9, "mit license under", []),
    ]
    df = spark.createDataFrame([(i, x, "n") for i, x, _ in rows] + [(4, rows[3][1], "n")], "doc_id long, text string, notices string")
    got = [(r.doc_id, [n.license for n in r.notices]) for r in licenses.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, w) for i, _, w in rows] + [(4, ["MIT"])], key=repr)
    assert licenses.scan(df.limit(0)).collect() == []
    assert all(not r.notices for r in licenses.scan(df, templates={}).collect())


def longest_common(a, b):
    """Length of the longest common subsequence, row by row."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_every_gap_with_a_common_word_is_aligned():
    assert len(licenses.align("a b a b".split(), "b a b a".split())) == 3
    assert licenses.align("x a a y".split(), "q a a a r".split()) == [(1, 1), (2, 2)]
    rng = random.Random(3)
    got = best = 0
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 30))] for _ in range(2))
        pairs, most = licenses.align(a, b), longest_common(a, b)
        assert len(pairs) <= most and (len(pairs) > 0) == (most > 0)
        got, best = got + len(pairs), best + most
    assert got > 0.8 * best


def test_scan_against_every_window(spark):
    """Damaged bodies in prose: notices are where a window at any word has them, by longest common subsequence."""
    rng = random.Random(5)
    usual = [w for t in licenses.TEMPLATES.values() for w in licenses.words(t)]
    found = there = 0
    for name in ("MIT-body", "BSD-3-Clause", "Zlib", "GPL-3.0-notice", "ISC-body"):
        template = licenses.words(licenses.TEMPLATES[name])
        for damage in (0.0, 0.05, 0.1, 0.15, 0.19, 0.35):
            body = []
            for w in template:
                r = rng.random()
                body += [] if r < damage / 2 else [rng.choice(usual)] if r < damage else [w]
                body += rng.choices(usual, k=rng.randint(1, 4)) if rng.random() < 0.15 else []
            doc = rng.choices(usual, k=rng.randint(0, 300)) + body + rng.choices(usual, k=rng.randint(0, 300))
            most = max(longest_common(doc[i : i + 2 * len(template)], template) for i in range(0, len(doc), 25)) / len(template)
            got = [c for c, _, _ in licenses.scan_words(doc, template, 0.8)]
            assert all(c <= most + 0.1 for c in got)  # every 25th window
            if most >= 0.83:
                there, found = there + 1, found + bool(got)
            if most < 0.7:
                assert not got
    assert there >= 15 and found >= 0.9 * there, (found, there)


def test_bodies_stand_apart(spark):
    rows = [(name, "/* Copyright (c) 2020 Someone. All rights reserved.\n * " + text.replace(". ", ".\n * ") + " */\nint main() { return 0; }\n" * 9) for name, text in licenses.BODIES.items()]
    got = {r.doc_id: [n.license for n in r.notices] for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: [name] for name in licenses.BODIES}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_lines_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: {n.license for n in r.notices} for r in licenses.scan(docs).collect()}
    lines = {"Apache-2.0": "apache license version 2 0", "GPL-3.0": "gnu general public license version 3", "CC-BY-NC-4.0": "under cc by nc 4 0", "MIT": "released under the mit license"}
    for r in docs.collect():
        text = " " + " ".join(licenses.words(r.text)) + " "
        assert got[r.doc_id] == {name for name, line in lines.items() if f" {line} " in text} or not re.search("licen[cs]e", text) and not got[r.doc_id], r.doc_id
