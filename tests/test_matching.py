"""The automaton against plain searches."""

import random
import re

import numpy as np
import pytest

from sievewright.operators import matching, records


def everywhere(text: bytes, markers):
    return sorted((i, k) for k, m in enumerate(markers) for i in range(len(text)) if text.startswith(m, i))


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_plain_search(seed, monkeypatch):
    rng = random.Random(seed)
    letters = [b"ab", b"abc", "가나ab".encode()][seed % 3]
    monkeypatch.setattr(matching, "STRIPS", rng.choice([1, 3, 50]))
    markers = list({bytes(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))})
    text = bytes(rng.choice(letters) for _ in range(rng.randrange(3000)))
    start, marker = matching.Automaton(markers).search(np.frombuffer(text, np.uint8))
    assert sorted(zip(start.tolist(), marker.tolist(), strict=True)) == everywhere(text, markers)


def test_markers_of_texts(spark):
    rng = random.Random(1)
    words = ["gpt", "gpt-4", "dall-e", "dall-e 3", "the", "混元", "混元x", "sd3", "e 3 the", "'", "xgpt", "ÀB"]
    texts = [None, "", "gpt", "GPT-4!", "agpt", "gpt4"] + [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(400)] + ["x" * 300_000 + " dall-e 3", "gp", "t"]
    lexicon = [(f"t{i % 4}", w.lower()) for i, w in enumerate(words)] + [("t9", "gpt"), ("t9", None), ("t9", ""), (None, "the")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.tool, r.marker) for r in records.marker_hits(docs, spark.createDataFrame(lexicon, "tool string, marker string"), "doc_id", "text").collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for tool, m in {(tool, m) for tool, m in lexicon if m}:
            if re.search(rf"(?<![a-z0-9]){re.escape(m)}(?![a-z0-9])", low) if m.isascii() else m in low:
                want.append((i, tool, m))
    assert got == sorted(want, key=repr)
    assert records.marker_hits(docs, spark.createDataFrame([], "tool string, marker string"), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        matching.Automaton([b"a", b""])


def test_counts_of_lists(spark):
    rng = random.Random(2)
    lists = {"a": ("aa", "ab", "b", "b"), "b": ("aba", "aa"), "c": ("zz",)}
    texts = [None, "", "aaaa", "aaa", "ababab"] + ["".join(rng.choice("ab ") for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    from pyspark.sql import functions as F

    got = {r.i: r.x for r in df.select("i", matching.counted(spark, lists)(F.col("text")).alias("x")).collect()}
    for i, t in enumerate(texts):
        for name, own in lists.items():
            assert (got[i][f"{name}_kinds"], got[i][f"{name}_times"]) == (sum(m in (t or "") for m in own), sum((t or "").count(m) for m in own))


def test_overlaps_of_a_marker_need_no_loop():
    """Every marker's places from the left without overlap, in a few lines run however many there are."""
    import sys

    rng = np.random.default_rng(2)
    lengths = np.array([1, 2, 3, 7])
    row, marker, start = rng.integers(0, 40, 30_000), rng.integers(0, 4, 30_000), rng.integers(0, 900, 30_000)
    row, marker, start = np.unique(np.stack([row, marker, start]), axis=1)
    want, last = [], {}
    for r, m, s in zip(row.tolist(), marker.tolist(), start.tolist(), strict=True):
        if s >= last.get((r, m), 0):
            want.append((r, m))
            last[r, m] = s + int(lengths[m])
    mixed = rng.permutation(len(row))
    assert list(zip(*map(np.ndarray.tolist, matching._apart(row[mixed], marker[mixed], start[mixed], lengths)), strict=True)) == want
    n, lines = 1 << 12, []

    def traced(frame, event, arg):
        lines.append(event)
        return traced

    sys.settrace(traced)
    try:
        kept, _ = matching._apart(np.zeros(n, int), np.ones(n, int), np.arange(n), np.array([1, 2]))
    finally:
        sys.settrace(None)
    assert len(kept) == n // 2 and len(lines) < n // 4
