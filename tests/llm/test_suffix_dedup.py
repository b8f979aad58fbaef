import random

import numpy as np

from sievewright.llm import suffix_dedup


def brute(rows, length, keep):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    order = range(len(rows))
    for r in order:
        for p in range(len(texts[r]) - length + 1):
            seen.setdefault(texts[r][p : p + length], []).append((r, p))
    flags = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for r, p in places if keep == "none" else sorted(places)[1:]:
                flags[r][p : p + length] = True
    out = []
    for (i, _), t, f in zip(rows, texts, flags, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[0, f.astype(int), 0]))
        spans = [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        out.append((i, len(t), int(f.sum()), spans, np.frombuffer(t, np.uint8)[~f].tobytes()))
    return out


def corpus(rng, length):
    letters = "abcdefghij éß"
    prose = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [prose(n) for n in (length // 2, length, length + 3, 3 * length, 8 * length)]
    texts = [None, "", "x", prose(length), "a" * (3 * length), "ab" * 2 * length, "line one\n" * length]
    for _ in range(14):
        parts = [prose(rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a:], prose(rng.randint(0, length))]
        texts.append("".join(parts))
    texts += [texts[7]] * 3 + [texts[8][:50] + "!" + texts[8][51:]]
    return texts


def test_against_brute_force(spark):
    for seed, length in ((1, 40), (2, 64), (3, 33)):
        rng = random.Random(seed)
        rows = list(enumerate(corpus(rng, length)))
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, th string, a int")
        for keep in ("none", "first"):
            want = brute(rows, length, keep)
            for limit in (1000, 1):  # suffix order, window counts
                got = suffix_dedup.remove_repeats(df, min_bytes=length, keep=keep, group_limit=limit, columns=("th", "a")).collect()
                assert {(r.th, r.a) for r in got} == {("x", 1)}
                assert sorted((r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == want


def test_odd_rows(spark):
    text = "".join(chr(0xC0 + i) for i in range(60)) + "plain" + "".join(chr(0x100 + i) for i in range(60))
    rows = [(1, text), (1, text), (None, text + "q"), (None, None), (4, "x" + text[3:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = suffix_dedup.remove_repeats(df, min_bytes=40, keep="none").collect()
    assert len(none) == 5 and sum(r.n_removed == r.n_bytes for r in none if r.doc_id == 1) == 2
    first = suffix_dedup.remove_repeats(df, min_bytes=40, keep="first", whole_letters=True).collect()
    assert len(first) == 5
    for r in first:
        bytes(r.kept).decode()
    assert sorted(r.n_removed > 0 for r in first) == [False, False, True, True, True]  # the null id comes first and stays
    assert suffix_dedup.remove_repeats(df.limit(0), min_bytes=40).collect() == []


def test_passages_are_counted_beside_bytes(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40)) for _ in range(4)]
    cut = lambda p: " ".join(p.split()[rng.randint(0, 12) : rng.randint(14, 40)])
    rows = [(i, " ".join(cut(rng.choice(pool)) + " " + str(rng.random()) for _ in range(rng.randint(1, 6)))) for i in range(50)] + [(90, None), (91, "a b"), (92, pool[0]), (92, pool[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("none", "first"):
        both = suffix_dedup.remove_repeats(df, min_bytes=120, keep=keep, passages_of=8).collect()
        plain = suffix_dedup.remove_repeats(df, min_bytes=120, keep=keep).collect()
        words = suffix_dedup.remove_repeats(df, min_words=8, keep=keep).collect()
        assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in both) == sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in plain)
        assert sorted((r.doc_id, r.n_passage) for r in both) == sorted((r.doc_id, r.n_removed) for r in words)
        assert any(r.n_passage and not r.n_removed for r in both)


def test_previous_factor_of_a_text():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 300).astype(np.uint8)
    for depth in (8, 11, 16, 30):
        at = np.arange(len(text) - depth + 1)
        got = suffix_dedup.reaches(suffix_ranks := suffix_dedup.suffix_ranks(text, at, depth), at)
        raw = text.tobytes()
        assert got.tolist() == [raw[p : p + depth] in (raw[q : q + depth] for q in range(p)) for p in at]
        order = sorted(at, key=lambda p: raw[p : p + depth])
        assert [suffix_ranks[p] for p in order] == sorted(suffix_ranks)
