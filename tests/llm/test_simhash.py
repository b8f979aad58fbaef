import re
from itertools import combinations

import xxhash

from sievewright.llm import simhash
from sievewright.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, key string, component string"


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            parent[root(i)] = root(j)
    out = []
    for i in range(len(ids)):
        same = [ids[j] for j in range(len(ids)) if root(j) == root(i) and ids[j] is not None]
        out.append(min(same) if same else None)
    return out


def test_odd_texts_against_brute_force(spark):
    base = "One two  three four\tfive SIX seven Ünder ÉTÉ eight nine ten " * 3
    texts = [None, "", "   ", "one", "one two", "One  TWO", base, base, base + "x", "a b c " * 30000, "\x0b\x0c", "ÄÖ ü", base.replace("five", "5")]
    rows = [(i if i != 7 else None, t, "f", "k", "c") for i, t in enumerate(texts)] + [(3, "one", "f", "k", "c")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps), strict=True), key=repr)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in out), key=repr) == want


def test_links_of_full_and_small_buckets_agree(spark):
    import random

    rng = random.Random(4)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(3)))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(sorted(signed), [f & (1 << 64) - 1 for f in sorted(signed)])
    for limit in (1, 5, 10**6):
        roots = {r.node: r.root for r in connected_components(simhash.links(df, bucket_limit=limit)).collect()}
        assert [roots.get(f, f) for f in sorted(signed)] == want


def test_components_of_chains_cycles_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}, **{i: 5000 for i in (5000, 5001, 5002)}}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
