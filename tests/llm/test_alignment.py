"""Alignment against both libraries on whole texts and plain loops over token ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievewright.llm import alignment, common
from sievewright.llm.bpe import byte_letters

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def by_loops(texts, libraries):
    """The contract's columns for each text."""
    a, b = libraries
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        cuts = sorted({*ends_a} & {*ends_b})
        of = lambda ids, ends: [[i for i, e in zip(ids, ends, strict=True) if low < e <= high] for low, high in zip([0, *cuts[:-1]], cuts, strict=True)]  # noqa: B023, E731
        overlaps, spans_b = 0, list(zip([0, *ends_b[:-1]], ends_b, strict=True))
        for x, y in zip([0, *ends_a[:-1]], ends_a, strict=True):
            overlaps += sum(max(x, u) < min(y, v) for u, v in spans_b)
        found.append((ia, ib, list(zip(of(ia, ends_a), of(ib, ends_b), strict=True)), overlaps))
    links = [Counter((x, y) for ga, gb in f[2] for x in ga for y in gb) if f else Counter() for f in found]
    held = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for f, own in zip(found, links, strict=True):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        best = sum(n for pair, n in own.items() if held[pair] == most[pair[0]])
        out.append((len(f[0]), len(f[1]), len(f[2]), sum(own.values()), f[3], best, sum(n * held[pair] for pair, n in own.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    words = "the of and Straße naïve 12345 3.14 don't we'll <|endoftext|> <s> </s> <unk> <0x41> internationalisation foo_bar XMLHttp 東京都 한국어 привет नमस्ते 👩‍👩‍👧 é ́ ﻿ \x00 ▁ ᠎".split(" ")
    gaps = [" ", " ", " ", "  ", "   ", "\n", "\n\n", "\t", " \n ", "\n  ", "\r\n", " ", " ", "　", "\x1f", "\x85", "​", "᠎", "", "."]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x20000), rng.randrange(32, 127)])) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256")


def test_equals_loops(spark, libraries):
    texts = [None, "", " ", "a", " a", "a ", "  ", "\n", "a▁b", "x" * 500, "ab " * 5000, "—" * 300, *random_texts(400, 5)]
    rows = list(enumerate(texts)) + [(None, "the cat"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS chunk", "2 AS pairs")
    got = alignment.aligned(df.repartition(6), A_PATH, B_PATH, keep_groups=True).collect()
    want = by_loops([t for _, t in rows], libraries)
    key = lambda rows: sorted(rows, key=repr)
    assert key((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == key((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert sum(w[0] == 0 for w in want) > 5 and sum(w[0] > 0 for w in want) > 400
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 or r.groups == r.groups_sha256 == "" for r in got)


def test_small_chunks_and_forgetting(spark, libraries, monkeypatch):
    texts = random_texts(60, 8)
    tokenizers = alignment.Tokenizers(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    assert tokenizers.cuts
    whole = alignment._chunk(tokenizers, texts, True)
    monkeypatch.setattr(alignment, "KEEP_SEGMENTS", 3)
    monkeypatch.setattr(alignment, "JOINED_LETTERS", 40)
    monkeypatch.setattr(alignment, "PRODUCTS", 7)
    tokenizers.reset()
    parts = [alignment._chunk(tokenizers, texts[i : i + 11], True) for i in range(0, len(texts), 11)]
    assert [g for p in parts for g in p["groups"]] == whole["groups"]
    assert [n for p in parts for n in p["n_links"]] == list(whole["n_links"])
    tokenizers.cuts = False  # whole texts instead of segments
    tokenizers.reset()
    assert alignment._chunk(tokenizers, texts, True)["groups"] == whole["groups"]


def test_links_stay_in_small_row_groups(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6000)]
    texts = ["a"] * 40 + [" ".join(rng.choices(words, k=12_000)) for _ in range(50)]  # small rows first, so that no guess from them serves
    tables = []
    monkeypatch.setattr(alignment, "written", lambda *a, **b: tables.append(common.written(*a, **b)) or tables[-1])
    monkeypatch.setattr(common, "WIDE_GROUP_BYTES", 1 << 17, raising=False)
    monkeypatch.setattr(alignment, "LINK_CHUNK_BYTES", 1)  # each text is a row
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert alignment.aligned(df, A_PATH, B_PATH).where("n_links > 0").count() == len(texts)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tables[0].inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == len(texts)
    assert sum(g.total_byte_size for g in groups) > 4 << 17
    assert all(g.total_byte_size <= 2 << 17 for g in groups)


def test_empty(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_product_equals_numpy():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (13, 9)) * (rng.random((13, 9)) < 0.4), rng.integers(0, 3, (7, 9)) * (rng.random((7, 9)) < 0.4)

    def csr(m):
        row, column = np.nonzero(m)
        return alignment.Csr(np.searchsorted(row, np.arange(len(m) + 1)), column, m[row, column])

    got = csr(a).times(csr(b).transposed(9), 7)
    dense = np.zeros((13, 7), int)
    dense[np.repeat(np.arange(13), np.diff(got.starts)), got.at] = got.counts
    assert (dense == a @ b.T).all()
