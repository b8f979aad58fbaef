import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievewright.llm import token_counts
from sievewright.llm.bpe import load

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_random_edits_equal_a_full_count(library):
    rng = random.Random(9)
    counter = token_counts.Counter(load(PATH), keep=500)
    bits = ["the ", "don't", " 'll", "  ", "\n\n", "été", " 123", "日本", "!!", " x", "'", "s", "ve ", "\t", "a" * 90, "👍", " "]
    latin = [b for b in bits if b.isascii()] + ["ß²", " ½x", "\x85", "\xa0", "\x1c", "×÷", "ª º", "'é"]
    for k in range(120):
        bits = latin if k % 2 else [*latin, "日本", "👍", "ǆ", "Ⅷ"]
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 300, 900])))
        words = counter.pattern.findall(text)
        tree = token_counts.build(words, counter.counts(words))
        assert tree.tokens == library(text)
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 200, len(text)]))
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 1, 2, 80])))
            text, _ = token_counts.edit(tree, text, a, b, new, counter)
            assert (tree.tokens, tree.letters) == (library(text), len(text))


def test_small_edits_encode_little(library):
    counter = token_counts.Counter(load(PATH))
    text = "some words of a long text " * 4000
    words = counter.pattern.findall(text)
    tree = token_counts.build(words, counter.counts(words))
    text, encoded = token_counts.edit(tree, text, 50001, 50003, "XYZ", counter)
    assert tree.tokens == library(text) and encoded < 3000


def test_operator(spark, library):
    rows = [
        (1, None, [(0, 0, "new text")], "x"),
        (2, "", None, "x"),
        (3, "abc def", [(3, 4, ""), (-5, 2, "zz"), None, (1, None, "q"), (90, 99, " end")], "x"),
        (None, "same", [], "x"),
        (None, "same", [], "x"),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_after, r.n_letters) for r in token_counts.counts_after_edits(df, PATH).collect())
    assert got == [(0, 1, 1, 4)] * 2 + [(1, 0, library("new text"), 8), (2, 0, 0, 0), (3, library("abc def"), library("zzcdef end"), 10)]
    assert token_counts.counts_after_edits(df.limit(0), PATH).collect() == []
