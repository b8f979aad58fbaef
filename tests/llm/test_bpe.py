import hashlib
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from sievewright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n\t ", "a", "Hello, WORLD's they'll 3.14", "aaaaaaaaaaaaaaa bbbb", "<|startoftext|>x<|endoftext|> y <|endoftext|", "\x1c\x1d a\x85b c d", "Σίσυφος ΟΔΟΣ ΣΣ", "été ﬁ İstanbul", "日本語テキスト 한국어", "👍🏽👩‍👩‍👧 ½ ² Ⅷ ٣", "don't 'S 'T 'RE it's", "a_b__c--$$$", "ß ẞ Ǆ", "͸ � \x00\x7f", "x" * 3000]


def test_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ["Wörter und Zahlen 123 " * 20000]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "x y", "n"), (3, "a", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256): r for r in bpe.encode_decode(df, PATH).collect()}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        key = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert key in got, (t or "")[:60]
        assert got[key].ids == ids and got[key].decoded == decoded
    assert bpe.encode_decode(df.limit(0), PATH).collect() == []


def test_every_code_point():
    library, own = Tokenizer.from_file(PATH), bpe.WordTokenizer(bpe.load(PATH))
    letters = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{}b", "1 {}2", "!{}!"):
        texts = [form.format(c) for c in letters]
        ids, counts = own.encode(texts)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [c for i, c in enumerate(letters) if want[i].ids != ids[bounds[i] : bounds[i + 1]].tolist()] == []


def test_random_texts():
    library, own = Tokenizer.from_file(PATH), bpe.WordTokenizer(bpe.load(PATH))
    rng = np.random.default_rng(3)
    odd = [chr(c) for c in (*range(0x20, 0x600), *range(0x1C80, 0x1C90), *range(0x2080, 0x20A0), *range(0xA7C0, 0xA7F4), *range(0x10D40, 0x10D90), *range(0xAC00, 0xAC40), *range(0x1100, 0x1180))]
    texts = ["".join(rng.choice(odd, rng.integers(1, 40))) for _ in range(3000)]
    ids, counts = own.encode(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[bounds[i] : bounds[i + 1]].tolist(), ascii(texts[i])


def test_combining_marks_side_by_side():
    library, own = Tokenizer.from_file(PATH), bpe.WordTokenizer(bpe.load(PATH))
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    near = "\u0334\u0315\u0327\u0301\u0345\u0610\u0749\ufe2a\u05c4"
    texts = [b + x + y for x in marks for y in near for b in ("e", "")] + [b + y + x for x in marks for y in near for b in ("e", "가")]
    rng = np.random.default_rng(4)
    letters = [*marks, *["e", "a", "o", "가", "\U00011935", "\U00011930", "א", "ب", " "] * 90]
    texts += ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(8000)]
    ids, counts = own.encode(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[bounds[i] : bounds[i + 1]].tolist(), ascii(texts[i])
