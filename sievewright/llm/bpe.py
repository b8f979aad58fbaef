"""Byte-pair encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import chunks, text_buffers


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """A vocabulary and its merges, with pairs as sorted keys for binary search.

    ``model`` is the "model" part of a tokenizer file; every byte's letter must
    be in the vocabulary.
    """

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        self.tokens = [""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        whole = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.whole = keys[order].astype(np.uint64), order.astype(np.int32), whole[order]
        if self.size**2 < 1 << 32:
            self.keys = self.keys.astype(np.uint32)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the sorted keys, or -1."""
        key = (left * self.size + right).astype(self.keys.dtype)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != key] = -1
        return at

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has).

        All words' symbols lie in one flat array.  A round finds each unfinished
        word's lowest-ranked neighbouring pair, merges its occurrences from left
        to right, and looks up only the pairs that changed.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[flat]
        filled = lengths > 0
        symbols[ends[filled] - 1] = self.last[flat[ends[filled] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        none = np.iinfo(np.int32).max
        done_ids, done_words = [], []
        place = np.full(len(symbols), -1)
        if len(symbols) > 1:
            inside = np.flatnonzero(word[:-1] == word[1:])
            place[inside] = self._find(symbols[inside], symbols[inside + 1])
        while len(symbols):
            rank = np.where(place >= 0, self.rank[place], none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(word)])
            if (best == none).any():  # finished words leave
                over = np.repeat(best == none, sizes)
                done_ids.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, place, rank = symbols[keep], word[keep], place[keep], rank[keep]
                best, sizes = best[best != none], sizes[best != none]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # Of overlapping pairs (a run of one symbol) every second merges, from the left.
            run = np.r_[True, np.diff(hit) != 1]
            nth = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[nth % 2 == 0]
            symbols[hit] = self.whole[place[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, place = symbols[keep], word[keep], place[keep]
            new = moved[hit]
            touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
            place[touched] = -1
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[word[touched] == word[touched + 1]]
            place[touched] = self._find(symbols[touched], symbols[touched + 1])
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        counts = np.bincount(owner, minlength=len(words))
        return ids[np.argsort(owner, kind="stable")], counts


@functools.cache
def unicode_differences() -> tuple[dict[int, str], dict[int, str]]:
    """(lower-case letters, stand-ins) of the code points that the tokenizers library's Unicode tables treat otherwise.

    Python, the regex module and the library each hold another Unicode version.
    A stand-in is a letter of the class that the library sees: letter, number,
    white space or none of them.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c) not in "\n"]
    whole = "".join(every)
    classes = {"\u00e9": (r"\p{L}", r"\p{L}"), "2": (r"\p{N}", r"\p{N}"), " ": (r"\s", r"\p{White_Space}")}
    theirs, ours = {}, {}
    for stand_in, (library, module) in classes.items():
        found = pre_tokenizers.Split(Regex(library), "removed", invert=True).pre_tokenize_str(whole)
        theirs.update((piece, stand_in) for piece, _ in found)
        ours.update((piece, stand_in) for piece in regex.findall(module, whole))
    stand_ins = {ord(c): theirs.get(c, "!") for c in every if theirs.get(c) != ours.get(c)}
    lowered = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    lower = {ord(c): low for c, low in zip(every, lowered, strict=True) if c != "\u03a3" and low != c.lower()}
    return lower, stand_ins


@functools.cache
def marks_apart() -> str:
    """Code points at which the tokenizers library's normal form stands apart from Python's: it cuts there.

    The library knows fewer combining marks: to it newer ones are letters of
    class 0, which no mark is moved over and nothing composes over.  The newer
    marks and the second parts of newer composed letters are returned.
    """
    from tokenizers import normalizers

    form = normalizers.NFC().normalize_str
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)) if chr(c) not in "\n"]  # the other planes have no marks
    odd: set[str] = set()

    def compare(of: dict[str, str]) -> set[str]:
        theirs = form("\n".join(of.values())).split("\n")
        return {c for (c, text), t in zip(of.items(), theirs, strict=True) if t != unicodedata.normalize("NFC", text)}

    marks = [c for c in every if unicodedata.combining(c)]
    odd |= compare({c: f"q{c}\u0334" for c in marks}) | compare({c: f"q\u0315{c}" for c in marks})  # over a mark of class 1, over one of class 232
    others = "\n".join(f"q{c}\u0334" for c in every if not unicodedata.combining(c))
    if form(others) != others:  # marks to the library alone
        odd |= compare({c: f"q{c}\u0334" for c in every if not unicodedata.combining(c)})
    split = {c: unicodedata.normalize("NFD", c) for c in every if unicodedata.decomposition(c)}
    return "".join(sorted(odd | {split[c][-1] for c in compare(split)}))


class WordTokenizer:
    """Lower-casing BPE with word ends: NFC, white space dropped, special tokens kept whole.

    ``differences`` are those of :func:`unicode_differences`, ``apart`` those of :func:`marks_apart`.
    """

    ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
    words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def __init__(self, spec: dict, differences: tuple[dict[int, str], dict[int, str]] | None = None, apart: str | None = None):
        apart = marks_apart() if apart is None else apart
        self.table = MergeTable(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = dict(enumerate(self.table.tokens)) | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lower, self.stand_ins = differences or unicode_differences()
        odd = sorted({*self.lower, *self.stand_ins, *(ord(c) for x in self.lower.values() for c in x)})
        starts = [c for i, c in enumerate(odd) if not i or odd[i - 1] != c - 1]
        ends = [c for i, c in enumerate(odd) if i == len(odd) - 1 or odd[i + 1] != c + 1]
        self.apart = re.compile(f"([{re.escape(apart)}])") if apart else None
        self.odd = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]") if odd else None

    def split(self, text: str) -> list[str | int]:
        """Words of a text; a special token is its id."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out += self.ascii_words.findall(part.lower())
            else:
                # Lower-casing goes letter by letter: a final sigma is not special.
                pieces = self.apart.split(part) if self.apart else [part]
                part = "".join([unicodedata.normalize("NFC", p) for p in pieces]).replace("Σ", "σ")
                if self.odd is None or not self.odd.search(part):
                    out += self.words.findall(part.lower())
                    continue
                part = "".join(self.lower.get(ord(c)) or c.lower() for c in part)
                out += [part[m.start() : m.end()] for m in self.words.finditer(part.translate(self.stand_ins))]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each has)."""
        place: dict[str | int, int] = {}
        uses, counts = [], []
        for text in texts:
            words = self.split(text)
            counts.append(len(words))
            uses += [place.setdefault(w, len(place)) for w in words]
        kinds = list(place)
        special = np.array([isinstance(w, int) for w in kinds], bool)
        ids, sizes = self.table.encode_words([b"" if isinstance(w, int) else w.encode() for w in kinds])
        if special.any():
            at = np.flatnonzero(special)
            ids = np.insert(ids, (np.cumsum(sizes) - sizes)[at], [kinds[i] for i in at])
            sizes[at] = 1
        used = np.array(uses, np.int64)
        spread = sizes[used]
        starts = (np.cumsum(sizes) - sizes)[used]
        flat = np.repeat(starts - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        per_text = np.diff(np.concatenate([[0], np.cumsum(spread)])[bounds])
        return ids[flat], per_text

    def decode(self, ids: list[int]) -> str:
        """The tokens' names joined by one space, special ones included."""
        names = self.names
        return " ".join([names[i] for i in ids])


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_tokens: bool = True) -> DataFrame:
    """Rows (<id>, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each whole text.

    The tokenizer is made once on the driver and broadcast; it does not grow with
    the data.  ids_sha256 is over the ids as little-endian unsigned
    32-bit numbers, decoded_sha256 over the decoded text in UTF-8.  A null or
    empty text has no tokens and decodes to the empty text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(WordTokenizer(load(vocab_path), unicode_differences(), marks_apart()))
    schema = T.StructType([docs.schema[id_col]])
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_tokens:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = sent.value
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids, counts = tokenizer.encode(texts)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(int)
                raw = ids.astype("<u4")
                each = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                decoded = [tokenizer.decode(x.tolist()) for x in each]
                columns = [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array([sha(x.tobytes()) for x in each], pa.string()), pa.array([sha(t.encode()) for t in decoded], pa.string())]
                if keep_tokens:
                    columns += [pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)
