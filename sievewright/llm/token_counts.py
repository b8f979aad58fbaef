"""Token counts that follow edits: segment trees over the pre-tokens of each document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.bpe import MergeTable, load
from sievewright.llm.common import chunks, text_buffers

#: The pre-token pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts within Latin-1, whose letters, numbers and spaces are listed.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
LATIN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Pre-tokens of one leaf.
LEAF = 64

EDITS = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Token counts of pre-tokens, new ones encoded together."""

    def __init__(self, spec: dict, keep: int = 200_000):
        self.table = MergeTable(spec["model"])
        self.pattern = regex.compile(PATTERN)
        self.keep = keep
        self.known: dict[str, int] = {}

    def pattern_for(self, *texts: str):
        try:
            for text in texts:
                text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern
        return LATIN

    def learn(self, words: set[str]) -> None:
        """Encodes the unknown words in one batch; the memory of words is bounded."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.keep:
            self.known, new = {}, list(words)
        if new:
            sizes = self.table.encode_words([w.encode() for w in new])[1]
            self.known.update(zip(new, sizes.tolist(), strict=True))

    def counts(self, words: list[str]) -> list[int]:
        self.learn(set(words))
        known = self.known
        return [known[w] for w in words]


class TokenTree:
    """Sums of letters and tokens over the leaves of one document's pre-tokens.

    Node k has children 2k and 2k + 1; leaves follow from ``width`` on.  Inner
    leaves begin and end where pre-tokens do, so a leaf can be encoded from its
    own letters on.
    """

    def __init__(self, leaves: np.ndarray):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(leaves)] = leaves
        self.pending: dict[int, list[str]] = {}  # leaves whose tokens are not counted yet
        at = self.width
        while at > 1:
            at //= 2
            self.sums[at : 2 * at] = self.sums[2 * at : 4 * at : 2] + self.sums[2 * at + 1 : 4 * at : 2]

    @property
    def letters(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def locate(self, place: int) -> tuple[int, int]:
        """(leaf, its first letter) of the leaf that holds the letter, or the last leaf with letters."""
        if not self.letters:
            return 0, 0
        place, node, before = min(place, self.letters - 1), 1, 0
        while node < self.width:
            node *= 2
            if place >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.width, before

    def put(self, leaf: int, letters: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([letters, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def build(words: list[str], counts: list[int]) -> TokenTree:
    n = -(-len(words) // LEAF) or 1
    leaves = np.zeros((n, 2), np.int64)
    if words:
        heads = np.arange(0, len(words), LEAF)
        leaves[:, 0] = np.add.reduceat(np.array([len(w) for w in words]), heads)
        leaves[:, 1] = np.add.reduceat(np.array(counts), heads)
    return TokenTree(leaves)


def edit(tree: TokenTree, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
    """(edited text, letters encoded anew): letters start..end become ``new``, and the tree's sums follow."""
    out = splice(tree, text, start, end, new, counter)
    settle([tree], counter)
    return out


def settle(trees: list[TokenTree], counter: Counter) -> None:
    """Encodes the pending leaves of many trees in one batch and updates their sums."""
    counter.learn({w for tree in trees for words in tree.pending.values() for w in words})
    for tree in trees:
        for leaf, words in tree.pending.items():
            tree.put(leaf, int(tree.sums[tree.width + leaf, 0]), sum(map(counter.known.__getitem__, words)))
        tree.pending = {}


def splice(tree: TokenTree, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
    """Like :func:`edit`, but leaves the touched leaf pending; letters are right at once, tokens after :func:`settle`.

    Encoding begins one leaf before the edit's (what ends there may reach into
    the edit) and goes on until a pre-token ends past the edit where a leaf
    ended before; from there on all pre-tokens are as before.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    leaf, begin = tree.locate(max(start - 1, 0))
    for _ in range(2):  # the leaf before, and one more if that is short
        if begin and start - begin < 4 * LEAF:
            leaf, begin = tree.locate(begin - 1)
    edited = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    last, stop = leaf, begin + int(tree.sums[tree.width + leaf, 0])  # in the old text
    found, words, place = counter.pattern_for(text, new).finditer(edited, begin), [], begin
    while True:
        while stop < end or (stop <= end and stop < len(text)):
            last += 1
            stop += int(tree.sums[tree.width + last, 0])
        if stop >= len(text):
            words += [m[0] for m in found]
            last = tree.width - 1
            break
        while place < stop + shift:
            words.append(next(found)[0])
            place += len(words[-1])
        if place == stop + shift:
            break
        last += 1
        stop += int(tree.sums[tree.width + last, 0])
    tree.put(leaf, sum(map(len, words)), 0)
    tree.pending[leaf] = words
    for k in range(leaf + 1, last + 1):
        tree.pending.pop(k, None)
        if tree.sums[tree.width + k].any():
            tree.put(k, 0, 0)
    return edited, sum(map(len, words))


def counts_after_edits(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Rows (<id>, n_tokens, n_after, n_letters, letters_encoded) of each whole text and its edits.

    The vocabulary is a byte-level one.  Edits are (start, end, text) in letters
    of the text as the edits before have left it; places outside are moved to
    the text's ends, null edits and null parts change nothing, a null text is
    empty.  n_tokens counts before the edits, n_after when all are applied;
    n_letters is the edited text's length and letters_encoded what the edits had
    to encode anew.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(vocab_path))
    schema = T.StructType([docs.schema[id_col]])
    for name in ("n_tokens", "n_after", "n_letters", "letters_encoded"):
        schema = schema.add(name, "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            rows = []
            for i, j in chunks(offsets):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                words = [counter.pattern_for(t).findall(t) for t in texts]
                flat = [w for x in words for w in x]
                counts, at, part = counter.counts(flat), 0, []
                for text, own, changes in zip(texts, words, batch.column(2).slice(i, j - i).to_pylist(), strict=True):
                    tree = build(own, counts[at : at + len(own)])
                    at += len(own)
                    before, encoded = tree.tokens, 0
                    for c in changes or []:
                        if c is not None and None not in (c["start"], c["end"], c["text"]):
                            text, n = splice(tree, text, c["start"], c["end"], c["text"], counter)
                            encoded += n
                    part.append((before, tree, encoded))
                settle([tree for _, tree, _ in part], counter)
                rows += [(before, tree.tokens, tree.letters, encoded) for before, tree, encoded in part]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col), F.col(edits_col).cast(EDITS)).mapInArrow(work, schema)
