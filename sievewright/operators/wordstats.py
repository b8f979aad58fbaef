"""Counts of word n-grams and lexical diversity of many texts at once, in numpy over Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that one step works on; a longer text comes alone.
SLICE = 1 << 18
#: Words that a factor's search looks at first; it doubles where no end is found.
LOOK = 64
#: Texts from which on their factors are searched side by side.
SIDE_BY_SIDE = 24
#: Share of different words at which a factor ends.
RATIO = 0.72

FIELDS = ("bigram_entropy", "n_trigrams", "trigrams", "trigrams_repeated", "distinct_words", "hapax", "mtld")


def _kinds(keys: np.ndarray, bits: int, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different grams, grams met once, sum of c * log2(c) over counts c) of each text, of sorted keys: text << bits | gram."""
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts, owner = np.diff(np.r_[head, len(keys)]), keys[head] >> bits
    weighted = np.bincount(owner, weights=counts * np.log2(counts), minlength=n_texts)
    return np.bincount(owner, minlength=n_texts), np.bincount(owner[counts == 1], minlength=n_texts), weighted


def factors(order: np.ndarray, keys: np.ndarray, starts: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """Factors of each text, with the unfinished one's part: a factor ends where its different words are ``ratio`` of its words or fewer.

    A word is a first sight of the factor that began at s if its last occurrence
    lies before s; so one array of last occurrences serves all factors.  All
    texts' factors are searched side by side, a window of words at a time.
    ``order`` has the words' places by text, word and place, ``keys`` the sorted
    text and word.
    """
    n, n_texts = len(order), len(starts) - 1
    last = np.full(n + 1, -1)
    same = keys[1:] == keys[:-1]
    last[order[1:][same]] = order[:-1][same]
    out = np.zeros(n_texts)
    live = np.flatnonzero(np.diff(starts))
    begin, fresh, upto = starts[live].copy(), np.zeros(len(live), np.int64), starts[live].copy()
    width = LOOK
    while len(live) >= SIDE_BY_SIDE:
        at = upto[:, None] + np.arange(width)
        inside = at < starts[live + 1][:, None]
        sights = np.cumsum((last[np.minimum(at, n)] < begin[:, None]) & inside, axis=1) + fresh[:, None]
        ends = (sights / (at - begin[:, None] + 1) <= ratio) & inside
        hit = ends.any(axis=1)
        end = upto + ends.argmax(axis=1) + 1
        out[live[hit]] += 1
        fresh = np.where(hit, 0, sights[:, -1])
        upto = np.where(hit, end, np.minimum(upto + width, starts[live + 1]))
        begin = np.where(hit, end, begin)
        over = upto >= starts[live + 1]
        rest = over & (upto > begin)
        out[live[rest]] += (1 - fresh[rest] / (upto - begin)[rest]) / (1 - ratio)
        live, begin, fresh, upto = live[~over], begin[~over], fresh[~over], upto[~over]
        width = LOOK if hit.any() else min(2 * width, 4096)
    for k, s, sights, place in zip(live.tolist(), begin.tolist(), fresh.tolist(), upto.tolist(), strict=True):  # the last few, word by word
        for at, before in enumerate(last[place : starts[k + 1]].tolist(), place):
            sights += before < s
            if sights / (at - s + 1) <= ratio:
                out[k], s, sights = out[k] + 1, at + 1, 0
        if s < starts[k + 1]:
            out[k] += (1 - sights / (starts[k + 1] - s)) / (1 - ratio)
    return out


def statistics(codes: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of FIELDS of texts of word codes."""
    n_texts = len(starts) - 1
    text = np.repeat(np.arange(n_texts), np.diff(starts))
    bits = int(codes.max(initial=0)).bit_length()
    out: dict[str, np.ndarray] = {}
    keys = (text << bits) | codes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    out["distinct_words"], out["hapax"], _ = _kinds(keys, bits, n_texts)
    f, n = factors(order, keys, starts), np.diff(starts)
    out["mtld"] = np.where(f > 0, n / np.where(f > 0, f, 1.0), n.astype(float))
    pair = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    at = np.flatnonzero(pair)
    pairs = (codes[at] << bits) | codes[at + 1]
    n_pairs = np.bincount(text[at], minlength=n_texts)
    if n_texts.bit_length() + 3 * bits > 62:  # as many words as grams may be: pairs get numbers
        _, pairs = np.unique(pairs, return_inverse=True)
        gram = int(pairs.max(initial=0)).bit_length()
    else:
        gram = 2 * bits
    _, _, weighted = _kinds(np.sort((text[at] << gram) | pairs), gram, n_texts)
    some = np.maximum(n_pairs, 1)
    out["bigram_entropy"] = np.where(n_pairs > 0, np.log2(some) - weighted / some, 0.0)
    next_ = np.flatnonzero(np.r_[pair, False][at + 1])
    triples = (pairs[next_] << bits) | codes[at[next_] + 2]
    owner = text[at[next_]]
    kinds, once, _ = _kinds(np.sort((owner << gram + bits) | triples), gram + bits, n_texts)
    out["n_trigrams"], out["trigrams"], out["trigrams_repeated"] = np.bincount(owner, minlength=n_texts), kinds, kinds - once
    return out


@F.arrow_udf(T.StructType([T.StructField(f, T.DoubleType() if f in ("bigram_entropy", "mtld") else T.LongType()) for f in FIELDS]))
def word_statistics(words: pa.Array) -> pa.Array:
    """Of an array of words: entropy of its bigrams in bits; trigrams, different ones, those met more than once; different words and those met once; words by factor.

    Null counts as no words.  Words are numbered once for a batch and grams made
    of the numbers, so nothing is hashed; a task holds a batch.
    """
    lengths = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
    codes = np.asarray(words.flatten().dictionary_encode().indices.fill_null(-1)).astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    parts, i = [], 0
    while i < len(lengths):
        j = min(max(int(np.searchsorted(starts, starts[i] + SLICE, side="right")) - 1, i + 1), len(lengths))
        own = codes[starts[i] : starts[j]]
        _, own = np.unique(own, return_inverse=True)
        parts.append(statistics(own, starts[i : j + 1] - starts[i]))
        i = j
    kinds = {f: (pa.float64() if f in ("bigram_entropy", "mtld") else pa.int64()) for f in FIELDS}
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[f] for p in parts]) if parts else np.zeros(0), kinds[f]) for f in FIELDS], names=list(FIELDS))
