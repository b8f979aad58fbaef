"""Letters and words of texts, measured over the bytes of Arrow columns: no array of words leaves the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievewright.functions import lexicons as L
from sievewright.functions.columns import WORD, alternation
from sievewright.operators.matching import buffers, slices
from sievewright.operators.wordstats import FIELDS, statistics

LETTER, IN_WORD, HANGUL, JAMO, TYPOGRAPHIC, SENTENCE_END, SPACE = (1 << k for k in range(7))
#: What is left out of a sentence's beginning.
MARKS = r"^[\"'\-–— ]*"
_TABLES: dict[str, np.ndarray] = {}
_PARTICLES = frozenset(L.KO_PARTICLES)


def character_classes(spark: SparkSession) -> np.ndarray:
    """Classes of all code points, learned from Spark's own patterns, so both know the same Unicode version."""
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        row = spark.range(1).select(F.regexp_replace(F.lit(every), r"\P{L}+", "").alias("a"), F.regexp_replace(F.lit(every), "[^" + WORD[1:], "").alias("b")).first()
        table = np.zeros(0x110000, np.uint8)
        for bit, found in ((LETTER, row.a), (IN_WORD, row.b)):
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] |= bit
        table[0xAC00:0xD7A4] |= HANGUL
        table[0x1100:0x1200] |= JAMO
        for bit, own in ((TYPOGRAPHIC, L.TYPOGRAPHIC[1:-1]), (SENTENCE_END, ".!?。！？\n"), (SPACE, " \t\n\x0b\f\r")):
            table[list(map(ord, own))] |= bit
        _TABLES.clear()
        _TABLES[key] = table
    return _TABLES[key]


def classes(blob: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each character at its first byte, of each byte its character's) of UTF-8 bytes."""
    first = np.where(blob < 0x80, table[np.minimum(blob, 0x7F)], 0).astype(np.uint8)
    lead = np.flatnonzero(blob >= 0xC0)
    if not len(lead):
        return first, first
    b = np.r_[blob, np.zeros(3, np.uint8)]
    a, x, y, z = b[lead].astype(np.int32), *(b[lead + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
    two, three = a < 0xE0, a < 0xF0
    point = np.where(two, (a & 0x1F) << 6 | x, np.where(three, (a & 0x0F) << 12 | x << 6 | y, (a & 0x07) << 18 | x << 12 | y << 6 | z))
    own = table[np.minimum(point, 0x10FFFF)]
    first[lead] = own
    each = np.r_[first, np.zeros(3, np.uint8)]
    each[lead + 1] = own
    each[lead[~two] + 2] = own[~two]
    each[lead[~three] + 3] = own[~three]
    return first, each[: len(blob)]


def word_bounds(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the first and the last byte of each word inside a row."""
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first], end[last] = word[first], word[last]
    return begin, end


def _counted(places: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(places, weights=weights, minlength=n)


def sentence_measures(blob: np.ndarray, offsets: np.ndarray, each: np.ndarray, ko: np.ndarray, least: int, endings: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Of each row: sentences of at least ``least`` letters, the sum and the squares of their words (1 at least), those that begin with a starter and that hold an ending."""
    n, n_rows = len(blob), len(offsets) - 1
    ends = (each & SENTENCE_END) > 0
    solid = np.flatnonzero(~ends & ((each & SPACE) == 0))
    row = np.searchsorted(offsets, solid, side="right") - 1
    part = np.cumsum(ends, dtype=np.int64)[solid]
    new = np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])] if len(solid) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    start, stop, row = solid[at], solid[np.r_[at[1:], len(solid)] - 1] + 1 if len(at) else at, row[at]
    letters = np.r_[0, np.cumsum((blob & 0xC0) != 0x80)]
    good = letters[stop] - letters[start] >= least
    start, stop, row = start[good], stop[good], row[good]
    begin, _ = word_bounds((each & IN_WORD) > 0, offsets)
    words = np.r_[0, np.cumsum(begin)]
    size = np.maximum(words[stop] - words[start], 1).astype(np.float64)
    inside = np.zeros(n + 1, np.int8)
    inside[start] += 1
    inside[stop] -= 1
    at = np.r_[0, np.cumsum(stop - start)].astype(np.int32)
    texts = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(blob[np.cumsum(inside[:-1], dtype=np.int8) > 0]))
    out = {"n_sentences": _counted(row, None, n_rows), "sentence_words": _counted(row, size, n_rows), "sentence_squares": _counted(row, size * size, n_rows)}
    low = pc.utf8_lower(pc.replace_substring(texts, "İ", "i̇"))
    out["starters"] = np.zeros(n_rows, np.int64)
    for own, known in ((~ko[row], L.STARTERS_EN), (ko[row], L.STARTERS_KO)):
        hit = np.asarray(pc.match_substring_regex(low.filter(pa.array(own)), f"{MARKS}({alternation(known)})"))
        out["starters"] += _counted(row[own][hit], None, n_rows)
    if endings:
        out["endings"] = _counted(row[np.asarray(pc.match_substring_regex(texts, alternation(endings)))], None, n_rows)
    return out


def without_particle(word: str) -> str:
    """The word without the longest Korean particle that leaves two letters."""
    for n in sorted({len(p) for p in L.KO_PARTICLES}, reverse=True):
        if len(word) > n + 1 and word[-n:] in _PARTICLES:
            return word[:-n]
    return word


def measured(spark: SparkSession, lists: dict[str, tuple[str, ...]], kinds: dict[str, tuple[str, ...]] | None = None, particles: bool = False, least: int = 8, endings: tuple[str, ...] = (), spans: bool = True, grams: bool = True):
    """A function of (text, lower-cased text): letters, hangul, jamo, typographic marks and the :func:`sentence_measures` of the first; n_words, the FIELDS and list counts of the second's words.

    ``lists`` count the words that they have, as <name>; ``kinds`` the different
    ones of their words that are a word or a piece of one between apostrophes.
    With ``particles`` the words of texts over 0.3 Hangul, jamo included, lose one particle.
    Without ``spans`` there are no sentence measures, without ``grams`` no FIELDS and lists, which take most of the time.
    """
    kinds = kinds or {}
    sent = spark.sparkContext.broadcast(character_classes(spark))
    sums = ["n_sentences", "sentence_words", "sentence_squares", "starters"] + ["endings"] * bool(endings)
    names = ["letters", "hangul", "jamo", "typographic", *(sums if spans else ()), "n_words", *((*FIELDS, *lists, *kinds) if grams else ())]
    real = ("bigram_entropy", "mtld", "sentence_words", "sentence_squares")

    def piece(blob, offsets, n_hangul, table):
        """Measures of the words of some texts."""
        _, cls = classes(blob, table)
        word = (cls & IN_WORD) > 0
        begin, end = map(np.flatnonzero, word_bounds(word, offsets))
        end += 1
        if not grams:
            return {"n_words": np.diff(np.searchsorted(begin, offsets))}
        at = np.r_[0, np.cumsum(end - begin)].astype(np.int32)
        found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(blob[word])).dictionary_encode()
        codes, known = np.asarray(found.indices).astype(np.int64), found.dictionary
        starts = np.searchsorted(begin, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
        if particles and n_hangul.any():
            bare = pa.array([without_particle(w) for w in known.to_pylist()], pa.string())
            both = pa.concat_arrays([known, bare]).dictionary_encode()
            to, known = np.asarray(both.indices).astype(np.int64), both.dictionary
            codes = np.where(n_hangul[owner], to[codes + len(bare)], to[codes])
        out = statistics(codes, starts)
        out["n_words"] = np.diff(starts)
        for name, own in lists.items():
            out[name] = np.bincount(owner[np.asarray(pc.is_in(known, pa.array(own, pa.string())))[codes]], minlength=len(offsets) - 1)
        for name, own in kinds.items():
            place = {w: k for k, w in enumerate(dict.fromkeys(own))}
            quoted = np.flatnonzero(np.asarray(pc.match_substring(known, "'")))
            plain = np.flatnonzero(np.asarray(pc.is_in(known, pa.array(list(place), pa.string()))))
            pairs = {(c, place[w]) for c in np.r_[quoted, plain].tolist() for w in (known[c].as_py(), *known[c].as_py().split("'")) if w in place}
            hit = np.zeros((len(known), len(place)), bool)
            for c, k in pairs:
                hit[c, k] = True
            some = hit.any(axis=1)[codes] if len(known) else np.zeros(0, bool)
            met = np.zeros((len(offsets) - 1, len(place)), bool)
            np.logical_or.at(met, owner[some], hit[codes[some]])
            out[name] = met.sum(axis=1)
        return out

    def measure(text: pa.Array, low: pa.Array) -> pa.Array:
        table, n = sent.value, len(text)
        out = {name: np.zeros(n, np.float64 if name in real else np.int64) for name in names}
        blob, offsets = buffers(text)
        ko = np.zeros(n, bool)
        for i, j in slices(offsets):
            part, at = blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            first, each = classes(part, table)
            for name, bit in (("letters", LETTER), ("hangul", HANGUL), ("jamo", JAMO), ("typographic", TYPOGRAPHIC)):
                out[name][i:j] = np.diff(np.searchsorted(np.flatnonzero(first & bit), at))
            share = (out["hangul"][i:j] + particles * out["jamo"][i:j]) / np.maximum(out["letters"][i:j], 1)
            ko[i:j] = share > 0.3
            if spans:
                for name, value in sentence_measures(part, at, each, ko[i:j], least, endings).items():
                    out[name][i:j] = value
        blob, offsets = buffers(low)
        for i, j in slices(offsets):
            for name, value in piece(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ko[i:j], table).items():
                out[name][i:j] = value
        return pa.StructArray.from_arrays([pa.array(out[name]) for name in names], names=names)

    return F.arrow_udf(measure, "struct<" + ",".join(f"{name}:{'double' if name in real else 'bigint'}" for name in names) + ">")
