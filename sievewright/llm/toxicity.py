"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

Besides words, word pairs and pairs with one word between, the openings of words
are features, so that an inflected or compounded form that no labelled document
holds still tells by its stem.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import ByteHasher, chunks, mix, text_buffers, words_of

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_HASHER = ByteHasher(10)

BITS = 20
#: Lengths in bytes of the word openings that are features.
STEMS = (3, 4, 5, 6, 7, 8)
#: Labelled documents to learn from, and bytes that their whole texts have together, as expected numbers.
TRAIN_DOCS = 12000
SAMPLE_BYTES = 1 << 26


def features(blob: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, row of each): words, word pairs, pairs with one word between, and word openings."""
    blob = _LOWER[blob]
    starts, ends, first = words_of(blob, offsets, _IS_WORD)
    prefix = _HASHER.prefix(blob)
    h = _HASHER.ranges(prefix, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    values, rows = [h], [row]
    for gap, factor in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        one = row[:-gap] == row[gap:]
        values.append(mix(h[:-gap][one] * np.uint64(factor) + h[gap:][one]))
        rows.append(row[gap:][one])
    for stem in STEMS:
        long_ = ends - starts >= stem
        values.append(mix(_HASHER.ranges(prefix, starts[long_], starts[long_] + stem) * np.uint64(0xD6E8FEB86659FD93)))
        rows.append(row[long_])
    return (np.concatenate(values) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 4) -> tuple[np.ndarray, float]:
    """(weights, intercept): per-coordinate FTRL-proximal over sets of hashed features.

    A feature present counts 1.  The intercept is a coordinate without L1.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(10)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            x = examples[i]
            w = weights(z[x], n[x])
            w0 = -z0 / ((beta + n0**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -30, 30))) - labels[i]
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha * w
            n[x] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0
            n0 += g * g
    return weights(z, n), -z0 / ((beta + n0**0.5) / alpha + l2)


def balanced_shift(logits: np.ndarray, labels: np.ndarray) -> float:
    """What to add to logits so that the labels' mean errors of probability balance; 0 where a label is missing.

    Found by bisection: the mean of label 1's missing probability falls with the
    shift, that of label 0's probability rises.
    """
    if not (labels == 1).any() or not (labels == 0).any():
        return 0.0
    low, high = -30.0, 30.0
    for _ in range(60):
        shift = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(logits + shift, -30, 30)))
        low, high = (shift, high) if (1 - p[labels == 1]).mean() > p[labels == 0].mean() else (low, shift)
    return low


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows (t, y, _hash_, _bytes_) of labelled texts, their hashes and sizes.

    Hash and size are columns of the documents' side, so that what only counts
    joins light rows; which labels an id has twice teach twice.
    """
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("_hash_"), F.octet_length(text_col).alias("_bytes_"))
    return light.join(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")), "id").drop("id")


def fit(labelled: DataFrame, text_col: str, label_col: str, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, intercept) of the features with weight, from a bounded sample.

    Of the different (text, label) pairs about ``train_docs`` are chosen by a
    hash of the text, fewer if their texts have over ``SAMPLE_BYTES`` together,
    and each teaches as a whole, 1 + log2(c) times, rounded down, where it has c
    equal rows, so that more of them always count and none rules.  The sample, at most twice that many pairs, is all that reaches the driver.  Null
    labels and null texts teach nothing; without a row of either label every
    text scores alike.

    Labels are rare, so plain probabilities of unseen texts are low.  Each half
    of the sample is scored by what the other half teaches, and the intercept is
    shifted so that both labels' mean errors are alike there.
    """
    if {"_hash_", "_bytes_"} <= set(labelled.columns):  # of labelled_rows
        rows = labelled.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"), F.col("_hash_").alias("h"), F.col("_bytes_").alias("n")).where("n is not null and y is not null")
    else:
        rows = labelled.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"), F.xxhash64(text_col).alias("h"), F.octet_length(text_col).alias("n")).where("n is not null and y is not null")
    total = rows.select("y", "h", "n").distinct().agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).first()
    share = min(1.0, train_docs / max(1, total.pairs), SAMPLE_BYTES / max(1, total.n or 0))
    unit = F.pmod(F.xxhash64("t", F.lit(10)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    pairs = rows.where(unit < F.lit(share)).groupBy("t", "y").agg(F.count("*").alias("n"))
    sample = pairs.select("y", "t", (F.floor(F.log2("n")) + 1).cast("int").alias("n"), F.xxhash64("t").alias("h")).orderBy("h", "t", "y").limit(2 * train_docs).collect()
    one, examples, fold = [], [], []
    for r in sample:
        text = np.frombuffer(r.t.encode(), np.uint8)
        one.append(np.unique(features(text, np.array([0, len(text)]))[0]).astype(np.int32))
        examples += [one[-1]] * r.n
        fold += [r.h & 3] * r.n
    labels, fold = np.array([r.y for r in sample for _ in range(r.n)], float), np.array(fold)
    w, intercept = ftrl(examples, labels)
    shift = 0.0
    if len(sample):
        logits, mine = np.zeros(len(sample)), np.array([r.h & 3 for r in sample])
        for k in (0, 1):
            other = np.flatnonzero(fold != k)
            v, v0 = ftrl([examples[i] for i in other], labels[other])
            for i in np.flatnonzero(mine == k):
                logits[i] = v[one[i]].sum() + v0
        shift = balanced_shift(logits[mine < 2], np.array([r.y for r in sample], float)[mine < 2])
    some = np.flatnonzero(w)
    return some, w[some].astype(np.float32), float(intercept + shift)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (<id>, <keep>, score): the probability of label 1 for each whole text.

    Only the sparse weights are broadcast, at most 2**BITS of them.  A null or
    empty text, or one without words, gets the intercept's probability.
    """
    kept = [id_col, *[c for c in keep if c != id_col]]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights, intercept = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[index] = weights
        for batch in batches:
            blob, offsets = text_buffers(batch.column(len(kept)))
            total = np.full(batch.num_rows, intercept)
            for i, j in chunks(offsets):
                value, row = features(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = np.flatnonzero(table[value])
                pairs = np.unique((row[some] << BITS) | value[some])
                total[i:j] += np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[f.name for f in schema])

    return docs.select(*kept, F.col(text_col).alias("_text_")).mapInArrow(work, schema)
