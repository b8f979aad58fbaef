"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import chunks, text_buffers

WINDOW = 128
WIDTHS = (2, 3, 4)
#: Bounds of the training sample: different texts of each language, and bytes that those have together, as expected numbers.
DOCS_PER_LANGUAGE = 800
BYTES_PER_LANGUAGE = 1 << 20


@dataclass
class ByteCNN:
    """Byte embedding, filters of several widths, max pooling over the window, softmax."""

    labels: list[str]
    embedding: np.ndarray  # 256 x e
    filters: np.ndarray  # max width * e x f; taps beyond a filter's width are zero
    bias: np.ndarray
    dense: np.ndarray  # f x labels
    dense_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pooled activations, patches) of byte windows."""
        taps = max(WIDTHS)
        x = self.embedding[windows].reshape(len(windows), -1)
        e = self.embedding.shape[1]
        n = windows.shape[1] - taps + 1
        patches = np.lib.stride_tricks.as_strided(x, (len(x), n, taps * e), (x.strides[0], e * x.itemsize, x.itemsize), writeable=False)
        y = patches.reshape(-1, taps * e) @ self.filters
        return y.reshape(len(x), n, -1), patches

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for i in range(0, len(windows), 512):
            pooled = np.maximum(self.features(windows[i : i + 512])[0].max(axis=1) + self.bias, 0)
            out[i : i + 512] = _softmax(pooled @ self.dense + self.dense_bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _windows(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zeros, row of each, bytes in each); an empty text has none."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(offsets[1:][row] - start, WINDOW)
    padded = np.concatenate([blob, np.zeros(WINDOW, np.uint8)])
    windows = padded[start[:, None] + np.arange(WINDOW)]
    windows[np.arange(WINDOW) >= length[:, None]] = 0
    return windows, row, length


def train(texts: list[bytes], langs: list[str], filters: int = 16, dims: int = 8, epochs: int = 8, seed: int = 6) -> ByteCNN:
    """Fits the network by Adam on windows of the texts, some cut short."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    x, row, length = _windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    y = np.searchsorted(labels, langs)[row] if labels else np.zeros(0, np.int64)
    short = rng.random(len(x)) < 0.3
    cut = np.where(short, rng.integers(12, WINDOW, len(x)), WINDOW)
    x[np.arange(WINDOW) >= np.minimum(cut, length)[:, None]] = 0
    taps, total = max(WIDTHS), filters * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(taps) < w, dims)[:, None] * np.ones((1, filters)) for w in WIDTHS], axis=1).astype(np.float32)
    net = ByteCNN(
        labels,
        rng.normal(0, 0.5, (256, dims)).astype(np.float32),
        (rng.normal(0, 1, (taps * dims, total)) * mask / np.sqrt(taps * dims)).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    names = ("embedding", "filters", "bias", "dense", "dense_bias")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs if len(labels) > 1 else 0):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 128):
            at = order[i : i + 128]
            maps, patches = net.features(x[at])
            best = maps.argmax(axis=1)
            raw = np.take_along_axis(maps, best[:, None, :], 1)[:, 0] + net.bias
            pooled = np.maximum(raw, 0)
            p = _softmax(pooled @ net.dense + net.dense_bias)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            d = (p @ net.dense.T) * (raw > 0)
            taken = patches[np.arange(len(at))[:, None], best]  # windows x filters x taps * dims
            grads = {"dense": pooled.T @ p, "dense_bias": p.sum(0), "bias": d.sum(0), "filters": np.einsum("nf,nfk->kf", d, taken) * mask}
            back = (d[:, :, None] * net.filters.T[None]).reshape(len(at), total, taps, dims)
            codes = x[at][np.arange(len(at))[:, None, None], best[:, :, None] + np.arange(taps)]
            grads["embedding"] = np.stack([np.bincount(codes.ravel(), back[..., k].ravel(), 256) for k in range(dims)], axis=1)
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    return net


def fit(labelled: DataFrame, text_col: str, lang_col: str, docs_per_language: int = DOCS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> ByteCNN:
    """Trains on a bounded sample of labelled texts, each taken as a whole, with all its windows.

    Of each language about ``docs_per_language`` different texts are chosen by a
    hash, fewer if those would have over ``bytes_per_language`` together; a text
    longer than that is not chosen.  The driver gets at most twice that many
    texts.  Null and empty texts and null languages teach nothing.
    """
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(text_col).alias("h"), F.octet_length(text_col).alias("n")).where("l is not null and n > 0").where(F.col("n") <= bytes_per_language)
    counts = rows.select("l", "h", "n").distinct().groupBy("l").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()  # a row for each language
    unit = F.pmod(F.col("h"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("l") == r.l, F.lit(min(1.0, docs_per_language / r.texts, bytes_per_language / r.n))).otherwise(share)
    sample = rows.where(unit < share).select("h", "l", "t").dropDuplicates(["h", "l"])
    chosen = sample.orderBy("h", "l").limit(2 * docs_per_language * max(1, len(counts))).collect()
    return train([r.t.encode() for r in chosen], [r.l for r in chosen])


def predict(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (<id>, <keep>, lang_pred, score): the language of each whole text.

    The text is cut into windows of 128 bytes, each gets the network's
    probabilities, and the mean weighted by bytes decides; score is its value.
    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learned.
    """
    spark = docs.sparkSession
    kept = [id_col, *[c for c in keep if c != id_col]]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    model = spark.sparkContext.broadcast(net)  # a fixed number of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            blob, offsets = text_buffers(batch.column(len(kept)))
            letters = np.array(batch.column(len(kept) + 1).to_pylist(), bool)
            total = np.zeros((batch.num_rows, max(1, len(net.labels))))
            for i, j in chunks(offsets, 1 << 17):
                windows, row, length = _windows(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(windows) and net.labels:
                    weighted = net.probabilities(windows) * length[:, None]
                    for k in range(weighted.shape[1]):
                        total[i:j, k] += np.bincount(row, weighted[:, k], j - i)
            share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
            best = share.argmax(axis=1)
            known = letters & (total.sum(axis=1) > 0)
            lang = [net.labels[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score)], names=[f.name for f in schema])

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*kept, F.col(text_col).alias("_text_"), has_letter.alias("_letter_")).mapInArrow(work, schema)
