"""Benchmark decontamination by winnowed word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import ByteHasher, chunks, mix, sliding, text_buffers, words_of, written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are runs of digits, letters and bytes beyond ASCII.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bits of the filter of benchmark fingerprints that every task gets: 8 MiB, whatever the benchmark's size.
FILTER_BITS = 26

class _Words:
    """Words of a slice of texts, with a hash of each."""

    hasher = ByteHasher(8)

    def __init__(self, blob: np.ndarray, offsets: np.ndarray):
        self.blob = _LOWER[blob]
        self.starts, self.ends, self.first = words_of(self.blob, offsets, _IS_WORD)
        self.hash = self.hasher.ranges(self.hasher.prefix(self.blob), self.starts, self.ends)
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether they are of one text)."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total, factor = np.zeros(m, np.uint64), 0x9E3779B97F4A7C15
        for j in range(n):
            total += self.hash[j : j + m] * np.uint64(factor)
            factor = factor * 0xD1342543DE82EF95 & (1 << 64) - 1 | 1
        return mix(total + np.uint64(n)), self.row[:m] == self.row[n - 1 :]

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends): the words with one space between those that something separated."""
        inside = _IS_WORD[self.blob]
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        at = np.concatenate([[0], np.cumsum(kept)])
        return np.where(inside, self.blob, np.uint8(32))[kept], at[self.starts], at[self.ends]


def winnowed(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some window of ``width`` k-grams.

    Any ``width`` neighbouring k-grams of one text have at least one of their
    positions chosen, and equal runs choose equal hashes.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    x = np.where(valid, hashes, top)
    pad = np.full(width - 1, top)
    least = sliding(np.minimum, np.concatenate([pad, x, pad]), width)
    return np.flatnonzero(valid & (sliding(np.maximum, least, width) == x))



def _prints(words: _Words, counts: np.ndarray, n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) to join on: winnowed k-grams for whole windows, every n-gram for shorter items.

    ``counts`` are the words of each row; only rows that can hold such a window count.
    """
    hashes, valid = words.grams(gram if n == window else n)
    if n == window:
        at = winnowed(hashes, valid & (counts >= window)[words.row[: len(hashes)]], window - gram + 1)
    else:
        at = np.flatnonzero(valid)
    return hashes[at], at


def _item_prints(items: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (n, h): the fingerprints of the items, by the length of their windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                words = _Words(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts = np.diff(words.first)
                for n in np.unique(np.minimum(counts, window)).tolist():
                    if n:
                        h, at = _prints(words, counts, n, window, gram)
                        h = np.unique(h[(np.minimum(counts, window) == n)[words.row[at]]])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], names=["n", "h"])

    return items.mapInArrow(work, "n int, h long").distinct()


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """Rows (words, item): every different window of every item, its words with spaces between."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                words = _Words(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                text, starts, ends = words.joined()
                n = np.minimum(np.diff(words.first), window)
                # Positions from which a whole window fits into the row.
                at = np.flatnonzero(np.arange(len(words.row)) + n[words.row] <= words.first[1:][words.row])
                to = at + n[words.row[at]] - 1
                raw = text.tobytes()
                for k in range(0, len(at), 1 << 16):
                    a, b = starts[at[k : k + (1 << 16)]].tolist(), ends[to[k : k + (1 << 16)]].tolist()
                    rows = pa.array(words.row[at[k : k + (1 << 16)]] + i)
                    yield pa.RecordBatch.from_arrays([pa.array([raw[x:y].decode() for x, y in zip(a, b, strict=True)], pa.string()), batch.column(0).take(rows)], names=["words", "item"])

    return items.mapInArrow(work, "words string, item string").distinct()


def _filter(prints: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value that the upper ``bits`` bits of some fingerprint have."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    packed = prints.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(max(1, 1 << bits >> 6), np.int64)
    table[packed["at"].to_numpy()] = packed["bits"].to_numpy()
    return table


def _candidates(texts: DataFrame, lengths: list[int], table: np.ndarray, bits: int, window: int, gram: int) -> DataFrame:
    """Rows (k, n, h, words, at) for fingerprints of the texts that pass the filter.

    ``words`` are those that windows around the fingerprint may hold, ``at`` the
    places of the first of them, in words; a text has one row for equal ones.
    """
    sent = texts.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("k", pa.binary()), ("n", pa.int32()), ("h", pa.int64()), ("words", pa.string()), ("at", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            blob, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                words = _Words(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts = np.diff(words.first)
                raw = None
                for n in lengths:
                    h, at = _prints(words, counts, n, window, gram)
                    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
                    some = (table[slot >> 6] >> (slot & 63)) & 1 == 1
                    h, at = h[some].view(np.int64), at[some]
                    if not len(at):
                        continue
                    row = words.row[at]
                    reach = window - gram if n == window else 0
                    a, b = np.maximum(at - reach, words.first[row]), np.minimum(at + n, words.first[row + 1])
                    if raw is None:
                        text, starts, ends = words.joined()
                        raw = text.tobytes()
                    seen: dict[tuple, list[int]] = {}
                    columns = (row, h, starts[a], ends[b - 1], a - words.first[row])
                    for r, x, s, e, place in zip(*(c.tolist() for c in columns), strict=True):
                        seen.setdefault((r, x, raw[s:e]), []).append(place)
                    keys = list(seen)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([k[0] + i for k in keys], pa.int64())).cast(pa.binary()),
                            pa.array(np.full(len(keys), n, np.int32)),
                            pa.array([k[1] for k in keys], pa.int64()),
                            pa.array([k[2].decode() for k in keys], pa.string()),
                            pa.array(list(seen.values()), schema.field("at").type),
                        ],
                        schema=schema,
                    )

    return texts.mapInArrow(work, "k binary, n int, h long, words string, at array<int>")


def _spans(hits: DataFrame) -> DataFrame:
    """Rows (k, n_hit, spans) of hits (k, n, shift, at): the union of the windows of each text."""
    grouped = hits.groupBy("k").agg(F.collect_list(F.struct("n", "shift", "at")).alias("hits"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for r in range(batch.num_rows):
                one = batch.column(1)[r].values
                at = one.field("at")
                size = np.diff(at.offsets.to_numpy())
                starts = at.flatten().to_numpy() + np.repeat(one.field("shift").to_numpy(), size)
                ends = starts + np.repeat(one.field("n").to_numpy(), size)
                order = np.argsort(starts, kind="stable")
                starts, reach = starts[order], np.maximum.accumulate(ends[order])
                new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
                first, last = starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]
                spans.append([{"start": a, "length": b - a} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                n_hit.append(int((last - first).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), pa.array(spans, kind)], names=["k", "n_hit", "spans"])

    return grouped.mapInArrow(work, "k binary, n_hit long, spans array<struct<start:int,length:int>>")


def _counted(docs: DataFrame, kept: list[str], text_col: str, key: F.Column) -> DataFrame:
    """Rows (<kept>, _text_key_, _n_words_) of all documents."""
    frame = docs.select(*kept, key.alias("_text_key_"), *([] if text_col in kept else [text_col]))
    out = T.StructType([*frame.schema.fields[: len(kept) + 1], T.StructField("_n_words_", T.LongType())])
    text_at = frame.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = text_buffers(batch.column(text_at))
            n = np.zeros(batch.num_rows, np.int64)
            for i, j in chunks(offsets):
                n[i:j] = np.diff(words_of(_LOWER[blob[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], _IS_WORD)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], pa.array(n)], names=[f.name for f in out])

    return frame.mapInArrow(work, out)


def contaminated_words(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    gram: int = 7,
    filter_bits: int = FILTER_BITS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: n_words, n_hit, ids of the items with occurring windows, runs of hit words.

    A-Z are lower-cased; words are runs of 0-9, a-z and bytes beyond ASCII.  A
    window is ``window`` consecutive words of an item; an item of fewer words is
    one window.  Both sides keep the least ``gram``-gram hash of each run of
    ``window - gram + 1``, and every n-gram where items have only n words.  The
    fingerprints are joined; what a hit reaches is cut into windows, which are
    joined with the items' windows word for word, so every shared window is
    found and nothing else.

    What a text holds depends on the text alone, so rows go by its SHA-256 and
    copies of a text are looked up once.  Every task gets a filter of
    2**``filter_bits`` bits, which spares the shuffle most fingerprints that no
    item has; those that it lets through fall out in the join.  Windows are
    joined as different ones, so neither frequent passages nor many items that
    share one give pairs of rows; what is used twice is written to the shared
    folder.  A null text has no words and no hits; null items and items without
    words have no windows; equal items all count, by id.  Columns named in
    ``keep`` stay in the result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    if not 6 <= filter_bits <= 30:
        raise ValueError("filter_bits must lie between 6 and 30")
    items = benchmark.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    prints = written(_item_prints(items, window, gram), "prints")
    owned = written(_item_windows(items, window), "windows")
    lengths = sorted(r.n for r in prints.select("n").distinct().collect())  # 1 to window

    key = F.unhex(F.sha2(text_col, 256))
    found = _candidates(docs.where(F.col(text_col).isNotNull()).select(key.alias("k"), F.col(text_col).alias("t")), lengths, _filter(prints, filter_bits), filter_bits, window, gram)
    joined = found.distinct().join(prints, ["n", "h"], "left_semi").withColumn("w", F.split("words", " "))
    cut = F.expr("transform(sequence(0, size(w) - n), i -> array_join(slice(w, i + 1, n), ' '))")
    pieces = joined.where("size(w) >= n").select("k", "n", "at", F.posexplode(cut).alias("shift", "words"))
    hits = written(pieces.join(owned.select("words").distinct(), "words", "left_semi"), "hits")

    of_items = hits.select("k", "words").distinct().join(owned, "words").select("k", "item").distinct()
    ids = of_items.groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("ids"))
    # Read from a table its size is known, so that a small one is broadcast and texts stay where they are.
    result = written(_spans(hits.select("k", "n", "shift", "at")).join(ids, "k"), "found")

    kept = [id_col, *[c for c in keep if c != id_col]]
    left = _counted(docs, kept, text_col, key).join(result.select(F.col("k").alias("_text_key_"), F.col("n_hit").alias("_n_hit_"), F.col("ids").alias("_ids_"), F.col("spans").alias("_spans_")), "_text_key_", "left")
    return left.select(
        *kept,
        F.col("_n_words_").alias("n_words"),
        F.coalesce("_n_hit_", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_ids_", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("_spans_", F.array().cast("array<struct<start:int,length:int>>")).alias("hit_spans"),
    )


def is_contaminated() -> F.Column:
    """At least a twentieth of the words, and one of them, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


