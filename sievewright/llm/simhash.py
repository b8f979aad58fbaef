"""SimHash near-duplicate detection: fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import batch_of, chunks, text_buffers, words_of
from sievewright.llm.components import connected_components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _majorities(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each row's run of hashes, the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    # 16-bit lanes hold four counters a word: runs are cut below 2**16 entries.
    pieces = (counts[rows] + 59999) // 60000
    owner = np.repeat(np.arange(len(rows)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[rows][owner] + nth * 60000
    of_row = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    lane = np.uint64(0x0001000100010001)
    for j in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lane, starts)
        for k in range(4):
            ones = np.add.reduceat(((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64), of_row)
            out[rows] |= (2 * ones > counts[rows]).astype(np.uint64) << np.uint64(j + 16 * k)
    return out


def text_fingerprints(blob: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: see :func:`fingerprints`."""
    blob = _LOWER[blob]
    starts, ends, first = words_of(blob, offsets, _IS_WORD)
    counts = np.diff(first)
    inside = _IS_WORD[blob]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one separator after each word
    flat = np.where(inside, blob, np.uint8(0x20))[keep].tobytes()
    place = np.cumsum(keep) - keep
    begin, stop = place[starts], place[ends - 1] + 1
    grams = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    total = int(grams.sum())
    of_row = np.cumsum(grams) - grams
    row = np.repeat(np.arange(len(grams)), grams)
    head = first[:-1][row] + np.arange(total) - of_row[row]
    tail = np.minimum(head + shingle, first[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], seed) for a, b in zip(begin[head].tolist(), stop[tail].tolist(), strict=True)), np.uint64, total)
    return _majorities(hashes, of_row, grams)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (<id>, fp): the SimHash of each whole text as a signed 64-bit number.

    A-Z are lower-cased, words are runs of bytes other than white space
    (20, 09-0D), shingles are ``shingle`` words joined by one space, repeats
    included; fewer words make one shingle, none (or null) fingerprint 0.  Each
    shingle's XXH64 (seed 42) votes; a bit is set if over half the votes have it.
    """
    id_type = docs.schema[id_col].dataType
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = text_buffers(batch.column(1))
            fps = [
                text_fingerprints(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in chunks(offsets)
            ]
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


def links(fps: DataFrame, max_distance: int = 2, n_blocks: int = 4, bucket_limit: int = 64) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within ``max_distance`` bits.

    Pigeonhole: of ``n_blocks`` equal blocks two close fingerprints share at
    least ``n_blocks - max_distance``; each choice of so many blocks is a key.
    Buckets of up to ``bucket_limit`` fingerprints are self-joined and verified
    by Hamming distance.  Fuller buckets take an exact way of linear cost: each
    fingerprint emits itself and its 64 one-bit neighbours; two within two bits
    share such a value, and all sharers (65 at most) are within two bits of each
    other, so a star of edges to their least stands for all pairs.
    """
    if max_distance != 2:
        raise ValueError("the exact way for full buckets holds for distance 2")
    width = 64 // n_blocks
    keys = []
    for c, chosen in enumerate(combinations(range(n_blocks), n_blocks - max_distance)):
        key = F.lit(c).cast("long")
        for k in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1))
        keys.append(key)
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    small = keyed.join(sizes.where(F.col("n") <= bucket_limit).select("key"), "key")
    other = small.select("key", F.col("fp").alias("fp2"))
    near = (
        small.join(other, "key")
        .where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_distance))
        .select(F.col("fp2").alias("a"), F.col("fp").alias("b"))
    )
    full = keyed.join(sizes.where(F.col("n") > bucket_limit).select("key"), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    stars = (
        full.select("fp", F.explode(flips).alias("bit"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
        .groupBy("value")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
        .where("a > b")
    )
    return near.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 2,
    n_blocks: int = 4,
    bucket_limit: int = 64,
) -> DataFrame:
    """Rows (<id>, fp, component): every document with the least id it is linked to.

    Links join equal fingerprints and those within ``max_distance`` bits; a
    component is all that chains of links reach.  Null ids keep a row and never
    name a component (a component of null ids alone has component null).
    Fingerprints and components never come to the driver.
    """
    from sievewright.llm.common import checkpointed

    of_docs = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    least = of_docs.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(links(least.select("fp"), max_distance, n_blocks, bucket_limit))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(named, "root").select("fp", "component")
    return of_docs.join(classes, "fp").select(id_col, "fp", "component")
