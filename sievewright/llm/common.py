"""Helpers shared by the operators: shared folders, Arrow buffers, byte hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step works on; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

_PRIME = 0x9E3779B97F4A7C15 | 1
_PRIME_INV = pow(_PRIME, -1, 1 << 64)


#: Folders that scratch_uri has named, by application.
_NAMED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the session is local, as in tests, a local folder
    is made and set; on a cluster the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder under the shared folder."""
    where = shared_dir(spark).rstrip("/")
    if "://" not in where:
        where = ("file:" if where.startswith("file:") else "file://") + where.removeprefix("file:")
    uri = f"{where}/{name}-{uuid.uuid4().hex}"
    _NAMED.setdefault(spark.sparkContext.applicationId, []).append(uri)
    return uri


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what the application has written by scratch_uri; results not yet computed are lost."""
    for uri in _NAMED.pop(spark.sparkContext.applicationId, []):
        delete_uri(spark, uri)


def delete_uri(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a Parquet row group where one row may have some MiB.
WIDE_GROUP_BYTES = 4 << 20


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df from a table in the shared folder, so that what uses it twice computes it once.

    wide: rows may have some MiB.  Spark's reader decodes up to 4096 rows of a row
    group at once, and Parquet looks at a group's size only every 100 rows, so a
    task would hold a whole file; row groups of WIDE_GROUP_BYTES, looked at after
    each row, bound what its writer and its reader hold.
    """
    path = scratch_uri(df.sparkSession, name)
    groups = {"parquet.block.size": str(WIDE_GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    df.write.options(**groups if wide else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; works for local, HDFS and object-store URIs."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


#: Bytes of an Arrow batch that a task sends to Python at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session to BATCH_BYTES where it has Spark's default of 64 MiB.

    A batch is held by the executor and by its Python worker, some parts of it
    more than once, beside all other tasks of the executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, str(BATCH_BYTES))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without a copy; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    blob = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return blob[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class ByteHasher:
    """Polynomial hashes modulo 2**64 of any byte range, from prefix sums.

    Each byte value has a random 64-bit weight, and results are mixed, so equal
    ranges have equal hashes and different ones differ but for chance.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.weights = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("powers", _PRIME), ("inverse", _PRIME_INV)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, blob: np.ndarray) -> np.ndarray:
        self._grow(len(blob) + 1)
        out = np.zeros(len(blob) + 1, np.uint64)
        np.cumsum(self.weights[blob] * self.powers[: len(blob)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of blob[start:end], for arrays of starts and ends."""
        return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def rolling(self, prefix: np.ndarray, length: int, mixed: bool = True) -> np.ndarray:
        """Hashes of all ranges of one length, by start; unmixed ones have weak lower bits."""
        n = len(prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (prefix[length:] - prefix[:n]) * self.inverse[:n] + np.uint64(length)
        return mix(raw) if mixed else raw


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(blob: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of maximal runs of word bytes.

    ``is_word`` says of each byte value whether it belongs to words; rows end runs.
    """
    n = len(blob)
    inside = is_word[blob]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over each window of ``width``, by start; length len(x) - width + 1."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
