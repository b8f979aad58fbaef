"""Media columns: payloads in image archives, read back by a Spark data source.

A payload is stored losslessly as an 8-bit greyscale PNG of 64 samples a row;
images lie uncompressed in ZIP archives of bounded size.  The data source
``media_archive`` plans byte ranges over a folder's archives, reads each
archive's own directory, streams the members that begin in its range in Arrow
batches, and retries each member by its offset.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievewright.llm.common import open_fs, scratch_uri

WIDTH = 64
#: An archive is closed beyond so many bytes; a byte range of the reader's plan.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20

MEMBERS = "id string, n_bytes long, archive string, member string, offset long, media binary"
_ARROW = pa.schema([("id", pa.string()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(payload: bytes) -> bytes:
    """The payload with zeros appended up to a positive multiple of the width."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def to_png(samples: bytes, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG; samples are a positive multiple of the width."""
    rows = len(samples) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # filter byte 0, then the samples
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such a PNG; checks each chunk and raises ValueError on damage."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, packed = 8, None, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(data) < size or zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return lines[:, 1:].tobytes()


def write_archives(rows: DataFrame, folder: str, id_col: str, text_col: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Stores each text's payload under ``folder``, a URI all executors share.

    A task writes archives under names of its own attempt; the manifest, written
    when all tasks have ended, names those that count.  No row is shuffled.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        fs.create_dir(f"{path}/archives", recursive=True)
        raw = archive = name = None
        n = 0
        for batch in batches:
            closed = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    name = f"media-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip"
                    raw = fs.open_output_stream(f"{path}/archives/{name}", compression=None)
                    archive, n = zipfile.ZipFile(_Counted(raw), "w", zipfile.ZIP_STORED, allowZip64=True), 0
                data = (text or "").encode()
                info = zipfile.ZipInfo(f"{n:09d}.png")
                info.comment = json.dumps([key, len(data)]).encode()
                archive.writestr(info, to_png(padded(data)))
                n += 1
                if archive.fp.tell() > archive_bytes:
                    archive.close()
                    closed.append((name, raw.tell(), n))
                    raw.close()
                    archive = None
            if closed:
                yield _manifest(closed)
        if archive is not None:
            archive.close()
            size = raw.tell()
            raw.close()
            yield _manifest([(name, size, n)])

    rows.select(F.to_json(F.struct(F.col(id_col).alias("v")), {"ignoreNullFields": "false"}), F.col(text_col)).mapInArrow(put, "archive string, size long, members int").write.parquet(f"{folder}/manifest")


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["archive", "size", "members"])


class _Counted:
    """A write-only stream for zipfile that knows its place but cannot seek."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        pass


class ArchiveRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over the archives of the manifest; as many as the bytes need."""
        import pyarrow.dataset as ds

        fs, path = open_fs(self.folder)
        listed = ds.dataset(f"{path}/manifest", filesystem=fs, format="parquet").to_table(columns=["archive", "size"])
        found = sorted(zip(listed["archive"].to_pylist(), listed["size"].to_pylist(), strict=True))
        return [ArchiveRange(a, i, min(i + self.range_bytes, size)) for a, size in found for i in range(0, size, self.range_bytes)] or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, path = open_fs(self.folder)
        name = f"{path}/archives/{partition.archive}"
        with fs.open_input_file(name) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if partition.start <= m.header_offset < partition.end]
        rows, size = [], 0
        for m in members:
            media = self._member(fs, name, m)
            key, n = json.loads(m.comment)
            rows.append((key, n, partition.archive, m.filename, m.header_offset, media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def _member(self, fs, name: str, member: zipfile.ZipInfo) -> bytes:
        """One member's bytes by its offset; a failed or damaged read is tried anew by itself."""
        for left in range(self.tries - 1, -1, -1):
            try:
                if self._open is None or self._open[0] != name:
                    self._open = (name, fs.open_input_file(name))
                file = self._open[1]
                head = file.read_at(30, member.header_offset)
                names, extra = struct.unpack_from("<HH", head, 26)
                media = file.read_at(member.file_size, member.header_offset + 30 + names + extra)
                if zlib.crc32(media) != member.CRC:
                    raise OSError(f"{name}: damaged member at {member.header_offset}")
                return media
            except (OSError, struct.error):
                self._open = None
                if not left:
                    raise
        raise AssertionError

    _open = None


class MediaArchive(DataSource):
    """Rows (id, n_bytes, archive, member, offset, media) of the archives in a folder; id is JSON."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def describe(samples: bytes) -> str:
    """Rows, mean, spread, share of changed neighbours and coarse histogram of an image's samples."""
    x = np.frombuffer(samples, np.uint8)
    wide = x.astype(np.int64)
    n, total, square = len(x), int(wide.sum()), int((wide * wide).sum())
    histogram = np.bincount(x >> 4, minlength=16)
    steps = int(np.count_nonzero(x[1:] != x[:-1]))
    return f"rows={n // WIDTH};sum={total};var={(n * square - total * total) // (n * n)};edges={steps};hist=" + ",".join(map(str, histogram))


FEATURES = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """Digests and features of each member's stored bytes and of the payload decoded from them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                payload = from_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in FEATURES.split(", ")])

    return members.select("id", "n_bytes", "media").mapInArrow(work, FEATURES)


def store_and_describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text (null: empty) as media, reads it back, and returns its features.

    Rows keep their id, null and repeated ids too; equal texts give equal values.
    """
    folder = scratch_uri(docs.sparkSession, "media")
    write_archives(docs, folder, id_col, text_col)
    out = features(read_archives(docs.sparkSession, folder))
    from pyspark.sql import types as T

    one = T.StructType([T.StructField("v", docs.schema[id_col].dataType)])
    return out.select(F.from_json("id", one)["v"].alias(id_col), *[c for c in out.columns if c != "id"])
