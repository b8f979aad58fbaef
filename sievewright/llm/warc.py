"""WARC archives with a two-level capture index.

Records are gzip members of WARC files in one folder.  The index is two-level:
capture lines sorted by reversed-host URL key lie in gzip blocks, one file for
each range of keys, and a sparse directory holds each block's first key, file,
offset and size.  A lookup binary-searches the ranges, the directory and the
block, then reads one byte range of an archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import open_fs, scratch_uri, written

#: Capture lines in an index block.
BLOCK_LINES = 256
#: Captures of one key that one lookup reads.
SLICE = 256
#: Bytes of records, as stored, that one task reads, and so many tasks at most.
TASK_BYTES, MAX_TASKS = 8 << 20, 100_000
#: Payloads of so many bytes are recorded once.
MIN_REVISIT = 1000

CAPTURES = "key string, page_id string, file string, offset long, length long"
BLOCKS = "part int, first_key string, file string, offset long, length long, lines int"


def url_key(url: str = "url") -> F.Column:
    """Reversed host, then the rest: com,example,www)/path?query. Scheme, www., default port and fragment go; null stays empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r":(80|443)$|^.*@", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def revisits(pages: DataFrame, id_col: str, body_col: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Rows (id, digest, refers_to) of the pages whose payload another, of larger id, records.

    Only ids and digests are shuffled; counts combine before the shuffle, and a
    join by digest can be split where one payload is very common.
    """
    digest = F.sha1(F.coalesce(F.encode(body_col, "UTF-8"), F.lit(b"")))
    light = pages.where(F.octet_length(body_col) >= min_bytes).select(F.col(id_col).alias("id"), digest.alias("digest")).where("id is not null")
    kept = light.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return light.join(kept, "digest").where("id < refers_to").select("id", "digest", "refers_to").distinct()


def _record(kind: str, url: str, date: str, digest: bytes, payload: bytes, size: int, page_id, refers_to) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {size}",
        f"X-Page-Id: {json.dumps(page_id)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {json.dumps(refers_to)}"]
    body = b"" if kind == "revisit" else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one gzip member; a damaged one raises ValueError."""
    try:
        data = zlib.decompress(member, 31)
    except zlib.error as e:
        raise ValueError(f"damaged record: {e}") from e
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    return headers, rest[:size]


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> None:
    """Writes a record for each page and the index under ``folder``, a URI all executors share.

    Equal payloads of at least ``min_revisit`` bytes are a response at the
    largest id and revisits elsewhere.  A null payload is empty, a null url the
    empty url; pages of null id are responses; rows of equal id and payload are
    recorded each.  A task writes files under names of its own attempt, and the
    index names those of attempts that ended well.
    """
    old = revisits(pages, id_col, body_col, min_revisit)
    body = F.coalesce(F.encode(body_col, "UTF-8"), F.lit(b""))
    full = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), url_key(url_col).alias("key"), body.alias("body")).withColumn("sha", F.sha1("body"))
    joined = full.join(old, (full.page == old.id) & (full.sha == old.digest), "left").select("page", "url", "key", "sha", "refers_to", "body")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        name, out, at = f"warc-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page, url, key, sha, refers, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(f"{path}/records", recursive=True)
                    out = fs.open_output_stream(f"{path}/records/{name}", compression=None)
                kind = "response" if refers is None else "revisit"
                member = _gzip(_record(kind, url, date, bytes.fromhex(sha), body, len(body), page, refers))
                out.write(member)
                rows.append((key, json.dumps(page), name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    joined.mapInArrow(put, CAPTURES).write.parquet(f"{folder}/captures")
    spark = pages.sparkSession

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        part = TaskContext.get().partitionId()
        name, out, at, held, directory = f"index-{part:05d}-{uuid.uuid4().hex}.gz", None, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                fs.create_dir(f"{path}/index", recursive=True)
                out = fs.open_output_stream(f"{path}/index/{name}", compression=None)
            packed = _gzip(b"\n".join(json.dumps(x).encode() for x in held))
            directory.append((part, held[0][0], name, at, len(packed), len(held)))
            out.write(packed)
            at += len(packed)
            held = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("part", "first_key", "file", "offset", "length", "lines"), d, strict=True)) for d in directory],
                pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())]),
            )

    # The page id is a part of the range key, so that one very common url can be split.
    captures = spark.read.schema(CAPTURES).parquet(f"{folder}/captures")
    captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(block, BLOCKS).write.parquet(f"{folder}/directory")


class Index:
    """Binary search in the index of one archive folder; keeps a few blocks and the range reads' handles."""

    def __init__(self, folder: str, ranges: list[tuple[str, int]]):
        self.fs, self.path = open_fs(folder)
        self.first, self.part = [k for k, _ in ranges], [p for _, p in ranges]
        self.directory: dict[int, list[tuple]] = {}
        self.block: tuple = (None, [])
        self.handles: dict = {}

    def _blocks(self, part: int) -> list[tuple]:
        if part not in self.directory:
            import pyarrow.dataset as ds

            if len(self.directory) > 8:
                self.directory.clear()
            table = ds.dataset(f"{self.path}/directory", filesystem=self.fs, format="parquet").to_table(filter=ds.field("part") == part)
            rows = zip(*(table[c].to_pylist() for c in ("first_key", "file", "offset", "length", "lines")), strict=True)
            self.directory[part] = sorted(rows, key=lambda r: (r[0], r[2]))
        return self.directory[part]

    def read(self, kind: str, name: str, offset: int, length: int, tries: int = 3) -> bytes:
        for left in range(tries - 1, -1, -1):
            try:
                if name not in self.handles:
                    if len(self.handles) >= 64:
                        self.handles.pop(next(iter(self.handles))).close()
                    self.handles[name] = self.fs.open_input_file(f"{self.path}/{kind}/{name}")
                data = self.handles[name].read_at(length, offset)
                if len(data) == length:
                    return data
                raise OSError(f"{name}: {len(data)} of {length} bytes at {offset}")
            except OSError:
                self.handles.pop(name, None)
                if not left:
                    raise
        raise AssertionError

    def captures(self, key: str, start: int = 0, stop: int | None = None) -> Iterator[list]:
        """Capture lines (key, page id, file, offset, length) of a key, in order, from the start-th to before the stop-th.

        Blocks that hold nothing but the key and lie before the start are counted by the directory, not read.
        """
        at = max(bisect.bisect_left(self.first, key) - 1, 0)
        seen = 0
        while at < len(self.first) and self.first[at] <= key:
            blocks = self._blocks(self.part[at])
            keys = [b[0] for b in blocks]
            after = self.first[at + 1] if at + 1 < len(self.first) else None
            k = max(bisect.bisect_left(keys, key) - 1, 0)
            while k < len(blocks) and keys[k] <= key and (stop is None or seen < stop):
                _, name, offset, length, lines = blocks[k]
                follows = keys[k + 1] if k + 1 < len(keys) else after
                if keys[k] == follows == key and seen + lines <= start:
                    seen += lines
                    k += 1
                    continue
                if self.block[0] != (name, offset):
                    rows = [json.loads(x) for x in zlib.decompress(self.read("index", name, offset, length), 31).split(b"\n")]
                    self.block = ((name, offset), rows, [x[0] for x in rows])
                rows, inside = self.block[1], self.block[2]
                found = rows[bisect.bisect_left(inside, key) : bisect.bisect_right(inside, key)]
                yield from found[max(0, start - seen) : None if stop is None else max(0, stop - seen)]
                seen += len(found)
                k += 1
            at += 1


RESULT = "key string, page_id string, record_type string, url string, digest string, payload_bytes long, refers_to string, payload binary"


def lookup(keys: DataFrame, folder: str, key_col: str = "key", with_payload: bool = True) -> DataFrame:
    """Captures of the wanted keys, each read by its byte range; ids are JSON text.

    Keys are sorted by range first, so that a task's lookups share blocks, and
    dealt to as many tasks as the records' bytes need; a key of many captures is
    looked up in slices of SLICE.  Keys that are null or not captured have no
    row; each distinct key is looked up once.  A revisit has the digest and size
    of the payload that it refers to.
    """
    spark = keys.sparkSession
    # A row for each index file, of which there are as many as shuffle partitions.
    ranges = sorted((r.k, r.part) for r in spark.read.schema(BLOCKS).parquet(f"{folder}/directory").groupBy("part").agg(F.min("first_key").alias("k")).collect())
    form = pa.schema([("key", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = Index(folder, ranges), []
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, page, name, offset, length in index.captures(key, part * SLICE, (part + 1) * SLICE):
                    headers, payload = parse_record(index.read("records", name, offset, length))
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                    kind = headers["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"{name}: wrong payload at {offset}")
                    rows.append((key, page, kind, headers["WARC-Target-URI"], digest.hex(), int(headers["X-Payload-Length"]), headers.get("X-Refers-To-Page-Id"), payload if with_payload else None))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)

    counts = spark.read.schema(CAPTURES).parquet(f"{folder}/captures").groupBy("key").agg(F.count("*").alias("n"), F.sum("length").alias("size"))
    wanted = written(keys.select(F.col(key_col).alias("key")).where("key is not null").distinct().join(counts, "key"), "wanted")
    size = wanted.agg(F.sum("size")).first()[0] or 0
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLICE))).alias("slice")
    parts = max(1, min(-(-size // TASK_BYTES), MAX_TASKS))
    return wanted.select("key", slices).repartitionByRange(parts, "key", "slice").sortWithinPartitions("key", "slice").mapInArrow(get, RESULT)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes all pages to a new folder and looks all their urls up again."""
    folder = scratch_uri(pages.sparkSession, "warc")
    write(pages, folder, id_col, url_col, body_col)
    out = lookup(pages.select(url_key(url_col).alias("key")), folder, "key", with_payload)
    kind = pages.schema[id_col].dataType
    read = lambda c: F.from_json(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), T.StructType([T.StructField("v", kind)]))["v"]
    return out.select(read("page_id").alias(id_col), "url", "payload_bytes", "digest", "record_type", read("refers_to").alias("refers_to"), "payload")
