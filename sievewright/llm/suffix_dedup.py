"""Removal of long repeated strings by longest-previous-factor arrays.

A string is so many bytes, or so many whole words.  A suffix array of all bytes
would move eight bytes or more for each byte of text.  Suffixes are therefore
compared only where a repeat is possible:

1. Every window of the string's length names its anchor, the least hash of the
   grams inside it; equal windows have equal anchors.  Neighbouring windows
   with one anchor form a region, about one for a hundred bytes.
2. A region whose anchor (g) occurs once has no repeat.  Regions of one anchor
   and equal content (e) repeat each other wholly and go on as one content with
   its first place.  Counts combine on the map side, so a passage that a third
   of all documents share costs one row a map task, and joins deal plain tables,
   so that adaptive execution splits a common anchor's rows.
3. Anchors with different contents (the ends of repeats) are settled by suffix
   order: each content is cut out once, the cuttings of many anchors are put in
   one buffer, their window starts are ranked to the window's depth by prefix
   doubling, and the previous and next smaller (larger) positions in suffix order
   give the longest earlier (later) match.
4. An anchor with over ``group_limit`` contents would be one long task.  Its
   regions are cut into blocks of a few windows, by their distance from the
   anchor, and the core that all windows of a block share takes the anchor's
   place: step 2 again.  What is left, blocks of one core and different contents,
   is settled by counting their windows' hashes.  The rows are the same.

Equality of contents rests on two 64-bit hashes, of the anchor's gram and of the
whole region, and only regions of one anchor are held against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import ByteHasher, chunks, mix, sliding, text_buffers, words_of, written

_HASHER = ByteHasher(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)

#: Bytes of cuttings that one suffix order is made of (a single anchor's cuttings stay together).
PIECE_BYTES = 1 << 20
#: Numbers that a list of documents is reduced to before it is broadcast: 2 MiB at most.
SIEVE = 1 << 18
#: Windows of a block of a common anchor's region.
BLOCK = 16
#: Kinds of strings; the lowest bit of an anchor's hash names the kind.
BYTES, WORDS = 0, 1


def _regions(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, place of the anchor) of each region, over symbols.

    raw holds the hash of each gram by its place, offsets the rows' first symbols.
    """
    per = length - gram + 1
    n = len(raw) - per + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    # The upper hash bits decide, then the leftmost place.
    anchor = sliding(np.minimum, (raw & _HIGH) | np.arange(len(raw), dtype=np.uint64), per)
    head = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, offsets[:-1][offsets[:-1] < n])
    row = np.searchsorted(offsets, head, side="right") - 1
    last = offsets[row + 1] - length
    tail = np.minimum(np.r_[head[1:] - 1, n - 1], last)
    some = head <= last
    head, tail, row = head[some], tail[some], row[some]
    return row, head, tail, (anchor[head] & _LOW).astype(np.int64)


def _named(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes & ~np.uint64(1) | np.uint64(kind)).view(np.int64)


def regions(blob: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first byte, end, anchor hash, content hash) of each region of windows of so many bytes."""
    gram = length // 4
    prefix = _HASHER.prefix(blob)
    raw = _HASHER.rolling(prefix, gram, mixed=False)
    row, head, tail, anchor = _regions(raw, offsets, length, gram)
    base = offsets[row]
    return row, head - base, tail + length - base, _named(mix(raw[anchor]), BYTES), _HASHER.ranges(prefix, head, tail + length).view(np.int64)


def passage_words(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row): runs other than white space; kana and Han letters, written without it, are words of their own."""
    starts, ends, first = words_of(blob, offsets, _IS_WORD)
    lead = np.flatnonzero((blob >= 0xE3) & (blob <= 0xE9))
    if not len(lead):
        return starts, ends, first
    cuts = np.union1d(lead, lead + 3)
    run = np.searchsorted(starts, cuts, side="right") - 1
    cuts = cuts[(cuts > starts[run]) & (cuts < ends[run])]
    starts, ends = np.union1d(starts, cuts), np.union1d(ends, cuts)
    return starts, ends, np.searchsorted(starts, offsets)


def passage_regions(blob: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """As :func:`regions`, of windows of so many whole words."""
    gram = max(1, words // 4)
    starts, ends, first = passage_words(blob, offsets)
    if len(starts) < words:
        return (np.zeros(0, np.int64),) * 5
    prefix = _HASHER.prefix(blob)
    hashes = _HASHER.ranges(prefix, starts[: len(starts) - gram + 1], ends[gram - 1 :])
    row, head, tail, anchor = _regions(hashes, first, words, gram)
    a, b, base = starts[head], ends[tail + words - 1], offsets[row]
    return row, a - base, b - base, _named(hashes[anchor], WORDS), _HASHER.ranges(prefix, a, b).view(np.int64)


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)


def _doubled(first: np.ndarray, wanted: np.ndarray, have: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes at the wanted places to ``depth``, given keys that order ``have`` symbols from each place.

    Each level triples the depth (doubles it where ranks need over 21 bits) and
    ranks only the places that the next one looks at.  Places whose ``depth``
    symbols leave the text end early.
    """
    n = len(first)
    parts = 3 if n < (1 << 21) - 1 else 2
    bits = np.uint64(63 // parts)
    levels, size = [], have
    while size < depth:
        steps = [min(k * size, depth - size) for k in range(1, parts)]
        levels.append(steps)
        size = min(parts * size, depth)
    need = np.zeros(n, bool)
    need[wanted] = True
    needs = [need]
    for steps in reversed(levels):
        wider = need.copy()
        for step in steps:
            wider[step:] |= need[: n - step]
        needs.append(need := wider)
    needs.reverse()
    rank = np.zeros(n + depth, np.uint64)
    at = np.flatnonzero(needs[0])
    rank[at] = _dense(first[at])
    for steps, need in zip(levels, needs[1:], strict=True):
        at = np.flatnonzero(need)
        key = rank[at]
        for step in steps:
            key = (key << bits) | rank[at + step]
        rank = np.zeros_like(rank)
        rank[at] = _dense(key)
    return rank[wanted].astype(np.int64)


def suffix_ranks(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Lexicographic ranks, to the given depth of bytes, of the suffixes at the wanted places."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + len(text)]
    return _doubled(key, wanted, 8, depth)


def word_ranks(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray, words: int) -> np.ndarray:
    """Ranks, to so many words and what separates them, of the suffixes at the wanted words."""
    prefix = _HASHER.prefix(text)
    alone = _HASHER.ranges(prefix, starts[wanted], ends[wanted])
    if words == 1:
        return _dense(alone).astype(np.int64)
    after = _HASHER.ranges(prefix, np.r_[0, ends[:-1]], ends)  # a word and what stands before it
    rest = _doubled(after, wanted + 1, 1, words - 1)
    return _dense((_dense(alone) << np.uint64(32)) | rest.astype(np.uint64)).astype(np.int64)


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, or -1."""
    out = np.arange(len(x)) - 1
    active = np.flatnonzero(out >= 0)
    while len(active):
        active = active[x[out[active]] >= x[active]]
        out[active] = out[out[active]]
        active = active[out[active] >= 0]
    return out


def reaches(ranks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor at each position reaches the ranked depth.

    Of all earlier positions, the previous and the next smaller one in suffix
    order share the longest prefix; equal ranks mean it reaches the depth.
    """
    order = np.lexsort((positions, ranks))
    pos, rank = positions[order], ranks[order]
    before = nearest_smaller(pos)
    after = len(pos) - 1 - nearest_smaller(pos[::-1])[::-1]
    hit = (before >= 0) & (rank[before] == rank)
    inside = after < len(pos)
    hit[inside] |= rank[after[inside]] == rank[inside]
    out = np.empty(len(pos), bool)
    out[order] = hit
    return out


def _size_of(kind: int, length: int) -> int:
    """Bytes that a text needs to hold such a string."""
    return length if kind == BYTES else 2 * length - 1


def _windows(kind: int, length: int, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first byte, end, first symbol) of each window of the rows, and the words' (starts, ends)."""
    if kind == BYTES:
        counts, first, starts, ends = np.maximum(np.diff(offsets) - length + 1, 0), offsets[:-1], None, None
    else:
        starts, ends, first = passage_words(blob, offsets)
        counts, first = np.maximum(np.diff(first) - length + 1, 0), first[:-1]
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
    begin, end = (at, at + length) if kind == BYTES else (starts[at], ends[at + length - 1])
    return row, begin - offsets[row], end - offsets[row], at, starts, ends


def region_blocks(kind: int, length: int, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows (row, first byte, end), blocks (core hash, content hash, first window) and the windows' hashes of regions.

    Each row is one region.  Equal windows stand at equal distances from their
    anchor; a block is the windows at BLOCK distances, and its core is what all
    of them hold, whether or not the region has them all.
    """
    size, gram = max(1, min(BLOCK, length // 4)), max(1, length // 4)
    row, begin, end, at, starts, ends = _windows(kind, length, blob, offsets)
    prefix = _HASHER.prefix(blob)
    if kind == BYTES:
        raw, first = _HASHER.rolling(prefix, gram, mixed=False), offsets
    else:
        raw, first = _HASHER.ranges(prefix, starts[: max(len(starts) - gram + 1, 0)], ends[gram - 1 :]), np.searchsorted(starts, offsets)
    owner, _, _, place = _regions(raw, first, length, gram)
    anchor = np.zeros(len(offsets), np.int64)
    anchor[owner] = place
    block = (anchor[row] - at) // size
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])][: len(row)])
    tail = np.r_[head[1:], len(row)][: len(head)] - 1
    low = anchor[row[head]] - block[head] * size
    high = low - (size - 1) + length  # the core's symbols
    core = (low, high) if kind == BYTES else (starts[low], ends[high - 1])
    base = offsets[row]
    c = _HASHER.ranges(prefix, *core) ^ mix(block[head].astype(np.uint64) * np.uint64(2) + np.uint64(kind))
    e = _HASHER.ranges(prefix, (base + begin)[head], (base + end)[tail])
    h = _named(_HASHER.ranges(prefix, base + begin, base + end), kind)
    return row, begin, end, c.view(np.int64), e.view(np.int64), head, h


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, lengths: dict[int, int], keep: str, group_limit: int) -> DataFrame:
    """Rows (id, th, at array<struct<a,b,k>>): byte ranges of repeats, by kind, of documents that have any; th is the text's hash.

    lengths has the windows' length for each kind, BYTES or WORDS.
    """
    texts = _hashed(docs, id_col, text_col).where(F.octet_length("text") >= min(_size_of(*x) for x in lengths.items()))
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    long, integer, byte = T.LongType(), T.IntegerType(), T.ByteType()

    def schema(**columns) -> T.StructType:
        return T.StructType([id_field, *[T.StructField(n, t) for n, t in ({"th": integer, "a": integer, "b": integer} | columns).items()]])

    region_schema = schema(g=long, e=long)
    cutting_schema = schema(g=long, cut=T.BinaryType())
    window_type = T.StructType([T.StructField("a", integer), T.StructField("b", integer), T.StructField("h", long)])
    block_schema = schema(k=byte, c=long, e=long, at=T.ArrayType(window_type))
    span_schema = schema(k=byte)

    def emit(form: T.StructType, batch: pa.RecordBatch, row: np.ndarray, a: np.ndarray, b: np.ndarray, *columns) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *columns], names=form.fieldNames())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = text_buffers(batch.column(2))
            for i, j in chunks(offsets):
                for kind, length in lengths.items():
                    row, a, b, g, e = (regions, passage_regions)[kind](blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                    yield emit(region_schema, batch, row + i, a, b, pa.array(g), pa.array(e))

    found = texts.mapInArrow(find, region_schema)
    # What a join deals is read from tables: adaptive execution can then split a hot key's rows.
    twice = written(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "anchors")
    kept = written(found.join(twice, "g", "left_semi"), "regions")
    place = F.struct("id", "th", "a", "b")
    contents = written(kept.groupBy("g", "e").agg(F.count("*").alias("n"), F.min(place).alias("rep")), "contents")
    counts = written(contents.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    # Regions of a content that occurs more than once repeat wholly.
    equal = kept.join(contents.where("n > 1").select("g", "e", "rep"), ["g", "e"])
    if keep == "first":
        equal = equal.where(place > F.col("rep"))
    settled = equal.select("id", "th", "a", "b", F.col("g").bitwiseAND(F.lit(1).cast("long")).cast("byte").alias("k"))
    # One region of each content of the other anchors: cut out of its text.
    open_ = contents.join(counts, "g").select("g", "m", "rep.*")
    listed = lambda rows: rows.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b", "g")).alias("at"))

    def cuts(batch: pa.RecordBatch):
        """(row, first byte, end, anchor, bytes) of the wanted regions, some at a time."""
        at = batch.column(3)
        flat, owner = at.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(at.offsets)))
        a, b, g = (np.asarray(flat.field(k)) for k in range(3))
        blob, offsets = text_buffers(batch.column(2))
        start = offsets[owner]
        for i in range(0, len(owner), 10000):
            k = slice(i, i + 10000)
            yield owner[k], a[k], b[k], g[k], [blob[x:y].tobytes() for x, y in zip((start + a)[k].tolist(), (start + b)[k].tolist(), strict=True)]

    def cuttings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, a, b, g, cut in cuts(batch):
                yield emit(cutting_schema, batch, owner, a, b, pa.array(g), pa.array(cut, pa.binary()))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, a, _, g, cut in cuts(batch):
                for kind, length in lengths.items():
                    mine = np.flatnonzero(g & 1 == kind)
                    blob, offsets = text_buffers_binary(pa.array([cut[i] for i in mine], pa.large_binary()))
                    for i, j in chunks(offsets):
                        row, begin, end, c, e, first, h = region_blocks(kind, length, blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                        own = mine[row + i]
                        fields = [pa.array((a[own] + x).astype(np.int32)) for x in (begin, end)]
                        last = np.r_[first[1:], len(row)] - 1
                        at = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.StructArray.from_arrays([*fields, pa.array(h)], names=["a", "b", "h"]))
                        yield emit(block_schema, batch, owner[own[first]], (a[own] + begin)[first], (a[own] + end)[last], pa.array(np.full(len(first), kind, np.int8)), pa.array(c), pa.array(e), at)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(table: pa.Table, kind: int) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            blob, offsets = text_buffers_binary(batch.column(5))
            row, begin, end, at, starts, ends = _windows(kind, lengths[kind], blob, offsets)
            ranks = suffix_ranks(blob, at, lengths[kind]) if kind == BYTES else word_ranks(blob, starts, ends, at, lengths[kind])
            order = np.arange(len(at))
            hit = reaches(ranks, order)
            if keep == "none":
                hit |= reaches(ranks, -order)
            first = hit & np.r_[True, ~hit[:-1] | (row[1:] != row[:-1])]
            last = hit & np.r_[~hit[1:] | (row[1:] != row[:-1]), True]
            owner, base = row[first], np.asarray(batch.column(2))[row[first]]
            return emit(span_schema, batch, owner, base + begin[first], base + end[last], pa.array(np.full(len(owner), kind, np.int8)))

        def pieces(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
            """(kind, cuttings) of about PIECE_BYTES, anchors whole."""
            table = table.combine_chunks()
            g = np.asarray(table.column(4).chunk(0))
            size = text_buffers_binary(table.column(5).chunk(0))[1]
            low = before = 0
            for end in [*(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]:
                if before > low and (g[before] & 1 != g[low] & 1 or size[end] - size[low] > PIECE_BYTES):
                    yield int(g[low] & 1), table.slice(low, before - low)
                    low = before
                before = end
            yield int(g[low] & 1), table.slice(low)

        def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
            held: pa.Table | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                if held.get_total_buffer_size() < PIECE_BYTES:
                    continue
                g = np.asarray(held.column(4).combine_chunks())
                ends = np.flatnonzero(g[1:] != g[:-1]) + 1
                if len(ends):
                    yield from pieces(held.slice(0, int(ends[-1])))
                    held = held.slice(int(ends[-1]))
            if held is not None and held.num_rows:
                yield from pieces(held)

        def single(table: pa.Table) -> pa.Table:
            """Rows of equal id and text bring a cutting more than once, one after another."""
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for k in (4, 0, 1, 2):
                column = table.column(k).combine_chunks()
                same = pc.equal(column[1:], column[:-1])
                null = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
                new[1:] |= ~np.asarray(pc.or_(pc.fill_null(same, False), null).cast(pa.uint8())).astype(bool)
            return table.filter(pa.array(new))

        for kind, table in groups(batches):
            yield piece(single(table), kind)

    kind_first = F.col("g").bitwiseAND(F.lit(1).cast("long"))
    near = _join(texts, listed(open_.where(F.col("m") <= group_limit))).mapInArrow(cuttings, cutting_schema)
    near = near.repartition("g").sortWithinPartitions(kind_first, "g", "id", "th", "a").mapInArrow(settle, span_schema)
    spans = settled.unionByName(near)
    common = counts.where(F.col("m") > group_limit)
    if not common.isEmpty():
        wanted = written(listed(open_.where(F.col("m") > group_limit)), "common")
        # Few texts hold such regions: a list of at most SIEVE numbers keeps most others from being dealt.
        sieve = F.pmod(F.xxhash64("id", "th"), F.lit(SIEVE)).alias("sieve")
        some = texts.join(F.broadcast(wanted.select(sieve).distinct()), sieve == F.col("sieve"), "left_semi")
        spans = spans.unionByName(_counted(_join(some, wanted).mapInArrow(blocks, block_schema), keep))
    return spans.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b", "k"))).alias("at"))


def _counted(blocks: DataFrame, keep: str) -> DataFrame:
    """Rows (id, th, a, b, k) that repeat, of blocks (id, th, a, b, k, c core, e content, at windows).

    Rows of equal id and text bring a block more than once: it repeats if its places differ.
    """
    blocks = written(blocks, "blocks")
    place = F.struct("id", "th", "a")
    ends = lambda rows, *by: rows.groupBy(*by).agg(F.min(place).alias("rep"), F.max(place).alias("last"))
    more = ~F.col("rep").eqNullSafe(F.col("last"))
    later = lambda rows: rows.where(place > F.col("rep")) if keep == "first" else rows
    contents = written(ends(blocks, "c", "e"), "block-contents")
    cores = written(contents.groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c"), "cores")
    settled = later(blocks.drop("at").join(contents.where(more).drop("last"), ["c", "e"]))
    open_ = contents.join(cores, "c", "left_semi").select("c", "e", "rep")
    window = blocks.join(open_, ["c", "e"]).where(place.eqNullSafe(F.col("rep"))).select("id", "th", "k", F.explode("at").alias("w")).select("id", "th", "k", "w.*")
    window = written(window, "windows")
    found = later(window.join(ends(window, "h").where(more).drop("last"), "h"))
    columns = ["id", "th", "a", "b", "k"]
    return settled.select(columns).unionByName(found.select(columns))


def _hashed(docs: DataFrame, id_col: str, text_col: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """id, 32 bits of the text's hash (to tell apart rows of one id), text, and columns as _0, _1, ..."""
    extra = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]
    return docs.select(F.col(id_col).alias("id"), F.shiftright(F.xxhash64(F.col(text_col)), 32).cast("int").alias("th"), F.col(text_col).alias("text"), *extra)


def text_buffers_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _join(texts: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """texts with the other's column ``at``, by id and text hash; null ids match."""
    right = other.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "at")
    return texts.join(right, texts["id"].eqNullSafe(right["id2"]) & (texts["th"] == right["th2"]), how).drop("id2", "th2")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = 400,
    keep: str = "first",
    whole_letters: bool = False,
    group_limit: int = 2000,
    columns: tuple[str, ...] = (),
    min_words: int | None = None,
    passages_of: int | None = None,
) -> DataFrame:
    """Rows (<id>, n_bytes, n_removed, spans, kept, <n_passage,> <columns>): each text without its long repeats.

    Texts are UTF-8 bytes, a null text is empty, and matches stay within texts.
    With keep "none" every byte covered by a string of ``min_bytes`` bytes that
    also starts anywhere else goes; with "first" the string that comes first, by
    id, text hash and place, stays, and later ones go.  Strings are judged on
    the input.  spans are the maximal removed runs as (start, length), kept the
    remaining bytes; with ``whole_letters`` a letter cut in part stays whole.
    Repeated rows (equal id and text) count twice with "none" and as one
    document with "first".  Nulls in the id sort first and are kept.  Other
    ``columns`` of the input are carried along; rows of equal id and text carry
    those of one of them.  With ``min_words`` strings are so many whole words
    (see :func:`passage_words`), of any number of bytes, instead of ``min_bytes``.
    With ``passages_of``, n_passage has the bytes that repeats of so many whole
    words cover; they stay.
    """
    if keep not in ("first", "none") or min_bytes < 16:
        raise ValueError("keep is first or none, min_bytes 16 at least")
    if min_words and passages_of:
        raise ValueError("passages of words are removed or counted")
    lengths = {WORDS: min_words} if min_words else {BYTES: min_bytes} | ({WORDS: passages_of} if passages_of else {})
    removed_kind = WORDS if min_words else BYTES
    min_bytes = min(_size_of(*x) for x in lengths.items())  # shorter texts hold no repeat
    spans = repeated_spans(docs, id_col, text_col, lengths, keep, group_limit)
    texts = _hashed(docs, id_col, text_col)
    long_ = _join(texts.where(F.octet_length("text") >= min_bytes), spans, "left")
    extra = [f"_{i}" for i in range(len(columns))]
    if columns:
        # Joined by the keys that the texts are dealt by already: only light rows move.
        others = _hashed(docs, id_col, text_col, columns).where(F.octet_length("text") >= min_bytes).groupBy("id", "th").agg(F.struct(*[F.first(c).alias(c) for c in extra]).alias("at"))
        long_ = _join(long_.withColumnRenamed("at", "spans"), others, "left").withColumnsRenamed({"at": "others", "spans": "at"}).select("id", "text", "at", *[F.col(f"others.{c}").alias(c) for c in extra])
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    if passages_of:
        schema = schema.add("n_passage", T.LongType())
    for name, c in zip(extra, columns, strict=True):
        schema = schema.add(name, docs.schema[c].dataType)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def runs_of(at: pa.StructScalar, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of the ranges of a kind, which are sorted."""
        a, b, k = (np.asarray(at.values.field(i)) for i in range(3))
        a, b = a[k == kind], b[k == kind]
        # A range joins the run before it if it begins within it.
        high = np.maximum.accumulate(b)
        new = np.r_[True, a[1:] > high[:-1]][: len(a)]
        return a[new], high[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]] if len(a) else b

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = text_buffers(batch.column(1))
            kept, runs, removed, passage = [], [], [], []
            for i, at in enumerate(batch.column(2)):
                text = blob[offsets[i] : offsets[i + 1]]
                begin, end = runs_of(at, removed_kind) if at.is_valid else (np.zeros(0, int),) * 2
                if whole_letters and len(begin):
                    begin, end = _letters(text, begin, end)
                flags = np.ones(len(text), bool)
                for x, y in zip(begin, end, strict=True):
                    flags[x:y] = False
                kept.append(text[flags].tobytes())
                runs.append([{"start": int(x), "length": int(y - x)} for x, y in zip(begin, end, strict=True)])
                removed.append(int((end - begin).sum()))
                if passages_of:
                    begin, end = runs_of(at, WORDS) if at.is_valid else (np.zeros(0, int),) * 2
                    passage.append(int((end - begin).sum()))
            more = [pa.array(passage, pa.int64())] if passages_of else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, span_type), pa.array(kept, pa.binary()), *more, *batch.columns[3:]], names=schema.fieldNames()
            )

    done = long_.select("id", "text", "at", *extra).mapInArrow(cut, schema)
    short = _hashed(docs, id_col, text_col, columns).where(F.coalesce(F.octet_length("text"), F.lit(0)) < min_bytes).select(
        F.col("id").alias(id_col),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
        F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("kept"),
        *([F.lit(0).cast("long").alias("n_passage")] if passages_of else []),
        *extra,
    )
    return done.unionByName(short).withColumnsRenamed(dict(zip(extra, columns, strict=True)))


def _letters(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs shrunk to letter boundaries: removed bytes are whole letters."""
    lead = np.r_[(text & 0xC0) != 0x80, True]
    places = np.flatnonzero(lead)
    begin = places[np.searchsorted(places, begin)]
    end = places[np.searchsorted(places, end, side="right") - 1]
    some = end > begin
    return begin[some], end[some]
