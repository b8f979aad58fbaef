"""Cross-tokenizer alignment: sparse incidence products link the tokens of two vocabularies."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.bpe import byte_letters
from sievewright.llm.common import chunks, text_buffers, written

#: Bytes of text whose links are counted together; a longer text is a chunk of its own.
LINK_CHUNK_BYTES = 2 << 20
#: Products that one step of a sparse product spreads out.
PRODUCTS = 1 << 21
#: Segments, and letters of them, that a task remembers; those met once are forgotten first.
KEEP_SEGMENTS, KEEP_LETTERS = 200_000, 6 << 20
#: Letters of new segments that are encoded as one text.
JOINED_LETTERS = 1 << 15
#: A segment begins with a space that follows a letter both tokenizers take for no white space.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f\u180e\u200b])(?= )")
_B_BITS = 20


class Csr(NamedTuple):
    """A sparse matrix of counts: row i has columns ``at[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    at: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> Csr:
        """Counts of (row, column) pairs."""
        keys, counts = np.unique(rows * n_columns + columns, return_counts=True)
        own = keys // max(n_columns, 1)
        return cls(np.searchsorted(own, np.arange(n_rows + 1)), keys - own * n_columns, counts)

    def transposed(self, n_columns: int) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.at, kind="stable")
        return Csr(np.searchsorted(self.at[order], np.arange(n_columns + 1)), rows[order], self.counts[order])

    def times(self, other: Csr, n_columns: int) -> Csr:
        """Gustavson's product: each row of the result is the sum of the other's rows that this row names.

        Rows are taken in blocks of about PRODUCTS products; a block's products
        are spread out, sorted by (row, column) and added up.
        """
        sizes = np.diff(other.starts)[self.at]
        n_rows = len(self.starts) - 1
        upto = np.concatenate([[0], np.cumsum(sizes)])[self.starts]
        begin, found = 0, []
        while begin < n_rows:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PRODUCTS, side="right")) - 1)
            part = slice(self.starts[begin], self.starts[end])
            row = np.repeat(np.arange(begin, end), np.diff(self.starts[begin : end + 1]))
            size = sizes[part]
            place = np.repeat(other.starts[self.at[part]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            keys = np.repeat(row, size) * n_columns + other.at[place]
            values = np.repeat(self.counts[part], size) * other.counts[place]
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            found.append((keys[heads], np.add.reduceat(values, heads) if len(heads) else values))
            begin = end
        keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
        values = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.int64)
        own = keys // max(n_columns, 1)
        return Csr(np.searchsorted(own, np.arange(n_rows + 1)), keys - own * n_columns, values)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Token-byte incidence of tokens that follow each other."""
    n = int(lengths.sum())
    return Csr(np.concatenate([[0], np.cumsum(lengths)]), np.arange(n), np.ones(n, np.int64))


class Aligned(NamedTuple):
    """Of each segment: token counts, groups, links by id pair (a << 20 | b), and its groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_overlaps: np.ndarray
    pair_starts: np.ndarray
    pairs: np.ndarray
    links: np.ndarray
    groups: list[bytes]


def align(a_ids: np.ndarray, a_lengths: np.ndarray, a_counts: np.ndarray, b_ids: np.ndarray, b_lengths: np.ndarray, b_counts: np.ndarray) -> Aligned:
    """Groups and links of segments whose tokens and token lengths in bytes are given in order.

    A·Bᵀ over the bytes gives the pairs of tokens that overlap.  In their order a
    group ends where both tokens change at once: there both end.  The product of
    the incidences of ids in groups then gives, for each segment and pair of
    ids, the pairs of occurrences that share a group.
    """
    n = len(a_counts)
    overlap = token_bytes(a_lengths).times(token_bytes(b_lengths).transposed(int(b_lengths.sum())), len(b_ids))
    a = np.repeat(np.arange(len(a_ids)), np.diff(overlap.starts))
    b = overlap.at
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) & (b[1:] != b[:-1])
    group = np.cumsum(first) - 1
    n_all = int(group[-1]) + 1 if len(group) else 0
    group_a, group_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    group_a[a], group_b[b] = group, group
    segment_a, segment_b = np.repeat(np.arange(n), a_counts), np.repeat(np.arange(n), b_counts)
    keys_a, row_a = np.unique((segment_a << _B_BITS) | a_ids, return_inverse=True)
    kinds_b, column_b = np.unique(b_ids, return_inverse=True)
    in_a = Csr.of(row_a, group_a, len(keys_a), n_all)
    in_b = Csr.of(column_b, group_b, len(kinds_b), n_all)
    shared = in_a.times(in_b.transposed(n_all), len(kinds_b))
    owner = np.repeat(np.arange(len(keys_a)), np.diff(shared.starts))
    pairs = ((keys_a[owner] & ((1 << _B_BITS) - 1)) << _B_BITS) | kinds_b[shared.at]
    pair_starts = np.searchsorted(keys_a[owner] >> _B_BITS, np.arange(n + 1))
    segment_of_link = segment_a[a]
    segment_of_group = segment_of_link[first]
    bounds = np.searchsorted(segment_of_group, np.arange(n + 1))
    groups = _group_texts(a_ids, group_a, b_ids, group_b, bounds)
    return Aligned(a_counts, b_counts, np.diff(bounds), np.bincount(segment_of_link, minlength=n), pair_starts, pairs, shared.counts, groups)


def _group_texts(a_ids: np.ndarray, group_a: np.ndarray, b_ids: np.ndarray, group_b: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """``a,a|b;a|b,b`` of the groups bounds[i]..bounds[i + 1] of each segment."""
    ids, group = np.concatenate([a_ids, b_ids]), np.concatenate([group_a, group_b])
    side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side = ids[order], group[order], side[order]
    before = np.full(len(ids), ord(","), np.uint8)
    new_group = np.r_[True, group[1:] != group[:-1]] if len(ids) else np.zeros(0, bool)
    before[new_group] = ord(";")
    before[1:][(side[1:] == 1) & (side[:-1] == 0)] = ord("|")
    width = 1 + np.searchsorted([10, 100, 1000, 10_000, 100_000, 1_000_000], ids, side="right")
    ends = np.cumsum(width + 1)
    text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text[ends - width - 1] = before
    for k in range(int(width.max(initial=0))):
        own = width > k
        text[ends[own] - 1 - k] = 48 + ids[own] // 10**k % 10
    flat = text.tobytes()
    at = np.concatenate([(ends - width - 1)[new_group], [len(flat)]]) if len(ends) else np.zeros(1, np.int64)
    return [flat[i + 1 : j] for i, j in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), strict=True)]


class _Bytes(NamedTuple):
    """The bytes of tokens by id: ``blob[starts[i]:starts[i + 1]]``."""

    blob: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, tokens: dict[int, bytes]) -> _Bytes:
        every = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        return cls(np.frombuffer(b"".join(every), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in every])]))

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids in order, how many each has)."""
        lengths = self.starts[ids + 1] - self.starts[ids]
        return self.blob[np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))], lengths


class Tokenizers:
    """Vocabulary A (byte-level BPE, a tokenizer file) and B (a sentencepiece model), and the bytes of their tokens."""

    def __init__(self, a_file: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        spec = json.loads(a_file)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        a_bytes = {i: bytes(map(byte_of.__getitem__, t)) if set(t) <= byte_of.keys() else t.encode() for i, t in names.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.a_bytes, self.b_bytes = _Bytes.of(a_bytes), _Bytes.of(b_bytes)
        self.space = self.b.piece_to_id("▁")
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        #: Whether tokens of neither reach over a cut of CUT.
        self.cuts = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.letters_kept = 0
        none = np.zeros(0, np.int64)
        self.table = Aligned(none, none, none, none, np.zeros(1, np.int64), none, none, [])
        self.good = np.zeros(0, bool)
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the segments met most often, at least twice and half of the bounds at most."""
        names = sorted(self.known, key=self.known.__getitem__)
        sizes = np.array([len(s) for s in names])
        order = np.argsort(-self.uses, kind="stable")
        fits = (self.uses[order] > 1) & (np.cumsum(sizes[order]) <= KEEP_LETTERS // 2)
        kept = np.sort(order[: KEEP_SEGMENTS // 2][fits[: KEEP_SEGMENTS // 2]])
        old = self.table
        size = np.diff(old.pair_starts)[kept]
        place = np.repeat(old.pair_starts[kept] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.table = Aligned(*[x[kept] for x in old[:4]], np.concatenate([[0], np.cumsum(size)]), old.pairs[place], old.links[place], [old.groups[k] for k in kept.tolist()])
        self.good, self.uses = self.good[kept], self.uses[kept] // 2
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.letters_kept = int(sizes[kept].sum())

    def segments(self, text: str) -> list[str]:
        """Pieces of space + text that both encode by themselves; each begins with a space."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def _encode(self, part: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of segments encoded as one text, [(ids of A, their number by segment, ids of B, number, whether both give the bytes back)].

        Where the bytes are not those of the text the halves are encoded apart,
        down to the segment that is not given back.
        """
        text = "".join(part)
        raw = np.frombuffer(text.encode(), np.uint8)
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array([self.space] if text == " " else self.b.encode(text[1:]), np.int64)
        ends = np.cumsum([len(s.encode()) for s in part]) if not text.isascii() else np.cumsum([len(s) for s in part])
        counts = []
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            given, lengths = table.joined(ids)
            upto = np.searchsorted(np.cumsum(lengths), ends)
            same = len(given) == len(raw) and (given == raw).all() and (np.cumsum(lengths)[upto] == ends).all()
            counts.append(np.diff(np.concatenate([[0], upto + 1])) if same else None)
        if counts[0] is not None and counts[1] is not None:
            return [(a, counts[0], b, counts[1], np.ones(len(part), bool))]
        if len(part) == 1:
            none = np.zeros(0, np.int64)
            return [(none, np.zeros(1, np.int64), none, np.zeros(1, np.int64), np.zeros(1, bool))]
        half = len(part) // 2
        return self._encode(part[:half]) + self._encode(part[half:])

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns segments and appends them to the table.

        Segments follow each other in one text where both tokenizers part them
        anyway; one that ends in white space is encoded alone.
        """
        alone = [k for k, s in enumerate(new) if not self.cuts or not CUT.search(s[-1] + " ")]
        apart = set(alone)
        order = [k for k in range(len(new)) if k not in apart] + alone
        rest = [new[k] for k in order[: len(new) - len(alone)]]
        parts = [rest[i:j] for i, j in chunks(np.concatenate([[0], np.cumsum([len(s) for s in rest])]), JOINED_LETTERS)] if rest else []
        got = [x for part in [*parts, *([new[k]] for k in alone)] for x in self._encode(part)]
        a_ids, a_counts, b_ids, b_counts, good = (np.concatenate(x) for x in zip(*got, strict=True))
        for i, j in chunks(np.concatenate([[0], np.cumsum([len(new[k]) for k in order])]), 1 << 18):
            one = self._part(a_ids, a_counts, i, j), self._part(b_ids, b_counts, i, j)
            made = align(one[0], np.diff(self.a_bytes.starts)[one[0]], a_counts[i:j], one[1], np.diff(self.b_bytes.starts)[one[1]], b_counts[i:j])
            self._append(made, good[i:j])
        for place, k in enumerate(order, len(self.known) - len(new)):
            self.known[new[k]] = place
        self.letters_kept += sum(map(len, new))

    @staticmethod
    def _part(ids: np.ndarray, counts: np.ndarray, i: int, j: int) -> np.ndarray:
        begin = int(counts[:i].sum())
        return ids[begin : begin + int(counts[i:j].sum())]

    def _append(self, got: Aligned, good: np.ndarray) -> None:
        old = self.table
        joined = [np.concatenate([x, y]) for x, y in zip(old[:4], got[:4], strict=True)]
        starts = np.concatenate([old.pair_starts, got.pair_starts[1:] + old.pair_starts[-1]])
        old.groups.extend(got.groups)
        self.table = Aligned(*joined, starts, np.concatenate([old.pairs, got.pairs]), np.concatenate([old.links, got.links]), old.groups)
        self.good = np.concatenate([self.good, good])
        self.uses = np.concatenate([self.uses, np.zeros(len(good), np.int64)])

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """Rows of the table of each text's segments, in order; null and empty texts have none."""
        split = [self.segments(t) if t else [] for t in texts]
        if len(self.known) > KEEP_SEGMENTS or self.letters_kept > KEEP_LETTERS:
            self.forget()
        known, new = self.known, []
        for own in split:
            for s in own:
                if s not in known:
                    known[s] = len(known)
                    new.append(s)
        if new:
            self.learn(new)
        out = [np.fromiter(map(known.__getitem__, own), np.int64, len(own)) for own in split]
        self.uses += np.bincount(np.concatenate([*out, np.zeros(0, np.int64)]), minlength=len(known))
        return out


_LOADED: dict[tuple[str, bytes], Tokenizers] = {}


def _loaded(files: tuple[str, bytes]) -> Tokenizers:
    """The worker's tokenizers, made once; the files are fixed and do not grow with the data."""
    if files not in _LOADED:
        _LOADED.clear()
        _LOADED[files] = Tokenizers(*files)
    return _LOADED[files]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def _chunk(tokenizers: Tokenizers, texts: list[str | None], keep_groups: bool) -> dict[str, list | np.ndarray]:
    """Counts and digests of texts, and the links of the chunk: its id pairs, and of each text which and how many."""
    places = tokenizers.places(texts)
    table, n = tokenizers.table, len(texts)
    sound = np.array([bool(len(p)) and bool(tokenizers.good[p].all()) for p in places], bool)
    places = [p if ok else p[:0] for p, ok in zip(places, sound, strict=True)]
    segment = np.concatenate([*places, np.zeros(0, np.int64)])
    text = np.repeat(np.arange(n), [len(p) for p in places])
    total = lambda x: np.bincount(text, weights=x[segment], minlength=n).astype(np.int64)  # noqa: E731  sums below 2**53
    out = {name: total(x) for name, x in zip(("n_a", "n_b", "n_groups", "n_overlaps"), table[:4], strict=True)}
    joined = [b";".join(map(table.groups.__getitem__, p.tolist())) for p in places]
    out["sha"] = [hashlib.sha256(g).hexdigest() if ok else "" for g, ok in zip(joined, sound, strict=True)]
    if keep_groups:
        out["groups"] = [g.decode() for g in joined]
    width = max(len(table.groups), 1)
    used, times = np.unique(text * width + segment, return_counts=True)
    text, segment = used // width, used % width
    size = np.diff(table.pair_starts)[segment]
    place = np.repeat(table.pair_starts[segment] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    pairs, at = np.unique(table.pairs[place], return_inverse=True)
    keys = np.repeat(text, size) * max(len(pairs), 1) + at
    links = np.repeat(times, size) * table.links[place]
    order = np.argsort(keys, kind="stable")
    keys, links = keys[order], links[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    links, keys = (np.add.reduceat(links, heads) if len(heads) else links), keys[heads]
    of_text, at = keys // max(len(pairs), 1), keys % max(len(pairs), 1)
    starts = np.searchsorted(of_text, np.arange(n + 1))
    sums = np.concatenate([[0], np.cumsum(links)])
    out["n_links"] = sums[starts[1:]] - sums[starts[:-1]]
    return out | {"pairs": pairs, "held": np.bincount(at, minlength=len(pairs)), "starts": starts, "at": at, "links": links}


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Rows (<id>, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256[, groups]) of each whole text.

    A is a byte-level BPE file and encodes space + text, B a sentencepiece model
    that adds its space itself; strings of special tokens are plain text.  Places
    where tokens of both end cut the tokens into groups; a link is a pair of
    occurrences of A and B in one group, an overlap one that shares bytes.  The
    count of a pair of ids is how many rows of docs hold it linked; n_best counts
    links whose count is the highest of their A id, count_sum adds the counts
    of all links.  ``groups`` is the text ``a,a|b;a|b,b`` that groups_sha256 is of.

    Texts that are null, empty, or that a vocabulary does not give back byte by
    byte have zeros and ''.  Repeated rows count as often as they occur; null ids
    keep their rows; an empty table gives none.

    Texts are cut where neither tokenizer's tokens can reach over, so a segment
    met again is neither encoded nor aligned again.  A chunk of some MiB of texts
    keeps its own pairs once: only (chunk, pair) rows are joined with the
    counts, and the texts' links stay in one row of the chunk in a table in
    the shared folder.  A vocabulary's pairs bound what one A id has.
    """
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    id_type = docs.schema[id_col].dataType
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType().add("chunk", long).add("ids", T.ArrayType(id_type))
    for name in _COUNTS:
        schema = schema.add(name, longs)
    schema = schema.add("sha", T.ArrayType(T.StringType())).add("groups", T.ArrayType(T.StringType()))
    schema = schema.add("pairs", longs).add("held", longs).add("starts", ints).add("at", ints).add("links", longs)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _loaded(files.value)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, LINK_CHUNK_BYTES):
                part = batch.slice(i, j - i)
                got = _chunk(tokenizers, part.column(1).to_pylist(), keep_groups)
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                columns = {"chunk": pa.array([chunk], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), part.column(0))}
                columns |= {name: one(got[name], pa.int64()) for name in (*_COUNTS, "pairs", "held", "links")}
                columns |= {name: one(got[name], pa.int32()) for name in ("starts", "at")}
                columns |= {"sha": one(got["sha"], pa.string()), "groups": one(got.get("groups", []), pa.string())}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=schema.fieldNames())
                chunk += 1

    table = written(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(link, schema), "links", wide=True)
    held = table.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", _B_BITS)))  # as many rows as B has ids, at most
    counts = held.select("pair", "n", (F.col("n") == highest).alias("best"))
    pulled = table.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair").select("of", "pos", "n", "best")
    result = T.StructType([T.StructField(id_col, id_type)])
    for name in (*_COUNTS, "n_best", "count_sum"):
        result = result.add(name, long)
    result = result.add("groups_sha256", "string")
    if keep_groups:
        result = result.add("groups", "string")

    def settle(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        """One chunk's texts with the counts of its pairs."""
        flat = lambda name: chunk.column(name).combine_chunks().flatten()
        order = np.argsort(np.asarray(counted.column("pos")))
        n, best = np.asarray(counted.column("n"))[order], np.asarray(counted.column("best")).astype(np.int64)[order]
        starts, at, links = (np.asarray(flat(name)) for name in ("starts", "at", "links"))
        add = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[starts]), pa.int64())
        columns = [flat(name) for name in ("ids", *_COUNTS)] + [add(links * best[at]), add(links * n[at]), flat("sha")]
        return pa.table([*columns, flat("groups")] if keep_groups else columns, names=result.fieldNames())

    payload = table.select("chunk", "ids", *_COUNTS, "sha", "groups", "starts", "at", "links")
    return payload.groupBy("chunk").cogroup(pulled.groupBy("of")).applyInArrow(settle, result)
