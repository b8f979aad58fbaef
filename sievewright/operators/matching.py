"""All markers of a lexicon in one pass: an Aho-Corasick automaton over the bytes of texts."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes that one step of the search works on, and strips they are cut into at most.
SLICE, STRIPS = 1 << 20, 2048
#: Largest automaton that is broadcast.
MAX_BYTES = 256 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


class Automaton:
    """Finds every occurrence of any of ``markers`` in one pass over the bytes.

    A state is a prefix of a marker; ``steps`` has the next state of each state
    and class of byte (bytes in no marker share class 0).  It is built once; its
    size is ``nbytes``, at most 4 bytes x markers' bytes x (different bytes + 1),
    and the time of a search does not depend on the number of markers.

    Every place's state depends on at most ``longest`` bytes before it, so the
    bytes are cut into strips that are walked side by side in numpy, each from
    ``longest`` bytes before its own.
    """

    def __init__(self, markers: list[bytes]):
        if not all(markers):
            raise ValueError("an empty marker is everywhere")
        self.markers = list(markers)
        self.lengths = np.array([len(m) for m in markers], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        used = sorted({b for m in markers for b in m})
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, marker in enumerate(markers):
            at = 0
            for b in self.classes[list(marker)].tolist():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][b]
            ends[at].append(k)
        n = len(children)
        if n * width * 4 > MAX_BYTES:
            raise ValueError(f"the markers make an automaton of over {MAX_BYTES} bytes")
        steps = np.zeros((n, width), np.int32)
        back = np.zeros(n, np.int64)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                steps[at] = steps[back[at]]
                ends[at] = ends[at] + ends[back[at]]
            for b, child in children[at].items():
                back[child] = steps[at, b] if at else 0
                steps[at, b] = child
                queue.append(child)
        self.steps = (steps * width).ravel()  # states are kept multiplied
        self.width = width
        self.found = np.array([bool(e) for e in ends])
        self.found_starts = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
        self.found_markers = np.array([k for e in ends for k in e], np.int64)
        self.nbytes = self.steps.nbytes + self.found.nbytes + self.found_starts.nbytes + self.found_markers.nbytes

    def search(self, blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, markers) of all occurrences in the bytes, by their ends."""
        n = len(blob)
        if not n or not self.markers:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        warm = self.longest - 1
        length = max(-(-n // STRIPS), 4 * warm, 64)
        strips = -(-n // length)
        padded = np.zeros(warm + strips * length, np.int32)
        padded[warm : warm + n] = self.classes[blob]
        rows = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (strips, warm + length), (4 * length, 4)).T)
        state = np.zeros(strips, np.int32)
        kept = np.empty((length, strips), np.int32)
        for t in range(warm):
            state = self.steps[state + rows[t]]
        for t in range(length):
            state = self.steps[state + rows[warm + t]]
            kept[t] = state
        hit, strip = np.nonzero(self.found[kept // self.width])
        end = strip * length + hit
        inside = end < n
        order = np.argsort(end[inside], kind="stable")
        end, at = end[inside][order], (kept[hit, strip][inside] // self.width)[order]
        sizes = self.found_starts[at + 1] - self.found_starts[at]
        place = np.repeat(self.found_starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        markers = self.found_markers[place]
        return np.repeat(end, sizes) + 1 - self.lengths[markers], markers

    def in_rows(self, blob: np.ndarray, offsets: np.ndarray, bounded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, markers, starts) of occurrences inside rows; those of ``bounded`` markers stand between bytes other than a-z and 0-9."""
        start, marker = self.search(blob)
        end = start + self.lengths[marker]
        row = np.searchsorted(offsets, start, side="right") - 1
        good = (start >= 0) & (end <= offsets[np.minimum(row + 1, len(offsets) - 1)])
        if bounded is not None and len(start):
            before = (start > offsets[row]) & _LETTER[blob[np.maximum(start - 1, 0)]]
            after = (end < offsets[np.minimum(row + 1, len(offsets) - 1)]) & _LETTER[blob[np.minimum(end, len(blob) - 1)]]
            good &= ~(bounded[marker] & (before | after))
        return row[good], marker[good], start[good]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    blob = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return blob[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Row ranges of at most ``limit`` bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1, i + 1), n)
        yield i, j
        i = j


def _apart(row: np.ndarray, marker: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, markers) of occurrences that do not overlap one of the same marker before, taken from the left.

    Each occurrence points to the first that begins at its end or later; those
    on the ways from the first of each overlapping run stay, found by doubling
    the steps: no loop over occurrences, however often a marker overlaps itself.
    """
    order = np.lexsort((start, marker, row))
    row, marker, start = row[order], marker[order], start[order]
    same = (row[1:] == row[:-1]) & (marker[1:] == marker[:-1])
    after = np.r_[False, same & (start[1:] - start[:-1] < lengths[marker[1:]])]  # overlaps the one before
    some = np.flatnonzero(after | np.r_[after[1:], False])
    if not len(some):
        return row, marker
    group = np.cumsum(~after[some])
    size = lengths[marker[some]]
    keys = group * (int(start.max()) + int(size.max()) + 1) + start[some]
    jump = np.r_[np.searchsorted(keys, keys + size), len(some)]
    kept = np.r_[~after[some], True]
    while True:
        reached = kept.copy()
        reached[jump[kept]] = True
        if (reached == kept).all():
            break
        kept, jump = reached, jump[jump]
    keep = np.ones(len(row), bool)
    keep[some] = kept[:-1]
    return row[keep], marker[keep]


def present(spark: SparkSession, markers: list[str | bytes], bounded: list[bool] | None = None):
    """A function of a text or binary column: the sorted places in ``markers`` of those that occur in it.

    Markers are compared as bytes, so lower-case the text first where case does
    not count.  ``bounded`` ones stand between bytes other than a-z and 0-9.  The
    automaton is broadcast once; its size is checked (see MAX_BYTES).
    """
    sent = spark.sparkContext.broadcast(Automaton([m.encode() if isinstance(m, str) else m for m in markers]))
    limits = np.array(bounded, bool) if bounded is not None else None

    def find(column: pa.Array) -> pa.Array:
        blob, offsets = buffers(column)
        rows, found = [], []
        for i, j in slices(offsets):
            row, marker, _ = sent.value.in_rows(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], limits)
            keys = np.unique((row + i) * len(markers) + marker)
            rows.append(keys // len(markers))
            found.append(keys % len(markers))
        row = np.concatenate([*rows, np.zeros(0, np.int64)])
        starts = np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32)))

    return F.arrow_udf(find, "array<int>")


def counted(spark: SparkSession, lists: dict[str, tuple[str, ...]]):
    """A function of a text column: a struct of, for each named list, how many of its markers occur and how often they do in all.

    Occurrences of one marker do not overlap; those of different markers may.
    Fields are <name>_kinds and <name>_times.
    """
    flat = sorted({m for own in lists.values() for m in own})
    place = {m: k for k, m in enumerate(flat)}
    groups = {name: np.array([place[m] for m in own], np.int64) for name, own in lists.items()}
    sent = spark.sparkContext.broadcast((Automaton([m.encode() for m in flat]), groups))
    fields = [f"{name}_{kind}" for name in lists for kind in ("kinds", "times")]

    def count(column: pa.Array) -> pa.Array:
        automaton, groups = sent.value
        blob, offsets = buffers(column)
        out = {f: np.zeros(len(column), np.int32) for f in fields}
        for i, j in slices(offsets):
            row, marker, start = automaton.in_rows(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            row, marker = _apart(row, marker, start, automaton.lengths)
            keys, times = np.unique(row * len(flat) + marker, return_counts=True)
            row, marker = keys // len(flat), keys % len(flat)
            for name, own in groups.items():  # a marker that a list has twice counts twice
                weight = np.bincount(own, minlength=len(flat))
                out[f"{name}_kinds"][i:j] = np.bincount(row, weights=weight[marker], minlength=j - i)
                out[f"{name}_times"][i:j] = np.bincount(row, weights=weight[marker] * times, minlength=j - i)
        return pa.StructArray.from_arrays([pa.array(out[f]) for f in fields], names=fields)

    return F.arrow_udf(count, "struct<" + ",".join(f"{f}:int" for f in fields) + ">")


def weighed(spark: SparkSession, lists: dict[str, dict[str, float]]):
    """A function of a text column: a struct of, for each named list of markers and points, the points of all its occurrences."""
    flat = sorted({m for own in lists.values() for m in own})
    place = {m: k for k, m in enumerate(flat)}
    weights = {name: np.zeros(len(flat)) for name in lists}
    for name, own in lists.items():
        for m, points in own.items():
            weights[name][place[m]] = points
    sent = spark.sparkContext.broadcast((Automaton([m.encode() for m in flat]), weights))

    def weigh(column: pa.Array) -> pa.Array:
        automaton, weights = sent.value
        blob, offsets = buffers(column)
        out = {name: np.zeros(len(column)) for name in weights}
        for i, j in slices(offsets):
            row, marker, start = automaton.in_rows(blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            row, marker = _apart(row, marker, start, automaton.lengths)
            for name, weight in weights.items():
                out[name][i:j] = np.bincount(row, weights=weight[marker], minlength=j - i)
        return pa.StructArray.from_arrays([pa.array(x) for x in out.values()], names=list(out))

    return F.arrow_udf(weigh, "struct<" + ",".join(f"{name}:double" for name in lists) + ">")
