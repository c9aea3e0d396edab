"""Suffix-array deduplication of repeated byte strings.

A sparse suffix array: the suffixes that start at windows with recurring anchors (see anchors) are sorted
in shards by anchor key, within a shard by merging. Two suffixes are compared by binary search over prefix
polynomial hashes for their common extension, so a comparison takes log2(length) steps; neighbours in the
sorted order whose extension reaches the length are equal strings, verified byte by byte; should two different strings
have equal hashes, the part is judged by its bytes instead.

Defined results: a null text is empty; a null doc_id comes before all others; rows that share a doc_id are
one place in the order, so equal starts in two of them are both kept; texts shorter than the length lose
nothing; longer ones are read whole, however long; other columns are ignored, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.anchors import M1, Recurring, grouped, mixed
from quern.llm.common import buffers, id_back

LENGTH, GRAM = 100, 32
#: Windows that a shard sorts at once, save that an anchor's windows stay together.
CHUNK = 200_000
_BASE = M1 | np.uint64(1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Suffixes:
    """Hash-compared suffixes of one byte array, to a depth of `length`."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        n = len(data) + 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BACK)]))
            self.sums = np.zeros(n, np.uint64)
            np.cumsum(mixed(data.astype(np.uint64) + np.uint64(7)) * power[:-1], out=self.sums[1:])
        self.steps = [1 << b for b in range(int(length).bit_length() - 1, -1, -1)]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most `length`."""
        got = np.zeros(len(a), np.int64)
        with np.errstate(over="ignore"):
            for step in self.steps:
                fits = got + step <= self.length
                x, y = a + got, b + got
                x1, y1 = np.where(fits, x + step, x), np.where(fits, y + step, y)
                same = (self.sums[x1] - self.sums[x]) * self.back[x] == (self.sums[y1] - self.sums[y]) * self.back[y]
                got += step * (fits & same)
        return got

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        got = self.extension(a, b)
        end = got >= self.length
        x, y = np.where(end, a, a + got), np.where(end, b, b + got)
        return np.where(end, or_equal, self.data[x] < self.data[y])

    def sort(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Order of suffixes by bucket (ascending already), then string, then as given: a mergesort of all buckets at once."""
        n = len(start)
        order = np.arange(n)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, n])
        at, width = np.repeat(first, size), 1
        size = np.repeat(size, size)
        while width < (size.max() if n else 0):
            live = np.flatnonzero(size > width)
            base, many = at[live], size[live]
            local = live - base
            run = local // width
            left = run % 2 == 0
            lo = np.where(left, run + 1, run - 1) * width
            hi = np.minimum(lo + width, many)
            lo = np.minimum(lo, hi)
            own, low, high = start[order[live]], lo.copy(), hi.copy()
            while True:  # the rank of each suffix in the run that it meets
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                other = start[order[base[open_] + mid]]
                before = self.less(other, own[open_], ~left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = base + (run - run % 2) * width + local % width + (low - lo)
            moved = order[live]
            order[to] = moved
            width *= 2
        return order


def repeats(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, k: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of `length` bytes at each start also occurs in its bucket with a lesser (k, place)."""
    by = np.lexsort((place, k, bucket))
    start, bucket = start[by], bucket[by]
    suffixes = Suffixes(data, length)
    order = suffixes.sort(start, bucket)
    s, b = start[order], bucket[order]
    same = b[1:] == b[:-1]
    pair = np.flatnonzero(same)
    same[pair] = suffixes.extension(s[pair], s[pair + 1]) >= length
    for part in np.array_split(np.flatnonzero(same), max(1, int(same.sum()) * length // (4 << 20))):
        if len(part):
            span = np.arange(length)
            if (data[s[part][:, None] + span] != data[s[part + 1][:, None] + span]).any():
                return repeats_by_bytes(data, start, bucket, k[by], place[by], length)[np.argsort(by)]
    lead = np.r_[True, ~same] if len(s) else np.zeros(0, bool)
    out = np.zeros(len(start), bool)
    # within a class the order is the order given, so its first is the earliest; ties in (k, place) are kept
    klass = np.cumsum(lead) - 1
    earliest = order[lead]
    k, place = k[by], place[by]
    out[by[order]] = (k[order] != k[earliest[klass]]) | (place[order] != place[earliest[klass]])
    return out


def repeats_by_bytes(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, k: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """repeats() by the strings themselves, of rows in order of (k, place): for when two different strings have equal hashes."""
    first: dict[tuple[int, bytes], tuple[int, int]] = {}
    out = np.zeros(len(start), bool)
    for i, (at, b, where) in enumerate(zip(start.tolist(), bucket.tolist(), zip(k.tolist(), place.tolist(), strict=True), strict=True)):
        out[i] = first.setdefault((b, data[at : at + length].tobytes()), where) != where
    return out


def _shard(length: int):
    def shard(batches):
        for table in grouped(batches, CHUNK):
            key, n = column_of(table, "key"), column_of(table, "n")
            k, lo, off = column_of(table, "k"), column_of(table, "lo"), column_of(table, "off")
            at, data = buffers(table.column("segment"))
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            marks = np.zeros(int(n.sum()), np.uint8)
            begin = np.cumsum(n) - n
            rows = np.flatnonzero(many)
            for some in parts(rows, group, n, 4 * CHUNK):
                row = np.repeat(some, n[some])
                w = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                bucket = group[row] * (1 << 20) + (off[row] - w)
                marks[begin[row] + w] = repeats(data, at[row] + w, bucket, k[row], lo[row] + w, length)
            bounds = np.r_[begin, n.sum()].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(marks.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(lo), pa.array(key), packed], ["k", "lo", "key", "marks"])

    return shard


def parts(rows: np.ndarray, group: np.ndarray, n: np.ndarray, limit: int):
    """Rows in parts of whole groups with about `limit` windows."""
    if not len(rows):
        return
    g, total = group[rows], np.cumsum(n[rows])
    begin, done = 0, 0
    while begin < len(rows):
        end = max(int(np.searchsorted(total, done + limit, "right")), begin + 1)
        if end < len(rows):
            cut = int(np.searchsorted(g, g[end - 1], "left"))
            end = cut if cut > begin else int(np.searchsorted(g, g[begin], "right"))
        yield rows[begin:end]
        begin, done = end, int(total[end - 1])


def column_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _spans(t, marked: np.ndarray, length: int):
    """Mask of covered bytes."""
    edge = np.zeros(len(t.data) + 1, np.int64)
    np.add.at(edge, marked, 1)
    np.add.at(edge, marked + length, -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with the bytes that remain: (doc_id, n_bytes, n_removed, spans, kept).

    A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document with a
    smaller doc_id or earlier in the same one. spans lists the maximal removed runs as begin and end.
    """

    def finish(t, k, row, marked):
        gone = _spans(t, marked, length)
        at, data = t.at, t.data
        begin = gone & ~np.r_[False, gone[:-1]]
        end = gone & ~np.r_[gone[1:], False]
        inner = at[(at > 0) & (at < len(data))]
        begin[inner] = gone[inner]
        end[inner - 1] = gone[inner - 1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[at[1:]] - total[at[:-1]]
        many = np.searchsorted(begin, at, "left")
        doc = np.repeat(at[:-1], np.diff(many))
        spans = pa.StructArray.from_arrays([pa.array(begin - doc), pa.array(end - doc)], ["begin", "end"])
        kept = np.r_[0, np.cumsum(np.diff(at) - removed)].astype(np.int32)
        rest = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(data[~gone].tobytes())])
        return pa.RecordBatch.from_arrays(
            [k, pa.array(np.diff(at)), pa.array(removed), pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), spans), rest], ["k", "n_bytes", "n_removed", "spans", "kept"]
        )

    plan = Recurring(docs, length, gram, words=False, within=True, id_col=id_col, text_col=text_col)
    out = plan.repeated(_shard(length), finish, "k long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary")
    return out.select(id_back(name=id_col), "n_bytes", "n_removed", "spans", "kept")


def brute(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The digest of every document, the slow way; for tests."""
    seen: set[bytes] = set()
    out = {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out

