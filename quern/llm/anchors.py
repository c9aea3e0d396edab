"""Recurring passages by anchors: what substring and phrase deduplication have in common.

A window is a stretch of L tokens. Its anchor is the place with the least hash among those of its
K-token grams (the leftmost of equals), so that equal windows have their anchor at the same offset and
with the same key. A run is a stretch of consecutive windows of one document with one anchor; there is
a run for about (L - K) / 2 tokens. Equal windows therefore lie in runs of equal keys, and all work is
sharded by key; no pair of documents is ever listed.

Keys that occur once leave at once. Of the others, a run's tokens (its segment) go to the shard of its
key, equal segments as one row with their first document: a passage that a third of all documents share
is one row for each task before the shuffle. What the shard finds out holds for the first document;
the segments of all other documents are known to repeat it. A key that over HOT documents have with ever other
surroundings (a common line, or near copies) is dealt out window by window, each by its own content: only equal windows
must meet, and those are one row for each task. So no group has more than the segments of HOT documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import buffers, column, keyed, ranges, slices, word_bounds, written

#: Bytes of segments that a task remembers in order to send equal ones once.
COMBINED = 48 << 20
#: Documents with a key beyond which its windows are dealt out by their own content; such keys, 9 bytes each, that are broadcast.
HOT, FEW_HOT = 1000, 100_000
#: Bytes of text that are worked on at once: the arrays stay in the cache.
SLICE = 1 << 18
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    now = 1
    while now * 2 <= width:
        x = np.minimum(x[:-now], x[now:])
        now *= 2
    return np.minimum(x[: len(x) - (width - now)], x[width - now :]) if now < width else x


def word_values(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data) + 1, M1 | np.uint64(1)))
        back = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(M1) | 1, -1, 1 << 64))))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mixed(data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of a base, and of its inverse."""
    if len(_powers[0]) < n:
        base = M1 | np.uint64(1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (base, np.uint64(pow(int(base), -1, 1 << 64)))]
    return [x[:n] for x in _powers]


class Tokens:
    """Tokens of some texts: bytes, or words between white space."""

    def __init__(self, texts: pa.Array, words: bool):
        self.at, self.data = buffers(texts)
        self.words = words
        if words:
            self.begin, self.end, self.first = word_bounds(self.at, self.data)
            self.values = word_values(self.data, self.begin, self.end)
        else:
            self.first, self.values = self.at, _BYTES[self.data]
        self.sums: np.ndarray | None = None

    def hashes(self, lo: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """A number for the n tokens from each lo, equal for equal ones."""
        power, back = powers(len(self.values) + 1)
        with np.errstate(over="ignore"):
            if self.sums is None:
                self.sums = np.zeros(len(self.values) + 1, np.uint64)
                np.cumsum(self.values * power[:-1], out=self.sums[1:])
            return mixed((self.sums[lo + n] - self.sums[lo]) * back[lo] + np.asarray(n).astype(np.uint64))

    def segment(self, lo: int, n: int) -> bytes:
        """Tokens lo to lo + n; words with one space between."""
        if not self.words:
            return self.data[lo : lo + n].tobytes()
        return b" ".join(self.data[self.begin[lo] : self.end[lo + n - 1]].tobytes().split())

    def runs(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """Text number, first window, windows, anchor less first window, and key of every run."""
        x, size = self.values, len(self.values)
        lens = np.diff(self.first)
        count = np.maximum(lens - length + 1, 0)
        if not count.any():
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        with np.errstate(over="ignore"):
            step = 1
            while step < gram:
                y = x[:-step] * M2
                y += x[step:]
                y ^= y >> np.uint64(29)
                x, step = y, 2 * step
            x = x * M1
            mask = np.uint64((1 << int(size).bit_length()) - 1)
            low = least((x & ~mask) | np.arange(len(x), dtype=np.uint64), length - gram + 1)
        text = np.repeat(np.arange(len(lens)), count)
        window = np.arange(len(text)) + np.repeat(self.first[:-1] - (np.cumsum(count) - count), count)
        place = (low[window] & mask).astype(np.int64)
        at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        place, lo = place[at], window[at]
        return text[at], lo, np.diff(np.r_[at, len(window)]), place - lo, x[place].view(np.int64)


def _keys(length: int, gram: int, words: bool, within: bool):
    """Keys of runs with their document. What recurs in a batch is known at once: its rows say so, and one more row
    tells the key's task, so that a key that all documents have doesn't send them all there."""

    def run(batches):
        for batch in batches:
            keys, ks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in slices(batch, "text", SLICE):
                text, _, _, _, key = Tokens(column(part, "text"), words).runs(length, gram)
                keys.append(key)
                ks.append(column(part, "k").to_numpy()[text])
            key, k = np.concatenate(keys), np.concatenate(ks)
            if not len(key):
                continue
            order = np.lexsort((k, key))
            key, k = key[order], k[order]
            lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            last = np.r_[lead[1:], len(key)] - 1
            twice = last > lead if within else k[last] != k[lead]
            known = np.repeat(twice, last - lead + 1)
            new = np.r_[True, (key[1:] != key[:-1]) | (k[1:] != k[:-1])]
            key, k, known = (np.concatenate([x[lead], x[known & new]]) for x in (key, k, known))
            known[: len(lead)] = False
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(k), pa.array(known)], ["key", "k", "known"])

    return run


def _recurring(within: bool):
    """Of rows in order of key, those that are known or have another row (of another document) with their key."""

    def run(batches):
        held = None  # the last key's rows, as far as none is sure
        for batch in batches:
            key, k, known = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "k", "known"))
            sure = [(key[known], k[known])]
            key, k = key[~known], k[~known]
            if held is not None:
                key, k = np.concatenate([held[0], key]), np.concatenate([held[1], k])
            held = None
            if len(key):
                lead = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                many = np.diff(np.r_[lead, len(key)])
                low, high = np.minimum.reduceat(k, lead), np.maximum.reduceat(k, lead)
                often = many > 1 if within else high > low
                on = np.repeat(often, many)
                sure.append((key[on], k[on]))
                at = lead[-1]
                held = (key[at:][:1], k[at:][:1])  # one row of the last key, which makes the next ones sure
            key, k = (np.concatenate([x[i] for x in sure]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(k)], ["key", "k"])

    return run


class Recurring:
    """Plans over documents (k, text) for windows of `length` tokens."""

    def __init__(self, docs: DataFrame, length: int, gram: int, words: bool, within: bool, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()):
        if gram & (gram - 1) or gram > length:
            raise ValueError("gram must be a power of two, at most length")
        self.length, self.gram, self.words = length, gram, words
        row = [F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("row")] if keep else []
        self.docs = keyed(docs, id_col, text_col, *row).repartition("k")
        # a key's rows meet in its task, save those of which the sender knows that they recur
        met = F.when(F.col("known"), F.xxhash64("k")).otherwise(F.col("key"))
        found = keyed(docs, id_col, text_col).mapInArrow(_keys(length, gram, words, within), "key long, k long, known boolean").repartition(met)
        recurring = written(found.sortWithinPartitions("key").mapInArrow(_recurring(within), "key long, k long"), "recurring")
        often = recurring.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
        often = written(often, "hot")
        few = often.count() <= FEW_HOT
        flagged = recurring.join(F.broadcast(often) if few else often, "key", "left")
        self.keys = flagged.groupBy("k").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))

    def segments(self) -> DataFrame:
        """(key, segment, k, lo, n, off): the distinct segments with their first document and first place in it.

        lo is the place of the segment's first token in its text, n the number of windows, off the
        anchor's place in the segment, shared whether two documents have it.
        """
        length, gram, words = self.length, self.gram, self.words

        def cut(batches):
            met: dict = {}
            held = 0
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    t, k = Tokens(column(part, "text"), words), column(part, "k").to_numpy()
                    out = [[] for _ in range(6)]
                    for i, lo, n, off, key in chosen(t, part, length, gram):
                        seen, own = set(), int(k[i])
                        for j in range(len(lo)):
                            s = (t.segment(int(lo[j]), int(n[j]) + length - 1), int(key[j]))
                            if s in seen:
                                continue
                            seen.add(s)
                            # what this task has sent is sent again only for an earlier document, or as a second one
                            before = met.get(s)
                            if before is not None and before[0] <= own and (before[1] or before[0] == own):
                                continue
                            met[s] = (own if before is None else min(own, before[0]), before is not None and before[0] != own or before is not None and before[1])
                            held += len(s[0]) + 250
                            for o, v in zip(out, (s[1], s[0], own, int(lo[j] - t.first[i]), int(n[j]), int(off[j])), strict=True):
                                o.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.binary() if c == 1 else pa.int64()) for c, o in enumerate(out)], ["key", "segment", "k", "lo", "n", "off"])
                    if held > COMBINED:
                        met, held = {}, 0

        rows = self.docs.join(self.keys, "k").mapInArrow(cut, "key long, segment binary, k long, lo long, n long, off long")
        return rows.repartition("key").groupBy("key", "segment").agg(
            F.min_by("lo", "k").alias("lo"), F.min("n").alias("n"), F.min("off").alias("off"), (F.min("k") < F.max("k")).alias("shared"), F.min("k").alias("k")
        )

    def repeated(self, shard: Callable, finish: Callable, schema: str) -> DataFrame:
        """shard(batches) turns rows of segments(), by key, into rows (k, lo, key, marks); marks has a byte for each
        window of that first segment, 1 if the window also occurs earlier. finish(tokens, k, row, marked) gives an
        Arrow batch for some texts, marked being the begins of all windows that occur earlier."""
        length, gram, words, within, rows = self.length, self.gram, self.words, not self.words, "row" in self.docs.columns
        first = self.segments().sortWithinPartitions("key").mapInArrow(shard, "k long, lo long, key long, marks binary")
        first = first.groupBy("k").agg(F.collect_list(F.struct("lo", "key", "marks")).alias("first"))

        def done(batches):
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    t, marked = Tokens(column(part, "text"), words), []
                    told = column(part, "first")
                    ends = np.cumsum(np.nan_to_num(pc.list_value_length(told).to_numpy(zero_copy_only=False)).astype(np.int64))
                    flat = told.flatten()
                    places, keys, all_marks = (flat.field(c) for c in ("lo", "key", "marks"))
                    places, keys = places.to_numpy(), keys.to_numpy()
                    for i, lo, n, _, key in chosen(t, part, length, gram):
                        a, b = int(ends[i - 1]) if i else 0, int(ends[i])
                        own = dict(zip(zip(places[a:b].tolist(), keys[a:b].tolist(), strict=True), all_marks[a:b].to_pylist(), strict=True))
                        begins = lo
                        with np.errstate(over="ignore"):
                            told_apart = len(np.unique(t.hashes(lo, n + length - 1) * M1 + key.view(np.uint64))) == len(lo)
                        if not told_apart:  # a segment that the text has twice is told of where it is first
                            seen: dict = {}
                            begins = np.array([seen.setdefault((t.segment(x, m + length - 1), y), x) for x, m, y in zip(lo.tolist(), n.tolist(), key.tolist(), strict=True)])
                        of_first = [own.get(x) for x in zip((begins - t.first[i]).tolist(), key.tolist(), strict=True)]
                        if within:
                            of_first = [m if again == 0 else None for m, again in zip(of_first, (lo - begins).tolist(), strict=True)]
                        alone = np.array([m is None for m in of_first])
                        marked.append(ranges(lo[alone], n[alone]))
                        if not alone.all():
                            some = np.frombuffer(b"".join(m for m in of_first if m is not None), np.uint8)
                            marked.append(ranges(lo[~alone], n[~alone])[np.flatnonzero(some)])
                    yield finish(t, column(part, "k"), column(part, "row") if rows else None, np.concatenate(marked) if marked else np.zeros(0, np.int64))

        all_ = self.docs.join(self.keys, "k", "left").join(first, "k", "left")
        return all_.mapInArrow(done, schema)


def chosen(t: Tokens, part: pa.RecordBatch, length: int, gram: int):
    """Of each text with recurring keys: its number and the runs (lo, n, off, key) that have them.

    A run whose key is hot comes window by window, each under a key of its own tokens. Equal windows stay together, and
    what a hot key's documents have around it tells them apart.
    """
    text, lo, n, off, key = t.runs(length, gram)
    edge = np.searchsorted(text, np.arange(part.num_rows + 1))
    keys, hots = column(part, "keys"), column(part, "hot")
    for i in np.flatnonzero(np.diff(edge)):
        own = keys[int(i)].values
        if own is None or not len(own):
            continue
        a, b = edge[i], edge[i + 1]
        at = np.flatnonzero(np.isin(key[a:b], own.to_numpy())) + a
        if not len(at):
            continue
        hot = hots[int(i)].values
        some = np.isin(key[at], hot.to_numpy()) if len(hot) else np.zeros(len(at), bool)
        if not some.any():
            yield int(i), lo[at], n[at], off[at], key[at]
            continue
        cold = at[~some]
        runs = [(lo[cold], n[cold], off[cold], key[cold])]
        many = n[at[some]]
        begin = ranges(lo[at[some]], many)
        with np.errstate(over="ignore"):
            own_key = mixed(t.hashes(begin, length) + np.repeat(key[at[some]], many).view(np.uint64) * M1).view(np.int64)
        runs.append((begin, np.ones_like(begin), np.repeat(off[at[some]], many) - ranges(np.zeros_like(many), many), own_key))
        yield int(i), *(np.concatenate(x) for x in zip(*runs, strict=True))


def grouped(batches: Iterator[pa.RecordBatch], limit: int):
    """Lists of whole groups (equal, adjacent keys) with at least `limit` windows in all, as dicts of columns."""
    held: list[pa.RecordBatch] = []
    size = 0

    def taken(upto=None):
        table = pa.Table.from_batches(held)
        return table if upto is None else (table.slice(0, upto), table.slice(upto))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += int(column(batch, "n").to_numpy().sum())
        if size < limit:
            continue
        key = column(batch, "key").to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if last == 0 and sum(b.num_rows for b in held) > batch.num_rows and column(held[-2], "key")[-1].as_py() == int(key[-1]):
            continue
        before = sum(b.num_rows for b in held[:-1]) + last
        if before:
            now, rest = taken(before)
            yield now
            held = rest.to_batches() if rest.num_rows else []
            size = sum(int(column(b, "n").to_numpy().sum()) for b in held)
    if held:
        yield taken()

