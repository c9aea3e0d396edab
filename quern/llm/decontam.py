"""Benchmark decontamination by a distributed positional inverted index.

The training texts are indexed in segments of whole documents, as search engines do: one row per segment with
its documents, and for each term the sorted positions. The index is a written table and partitioned by
document, so a query goes to every segment and no posting is ever shuffled. A window of test words starts with
its rarest term (by counts over the whole corpus); that term's positions less its offset are intersected with
those of the next rarest, and so on. What survives all terms is an exact occurrence. Positions of different
documents are apart by a gap, so none crosses.

The index holds all terms, so that it serves any test set. A test set is taken in blocks of a bounded number of words,
which bounds what is broadcast; longer items are cut into pieces that have all their windows. Each block is a pass over
the index.

Defined results: a null text has no words; null and repeated identifiers are kept as they are, a result for each
row; items with equal ids are one item, and those with a null id are one, the item null; an item without words has no
window; an item with fewer words than a window is one window; texts are indexed whole, a longer one than a segment is a
segment of its own; other columns are ignored, whatever their names; empty tables give empty tables or no hits.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import buffers, column, few_rows, slices, written

WINDOW = 10
#: A word of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text in a segment, and test words that are broadcast at once.
SEGMENT, BLOCK = 1 << 20, 200_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: terms are joined by blanks; n_words, counts and positions are int32, so that the JVM passes on one value for each.
INDEX = "segment long, ids array<bigint>, n_words binary, terms binary, counts binary, positions binary"


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and all beyond ASCII."""
    return text.translate(_TABLE).split()


class Windows:
    """The test set: windows of words with the items that have them. Bounded by BLOCK words."""

    def __init__(self, items: list[tuple], window: int):
        found: dict[tuple, set] = {}
        for item, text in items:
            ws = words_of((text or "").encode())
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                found.setdefault(tuple(ws[i : i + window]), set()).add(item)
        terms = sorted({w for ws in found for w in ws})
        number = {t: i for i, t in enumerate(terms)}
        self.terms = pa.array(terms, pa.binary())
        self.words = [np.array([number[w] for w in ws]) for ws in found]
        self.items = [sorted(s, key=str) for s in found.values()]

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The number of each term, -1 for those that no window has."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def rarest_first(self, count: np.ndarray) -> None:
        """Orders each window's (term, offset) by the term's count in the corpus."""
        self.order = [np.argsort(count[ws], kind="stable") for ws in self.words]
        width = max(map(len, self.words), default=1)
        self.matrix = np.array([np.resize(ws, width) for ws in self.words], np.int64).reshape(-1, width)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW) -> DataFrame:
    """The positional index of whole texts, of all terms, as a written table."""
    few_rows(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                at, data = buffers(column(part, "text"))
                words = [words_of(raw) for raw in _texts(at, data)]
                n = np.fromiter(map(len, words), np.int64, len(words))
                number: dict[bytes, int] = {}
                term = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int32, int(n.sum()))
                begin = np.cumsum(n + gap) - (n + gap)
                place = np.arange(len(term)) + np.repeat(begin - (np.cumsum(n) - n), n)
                place = place[np.argsort(term, kind="stable")].astype(np.int32)
                one = lambda values: pa.array([values.astype(np.int32).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 66]), pa.array([column(part, "id").to_pylist()], pa.list_(pa.int64())), one(n),
                     pa.array([b" ".join(number)], pa.binary()), one(np.bincount(term, minlength=len(number))), one(place)],
                    ["segment", "ids", "n_words", "terms", "counts", "positions"],
                )

    return written(given.mapInArrow(run, INDEX), "index")


def ints(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def words_in(value: pa.Scalar) -> pa.Array:
    return pa.array(value.as_py().split(), pa.binary())


def _texts(at: np.ndarray, data: np.ndarray):
    raw = data.tobytes()
    return (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def term_counts(index: DataFrame, windows: Windows) -> np.ndarray:
    """How often the corpus has each term of the windows; each task adds up its segments first."""
    held = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        w = held.value
        total = np.zeros(len(w.terms) + 1, np.int64)
        for batch in batches:
            for terms, counts in zip(column(batch, "terms"), column(batch, "counts"), strict=True):
                total[w.numbers(words_in(terms))] += ints(counts)  # a segment has a term once
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    count = np.zeros(len(windows.terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # bounded by the block's terms
        count[r.term] = r.n
    return count


class Segment:
    """One row of the index."""

    def __init__(self, row: pa.RecordBatch, windows: Windows, gap: int):
        value = lambda name: column(row, name)[0]
        self.ids, self.n = value("ids").values, ints(value("n_words"))
        self.begin = np.r_[0, np.cumsum(self.n + gap)]
        counts, self.positions = ints(value("counts")), ints(value("positions"))
        number = windows.numbers(words_in(value("terms")))
        self.lo, self.hi = (np.zeros(len(windows.terms) + 1, np.int64) for _ in range(2))
        end = np.cumsum(counts)
        self.lo[number], self.hi[number] = end - counts, end
        self.lo[-1] = self.hi[-1] = 0

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.lo[term] : self.hi[term]]

    def phrase(self, words: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Begins of exact occurrences: offset-adjusted lists, intersected from the rarest term."""
        found = self.of(words[order[0]]) - order[0]
        for i in order[1:]:
            if not len(found):
                break
            other = self.of(words[i]) - i
            at = np.searchsorted(other, found)
            found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == found)]
        return found

    def near(self, words: np.ndarray, order: np.ndarray, slop: int) -> np.ndarray:
        """Begins x such that every term stands at x to x + slop, less its offset, and one at x itself."""
        first = self.of(words[order[0]]) - order[0]
        found = np.unique((first[:, None] - np.arange(slop + 1)).ravel())
        exact = np.zeros(len(found), bool)
        for i in order:
            other = self.of(words[i]) - i
            if not len(other):
                return found[:0]
            at = np.minimum(np.searchsorted(other, found), len(other) - 1)
            ok = (other[at] >= found) & (other[at] <= found + slop)
            found, exact = found[ok], (exact | (other[at] == found))[ok]
        return found[exact]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1


def _prepare(index: DataFrame, windows: Windows):
    windows.rarest_first(term_counts(index, windows))
    return index.sparkSession.sparkContext.broadcast(windows)


def find_windows(index: DataFrame, windows: Windows, gap: int = WINDOW) -> DataFrame:
    """(segment, at, id, n_words, spans, items) for every document: the words hit, as begin and end, and the items found."""
    held = _prepare(index, windows)

    def run(batches):
        w = held.value
        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1)
                s = Segment(row, w, gap)
                edge = np.zeros(int(s.begin[-1]) + 1, np.int64)
                items: dict[int, set] = {}
                for i in np.flatnonzero((s.hi > s.lo)[w.matrix].all(1)) if len(w.words) else ():
                    found = s.phrase(w.words[i], w.order[i])
                    if len(found):
                        np.add.at(edge, found, 1)
                        np.add.at(edge, found + len(w.words[i]), -1)
                        for d in np.unique(s.document(found)).tolist():
                            items.setdefault(d, set()).update(w.items[i])
                hit = np.diff(np.r_[0, np.cumsum(edge) > 0, 0])
                begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
                doc = s.document(begin)
                spans: list[list] = [[] for _ in range(len(s.n))]
                for d, a, b in zip(doc.tolist(), (begin - s.begin[doc]).tolist(), (end - s.begin[doc]).tolist(), strict=True):
                    spans[d].append({"begin": a, "end": b})
                n = len(s.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([column(row, "segment")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), s.ids, pa.array(s.n.astype(np.int64)),
                     pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(items.get(d, ()), key=str) for d in range(n)], pa.list_(pa.int64()))],
                    ["segment", "at", "id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, "segment long, at int, id long, n_words long, spans array<struct<begin: long, end: long>>, items array<bigint>")


def find_near(index: DataFrame, phrases: list[tuple[int, str]], slop: int, gap: int = WINDOW) -> DataFrame:
    """(id, phrase, begin) of proximity matches: whole phrases, each word at most `slop` words off its place. slop below gap."""
    if slop >= gap:
        raise ValueError("slop must be below the gap between documents")
    windows = Windows(phrases, 1 << 30)
    held = _prepare(index, windows)

    def run(batches):
        w = held.value
        for batch in batches:
            for j in range(batch.num_rows):
                s = Segment(batch.slice(j, 1), w, gap)
                out: list[tuple] = []
                for i in range(len(w.words)):
                    for x in s.near(w.words[i], w.order[i], slop).tolist():
                        d = int(s.document(np.array([max(x, 0)]))[0])
                        out += [(s.ids[d].as_py(), item, x - int(s.begin[d])) for item in w.items[i]]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["id", "phrase", "begin"])

    return index.mapInArrow(run, "id long, phrase long, begin long")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: the words inside occurrences of test windows, and the items they are of."""
    lower = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tests = items.select(F.col(item_col).cast("long").alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words")).where("size(words) > 0")
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(block))
    pieces = tests.select("item", F.explode(F.transform(begins, lambda i: F.array_join(F.slice("words", i + 1, block + window - 1), " "))).alias("text"))
    pieces = written(pieces, "tests")
    size = pieces.select(F.sum(F.regexp_count("text", F.lit(" ")) + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    index = build_index(docs, id_col, text_col, window)
    found = None
    for b in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        one = find_windows(index, Windows([(r.item, r.text) for r in own.collect()], window), window)
        found = one if found is None else found.union(one)
    if blocks == 1:
        return found.select(F.col("id").alias(id_col), "n_words", "spans", "items")
    merged = found.groupBy("segment", "at", "id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    join = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["begin"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    empty = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    return merged.select(F.col("id").alias(id_col), "n_words", F.aggregate("spans", empty, join).alias("spans"), "items")


#: op3's digests in DuckDB SQL, over the views documents and benchmark.
SQL = """
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (
  select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
wanted as (
  select distinct item, least(len(w), 10) as m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as words
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
places as (
  select r, i, m, array_to_string(w[i : i + m - 1], ' ') as words
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from docs cross join (select distinct m from wanted))),
found as (select r, i, places.m as m, item from places join wanted on places.words = wanted.words and places.m = wanted.m),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from found) group by r),
named as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct r, item from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from docs left join hits using (r) left join named using (r)
"""


def brute(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """doc_id: (n_words, n_hit, sorted items), the slow way; for tests."""
    wanted: dict[tuple, set] = {}
    for item, text in items.items():
        ws = words_of((text or "").encode())
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            wanted.setdefault(tuple(ws[i : i + window]), set()).add(item)
    lens = sorted({len(w) for w in wanted})
    out = {}
    for k, text in texts.items():
        ws = words_of((text or "").encode())
        hit, found = set(), set()
        for m in lens:
            for i in range(len(ws) - m + 1):
                if (got := wanted.get(tuple(ws[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= got
        out[k] = (len(ws), len(hit), sorted(map(str, found)))
    return out
