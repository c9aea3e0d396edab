"""Substring deduplication by repeated-phrase automata.

Passages are confirmed in shards by anchor key (see anchors): stretches of at least `length` words that
occur in two documents or more. Each shard compiles its passages into Aho-Corasick automata of bounded
size over word numbers and streams the segments of all documents that reach it; an occurrence in a document
other than the passage's first one goes. Equal segments are streamed once and stand for all their documents.

Defined results: a null text has no words; a null doc_id comes before all others; rows that share a doc_id
are one document and never remove each other's words; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import Recurring, grouped
from quern.llm.common import SPACES, id_back

LENGTH, GRAM = 50, 16
#: Windows that a shard confirms at once, and words in one automaton.
CHUNK, NODES = 60_000, 300_000


def passages(segments: list[list[bytes]], n: list[int], off: list[int], k: list[int], shared: list[bool], length: int) -> list[tuple[list[bytes], int]]:
    """Recurring passages of segments with one anchor, each with its first document.

    Consecutive windows that occur in the same segments make one passage. A segment that several documents have is
    itself one.
    """
    found = [(words, k[i]) for i, words in enumerate(segments) if shared[i]]
    if len(segments) == 1:
        return found
    where: dict[tuple, list] = {}
    for i, words in enumerate(segments):
        for w in range(n[i]):
            at = (off[i] - w, b" ".join(words[w : w + length]))
            got = where.get(at)
            if got is None:
                where[at] = [k[i], i, 1, hash((i, length))]
            else:
                got[0] = min(got[0], k[i])
                got[2] += 1
                got[3] ^= hash((i, length))
    for i, words in enumerate(segments):
        begin, last = None, None
        for w in range(n[i] + 1):
            got = where[off[i] - w, b" ".join(words[w : w + length])] if w < n[i] else None
            mark = (got[3], got[2], got[0]) if got and got[1] == i and got[2] > 1 else None
            if mark != last:
                if last is not None:
                    found.append((words[begin : w - 1 + length], last[2]))
                begin, last = w, mark
    return found


def occurrences(found: list[tuple[list[bytes], int]], segments: list[list[bytes]], groups: tuple[list[int], list[int]], k: list[int]) -> list[list[tuple[int, int]]]:
    """(begin, end) in words of each segment's occurrences of passages that start with an earlier document."""
    of_passage, of_segment = groups
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    begin, at = 0, 0
    while begin < len(found):
        size, end = 0, begin
        last = of_passage[begin]
        while end < len(found) and (size < NODES or of_passage[end] == last) and size < 4 * NODES:
            size += len(found[end][0])
            last = of_passage[end]
            end += 1
        number: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, first in found[begin:end]:
            path = tuple(number.setdefault(w, len(number) + 1) for w in words)
            told = automaton.get(path, None)
            automaton.add_word(path, (len(path), first if told is None else min(first, told[1])))
        automaton.make_automaton()
        while at < len(segments) and of_segment[at] < of_passage[begin]:
            at += 1
        for i in range(at, len(segments)):
            if of_segment[i] > of_passage[end - 1]:
                break
            for last_word, (size, first) in automaton.iter(tuple(number.get(w, 0) for w in segments[i])):
                if first < k[i]:
                    out[i].append((last_word + 1 - size, last_word + 1))
        begin = end
    return out


def _shard(length: int):
    def shard(batches):
        for table in grouped(batches, CHUNK):
            key, k, lo, n, off, shared = (table.column(c).to_pylist() for c in ("key", "k", "lo", "n", "off", "shared"))
            segments = [s.split(b" ") for s in table.column("segment").to_pylist()]
            found, of_passage, of_segment = [], [], []
            begin, group = 0, 0
            while begin < len(key):
                end = begin
                while end < len(key) and key[end] == key[begin]:
                    end += 1
                own = passages(segments[begin:end], n[begin:end], off[begin:end], k[begin:end], shared[begin:end], length)
                found += own
                of_passage += [group] * len(own)
                of_segment += [group] * (end - begin)
                begin, group = end, group + 1
            marks = []
            for i, spans in enumerate(occurrences(found, segments, (of_passage, of_segment), k)):
                m = bytearray(n[i])
                for a, b in spans:
                    for w in range(a, b - length + 1):
                        m[w] = 1
                marks.append(bytes(m))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(lo, pa.int64()), pa.array(key, pa.int64()), pa.array(marks, pa.binary())], ["k", "lo", "key", "marks"])

    return shard


def phrase_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document with the words that remain: (doc_id, n_words, n_removed, kept), and a struct row of the columns of keep.

    A word goes if it lies in `length` consecutive words that also start in a document with a smaller doc_id.
    kept joins the rest by one space; with keep, which is for columns other than the text, a text that loses nothing
    stays as it is.
    """

    def finish(t, k, row, marked):
        edge = np.zeros(len(t.values) + 1, np.int64)
        np.add.at(edge, marked, 1)
        np.add.at(edge, marked + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[t.first[1:]] - total[t.first[:-1]]
        kept = []
        raw = t.data.tobytes()
        begin, end = t.begin, t.end
        for i in range(len(t.at) - 1):
            if removed[i] == 0:
                whole = raw[t.at[i] : t.at[i + 1]]
                kept.append(whole if keep else b" ".join(whole.split()))
            else:
                own = np.flatnonzero(~gone[t.first[i] : t.first[i + 1]]) + t.first[i]
                kept.append(b" ".join(raw[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)))
        out = {"k": k, "n_words": pa.array(np.diff(t.first)), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.binary())} | ({"row": row} if keep else {})
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    plan = Recurring(docs, length, gram, words=True, within=False, id_col=id_col, text_col=text_col, keep=keep)
    rows = f", row {plan.docs.schema['row'].dataType.simpleString()}" if keep else ""
    out = plan.repeated(_shard(length), finish, f"k long, n_words long, n_removed long, kept binary{rows}")
    return out.select(id_back(name=id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), *(["row"] if keep else []))


def brute(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, str]]:
    """The slow way; for tests."""
    first: dict[tuple, int] = {}
    words = {k: [w for w in (t or "").encode().translate(bytes(32 if c in SPACES else c for c in range(256))).split(b" ") if w] for k, t in texts.items()}
    for k in sorted(words):
        for s in range(len(words[k]) - length + 1):
            first.setdefault(tuple(words[k][s : s + length]), k)
    out = {}
    for k, ws in words.items():
        gone = [False] * len(ws)
        for s in range(len(ws) - length + 1):
            if first[tuple(ws[s : s + length])] < k:
                gone[s : s + length] = [True] * length
        out[k] = (len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode())
    return out


#: op9's digests in DuckDB SQL, over the view documents.
SQL = f"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (
  select r, doc_id, i, sha256(array_to_string(w[i : i + {LENGTH - 1}], ' ')) as words from (select r, doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) as i from docs where len(w) >= {LENGTH})),
firsts as (select words, min(doc_id) as first_id, count(*) filter (where doc_id is null) as of_null from windows group by words having count(*) > 1),
gone as (
  select distinct r, unnest(range(i, i + {LENGTH})) as p from windows join firsts using (words) where doc_id is not null and (of_null > 0 or first_id < doc_id)),
places as (select r, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from docs),
rest as (select places.r, count(gone.p) as n_removed, string_agg(word, ' ' order by places.p) filter (where gone.p is null) as kept from places left join gone on places.r = gone.r and places.p = gone.p group by places.r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join rest using (r)
"""
