"""Substring, phrase and near-duplicate removal against brute force, with nulls, ties, long texts and clashing columns."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import anchors, neardup, phrase_dedup, suffix_dedup
from quern.llm.anchors import Tokens


def corpus(seed: int, n: int = 60) -> dict:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passages = [[r.choice(words) for _ in range(r.randint(30, 130))] for _ in range(5)]
    out = {}
    for k in range(n):
        ws = [r.choice(words) for _ in range(r.randint(0, 200))]
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(ws))
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            ws[at:at] = p if r.random() < 0.5 else p[a:b]
        out[k * 3 - 20] = r.choice([" ", "\n", " \t"]).join(ws)
    out[1000] = "a" * 3000
    out[1001] = "ab" * 700 + "x" + "a" * 150
    out[1002] = out[-20 + 3]
    out[1003] = ""
    out[1004] = None
    out[1005] = "\n".join(passages[0] * 9)
    return out


def frame(spark, texts: dict):
    """Identifiers and texts, beside columns that operators use inside."""
    rows = [(k, t, "key", 1, "x", None) for k, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, k int, segment string, row string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.substring_dedup(frame(spark, texts)).collect()}
    assert got == suffix_dedup.brute(texts)


@pytest.mark.parametrize("seed", [3, 4])
def test_phrase_dedup(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrase_dedup.phrase_dedup(frame(spark, texts)).collect()}
    assert got == phrase_dedup.brute(texts)


@pytest.mark.parametrize("hot", [0, 2])
def test_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    texts = corpus(8)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.substring_dedup(frame(spark, texts)).collect()}
    assert got == suffix_dedup.brute(texts)
    monkeypatch.setattr(anchors, "FEW_HOT", -1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrase_dedup.phrase_dedup(frame(spark, texts)).collect()}
    assert got == phrase_dedup.brute(texts)


@pytest.mark.parametrize("words", [False, True])
def test_windows_of_hot_keys_are_told_apart_without_their_texts(monkeypatch, words):
    """No text is cut out for a window, equal windows of a key stay together, others part."""
    r = random.Random(7)
    line = [f"line{i}" for i in range(40)]
    texts = [" ".join([f"a{r.random()}" for _ in range(30)] + line + [f"b{r.random()}" for _ in range(30)]) for _ in range(20)] * 2
    length, gram = (50, 16) if words else (100, 32)
    t = Tokens(pa.array(texts), words)
    segment = t.segment
    keys = t.runs(length, gram)[4]
    own = pa.array([keys.tolist()] * len(texts), pa.list_(pa.int64()))
    part = pa.RecordBatch.from_arrays([pa.array(texts), own, own], ["text", "keys", "hot"])
    monkeypatch.setattr(t, "segment", lambda lo, n: pytest.fail("a text is cut out for a window"))
    told, total = {}, 0
    for _, lo, n, off, key in anchors.chosen(t, part, length, gram):
        assert (n == 1).all() and (off >= 0).all() and (off <= length - gram).all()
        total += len(lo)
        for x, y in zip(lo.tolist(), key.tolist(), strict=True):
            told.setdefault(y, set()).add(segment(x, length))
    windows = {s for x in told.values() for s in x}
    assert total == int(np.maximum(np.diff(t.first) - length + 1, 0).sum()) and all(len(x) == 1 for x in told.values()) and len(windows) == len(told)


def test_a_common_line_with_ever_other_surroundings(spark, monkeypatch):
    """One anchor that all documents have: no group grows with their number, and what repeats is found."""
    monkeypatch.setattr(anchors, "HOT", 20)
    r = random.Random(4)
    line = [f"line{i}" for i in range(30)]
    texts = {k: " ".join([f"a{r.random()}" for _ in range(30)] + line + [f"b{r.random()}" for _ in range(30)]) for k in range(300)}
    texts |= {1000: texts[7], 1001: " ".join(texts[9].split()[10:80]), 1002: "x " * 60}
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in phrase_dedup.phrase_dedup(frame(spark, texts)).collect()}
    assert got == phrase_dedup.brute(texts)
    parts = anchors.Recurring(frame(spark, texts), 50, 16, True, False).segments()
    assert max(x["count"] for x in parts.groupBy("key").count().collect()) <= 20


def test_other_lengths(spark):
    texts = corpus(5, 30)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrase_dedup.phrase_dedup(frame(spark, texts), 20, 8).collect()}
    assert got == phrase_dedup.brute(texts, 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.substring_dedup(frame(spark, texts), 40, 16).collect()}
    assert got == suffix_dedup.brute(texts, 40)


def test_kept_columns(spark):
    texts = corpus(6, 20)
    rows = phrase_dedup.phrase_dedup(frame(spark, texts), keep=("key", "segment")).collect()
    assert all(r.row.key == "key" and r.row.segment == "x" for r in rows)
    assert all(r.kept == (texts[r.doc_id] or "") for r in rows if not r.n_removed)


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in phrase_dedup.phrase_dedup(df).collect())
    assert got == [(False, 1, 60), (False, 1, 60), (False, 2, 60), (True, 0, 0)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.substring_dedup(df.where("doc_id = 1")).collect())
    assert got == [(False, 1, 0), (False, 1, 0)]


def test_equal_hashes_of_different_strings(monkeypatch):
    """If hashes tell nothing apart, the bytes do."""
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start, bucket = rng.integers(0, 380, 200), np.sort(rng.integers(0, 4, 200))
    k, place = rng.integers(0, 9, 200), start
    want = suffix_dedup.repeats(data, start, bucket, k, place, 12)
    monkeypatch.setattr(suffix_dedup.Suffixes, "extension", lambda self, a, b: np.full(len(a), self.length))
    assert (suffix_dedup.repeats(data, start, bucket, k, place, 12) == want).all() and want.any() and not want.all()


def test_long_texts(spark):
    """Texts of 100 000 words, one of them a copy with an insertion."""
    r = random.Random(12)
    words = [f"w{r.randint(0, 9999)}" for _ in range(100_000)]
    texts = {1: " ".join(words), 2: " ".join([*words[:50_000], "new", *words[50_000:]]), 3: "a" * 400_000}
    df = frame(spark, texts)
    got = {x.doc_id: (x.n_words, x.n_removed) for x in phrase_dedup.phrase_dedup(df).collect()}
    assert got == {1: (100_000, 0), 2: (100_001, 100_000), 3: (1, 0)}
    rows = {x.doc_id: x for x in suffix_dedup.substring_dedup(df).collect()}
    assert rows[1].n_removed == 0 and len(texts[2]) - 10 <= rows[2].n_removed <= len(texts[2])
    assert rows[3].n_removed == 399_999  # all but the first byte lie in a string that also starts earlier
    assert {x.doc_id: x.component_id for x in neardup.similar_groups(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert phrase_dedup.phrase_dedup(none).count() == suffix_dedup.substring_dedup(none).count() == neardup.near_duplicates(none).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert phrase_dedup.phrase_dedup(nulls).count() == suffix_dedup.substring_dedup(nulls).count() == neardup.near_duplicates(nulls).count() == 2


def test_suffix_order():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    start = rng.integers(0, 500, 300)
    bucket = np.sort(rng.integers(0, 5, 300))
    s = suffix_dedup.Suffixes(data, 64)
    order = s.sort(start, bucket)
    strings = [(b, bytes(data[a : a + 64])) for a, b in zip(start.tolist(), bucket.tolist(), strict=True)]
    assert [strings[i] for i in order] == sorted(strings)
    assert order.tolist() == sorted(range(300), key=lambda i: strings[i])


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    body = "the quick brown fox jumps over a lazy dog again and again until it is dark outside and nobody is left to see it fall over there"
    t = Tokens(pa.array([f"xx{body}yy", body, f"{body[:110]}zzz"]), False)
    text, lo, n, off, key = t.runs(100, 32)
    first = t.first
    seen = {}
    for i in range(len(lo)):
        for w in range(n[i]):
            s = bytes(t.data[lo[i] + w : lo[i] + w + 100])
            seen.setdefault(s, set()).add((int(key[i]), int(off[i] - w)))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) > 20 and len(first) == 4


def near_corpus(seed: int) -> dict:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    out, k = {}, 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(40, 300))]
        for _ in range(r.randint(1, 8)):
            ws = list(base)
            for _ in range(r.randint(0, 2)):
                ws[r.randrange(len(ws))] = r.choice(words)
            out[k] = " ".join(ws)
            k += 1
    return out | {900: None, 901: "", 902: "A b", 903: "a  B", 904: "\n", 905: "x"}


def test_near_duplicates(spark):
    texts = near_corpus(1)
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in texts.items()], "doc_id long, text string, fp string, node int")
    got = {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in neardup.near_duplicates(df).collect()}
    want = neardup.brute(texts)
    assert got == want
    assert any(c != k and want[c][0] != want[k][0] for k, (_, c) in want.items())  # some link between different fingerprints


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_trie_join_finds_all(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 16, 40, dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    raw = fp.astype(">u8").view(np.uint8).reshape(-1, 8)
    found = set()
    neardup.trie_join(raw, np.array([0, len(fp) // 3]), radius, lambda a, b, bits: found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)), lambda: [np.arange(len(fp))])
    cut = len(fp) // 3
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= radius and (i < cut) == (j < cut)}
    assert found == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
