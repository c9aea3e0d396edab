"""Groups by verified similarity against brute force, pairs on either side of 0.8, recall, hot shards and repeated ids."""

import random
import time

import numpy as np
import pyarrow as pa

import corpus_pipeline

from quern.llm import neardup


def edited(r, words, edits):
    """words with one changed in each of `edits` places that are five apart: each changes five shingles."""
    out = list(words)
    for at in r.sample(range(4, len(words) - 5, 5), edits):
        out[at] = f"x{r.random()}"
    return out


def made():
    r, texts = random.Random(3), {}
    for i in range(60):
        words = [f"w{r.randint(0, 99999)}" for _ in range(204)]
        texts[10 * i] = " ".join(words)
        # 200 shingles, 5 for each edit: 4 edits are 180 / 220 = 0.818, 5 are 175 / 225 = 0.778
        texts[10 * i + 1] = " ".join(edited(r, words, 4 if i < 30 else 5))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_keeps_below_and_drops_from_the_threshold(spark):
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, frame(spark, made()), "").collect()}
    assert kept == {10 * i for i in range(60)} | {10 * i + 1 for i in range(30, 60)}


def test_groups_against_brute_force(spark):
    r, texts = random.Random(5), made()
    # a passage that most have, a chain of edits, a large group, copies, short, empty
    passage = [f"p{i}" for i in range(60)]
    for i in range(150):
        texts[1000 + i] = " ".join(passage + [f"w{r.randint(0, 9999)}" for _ in range(r.choice([3, 6, 9, 15, 40]))])
    words = [f"c{i}" for i in range(150)]
    for i in range(25):
        texts[2000 + i] = " ".join(words)
        words = edited(r, words, 2)
    base = [f"g{i}" for i in range(200)]
    for i in range(80):
        texts[3000 + i] = " ".join(edited(r, base, r.choice([0, 1, 2])))
    texts |= {4000: "a b c", 4001: "A  b\tc", 4002: "a b", 4003: "", 4004: None, 4005: " "}
    got = {x.doc_id: x.component_id for x in neardup.similar_groups(frame(spark, texts)).collect()}
    assert got == neardup.brute_similar(texts)[0]


def test_cut_shards_change_nothing(spark, monkeypatch):
    r, texts = random.Random(9), made()
    base = [f"g{i}" for i in range(200)]
    for i in range(120):
        texts[3000 + i] = " ".join(edited(r, base, r.choice([0, 1, 2, 3])))
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    monkeypatch.setattr(neardup, "HOT", 7)
    monkeypatch.setattr(neardup, "SET_ROWS", 20)
    got = {x.doc_id: x.component_id for x in neardup.similar_groups(frame(spark, texts)).collect()}
    assert got == neardup.brute_similar(texts)[0]
    docs = frame(spark, {k: t for k, t in texts.items() if k >= 3000})
    got = {x.doc_id: (x.fp.hex(), x.component_id) for x in neardup.near_duplicates(docs).collect()}
    assert got == neardup.brute({k: t for k, t in texts.items() if k >= 3000})


def test_recall_at_the_threshold():
    """Pairs at 0.8, of many and of few shingles: the share that the tables and the radius let meet."""
    r = random.Random(1)
    radius, tables = neardup.bit_tables(neardup.WIDE, 0.8, 1 << 18)
    for n, same, least in ((900, 800, 0.95), (90, 80, 0.95), (9, 8, 0.9)):
        met = 0
        for _ in range(300):
            one, a, b = ([r.getrandbits(64) for _ in range(k)] for k in (same, n - same, n - same))
            x, y = (np.unpackbits(np.frombuffer(neardup.simhash(one + more, neardup.WIDE), np.uint8)) for more in (a, b))
            met += (x != y).sum() <= radius and any((x[t] == y[t]).all() for t in tables)
        assert met >= least * 300, (n, met)


def by_brute_force(fp, first, radius):
    wide, out = fp.view(np.uint64), set()
    for lo, hi in zip(first.tolist(), [*first.tolist()[1:], len(fp)], strict=True):
        near = np.bitwise_count(wide[lo:hi, None] ^ wide[None, lo:hi]).sum(2) <= radius
        out |= {(lo + a, lo + b) for a, b in np.argwhere(np.triu(near, 1)).tolist()}
    return out


def test_trie_join_of_small_and_large_shards_against_brute_force():
    """Whatever the size of its leaves: near rows, equal rows, shards below and above a leaf."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    bits = np.unpackbits(base[rng.integers(0, 40, 700)], axis=1) ^ (rng.random((700, 256)) < rng.choice([0, 0.05, 0.15], (700, 1)))
    part = np.sort(rng.choice([0, 1, 2, 3, 4, 4, 4, 4, 4, 4], 700))
    fp = np.packbits(bits.astype(np.uint8), axis=1)
    order = np.lexsort((*fp.T[::-1], part))
    fp, first = fp[order], np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
    want = by_brute_force(fp, first, 56)
    for leaf in (1, 30, neardup.LEAF, 1 << 20):
        got = []
        neardup.trie_join(fp, first, 56, lambda a, b, bits: got.extend(zip(a.tolist(), b.tolist(), strict=True)), lambda: [np.arange(700)], leaf)
        assert len(got) == len(want) and {(min(p), max(p)) for p in got} == want


def test_shards_of_a_large_corpus_cost_little_for_each_pair():
    """Shards as full as those of 2.7 million documents: the join of a table takes no more than a few times what its pairs take."""
    rng = np.random.default_rng(4)
    size, many = 83, 500
    fp = rng.integers(0, 256, (size * many, 32), dtype=np.uint8)
    fp = fp[np.lexsort((*fp.T[::-1], np.repeat(np.arange(many), size)))]
    rows = [pa.array(np.repeat(np.arange(many), size)), pa.array(np.arange(size * many)), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(np.arange(size * many))]
    batch = pa.RecordBatch.from_arrays(rows, ["part", "node", "fp", "label"])
    radius, tables = neardup.bit_tables(neardup.WIDE, 0.8, 2_700_000)
    began = time.process_time()
    assert sum(x.num_rows for x in neardup.meeting(radius, tables)([batch])) == 0
    assert time.process_time() - began < 0.3e-6 * many * size * (size - 1) / 2


def test_blocks_follow_the_number_of_nodes():
    for nodes, size in ((1000, 16), (10**7, 25), (10**10, 31)):
        tables = neardup.block_tables(64, 3, nodes)
        assert min(map(len, tables)) >= min(size, 25)
        for _ in range(200):
            wrong = set(random.Random(_).sample(range(64), 3))
            assert any(not wrong & set(t.tolist()) for t in tables)


def test_a_third_of_all_rows_is_one_group(spark):
    """The pairs proposed stay near the number of documents, whatever the group."""
    r, base = random.Random(2), [f"g{i}" for i in range(300)]
    texts = {i: " ".join(edited(r, base, r.choice([1, 2, 3]))) for i in range(400)}
    texts |= {1000 + i: " ".join(f"w{r.randint(0, 99999)}" for _ in range(60)) for i in range(800)}
    got = neardup.similar_groups(frame(spark, texts)).collect()
    assert {x.component_id for x in got if x.doc_id < 1000} == {0} and len(got) == 1200
    assert len({x.component_id for x in got}) == 801


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (None, "z"), (9, "z")], "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in neardup.similar_groups(docs).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (None, None), (9, None)}
