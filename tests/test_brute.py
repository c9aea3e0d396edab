"""Queries that SQL can't express against plain versions, on whole small tables."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern import catalog
from quern.functions import ladders as L
from quern.functions import passes as P
from quern.operators import dedup as D
from quern.operators import evaluation as E
from quern.operators import vectors as V
from quern.plans import samples, scores


def signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def test_rouge_is_the_longest_common_subsequence(spark, small_dir):
    import re

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0

    rows = {r.idx: r for r in E.scored(scores._predictions(spark, small_dir)).where("bucket = 'open'").collect()}
    got = {r.idx: r.rouge_l for r in catalog.queries()["rouge_l"](spark, small_dir).collect()}
    words = lambda s: re.findall("[a-z0-9]+", s.lower())
    assert set(got) == set(rows) and len(got) > 5
    assert all(math.isclose(got[k], plain(words(r.pred), words(r.ref))) for k, r in rows.items())


def test_bands_against_sets(spark, small_dir):
    """Shingles, signatures and bands, each worked out again."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    import re

    sets = {}
    for k, t in docs:
        ws = re.findall(r"[A-Za-z0-9_]+", t.lower(), re.ASCII)
        grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ws
        sets[k] = {signed(xxhash.xxh64_intdigest(g.encode(), 42)) for g in grams}
    df = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", D.shingles("text").alias("items"))
    assert {r.doc_id: set(r["items"]) for r in df.collect()} == sets

    def chained(i, x):
        return signed(xxhash.xxh64_intdigest(struct.pack("<q", x), xxhash.xxh64_intdigest(struct.pack("<i", i), 42)))

    def sign(items):
        return [min((chained(42 + i, x) for x in items), default=2**63 - 1) for i in range(32)]

    signatures = {k: sign(s) for k, s in sets.items()}
    assert {r.doc_id: list(r.sig) for r in df.select("doc_id", V.minhash("items", 32).alias("sig")).collect()} == signatures

    def band(i, rows):
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), 42)
        for x in rows:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return h

    keys = {k: [band(i, s[4 * i : 4 * i + 4]) for i in range(8)] for k, s in signatures.items() if sets[k]}
    often = {}
    for s in keys.values():
        for i, x in enumerate(s):
            often[i, x] = often.get((i, x), 0) + 1
    want = {k: n for k, s in keys.items() if (n := sum(often[i, x] > 1 for i, x in enumerate(s)))}
    assert {r.doc_id: r.bands for r in catalog.queries()["minhash_candidates"](spark, small_dir).collect()} == want


def test_intervals_hold_the_mean_and_agree(spark, small_dir):
    one, two = ([tuple(r) for r in catalog.queries()["bootstrap_ci"](spark, small_dir).orderBy("bucket", "metric").collect()] for _ in range(2))
    assert one == two and one and all(low <= mean <= high for *_, mean, low, high in one)
    long = E.long_scores(E.scored(scores._predictions(spark, small_dir)), "idx", ("bucket",), ("accuracy", "token_f1", "rouge_l")).toPandas()
    means = long.groupby(["bucket", "metric"]).score.agg(["mean", "count"])
    assert all(math.isclose(means.loc[(b, m), "mean"], mean) and means.loc[(b, m), "count"] == n for b, m, n, mean, *_ in one)
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "i int, score double")
    (got,) = E.bootstrap(rows, (), 2000).collect()
    assert abs(got.low - (0.5 - 1.96 * 0.025)) < 0.01 and abs(got.high - (0.5 + 1.96 * 0.025)) < 0.01


@pytest.mark.parametrize("name", ["redact_names", "remediation", "strip_artefacts", "strict_clean", "greeting_strip"])
def test_ladders_agree_with_themselves(spark, small_dir, name):
    """A row for each text or pair, the made-up ones among them, and the same again."""
    one, two = (sorted(map(tuple, catalog.queries()[name](spark, small_dir).collect()), key=str) for _ in range(2))
    assert one == two and len(one) > len(samples.QUESTIONS)


def test_rules_that_fired(spark, small_dir):
    fired = {r.rule: r.n for r in catalog.queries()["conservative_clean"](spark, small_dir).collect()}
    assert set(fired) <= set(L.RULES) and {"platform_or_ref", "add_period", "abbr_comma"} & set(fired) and all(fired.values())


def test_nothing_is_left_that_a_rule_takes(spark):
    """What the rules are for is gone from texts that are made of it, whatever its order."""
    import re

    r = random.Random(6)
    parts = ["nama saya Budi Santoso,", "081234567890", "a.b@c.co.id", "perkenalkan saya Rina umur", "demam", "obat.", "Saya Ingin, minum"]
    texts = [" ".join(r.sample(parts, r.randint(1, len(parts)))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", "c", L.redacted(F.col("c")).alias("r"))
    for row in df.collect():
        assert not re.search(r"Budi|Rina|0812|@", row.r.text)
        assert row.r.n == sum(x in row.c for x in ("Budi", "Rina umur", "0812", "@")) and ("Ingin" in row.c) == ("Ingin" in row.r.text)
    names = ["dr. Irna", "dokter william danny", "Drg. Andi", "dr. spesialis", "obat", "dr cecilia"]
    texts = [" ".join(r.sample(names, r.randint(1, len(names)))) for _ in range(100)]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("c", L.scrubbed(F.col("c"))["text"].alias("t")).collect()
    assert all(not re.search(r"(?i)irna|andi|cecilia", x.t) and ("spesialis" in x.c) == ("spesialis" in x.t) for x in out)


def test_normalised_texts(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/pages.parquet").select("page_id", "html", P.normalized(F.col("html")).alias("t")).collect()
    import re
    import unicodedata

    for row in rows:
        t = row.t or ""
        assert t == " ".join(t.split()) and not re.search(r"https?://\S", t) and unicodedata.is_normalized("NFC", t)
        assert row.html is not None or row.t is None


def test_similar_pairs_of_random_sets(spark):
    """Against all pairs: near copies of several sizes, equal sets, a key with two rows, keys that are structs, null keys; several thresholds."""
    rng = random.Random(7)
    word = lambda: rng.getrandbits(63) if rng.random() < 0.6 else rng.randrange(40)
    sets = []
    for _ in range(60):
        first = {word() for _ in range(rng.choice((1, 2, 9, 40, 70, 300)))}
        sets.append(first)
        for _ in range(rng.randrange(4)):
            lost = set(rng.sample(sorted(first), len(first) * rng.choice((0, 5, 15, 30)) // 100))
            sets.append(first - lost | {word() for _ in range(rng.randrange(len(lost) + 1))})
    sets.append(set())
    keyed = [(i, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame([*keyed, keyed[3], (None, sorted(sets[5]))], "k long, items array<bigint>").repartition(3).select(F.when(F.col("k").isNotNull(), F.struct(F.lit(0).alias("s"), "k")).alias("k"), "items")
    for least in (0.8, 0.9, 0.5):
        pairs, members = D.similar_pairs(df, "k", "items", least)
        got = {(r.a.k, r.b.k): r.similarity for r in pairs.collect()}
        first = {}
        for i, s in keyed:
            first.setdefault(tuple(s), i)
        reps = [(i, set(s)) for s, i in first.items() if s]
        want = {(i, j): len(x & y) / len(x | y) for i, x in reps for j, y in reps if i < j and len(x & y) >= least * len(x | y) - 1e-12}
        assert got == want and pairs.count() == len(want) > 10
        assert {(r.k.k, r.a.k) for r in members.where("k is not null").collect()} == {(i, first[tuple(s)]) for i, s in keyed}


def test_parities_differ_no_more_than_sets():
    rng = random.Random(3)
    for n in (1, 63, 64, 65, 500, 5000):
        x = {rng.getrandbits(62) for _ in range(n)}
        y = set(rng.sample(sorted(x), n * 9 // 10)) | {rng.getrandbits(62) for _ in range(n // 5)}
        flat = [sorted(x), sorted(y), [], sorted(x)]
        rows = D._parities(pa.array(range(4)), np.array([len(s) for s in flat]), np.array(sum(flat, []), np.int64)).column("bits").to_pylist()
        assert P.differing(rows[0], rows[1]) <= len(x ^ y) and P.differing(rows[0], rows[3]) == 0
        assert P.differing(rows[0], rows[2]) <= n and len(rows[0]) * 8 < 2 * max(n, 64)
