"""Decontamination, fingerprints, language identification and mixing."""

import hashlib
import math
import random

import duckdb
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontam, fingerprint, langid, mixing


def test_decontamination(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    items = {i: " ".join(r.choice(words) for _ in range(r.randint(0, 30))) for i in range(20)} | {20: None, 21: "!?", 22: "Ab, CD"}
    docs = {}
    for k in range(80):
        ws = [r.choice(words) for _ in range(r.randint(0, 120))]
        if k % 3 == 0:
            it = (items[r.randrange(20)] or "").split()
            a = r.randint(0, max(0, len(it) - 12))
            ws[5:5] = it[a : a + r.randint(8, 20)]
        docs[k] = r.choice([" ", "--", "\n"]).join(ws).upper() if k % 5 == 0 else ", ".join(ws)
    docs |= {100: None, 101: "", 102: "x ab cd y"}
    df = spark.createDataFrame([(k, t, "t", 1) for k, t in docs.items()], "doc_id long, text string, terms string, segment int").repartition(3)
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = decontam.brute(docs, items)
    for block in (decontam.BLOCK, 40):
        got = {r.doc_id: (r.n_words, sum(s.end - s.begin for s in r.spans), sorted(map(str, r["items"]))) for r in decontam.decontaminate(df, tests, block=block).collect()}
        assert got == want
    assert any(v[1] for v in want.values())


def test_decontamination_of_odd_rows(spark):
    """Null and repeated item ids, repeated documents, a text longer than a segment, clashing columns."""
    item = " ".join(f"w{i}" for i in range(12))
    long = " ".join(f"x{i}" for i in range(700_000)) + f" {item} end"
    docs = [(1, f"a {item}"), (1, f"a {item}"), (2, long), (None, item), (3, None)]
    tests = [(7, item), (None, item), (7, "w0 w1"), (None, None), (9, "absent words")]
    df = spark.createDataFrame([(*r, "i", 3) for r in docs], "doc_id long, text string, ids string, n_words int").repartition(2)
    items = spark.createDataFrame([(*r, 1) for r in tests], "item_id long, text string, item int")
    for block in (decontam.BLOCK, 4):
        got = sorted((r.doc_id or 0, r.n_words, sum(s.end - s.begin for s in r.spans), sorted(map(str, r["items"]))) for r in decontam.decontaminate(df, items, block=block).collect())
        assert got == [(0, 12, 12, ["7", "None"]), (1, 13, 12, ["7", "None"]), (1, 13, 12, ["7", "None"]), (2, 700_013, 12, ["7", "None"]), (3, 0, 0, [])]


def test_long_items_are_cut_with_all_their_windows(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = {1: " ".join(words), 2: " ".join(words[290:]), 3: "w1 w2"}
    docs = {k: " ".join(words[a : a + r.randint(5, 40)]) for k, a in enumerate(range(0, 295, 7))}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (7, 50, 1000):
        got = {x.doc_id: (x.n_words, sum(s.end - s.begin for s in x.spans), sorted(map(str, x["items"]))) for x in decontam.decontaminate(df, tests, block=block).collect()}
        assert got == decontam.brute(docs, items)


def test_one_index_serves_any_test_set(spark):
    index = decontam.build_index(spark.createDataFrame([(1, "a b c d e"), (2, "c d e f")], "doc_id long, text string"))
    for phrase, hits in (("c d e", {1, 2}), ("e f", {2}), ("f g", set())):
        found = decontam.find_windows(index, decontam.Windows([(0, phrase)], 10))
        assert {r.id for r in found.collect() if r.spans} == hits


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    tests = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert decontam.decontaminate(none, tests).count() == 0
    assert sorted((r.n_words, len(r.spans)) for r in decontam.decontaminate(one, tests).collect()) == [(0, 0), (2, 0)]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, "a x y z b c d"), (4, "d c b a")], "doc_id long, text string")
    index = decontam.build_index(df)
    got = {(r.id, r.begin) for r in decontam.find_near(index, [(7, "a b c d")], 1).collect()}
    assert (1, 0) in got and (2, 0) in got and not {i for i, _ in got} & {3, 4}


def plain_print(text: str) -> int:
    ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    total = sum(min(len(w), 12) for w in ws)
    ones = [sum(min(len(w), 12) for w in ws if xxhash.xxh64_intdigest(w.encode(), 42) >> b & 1) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > total)


def test_fingerprints(spark):
    r = random.Random(2)
    texts = {k * 7 - 30: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 15))) for _ in range(r.randint(0, 40))) for k in range(50)} | {500: None, 501: "", 502: "😀😀😀😀", 503: "A\tb\nC"}
    fingerprint.STRETCH, kept = 7, fingerprint.STRETCH
    try:
        rows = fingerprint.document_fingerprints(spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, s int, fp string").repartition(4)).collect()
    finally:
        fingerprint.STRETCH = kept
    order = sorted(texts)
    assert sorted(x.doc_id for x in rows) == order
    for x in rows:
        own, following = texts[x.doc_id] or "", texts[order[(order.index(x.doc_id) + 1) % len(order)]] or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + following[:q]
        assert (x.n_chars, x.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert [v % 2**64 for v in (x.fp, x.edited_fp, x.next_fp)] == [plain_print(t) for t in (own, edited, following)]


def test_fingerprints_of_few(spark):
    assert fingerprint.document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprint.document_fingerprints(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one.next_fp == one.fp
    same = fingerprint.document_fingerprints(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert len(same) == 3 and same[0].fp is not None


def test_near_fingerprints(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 5))}) for b in base for _ in range(5)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius in (0, 3):
        got = {(x.fp, x.other_fp) for x in fingerprint.near_fingerprints(df, radius).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= radius}
        assert got == want
        some = df.where(F.pmod("fp", F.lit(3)) == 0)
        pairs = [(x.fp, x.other_fp) for x in fingerprint.near_fingerprints(df, radius, queries=some).collect()]
        asked = [f for f in signed if f % 3 == 0]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in asked for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= radius}
    assert want


def test_near_of_odd_rows(spark):
    """Copies, nulls and repeated ids among the queries; a very long text."""
    rows = [(0, "a b c"), (50, "a b c"), (50, "A B\tc"), (51, "a b c"), (100, None), (150, ""), (None, "a b c"), (200, "z " * 200_000)]
    out = fingerprint.with_near(fingerprint.document_fingerprints(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int"))).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_near if r.n_near is not None else -1) for r in out) == [(-1, -1), (0, 4), (50, 4), (50, 4), (51, -1), (100, 1), (150, 1), (200, 0)]


def test_language_id(spark):
    r = random.Random(4)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ein", "ich"], "cc": ["ção", "ão", "nh", "lh"]}
    rows = [(k, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randint(5, 60))), lang, "source", 1) for k in range(300) for lang in [sorted(parts)[k % 3]]]
    rows += [(900, None, "aa", "s", 1), (901, "", "aa", "s", 1), (902, "12 !?", "bb", "s", 1), (903, "x", None, "s", 1), (None, "tokami", "aa", "s", 1), (904, "日本", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bin int")
    got = {x.doc_id: x for x in langid.identify_languages(df).collect()}
    assert len(got) == len(rows)
    out = [k for k, *_ in rows if k is not None and k < 300 and got[k].held_out]
    assert len(out) > 30 and sum(got[k].lang_pred == rows[k][2] for k in out) / len(out) > 0.97
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902)) and got[904].lang_pred in parts and got[903].lang_pred in parts
    assert all(0 <= x.score <= 1 for x in got.values()) and got[None].held_out is False
    import zlib

    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got if k is not None)


def test_more_languages_than_one_matrix(spark, monkeypatch):
    rows = [(k, f"{chr(97 + k % 20)}q{chr(97 + k % 20)} " * 20, f"l{k % 20:02d}") for k in range(400)] + [(1000, "dqd " * 400_000, None), (1001, "?", "l00"), (1002, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: r for r in langid.identify_languages(df).collect()}
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    monkeypatch.setattr(langid, "GATHERED", 1 << 10)
    cut = {r.doc_id: r for r in langid.identify_languages(df).collect()}
    assert {k: r.lang_pred for k, r in cut.items()} == {k: r.lang_pred for k, r in whole.items()} and whole[1000].lang_pred == "l03"
    assert all(abs(cut[k].score - whole[k].score) < 1e-6 for k in whole)
    assert sum(whole[k].lang_pred == lang for k, _, lang in rows[:400]) == 400 and (whole[1001].lang_pred, whole[1002].lang_pred) == ("und", "und")


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(x.lang_pred, x.score) for x in langid.identify_languages(df).collect()] == [("und", 0.0)] * 2
    assert langid.identify_languages(df.limit(0)).count() == 0


def test_language_is_no_input(spark):
    df = spark.createDataFrame([(k, "kato mira" if k % 2 else "schung ein", "aa" if k % 2 else "bb") for k in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    a, b = (langid.predict(d, model).orderBy("doc_id").collect() for d in (df, df.withColumn("lang", F.lit("zz"))))
    assert a == b


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket string, mix_size int").repartition(3)
    return df, mixing.mix_sources(df, keep_text=False)


def test_mixing(spark):
    r = random.Random(5)
    rows = [(k, " ".join("w" * r.randint(1, 9) for _ in range(r.choice([0, 1, 5, 50, 400]))), r.choice(["a", "a", "a", "b", "c", "ß", "Z", None]), "x", 9) for k in range(400)] + [(400, None, "empty", "x", 9), (None, "a b", "a", "x", 9)]
    df, out = mixed(spark, rows)
    got = out.collect()
    assert len(got) == len(rows) and "text" not in out.columns and out.columns.count("mix_size") == 1
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toArrow()
    con.register("documents", documents)
    want = {x[0]: x[1:] for x in con.sql(mixing.SQL).fetchall()}
    assert {x.doc_id: (x.mix_size, x.mix_source_size, x.mix_target, x.mix_size * x.mix_repeats) for x in got} == want
    total = sum(x.mix_size for x in got)
    targets = {x.source: (x.mix_target, x.mix_source_size) for x in got}
    assert math.isclose(sum(t for t, _ in targets.values()), 1.5 * total) and all(t <= 2 * s + 1e-9 for t, s in targets.values())
    for source, (target, _) in targets.items():
        own = [x for x in got if x.source == source]
        assert abs(sum(x.mix_size * x.mix_repeats for x in own) - target) <= max(x.mix_size for x in own) / 2 + 1e-9
    assert all(x.mix_repeats <= 2 for x in got)


def test_mixing_is_proportional_or_clamped(spark):
    rows = [(k, "w " * 10, "abc"[k % 3], "x", 1) for k in range(90)]
    _, out = mixed(spark, rows)
    t = {x.source: x.mix_target for x in out.collect()}
    # 300 words each, 1350 to share 3:1:2; a would get 675 and is clamped at 600, the rest goes 1:2
    assert t == {"a": 600.0, "b": 250.0, "c": 500.0}


def test_mixing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == 0
    nulls = mixing.mix_sources(spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(x.mix_size, x.mix_target) for x in nulls] == [(0, 0.0)] * 2


def test_no_document_beyond_the_epochs(spark):
    """Documents of size 0 follow the passes of their source."""
    rows = [(k, None if k % 2 else "w " * 10, "abc"[k % 3], "x", 1) for k in range(120)]
    _, out = mixed(spark, rows)
    got = out.collect()
    assert all(x.mix_repeats <= 2 for x in got)
    assert {x.mix_repeats for x in got if x.source == "a"} == {2}
    long = [(1, "w " * 300_000, "a", "x", 1), (1, "w " * 300_000, "a", "x", 1), (2, "v", "b", "x", 1)]
    assert sorted((x.doc_id, x.mix_size, x.mix_repeats) for x in mixed(spark, long)[1].collect()) == [(1, 300_000, 2), (1, 300_000, 2), (2, 1, 2)]
