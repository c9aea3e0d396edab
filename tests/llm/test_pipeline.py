"""The registered queries against brute force and SQL on whole small tables, and the pipeline on planted cases."""

import hashlib
import math
import random

import corpus_pipeline
import duckdb
import pytest

from quern.llm import decontam, neardup, phrase_dedup, queries, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, small_dir)
    want = con.sql(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_substrings(spark, small_dir, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_array_dedup(spark, small_dir).collect()}
    assert got == suffix_dedup.brute(docs)


def test_phrases(spark, small_dir, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_phrase_automata_dedup(spark, small_dir).collect()}
    assert got == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in phrase_dedup.brute(docs).items()}


def test_fingerprint_groups(spark, small_dir, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_trie_dedup(spark, small_dir).collect()}
    assert got == neardup.brute(docs)


def test_benchmark(spark, small_dir, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op3_decontaminate(spark, small_dir).collect()}
    want = {k: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for k, (n, h, i) in decontam.brute(docs, items).items()}
    assert got == want


def test_fingerprints_tell_edits_from_neighbours(spark, small_dir):
    rows = queries.op7_simhash_fingerprints(spark, small_dir).collect()
    mean = lambda xs: sum(xs) / len(xs)
    assert mean([r.near_edited for r in rows]) > 0.7 and mean([r.near_next for r in rows]) < 0.35
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 16 for r in rows)


def test_held_out_accuracy(spark, small_dir):
    told = queries.op10_language_id(spark, small_dir)
    lang = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang")
    rows = told.where("held_out").join(lang, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95


def test_chats_and_pages(spark, small_dir):
    conv = queries.op5_chat_prefix_tree(spark, small_dir).collect()
    own = next(r for r in conv if r.conv_id == -7)
    text = r"\### Assistant: </turn> ok"
    assert own.n_turns == 2 and own.loss_chars == len(text) and own.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    rows = queries.op1_warc(spark, small_dir).collect()
    assert {r.page_id: r.payload_digest for r in rows} == {k: hashlib.sha256((h or "").encode()).hexdigest() for k, h in pages.items()}


def planted(tmp_path, spark):
    r = random.Random(9)
    words = {"en": ["the", "and", "thing", "other", "with", "have"], "de": ["und", "schlecht", "eine", "nicht", "auch", "wird"]}

    def text(lang, n):
        return " ".join(r.choice(words[lang]) + r.choice(["", "s", "er", "ing"]) + str(r.randint(0, 99)) for _ in range(n))

    docs = [(i, text(lang := ["en", "de"][i % 2], 150), lang, f"s{i % 4}") for i in range(120)]
    passage, item = text("en", 70), text("en", 25)
    at = dict((d[0], d) for d in docs)
    near = at[6][1].split()
    near[40] = "changed"
    docs += [(200, at[4][1], "en", "s0"), (201, " ".join(near), "en", "s1"), (202, f"{text('en', 50)} {passage} {text('en', 50)}", "en", "s1"), (203, f"{text('en', 60)} {passage} {text('en', 40)}", "en", "s2")]
    docs += [(204, f"{text('en', 60)} {item} {text('en', 60)}", "en", "s3"), (205, "123 456 !!", "en", "s0"), (206, None, None, None), (207, "", "de", "s0")]
    d = tmp_path / "sf"
    spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {x[0]: x[1] for x in docs}, passage


def test_pipeline_on_planted_cases(spark, tmp_path):
    d, texts, passage = planted(tmp_path, spark)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, d), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "mixing" or docs.columns == list(corpus_pipeline.COLUMNS)
    clean = set(range(120))
    assert set(kept["language_id"]) == clean | {200, 201, 202, 203, 204}
    assert set(kept["near_dedup"]) == clean | {202, 203, 204}
    assert set(kept["substring_dedup"]) == clean | {202, 203, 204}
    assert passage in kept["substring_dedup"][202].text and passage not in kept["substring_dedup"][203].text
    assert kept["substring_dedup"][203].n_chars == len(kept["substring_dedup"][203].text) and kept["substring_dedup"][5].text == texts[5]
    assert set(kept["decontamination"]) == clean | {202, 203}
    assert set(kept["mixing"]) <= clean | {202, 203} and all(r.mix_repeats in (1, 2) for r in kept["mixing"].values())
    again = {r.doc_id: r.mix_repeats for r in corpus_pipeline.run(spark, d).collect()}
    assert again == {k: r.mix_repeats for k, r in kept["mixing"].items()}


def test_stages_on_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Repeated doc_ids, null ids and texts, very long texts and columns named like the operators' own."""
    long = " ".join(f"the thing {i} with other" for i in range(60_000))
    rows = [(1, "the thing and the other with have " * 20, "en", "a"), (1, "the thing and the other with have " * 20, "en", "a"), (2, long, "en", "a"), (3, long + " and more", "en", "b"), (None, None, None, None), (None, "the and thing other " * 30, "en", None), (4, "", "en", "a")]
    d = str(tmp_path / "sf")
    clash = ("k", "node", "fp", "d", "label", "part", "gone", "kept", "row", "spans", "items", "mix_size", "_source", "held_out", "lang_pred", "component_id")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    spark.createDataFrame([(1, "nothing of the kind is in here at all i hope")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).collect()
        assert out, name
        if name == "near_dedup":
            assert sorted((r.doc_id or 0) for r in out) == [0, 0, 1, 1, 2]


def test_pipeline_of_nothing(spark, tmp_path):
    d = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def plain_languages(rows):
    """Naive Bayes with plain counters; rows of (doc_id, text, lang). The language, and its probability."""
    import math
    import zlib
    from collections import Counter, defaultdict

    from quern.llm import langid

    def bins(text):
        points = [p + 32 if 65 <= p <= 90 or 0xC0 <= p <= 0xDE and p != 0xD7 else p for p in map(ord, text)]
        points = [32 if p < 97 or 122 < p < 0xAA else p for p in points]
        for order in langid.ORDERS:
            for i in range(len(points) - order + 1):
                h = order
                for p in points[i : i + order]:
                    h = (h ^ p) * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                yield h % langid.BINS

    counts, docs, cache = defaultdict(Counter), Counter(), {k: Counter(bins(t or "")) for k, t, _ in rows}
    for k, t, lang in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2 and lang is not None and t is not None:
            docs[lang] += 1
            counts[lang].update(cache[k])
    total = {x: sum(c.values()) + langid.SMOOTH * langid.BINS for x, c in counts.items()}
    out = {}
    for k, t, _ in rows:
        score = {x: math.log(docs[x] / sum(docs.values())) + sum(n * math.log((counts[x][b] + langid.SMOOTH) / total[x]) for b, n in cache[k].items()) for x in counts}
        best = max(sorted(score), key=score.get)
        share = 1 / sum(math.exp(max(-700, v - score[best])) for v in score.values())
        out[k] = (best, share) if any(c.isalpha() for c in t or "") else ("und", 0.0)
    return out


def test_languages_against_counters(spark, small_dir):
    import zlib

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    want, got = plain_languages(rows), {r.doc_id: r for r in queries.op10_language_id(spark, small_dir).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {k: w for k, (w, _) in want.items()}
    assert all(abs(r.score - want[k][1]) < 1e-3 and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())


def test_fingerprints_against_plain_votes(spark, small_dir, docs):
    from test_texts import plain_print

    order = sorted(docs)
    like = lambda a, b: max(0.0, math.cos((a ^ b).bit_count() * math.pi / 64))
    prints = {k: plain_print(t or "") for k, t in docs.items()}
    rows = queries.op7_simhash_fingerprints(spark, small_dir).collect()
    assert sorted(r.doc_id for r in rows) == order
    for r in rows:
        own, follows = docs[r.doc_id] or "", order[(order.index(r.doc_id) + 1) % len(order)]
        q = len(own) // 4
        edited = own[: len(own) - q] + (docs[follows] or "")[:q]
        fp, other = prints[r.doc_id], plain_print(edited)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(own), hashlib.sha256(edited.encode()).hexdigest(), f"{fp:016x}", f"{other:016x}")
        assert r.n_near == (sum((prints[r.doc_id] ^ x).bit_count() <= 3 for x in prints.values()) - 1 if r.doc_id % 50 == 0 else None)
        assert math.isclose(r.near_edited, like(fp, other), abs_tol=1e-12) and math.isclose(r.near_next, like(fp, prints[follows]), abs_tol=1e-12)


def test_pipeline_against_brute_force(spark, small_dir):
    from quern.llm import mixing

    rows = {r.doc_id: r for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    told = plain_languages([(k, r.text, r.lang) for k, r in rows.items()])
    texts = {k: rows[k].text for k in rows if told[k][0] != "und" and told[k][1] >= corpus_pipeline.SURE}
    label, _ = neardup.brute_similar(texts)
    texts = {k: t for k, t in texts.items() if label[k] == k}
    cut = phrase_dedup.brute(texts)
    texts = {k: (kept if removed else texts[k]) for k, (n, removed, kept) in cut.items() if not removed or removed < n}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()}
    texts = {k: t for k, t in texts.items() if not decontam.brute({k: t}, items)[k][1]}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(k, t, rows[k].source) for k, t in texts.items()])
    want = {k: (texts[k], size, target, taken) for k, size, _, target, taken in con.sql(mixing.SQL).fetchall() if taken or not size}
    got = {r.doc_id: (r.text, r.mix_size, r.mix_target, r.mix_size * r.mix_repeats) for r in corpus_pipeline.run(spark, small_dir).collect()}
    assert got == want
