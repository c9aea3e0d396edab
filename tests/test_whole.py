"""Queries that do the whole job: whole texts, all documents."""

import hashlib
import shutil

import duckdb

from quern import catalog
from quern.plans import audits, curation, duplicates


def documents(spark, tmp_path, texts):
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_reverts_after_the_first_500_characters(spark, tmp_path):
    text = "\n".join(["The thing is on  the table"] * 100)
    row = audits.spelling_reverted(spark, documents(spark, tmp_path, {1: text})).collect()[0]
    assert (row.back, row.corrected) == (md5(text.lower()), md5(text.replace("thing", "think")))


def test_every_copy_has_a_row(spark, tmp_path):
    d = documents(spark, tmp_path, {1: "one two three four", 2: "One two, three four", 3: "one two three four", 4: "five six seven", 5: ""})
    want = {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1)}
    for query in (duplicates.near_members, duplicates.bucketed_members):
        assert {tuple(r) for r in query(spark, d).collect()} == want


def test_gated_selects_from_more_than_a_hundred_rows(spark):
    assert curation.curate_gated(spark, "/root/testdata/sf0.1").count() > 100


def test_first_letters_agree_with_sql(spark, small_dir, tmp_path):
    odd = [chr(c) for c in range(0x80, 0x1E000) if not 0xD800 <= c < 0xE000 and (chr(c).upper() != chr(c) or len(chr(c).lower()) > 1)]
    d = documents(spark, tmp_path, dict(enumerate(x + tail for x in odd for tail in ("", "traße ΣΑΣ İzmir is a long enough text"))))
    shutil.copy(f"{small_dir}/conversations.parquet", d)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
    for name in ("truncate_words", "shared_greeting", "stripped_address", "dedup_documents"):
        got = catalog.queries()[name](spark, d).collect()
        assert sorted(map(tuple, got)) == sorted(con.sql(catalog.oracle_sql()[name]).fetchall()), name
