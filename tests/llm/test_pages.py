"""Archives, url filters and chat packs."""

import gzip
import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import chat, queries, url_filter, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_warc_round_trip(spark):
    big = "é" * 80
    rows = [(5, "http://a/?q=é\r\nX: y", big), (3, "http://b", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 300_000), (None, "u", "y" * 100), (8, "u", "y" * 100), (8, "v", "y" * 100)]
    got = warc.read_warc(warc.write_warc(pages(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        payloads = {(h or "").encode() for k, _, h in rows if k == r.page_id}
        body = next(p for p in payloads if hashlib.sha256(p).hexdigest() == r.payload_digest)
        assert r.payload_bytes == len(body)
        first = min(-1 if k is None else k for k, _, h in rows if (h or "").encode() == body)
        again = len(body) >= 100 and (-1 if r.page_id is None else r.page_id) > first
        assert (r.record_type, r.refers_to) == (("revisit", None if first == -1 else first) if again else ("response", None))
        assert again or bytes(r.payload) == body


def test_warc_is_one_member_per_record():
    raw = warc.record(1, "http://x", b"abc", hashlib.sha256(b"abc").hexdigest(), None) + warc.record(2, None, b"abc", hashlib.sha256(b"abc").hexdigest(), 1)
    a, b = warc.read_records(io.BytesIO(raw))
    assert (a["payload"], b["payload"], b["refers_to"], b["offset"]) == (b"abc", None, 1, len(raw) // 2 if a["offset"] else b["offset"])
    assert gzip.decompress(raw[: b["offset"]]).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_warc_damage():
    good = warc.record(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None)
    text = gzip.decompress(good)
    for bad in (good[:-5], gzip.compress(text.replace(b"abcabc", b"abcabd", 1)), gzip.compress(text[:-8]), gzip.compress(text + b"x"), gzip.compress(b"nothing\r\n\r\n"), gzip.compress(text.replace(b"Content-Length: 150", b"Content-Length: 151"))):
        with pytest.raises(ValueError, match="."):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_of_other_writers():
    import base64

    block = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc"

    def packed(*fields):
        return gzip.compress("\r\n".join(["WARC/1.0", "WARC-Type: response", "Content-Type: application/http", *fields]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    size, sha1 = f"Content-Length: {len(block)}", base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    (one,) = warc.read_records(io.BytesIO(packed(size, f"WARC-Payload-Digest: sha1:{sha1}")))
    assert (one["payload"], one["payload_bytes"], one["payload_digest"]) == (b"abc", 3, sha1)  # the HTTP head's own length decides nothing
    for fields in ((), ("Content-Length: x",), (size, "WARC-Payload-Digest: sha1:AAAA"), (size, "WARC-Block-Digest: md5:00"), (size, "WARC-Payload-Digest: crc:1")):
        with pytest.raises(ValueError, match="."):
            list(warc.read_records(io.BytesIO(packed(*fields))))


def test_warc_long_and_repeated(spark):
    rows = [(1, "u", "é" * 1_500_000), (2, "u" * 70_000, "é" * 1_500_000), *[(None, None, None)] * 40]
    got = warc.read_warc(warc.write_warc(pages(spark, rows))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to) for r in got) == [(0, "response", 0, None)] * 40 + [(1, "response", 3_000_000, None), (2, "revisit", 3_000_000, 1)]


def test_warc_of_nothing(spark):
    assert warc.read_warc(warc.write_warc(pages(spark, []))).count() == 0


URLS = [
    "http://a.NET/x", "http://net/", "http://net", "https://b.example.net/en/1?x", "https://example.net/en", "x://example.com/de/#f", "http://sub.example.com/de/y", "http://example.com/DE/", "http://q.org/fr/z", "http://q.org?/fr/", "http://xnet/", "http://a.net#f",
    "", None, "no scheme", "://", "http:///en/", "a://b://c.net/", "http://exámple.net/é", "http://a.b.c.example.net/en/?", "HTTP://WWW.EXAMPLE.ORG/fr/", "http://user@net/",
]


def test_url_filter(spark):
    import duckdb

    rows = [(i, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame([(*r, "k", True) for r in rows], "page_id long, url string, key string, listed boolean")
    con = duckdb.connect()
    pages = df.select("page_id", "url").toArrow()
    con.register("pages", pages)
    want = sorted(map(str, con.sql(url_filter.SQL).fetchall()))
    for bits in (url_filter.MOST_BITS, 128):
        assert sorted(str(tuple(r)) for r in url_filter.filter_urls(df, most_bits=bits).collect()) == want
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    rest = {u: next(r for r in url_filter.filter_urls(df).collect() if r.page_id == i) for i, u in enumerate(URLS)}
    assert (rest["http://net/"].rule, rest["http://net"].rule, rest["https://b.example.net/en/1?x"].verdict, rest["http://xnet/"].rule, rest[None].host) == ("net/", None, "allow", None, "")


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    cascade = url_filter.Cascade(universe)
    assert len(cascade.levels) > 2 and universe.where(cascade.has(F.col("key")) != F.col("listed")).count() == 0
    with pytest.raises(OverflowError):
        url_filter.Cascade(universe, 1000)


def test_few_listed_of_many(spark):
    """What level 0 lets pass counts for the sections too."""
    from pyspark.sql import functions as F

    universe = spark.range(60_005).select(F.col("id").cast("string").alias("key"), (F.col("id") < 5).alias("listed")).cache()
    of, cascades = url_filter.sections(universe, 4096)
    assert len(cascades) > 1 and all(level.words * 64 <= 4096 for c in cascades for level in c.levels)
    answer = F.lit(None).cast("boolean")
    for s, c in enumerate(cascades):
        answer = F.when(of(F.col("key")) == s, c.has(F.col("key"))).otherwise(answer)
    assert universe.where(~answer.eqNullSafe(F.col("listed"))).count() == 0


def test_sections_read_the_pages_once(spark, tmp_path):
    rows = [(i, f"http://h{i}.{'net' if i % 2 else 'org'}/{i}/{'x' * (100_000 if i == 7 else 3)}", "k", True) for i in range(700)]
    spark.createDataFrame(rows, "page_id long, url string, key string, listed boolean").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    out = url_filter.filter_urls(df, most_bits=384)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("pmod(xxhash64") >= 1
    assert {r.page_id: r.verdict for r in out.collect()} == {i: "block" if i % 2 else "allow" for i in range(700)}


CONVERSATIONS = {
    1: [("system", "be kind"), ("user", "hi ### there"), ("assistant", r"\### Assistant: </turn> ok")],
    2: [("system", "be kind"), ("user", "hi ### there"), ("assistant", "####</turn></turn>\\")],
    3: [("system", "be kind"), ("user", "hi")],
    4: [("user", ""), ("assistant", None), ("user", "é😀\n### user: x</turn>\n"), ("assistant", "")],
    5: [("we:ird#\\\n<", "x"), (None, "y")],
    6: [("assistant", "alone " * 500)],
    None: [("user", "null id")],
}


@pytest.mark.parametrize("pack", [64, chat.PACK])
def test_chat_round_trip(spark, pack):
    rows = [(c, i, r, t, "p", 1) for c, ts in CONVERSATIONS.items() for i, (r, t) in enumerate(ts)]
    rows += [(c + 10_000 * k, *rest) for k in (1, 2) for c, *rest in rows if c]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, turns int").repartition(4)
    packs = chat.format_chats(df, pack)
    got = {r.conv_id: r for r in chat.read_back(packs).collect()}
    for c, ts in CONVERSATIONS.items():
        turns = [("null" if r is None else r, t or "") for r, t in ts]
        for k in (0, 1, 2) if c else (0,):
            r = got[c + 10_000 * k if c else c]
            assert [(t.role, t.text) for t in r.turns] == turns and r.n_turns == len(turns)
            loss = "".join(t for role, t in turns if role == "assistant")
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_shared_turns_are_emitted_once(spark):
    shared = [(c, 0, "user", "the same question " * 20) for c in range(50)] + [(c, 1, "assistant", f"answer {c}") for c in range(50)]
    packs = chat.format_chats(spark.createDataFrame(shared, "conv_id long, turn long, role string, text string")).collect()
    tokens = sum(len(p.tokens) for p in packs)
    assert tokens < len(packs) * 450 + 50 * 60
    for p in packs:
        for n in p.nodes:
            assert n.attend[-1].end == n.end and (n.parent < 0 or n.begin >= p.nodes[n.parent].end)
            assert p.positions[n.begin] == (0 if n.parent < 0 else p.positions[p.nodes[n.parent].end - 1] + 1)


def test_vocabulary(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, 0, "user", "Hello wörld ### x"), (1, 1, "assistant", "Bye")], "conv_id long, turn long, role string, text string")
    how = {"vocabulary": tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": tokenizers.PATTERN}
    packs = chat.format_chats(df, **how)
    assert len(packs.first().tokens) < 30 and chat.read_back(packs, **how).first().turns[0].text == "Hello wörld ### x"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:#<>/\\turn\n ", max_size=12), st.text(alphabet="#</turn>\\ \nx:", max_size=30)), max_size=5))
def test_template_is_reversible(turns):
    assert chat.parse("".join(f"### {chat.escape_role(r)}: {chat.escape(t)}{chat.CLOSE}" for r, t in turns)) == turns


def test_no_conversations(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_every_operator_is_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)
