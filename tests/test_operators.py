"""Operators on small tables: order, ties, empty tables, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import passes as P
from quern.functions import text as T
from quern.operators import dedup as D
from quern.operators import evaluation as E
from quern.operators import gates as G
from quern.operators import selection as S
from quern.operators import typo as Y
from quern.operators import vectors as V
from quern.shared import ranked
from quern.sources import readers, sinks


def test_ranked(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 3).cast("int"))
    got = {(r.g, r["rank"]): r.id for r in ranked(df, [F.col("id").desc()], ("g",)).collect()}
    for g in range(3):
        ids = sorted((i for i in range(1000) if i % 3 == g), reverse=True)
        assert [got[g, n + 1] for n in range(len(ids))] == ids
    assert [r.id for r in ranked(df.limit(0), [F.col("id")]).collect()] == []


def test_similar_pairs_and_greedy(spark):
    sets = {1: "a b c d e f g h i j k", 2: "a b c d e f g h i j k", 3: "a b c d e f g h i j x", 4: "b c d e f g h i j x y", 5: "q", 6: ""}
    df = spark.createDataFrame(list(sets.items()), "k long, t string").select("k", D.shingles("t", 1).alias("items"))
    pairs, members = D.similar_pairs(df, "k", "items", 0.8)
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and a != 2 and b != 2 and sets[a] and len(set(sets[a].split()) & set(sets[b].split())) / max(1, len(set(sets[a].split()) | set(sets[b].split()))) >= 0.8}
    assert got == want
    assert {r.k for r in D.greedy_keep(pairs, members, "k").collect()} == {1, 4, 5, 6}


def test_half_even(spark):
    df = spark.createDataFrame([(n,) for n in range(20)], "n long")
    got = [r[0] for r in df.orderBy("n").select(S.half_even(F.col("n"), F.lit(4))).collect()]
    assert got == [round(n / 4) for n in range(20)]


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(103)
    n = {r["split"]: r["count"] for r in S.split(df, "id").groupBy("split").count().collect()}
    assert n == {"train": 82, "val": 10, "test": 11}


def test_many_first_rows(spark, monkeypatch):
    df = spark.range(500).withColumn("x", (F.col("id") * 7919) % 500)
    few = [r.id for r in S.top(df, 100, "x", "id").collect()]
    monkeypatch.setattr(S, "GATHERED", 10)
    assert sorted(r.id for r in S.top(df, 100, "x", "id").collect()) == sorted(few)
    assert S.sample(df, 50, "id").count() == 50


def test_oversample_reaches_share(spark):
    df = spark.range(100)
    out = S.oversample(df, F.col("id") < 10, "id", 0.25, 2)
    assert out.where("id < 10").count() == 20 and out.where("id >= 10").count() == 90


def test_ladder_is_sequential(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3) for i in range(30)], "i int, a int, b int")
    gates = [G.Gate("A", (("odd", F.col("a") == 1),)), G.Gate("B", (("three", F.col("b") == 0), ("one", F.col("b") == 1)))]
    steps = [(r.gate, r.n_in, r.n_dropped, r.n_out) for r in G.funnel(df, gates).orderBy("ord").collect()]
    assert steps == [("A", 30, 15, 15), ("B", 15, 5, 10), ("B", 10, 5, 5)]
    assert G.survivors(df, gates).count() == 5


def test_bootstrap_interval(spark):
    long = spark.createDataFrame([(i, "x", float(i % 2)) for i in range(200)], "idx int, k string, score double")
    a, b = (E.bootstrap(long, ("k",), 300).first() for _ in range(2))
    assert a == b and a.n == 200 and a.mean == 0.5 and 0.4 < a.low < 0.5 < a.high < 0.6
    shifted = long.withColumn("score", F.col("score") + 1)
    r = E.paired_bootstrap(long.select("idx", "score"), shifted.select("idx", "score"), "idx", rounds=100).first()
    assert r.significant and r.mean == 1.0


def test_minhash_estimates(spark):
    df = spark.createDataFrame([(list(range(100)), list(range(20, 120))), ([], [])], "a array<bigint>, b array<bigint>")
    rows = df.select(V.minhash("a", 256).alias("x"), V.minhash("b", 256).alias("y")).collect()
    same = sum(i == j for i, j in zip(rows[0].x, rows[0].y, strict=True)) / 256
    assert abs(same - 80 / 120) < 0.12 and rows[1].x == rows[1].y


def test_minhash_by_rows(spark):
    """As by columns, for repeated keys and empty sets too, and with the text read once for all hashes."""
    df = spark.createDataFrame([(1, "one two three four"), (1, "five six seven eight"), (2, "one two three four"), (3, ""), (None, "a b"), (4, None)], "k long, t string")
    sets = df.select("k", D.shingles("t").alias("items"))
    want = sets.where(F.size("items") > 0).select("k", V.minhash("items", 8).alias("sig")).collect()
    got = V.with_minhash(sets, "k", "items", 8)
    assert sorted(got.collect(), key=str) == sorted(want, key=str) and len(want) == 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2


def test_spelling(spark):
    df = spark.createDataFrame([("Tge tge man THE tge.",)], "t string")
    assert Y.apply(df, "t", {"tge": "the"}).first().t == "The the man THE the."
    assert tuple(df.select(Y.corrected("t", {"tge": "the"})).first()[0]) == ("Tge tge man THE tge.", 0)
    long = spark.createDataFrame([("Telfon saya. Telfon dan Telfon TELFON",), ("  Telfon\nTelfon, Telfon",), ("",), (None,)], "t string")
    got = [r[0] and tuple(r[0]) for r in long.select(Y.corrected("t", {"telfon": "telepon"})).collect()]
    assert got[:3] == [("Telepon saya. Telepon dan Telfon TELFON", 2), ("  Telepon\nTelepon, Telfon", 2), ("", 0)]
    assert tuple(df.select(Y.corrected("t", {})).first()[0]) == ("Tge tge man THE tge.", 0)


def test_runtime_corrections(spark):
    """By hand, else the official list for unknown words, else the one word of the dictionary that is one edit away."""
    words = spark.createDataFrame([("karna",), ("apotik",), ("demma",), ("berobat",), ("salma",), ("obar",), ("kata",), ("abc",), ("Obatt",)], "word string")
    valid = spark.createDataFrame([("demam",), ("obat",), ("obak",), ("kata",), ("deema",)], "word string")
    official = spark.createDataFrame([("demma", "demam"), ("kata", "katak"), ("salma", "salam"), ("obar", "x")], "old string, new string")
    plain = {r.old: r.new for r in Y.runtime_corrections(words, valid, official).collect()}
    assert plain == {"karna": "karena", "apotik": "apotek", "demma": "demam"}
    more = {r.old: r.new for r in Y.runtime_corrections(words, valid, official, aggressive=True).collect()}
    assert more == plain | {"obatt": "obat"}  # obar is one edit from two words


def test_correction_flags_are_counted(spark):
    df = spark.createDataFrame([(["MEDIS", "JAUH(d=3)"], 2), (["JAUH(d=4)", "SERING(9)"], 5)], "flags array<string>, n int")
    assert {(r.flag, r.types, r.applied) for r in Y.flag_counts(df, "flags", "n").collect()} == {("MEDIS", 1, 2), ("JAUH", 2, 7), ("SERING", 1, 5)}
    assert [r[0] for r in df.select(Y.priority("flags")).collect()] == [0, 9]


def test_readers_and_sinks(spark, tmp_path):
    lines = tmp_path / "chat.jsonl"
    lines.write_text('{"messages":[{"role":"user","content":"x"}],"source":"s"}\n\n{"messages":[],"source":null}\n')
    assert readers.json_lines(spark, str(lines)).count() == 2
    csv = tmp_path / "qa.csv"
    csv.write_text('title,question,answer,question_clean,answer_clean\nt,"a ""b""\nc",y,nan,z\n')
    df = readers.csv_table(spark, str(csv))
    assert df.select(readers.first_of(df, "question_clean", "question")).first()[0] == 'a "b"\nc'
    docs = tmp_path / "q.json"
    docs.write_text(json.dumps({"questions": [{"body": "b", "type": "list", "ideal_answer": ["i"], "exact_answer": [["x"], ["y"]]}, {"body": "c", "type": "yesno", "ideal_answer": "i", "exact_answer": "yes"}]}))
    got = readers.nested_questions(spark, [str(docs)]).orderBy("body").collect()
    assert [(r.body, r.ideal_answer, r.exact_answer) for r in got] == [("b", '["i"]', '[["x"],["y"]]'), ("c", '"i"', '"yes"')]
    out = str(tmp_path / "out")
    sinks.json_lines(spark.range(3), out)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.json_lines(spark.range(3), out)
    assert sinks.root("/x/", debug=True) == "/x/debug"
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "a.json").write_text(json.dumps({"label": "m_baseline", "metrics": {"overall": {"token_f1": 0.5}}}))
    (runs / "preds_a.json").write_text(json.dumps({"label": "no", "metrics": {}}))
    assert [tuple(r) for r in readers.runs(spark, str(runs)).collect()] == [("m_baseline", "overall", "token_f1", 0.5)]


def test_limits_sheets_pools_and_latest(spark, tmp_path):
    lines = tmp_path / "chat.jsonl"
    lines.write_text("".join(json.dumps({"messages": [], "source": f"s{i}"}) + "\n" for i in range(5)))
    assert readers.json_lines(spark, str(lines), limit=3).count() == 3
    sheet = tmp_path / "codes.csv"
    sheet.write_text('Code,Title,Note\n1A,"- Cholera, acute",\nnan,x,"two\nlines"\n')
    got = [tuple(r) for r in readers.sheet(spark, str(sheet), ("Code", "Title", "Note")).collect()]
    assert got == [("1A", "- Cholera, acute", None), (None, "x", "two\nlines")]
    with pytest.raises(ValueError, match="no Chapter"):
        readers.sheet(spark, str(sheet), ("Code", "Chapter"))
    row = lambda q: json.dumps({"q": q, "a": "x", "title": None, "scores": {"lang": 0.5}}) + "\n"
    first, b, c = (tmp_path / f"{n}.jsonl" for n in "fbc")
    b.write_text(row("b"))
    c.write_text(row("c"))
    paths = [str(x) for x in (first, b, c)]
    assert {r.q for r in readers.pool(spark, paths).collect()} == {"b", "c"}
    first.write_text(row("f"))
    assert {r.q for r in readers.pool(spark, paths).collect()} == {"f"}
    with pytest.raises(FileNotFoundError):
        readers.pool(spark, [str(tmp_path / "none.jsonl")])
    for day in ("2024-01-02", "2024-01-10", "2023-12-31"):
        (tmp_path / f"run-{day}.txt").write_text(f"{day}\n")
    assert [r.value for r in readers.latest(spark, f"{tmp_path}/run-*.txt").collect()] == ["2024-01-10"]
    with pytest.raises(FileNotFoundError):
        readers.latest(spark, f"{tmp_path}/no-*.txt")
    assert readers.parquet_or_json(spark, str(tmp_path / "none.parquet")) is None
    assert readers.parquet_or_json(spark, str(b)).count() == 1


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(1, "train", "x", 5), (2, "val", "x", 7), (3, "train", "y", 9)], "id int, split string, domain string, n int")
    sinks.splits(df, f"{d}/splits")
    assert {r.split: r.n for r in spark.read.json(f"{d}/splits").groupBy("split").agg(F.count("id").alias("n")).collect()} == {"train": 2, "val": 1}
    assert {tuple(r) for r in sinks.split_stats(df, "split", "domain", "n").collect()} == {("train", "x", 1, 5, 5), ("train", "y", 1, 9, 9), ("val", "x", 1, 7, 7)}
    for write, name, sep in ((sinks.tsv, "t", "\t"), (sinks.csv, "c", ",")):
        write(df, f"{d}/{name}")
        assert spark.read.option("header", True).option("sep", sep).csv(f"{d}/{name}").count() == 3
    sinks.two(df, f"{d}/two", F.col("n") > 6, df.agg(F.sum("n").alias("total")))
    assert spark.read.json(f"{d}/two/flagged").count() == 2 and spark.read.json(f"{d}/two/summary").first().total == 21
    funnel = spark.createDataFrame([(1, "G2", "b", 4, 1, 3), (0, "G1", "a", 5, 1, 4)], "ord int, gate string, reason string, n_in int, n_dropped int, n_out int")
    card = sinks.data_card(funnel, "Title").splitlines()
    assert card[0] == "# Title" and card[4:] == ["| G1 | a | 5 | 1 | 4 |", "| G2 | b | 4 | 1 | 3 |"]
    assert json.loads(sinks.report(df.orderBy("id").limit(1))) == [{"id": 1, "split": "train", "domain": "x", "n": 5}]
    assert sinks.root("/x", version="v2") == "/x/v2" and sinks.root("/x/", True, "v3") == "/x/debug/v3"
    sinks.json_lines(df, f"{d}/some", ["id"])
    assert spark.read.json(f"{d}/some").columns == ["id"]


def test_source_adapters(spark):
    """Each kind of source at the edges of its filters."""
    from quern.sources import adapters as A

    rows = lambda df: [tuple(r) for r in df.collect()]
    qa = spark.createDataFrame([("q1", "x" * 49), ("q2", "x" * 50), (" q3 ", " " + "y " * 1100), ("q4", "None"), (None, "x" * 60), ("q5", None), (" ", "x" * 60), ("q6", "z" * 2001)], "question string, answer string")
    assert rows(A.plain(qa)) == [("q2", "x" * 50), ("q3", ("y " * 1000).rstrip() + "..."), ("q6", "z" * 2000 + "...")]
    inst = spark.createDataFrame([("do", "", "o" * 50), ("do", " None", "o" * 50), ("do", " this ", "o" * 50), (None, "x", "o" * 50), ("do", "x", "o" * 49)], "instruction string, input string, output string")
    assert [q for q, _ in rows(A.instructions(inst))][:3] == ["do", "do", "do\nthis"]
    dec = spark.createDataFrame([("q", "long", "yes"), ("q", "long", "MAYBE"), ("q", "long", None), ("q", "long", "nan"), ("q", None, "no"), ("", "long", "no")], "question string, long_answer string, final_decision string")
    assert rows(A.decisions(dec)) == [("q", "Yes. long"), ("q", "Maybe. long"), ("q", "long"), ("q", "long")]
    mcq = spark.createDataFrame([("q", "a", "b ", "c", "d", i, why) for i, why in ((0, "because"), (3, ""), (4, "none"), (None, "x"))], "question string, opa string, opb string, opc string, opd string, cop int, exp string")
    assert [a for _, a in rows(A.choices(mcq))] == ["The correct answer is **A) a**. because", "The correct answer is **D) d**.", "The correct answer is **?) **."]
    assert rows(A.choices(mcq))[0][0] == "q\nA) a\nB) b\nC) c\nD) d"
    chat = spark.createDataFrame([("q" * 19, "a" * 100), ("q" * 20, "a" * 99), ("q" * 20, "a" * 100)], "question string, response string")
    assert rows(A.dialogues(chat)) == [("q" * 20, "a" * 100)]


def test_final_checks(spark):
    from quern.operators import audit

    good = [("train", "q1", "jawaban satu"), ("test", "q2", "jawaban dua")]
    told = lambda rows: {r.check: r.passed for r in audit.final_checks(spark.createDataFrame(rows, "split string, q string, a string"), "split").collect()}
    assert told(good) == told([]) == {"leaks": True, "duplicates": True, "over_strip": True}
    assert told([*good, ("val", "Q1 ", "jawaban satu")])["leaks"] is False
    assert told([*good, ("train", "q1", "jawaban satu")])["duplicates"] is False
    opening = "Halo. Welcome to this forum, dear user. I have read your query. Thanks for asking us. Obat ini diminum sesudah makan pagi."
    assert told([*good, ("val", "q3", opening)])["over_strip"] is False


def test_layouts(spark):
    a = spark.createDataFrame([("i", "o")], "instruction string, output string")
    b = spark.createDataFrame([([("user", "u"), ("assistant", "a")],)], "messages array<struct<role: string, content: string>>")
    assert [tuple(readers.any_layout(x).first()) for x in (a, b)] == [("i", "o"), ("u", "a")]
    with pytest.raises(ValueError, match="layout"):
        readers.any_layout(spark.createDataFrame([("x",)], "text string"))


def test_entry_tells_a_broken_import():
    """A module that is missing for another reason than the subpackage's absence isn't swallowed."""
    import subprocess
    import sys

    block = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", block], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
    import importlib.util

    assert (done.returncode != 0) == (importlib.util.find_spec("quern.llm.neardup") is not None if importlib.util.find_spec("quern.llm") else False), done.stderr[-500:]


def test_code_without_the_subpackage():
    """Nothing outside the subpackage for training corpora imports it."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quern"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "quern.llm" not in p.read_text(), p


def test_eval_reasons(spark):
    from quern.operators import leaks as L

    base = "one two three four five six seven eight nine ten eleven twelve"
    prefix = "z" * 200
    train = [(1, "Q one?", base), (2, "Q two?", f"{prefix} {base}")]
    rows = [(10, "new", "One, two three four five six seven eight nine ten eleven twelve!"), (11, "q ONE", "other"), (12, "x", f"{prefix} {base} thirteen"), (13, "y", "fresh"), (14, "z", "Fresh."), (15, "w", f"{prefix} a b c d e"), (16, "v", f"{prefix} a b c d e f"), (17, "u", None)]
    df = lambda r: spark.createDataFrame(r, "id long, q string, a string")
    got = {r.id: r.reason for r in L.eval_reasons(df(rows), df(train), "id").collect()}
    assert {k: got[k] for k in range(10, 17)} == {10: "leak_ans", 11: "leak_q", 12: "leak_near", 13: None, 14: "dup_ans", 15: None, 16: "dup_near"}
    assert set(got) == set(range(10, 18))


def test_pilot_checks(spark):
    log = spark.createDataFrame([(i, 3.0 - i / 10) for i in range(10)], "step int, loss double")
    out = spark.createDataFrame([("a b c d e f", True), ("g h i j k", True)], "text string, ok boolean")
    good = {r.check: r.passed for r in E.pilot_checks(log, out, "step", "loss", "text", "ok").collect()}
    assert good == dict.fromkeys(("trend", "no_explosion", "finite", "language", "no_repeats"), True)
    bad = {r.check: r.passed for r in E.pilot_checks(log.withColumn("loss", F.col("step") * 9.0 + 1), out.withColumn("text", F.lit("a b c d a b c d a b c d")), "step", "loss", "text", "ok").collect()}
    assert not bad["trend"] and not bad["no_explosion"] and not bad["no_repeats"]


def test_spelling_corrections(spark):
    counts = spark.createDataFrame([("demam", 50), ("deman", 1), ("demma", 2), ("telfon", 1), ("salma", 1), ("minuman", 1), ("minum", 40), ("obat", 100)], "word string, n long")
    caps = spark.createDataFrame([("demma", 1)], "word string, n long")
    valid = spark.createDataFrame([("demam",), ("minum",), ("obat",), ("telepon",), ("apotek",)], "word string")
    official = spark.createDataFrame([("apotik", "apotek"), ("obatt", "xxxx"), ("minuman", "minum")], "old string, new string")
    counts = counts.union(spark.createDataFrame([("apotik", 70), ("obatt", 1)], "word string, n long"))
    got = {r.old: r.new for r in Y.corrections(counts, caps, valid, official).collect()}
    assert got == {"deman": "demam", "telfon": "telepon", "apotik": "apotek"}  # xxxx, the listed one for obatt, is no word


def test_taxonomy(spark):
    """Keywords of titles by group, weighed by their words; the fallback group only where no other has any."""
    titles = spark.createDataFrame([("heart", "Acute heart failure [x] (y)"), ("heart", "Heart valve disorders"), ("skin", "Atopic eczema"), ("Gejala & Tanda Klinis", "Fever")], "g string, t string")
    kws = titles.select("g", F.explode(T.title_keywords("t", ("acute", "disorders"))).alias("k")).groupBy("g").agg(F.collect_set("k").alias("k"))
    groups = {r.g: tuple(r.k) for r in kws.collect()}
    assert set(groups["heart"]) == {"heart", "failure", "heart failure", "valve", "heart valve"} and set(groups["skin"]) == {"atopic", "eczema", "atopic eczema"}
    df = spark.createDataFrame([("heart failure and eczema",), ("atopic eczema of the Heart",), ("fever",), ("eczemas",), (None,), ("eczema heart",)], "c string")
    assert [r[0] for r in df.select(T.topic("c", {k: groups[k] for k in ("skin", "heart", "Gejala & Tanda Klinis")})).collect()] == ["heart", "skin", "Gejala & Tanda Klinis", "Lain-lain", "Lain-lain", "skin"]


def test_buckets_by_type_and_source(spark):
    rows = [("q\nA) x", "Yes", "open", "x", "open"), ("q\nA) x", "Yes", None, "x", "mcqa"), ("q", "Ya, bisa", None, "indonesia_qna", "open"), ("q", "z", None, "medmcqa", "mcqa"), ("q", "z", None, "pubmedqa", "yesno"), ("q", "tidak", None, None, "yesno"), ("q", "z", "x", None, "open")]
    df = spark.createDataFrame(rows, "question string, ref string, type string, source string, want string")
    assert all(r.b == r.want for r in df.select("want", T.bucket("question", "ref", F.col("type"), F.col("source")).alias("b")).collect())
    assert [r.bucket for r in E.scored(df.withColumn("pred", F.col("ref"))).collect()] == [r[4] for r in rows]


def test_quantisation_gap(spark):
    runs = spark.createDataFrame([("m_finetuned", "overall", "rougeL", 0.4), ("m_finetuned_q4", "overall", "rougeL", 0.37), ("n_q4", "overall", "rougeL", 0.1)], "label string, key string, metric string, value double")
    got = E.quantisation_gap(runs).collect()
    assert [(r.label, round(r.delta, 3)) for r in got] == [("m_finetuned_q4", -0.03)]


def test_any_message_may_ask_for_a_code(spark):
    df = spark.createDataFrame([([("user", "x"), ("assistant", "What is the ICD-11 code for x?")], "s"), ([("user", "x")], "icd11"), ([("user", "x")], "s")], "m array<struct<role: string, content: string>>, source string")
    assert [r[0] for r in df.select(G.any_code_lookup("m", F.col("source"), ("icd11",))).collect()] == [True, True, False]


def test_dictionary(spark):
    rows = [("telepon", "telepon telepon", "telfon"), ("apotek", None, "apotik"), ("satu dua", "x", "dua"), ("atas", "a", "bawah")]
    words, official = Y.dictionary(spark.createDataFrame(rows, "nama string, kata string, salah string"), ("nama", "kata"), "salah", "nama")
    assert {r.word for r in words.collect()} == {"telepon", "apotek", "satu", "dua", "atas"}
    assert {(r.old, r.new) for r in official.collect()} == {("telfon", "telepon"), ("apotik", "apotek")}


def test_stream_keeps_what_the_table_keeps(spark, tmp_path):
    from quern.streaming import gates as stream

    path = str(tmp_path / "in")
    spark.range(500).repartition(5).write.parquet(path)
    gate = [G.Gate("even", (("odd", F.col("id") % 2 == 1),))]
    out = stream.drained(stream.labelled(stream.read(spark, path, "id long"), gate))
    assert out.count() == 500 and out.where("failed is null").count() == 250


def test_plans_of_nothing(spark):
    from quern.plans import curation

    none = spark.createDataFrame([], "id long, q string, a string, source string")
    assert curation.basic(none).count() == 0


def test_passes_run_once_in_small_batches(spark):
    df = spark.createDataFrame([("a  b",), ("�",), (None,)], "t string").select(P.normalized(F.col("t")).alias("n")).where(~F.contains("n", F.lit("�"))).select("n", F.upper("n").alias("u"))
    assert [tuple(r) for r in df.collect()] == [("a b", "A B")]
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_words_are_worked_out_once(spark):
    df = spark.createDataFrame([("the man and the dog of Rome",), ("le chien",), ("",), (None,)], "t string")
    told = V.by_profile({"en": ("the", "of"), "fr": ("le", "la")}, "t", "t")(df)
    assert [tuple(r)[1:] for r in told.collect()] == [("en", 1.0), ("unknown", 1.0), ("unknown", 0.0), ("unknown", 0.0)]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert df.select(V.bag("t", 8).alias("b"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [sum(r[0]) for r in df.where("t is not null").select(V.bag("t", 8)).collect()] == [7, 2, 0]
