"""Cleaning, redaction, detectors and repairs on the strings they are for."""

import pytest
from pyspark.sql import functions as F

from quern.functions import ladders as L
from quern.functions import passes as P
from quern.functions import text as T


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "c string").select(*columns).first())


def told(spark, rule, value):
    out = spark.createDataFrame([(value,)], "c string").select(rule(F.col("c")).alias("v")).first().v
    return tuple(out) if hasattr(out, "asDict") else out


@pytest.mark.parametrize("name", ["Hippocrates membuat sumpah itu.", "Hidradenitis adalah penyakit kulit.", "Alopecia areata bisa diobati.", "Halothane dipakai sebagai obat bius."])
def test_medical_words_are_no_greetings(spark, name):
    assert told(spark, L.without_greeting, name) == name
    assert told(spark, L.without_opening, name) == name


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Halo, hai! kista adalah benjolan berisi cairan.", "Kista adalah benjolan berisi cairan."),
        ("@tina, Terima kasih telah bertanya. Obat ini diminum sesudah makan.", "Obat ini diminum sesudah makan."),
        ("Halo", "Halo"),
        ("", ""),
    ],
)
def test_greeting(spark, given, wanted):
    assert told(spark, L.without_greeting, given) == wanted


def test_opening_takes_name_and_boilerplate(spark):
    assert told(spark, L.without_opening, "Hai Sofy, I have read your query. Gejala ini biasanya ringan dan sembuh sendiri.") == "Gejala ini biasanya ringan dan sembuh sendiri."


def test_address(spark):
    assert told(spark, L.without_address, "Halo Budi demam bisa turun.") == "Demam bisa turun."
    assert told(spark, L.without_address, "Budi... demam bisa turun.") == told(spark, L.without_address, "Budi, demam bisa turun.") == "Demam bisa turun."
    assert told(spark, L.without_address, "Saya, dan kamu.") == "Saya, dan kamu."


def test_redaction(spark):
    assert told(spark, L.redacted, "nama saya Budi Santoso, telepon 081234567890, surel a.b@c.co.id") == ("nama saya [NAMA], telepon [NOMOR], surel [EMAIL]", 3)
    assert told(spark, L.redacted, "Saya Demam, dokter.") == ("Saya Demam, dokter.", 0)
    assert told(spark, L.redacted, "Nama Saya Ani. perkenalkan saya Rudi Hartono umur 3") == ("nama saya [NAMA]. perkenalkan saya [NAMA] umur 3", 2)


def test_normalize():
    assert P.normalize("a&amp;b <br> c​d  https://x.y/z é") == "a&b cd é"


def test_strict_clean(spark):
    text, glued = told(spark, L.strict_answer, "Halo dok, demamTinggi bisa turun (WHO). Minum air putih. baca juga artikel lain")
    assert glued == 1 and "WHO" not in text and "baca juga" not in text and text.startswith("Demam Tinggi")


def test_triples(spark):
    assert one(spark, "Sayaaa XIII vaaa!!", T.collapse_triples("c")) == ("Sayaa XIII vaa!!",)


def test_repairs(spark):
    assert told(spark, L.scrubbed, "Tanya dr. irna cecilia, bukan dr. spesialis") == ("Tanya dokter, bukan dr. spesialis", 2)
    assert told(spark, L.truncation_trimmed, "Obat ini aman untuk semua orang. Jangan minum dengan") == ("Obat ini aman untuk semua orang.", "kept")
    assert told(spark, L.truncation_trimmed, "Semoga bermanfaat") == ("Semoga bermanfaat", "noop")
    assert told(spark, L.truncation_trimmed, "dan") == ("dan", "drop")
    assert told(spark, L.tail_trimmed, "Minum obat ini. Informasi lebih lanjut baca di sini.") == ("Minum obat ini.", True)
    assert told(spark, L.tail_trimmed, "Minum obat ini.") == ("Minum obat ini.", False)
    assert P.restore_head("Halo Budi kista ovarium", "adalah benjolan.") == "kista ovarium adalah benjolan."
    assert P.lost_head("Budi, kista ini.", "kista ini.") == "Budi"


def test_conservative_clean(spark):
    """Every rule fires."""
    given = "Obat diatas aman,murah dll Jika perlu kedokter lagi. Sayaaa lainya. Untuk lebih jelas mengenai keluhan yang Anda alami silakan unduh aplikasi. S.Ked Radhianie Djan"
    fired = {r for t in (given, "Tubuh sehat Hindari rokok", "Minum air. Budi Santoso, S.Ked", "Obat ini baik. Radhianie Djan", "jamu, dll, obat") for r in told(spark, L.conservative, t)[1]}
    assert fired == set(L.RULES)
    assert told(spark, L.conservative, "Tubuh sehat Hindari rokok") == ("Tubuh sehat. Hindari rokok.", ["sentence_split", "add_period"])


def test_detectors(spark):
    assert one(spark, "adalah penyakit", T.over_strip("c"))[0] == "high"
    assert one(spark, "Dari mana?", T.over_strip("c"))[0] == "low"
    assert one(spark, "...", T.over_strip("c"))[0] is None
    assert one(spark, "Obat ini dan", T.truncated("c"))[0] is True
    assert one(spark, "Obat ini dan.", T.truncated("c"))[0] is False
    assert one(spark, "Tanya dr. Irna saja", T.doctor_leak("c"))[0] is True
    assert one(spark, "Ke dr. spesialis saja", T.doctor_leak("c"))[0] is False


def test_evaluation(spark):
    assert one(spark, "The correct answer is **B) x", T.option_letter("c")) == ("B",)
    assert one(spark, "Tidak, bukan.", T.yes_no("c")) == ("no",)
    assert P.rouge_l("a b c d", "a c d e") == 0.75
    df = spark.createDataFrame([("a b b", "b b c")], "p string, r string")
    assert abs(df.select(T.token_f1("p", "r")).first()[0] - 2 / 3) < 1e-12


@pytest.mark.parametrize(("a", "b", "near"), [("form", "from", True), ("form", "forms", True), ("form", "farm", True), ("form", "form", False), ("form", "frmo", False), ("ab", "abcd", False)])
def test_one_edit(a, b, near):
    assert P.one_edit(a, b) is near
    assert P.one_edit(b, a) is near
    assert not near or set(P.deletions(a)) & set(P.deletions(b))


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,), ("x",)], "c string")
    got = df.select(L.without_greeting(F.col("c")).alias("g"), L.redacted(F.col("c"))["text"].alias("r"), T.clean_basic("c").alias("b")).collect()
    assert [r.g for r in got] == [None, "x"] and [r.b for r in got] == [None, "x"] and got[1].r == "x"


def test_lead_names(spark):
    from quern.operators import vectors as V

    df = spark.createDataFrame([("Ainun Telinga berdenging sejak kemarin",), ("Vaksin Polio aman untuk bayi semua",)], "a string")
    people = lambda t: t.withColumn("e", F.when(F.col("name") == "Ainun", F.array(F.struct(F.lit("PER").alias("entity_group"), F.lit(0.6).alias("score"), F.col("name").alias("word")))).otherwise(F.array().cast("array<struct<entity_group:string,score:double,word:string>>")))
    names = [r.name for r in V.lead_names(df, "a", people, "e").collect()]
    assert names == ["Ainun"]
    got = [r[0] for r in df.select(L.lead_names_stripped(names)(F.col("a"))).collect()]
    assert got == ["Telinga berdenging sejak kemarin", "Vaksin Polio aman untuk bayi semua"]


def test_reverts_words_beside_marks_and_blanks():
    assert P.revert("CT urogram, kiri", "CT program, kiri", {"urogram>program": ""}) == "CT urogram, kiri"
    assert P.revert("a  Garus\tyang", "a  Harus\tyang", {"garus>harus": "garis"}) == "a  Garis\tyang"
    assert P.revert("x on y", "x om y z", {"on>om": ""}) == "x on y z"
    assert P.substitutions("a  b, c", "a  d, c") == [{"at": 1, "old": "b", "new": "d"}]


@pytest.mark.parametrize(("whole", "part", "at"), [([1, 2, 1, 2, 3], [1, 2, 3], 2), ([1, 1, 1, 2], [1, 1, 2], 1), ([1, 2], [3], -1), ([], [1], -1), ([5], [], 0), ([4, 4], [4, 4], 0)])
def test_part_of_a_sequence(whole, part, at):
    assert P.find_part(whole, part) == at


def test_part_of_a_sequence_as_a_column(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3]), (None, [1])], "w array<int>, p array<int>")
    assert [r[0] for r in df.select(P.part_at(F.col("w"), F.col("p"))).collect()] == [1, None]


def test_sentences_and_bullets(spark):
    assert one(spark, "Satu. Dua kata ini! Tiga", T.sentence_of("c", "kata")) == ("Dua kata ini!",)
    got = one(spark, "langkah, : a b, atau c, dan lainnya.  Perhatikan: satu, dua. Sebab: a, dan lain-lain, c", T.enumerations("c"))[0]
    assert got == "**Langkah:**\n- a b\n- c\n\nPerhatikan: satu, dua.\n\n**Sebab:**\n- a\n- c"


def test_medical_words(spark):
    df = spark.createDataFrame([("Gastritis",), ("itis",), ("oitis",), ("dermatitis",), ("vertigo",), ("rumah",), ("grafi",)], "c string")
    assert [r[0] for r in df.select(T.looks_medical("c")).collect()] == [True, False, False, True, True, False, False]


def test_checks_before_rules_change_nothing(spark, small_dir, monkeypatch):
    """Ladders with and without the checks that spare rules texts they can't match."""
    ends = ["Terima kasih. Dian Paramitasari", "ok. dr. Budi, BMed.", "Siti, S.Ked\n", "Sp." + "A." * 90, "x Sp." + "A" * 70, "MARS  ", "Drg.", "Sc", "FINASIM."]
    middles = ["Baca juga artikel ini. Ya.", "Unduh  aplikasi\tini!  Live \n chat.", "dr. Budi dan drg Ulfi, dokter dokter WILLIAM", "aaab XIII lainya Lainya, dll makan dsb. dst", "Silakan klik tautan", "Lebih  rincinya pada", "A.\nB! \t C"]
    heads = ["@budi, Hello there, ", "hellothanks for it. ", "Hai hai Dear Ann, selamat pagi semua. ", "terima kasih atas itu. ", "salam"]
    texts = [h + m + " " + e for h in ["", *heads] for m in ["", *middles] for e in ["", *ends]]
    docs = [r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *docs, None])], "id int, t string").repartition(4).cache()

    def run():
        c = F.col("t")
        return {r.id: tuple(r) for r in df.select("id", L.conservative(c), L.scrubbed(c), L.tail_trimmed(c), L.without_greeting(c), L.without_opening(c), L.without_address(c)).collect()}

    checked = run()
    always, signed = lambda t, words: F.lit(True), L._signed
    steps = {"sig_name": signed(L._NAMES, 0, lambda t: F.lit(True)), "sig_cred": signed(L.R.CREDENTIALS, 1, lambda t: F.lit(True)), "triple": lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda w: F.when(w.rlike("(?i)^[ivxlcdm]+$"), w).otherwise(F.regexp_replace(w, r"([A-Za-z])\1{2,}", "$1$1"))), "")}
    monkeypatch.setattr(L, "has_any", always)
    monkeypatch.setattr(L, "_GREETED", "")
    monkeypatch.setattr(L, "CONSERVATIVE", tuple((n, steps.get(n, f)) for n, f in L.CONSERVATIVE))
    monkeypatch.setattr(L, "rounds", lambda c, most, step: F.aggregate(F.sequence(F.lit(1), F.lit(most)), c, lambda t, _: step(t)))
    plain = run()
    assert [(k, df.where(F.col("id") == k).first().t, checked[k], plain[k]) for k in plain if plain[k] != checked[k]][:2] == []
