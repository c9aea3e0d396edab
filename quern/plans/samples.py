"""Made-up rows that make every branch of the rules fire, beside the tables at hand, which are of other languages.

Queries read them together with a whole table; their SQL has the same rows as VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers of made-up rows are this and below.
FIRST = -1000

#: (question, answer, source)
QUESTIONS: tuple[tuple[str, str, str], ...] = (
    ("Apakah demam tinggi pada anak saya berbahaya dan harus ke dokter?", "Halo Budi, demam tinggi pada anak perlu dipantau. Minum air putih yang cukup, kompres hangat, dan istirahat. Bila demam lebih dari tiga hari segera periksa ke dokter.", "alodokter"),
    ("What is the ICD-11 code for measles?", "The ICD-11 code for **measles** is **1F03**. It is classified under Chapter 01.", "icd11"),
    ("What condition does 1F03 represent", "Measles.", "hidr"),
    ("Obat apa untuk batuk berdahak yang aman", "dear pasien, obat batuk <b>aman</b> &amp; murah. Lihat https://contoh.id/obat lalu tulis ke @dokter {nama} ## | --- N/A [deleted]", "forum"),
    ("nama saya [nama] 😀 umur dua puluh", "<think> </think> Selamat pagi. Dr. Budi Santoso menjawab (WHO) demamTinggi :) [nama] ainul [[x]]", "forum"),
    ("Bapak Joko sakit kepala", "Rina! Minum obat. Baca juga artikel lain", "forum"),
    ("Bagaimana cara mengobati luka bakar ringan di rumah?", "Hello, Thank you for asking. Keep it clean.", "chat"),
    ("Is this normal for my age, doctor?", "Hii. Hope this message finds you well.", "chat"),
    ("Is it safe to take two tablets?", "Hi. Thank you for consulting in Chat Doctor.", "chat"),
    ("Is it safe to take three tablets?", "Hello Thank you for consulting us. " + "You can take it safely with food and water every morning. " * 4, "chat"),
    ("Kenapa jerawat saya tidak hilang juga, dok?", "kenapa belum dibalas ya, saya sudah menunggu dari kemarin dan masih belum ada jawaban sama sekali dari dokter di sini", "indonesia_qna"),
    ("Tolong bantu saya untuk masalah lambung ini", "maaf kalau saya bertanya lagi karena pertanyaan saya yang dulu belum ada yang menjawab padahal saya butuh jawabannya", "indonesia_qna"),
    ("Apa &lt;itu&gt; <i>maag</i>  dan   apa obatnya https://a.b/c ?", "Maag adalah <p>peradangan</p> pada lambung &amp; usus. Gejalanya: nyeri ulu hati, mual, muntah, dan lain-lain. Hindari makanan pedas, kopi, atau rokok setiap hari.", "indonesia_qna"),
    ("Pendek?", "Jawaban ini cukup panjang untuk lolos batas bawah seratus karakter karena kalimatnya memang dibuat panjang sekali.", "indonesia_qna"),
    ("Pertanyaan dan jawaban di sini sama persis dan cukup panjang supaya hanya aturan kesamaan yang membuangnya dari tabel.", "Pertanyaan dan jawaban di sini sama persis dan cukup panjang supaya hanya aturan kesamaan yang membuangnya dari tabel.", "indonesia_qna"),
    ("Mengapa tubuh saya terasa lemas sepanjang hari?", "Lemas. Semoga Bermanfaat", "forum"),
    ("Mengapa tubuh saya terasa berat sepanjang hari?", "Lemas bisa karena anemia. Rina Wati", "forum"),
    ("Mengapa tubuh saya terasa dingin sepanjang hari?", "  ", "forum"),
    ("Apa yang harus saya lakukan untuk keluhan ini?", "Silakan periksa ke dokter ya, supaya jelas apa yang terjadi dan apa yang perlu dilakukan selanjutnya, agar semuanya menjadi terang dan Anda tenang.", "forum"),
    ("Apa yang harus saya makan untuk keluhan ini?", "Sebaiknya konsultasi dahulu bila nyeri perut disertai demam dan diare, karena infeksi usus dapat membuat lemas, dan minum obat tanpa diagnosis bisa menutupi gejala penyakit.", "forum"),
    ("Adakah obat murah yang bisa saya beli sendiri?", "Ada promo besar untuk Anda semua hari ini, silakan hubungi kami lewat wa.me dan pesan obat apa saja yang Anda mau dengan harga yang sangat murah sekali.", "forum"),
    ("Mengapa dokter itu tidak menjawab pertanyaan saya?", "Dasar bajingan, dokter itu memang tidak pernah menjawab siapa pun di sini, jadi jangan berharap apa apa lagi dan cari saja dokter lain yang lebih baik.", "forum"),
    ("Apakah saya boleh minum obat ini bersama susu?", "Halo, pasien saya di puskesmas dengan keluhan demam dan batuk boleh minum obat ini, tidak dengan susu. Baca juga di www.contoh.id tentang jantung dan tekanan darah tinggi ya.", "alodokter"),
    ("Apakah hasil pemeriksaan saya ini normal, dok?", "Dari foto yang Anda kirim tampak ruam merah yang luas di lengan kiri, dan biasanya keadaan itu mereda sendiri dalam beberapa hari saja tanpa obat apa pun.", "forum"),
    ("Apakah anak saya perlu obat penurun panas, dok?", "Terima kasih, saya dr. Rina akan menjelaskan bahwa demam pada anak tidak selalu perlu obat, dan cukup minum banyak air serta istirahat di rumah saja.", "forum"),
    ("Apakah ibu saya boleh berolahraga setiap pagi?", "Budi yang baik, olahraga ringan setiap pagi baik untuk jantung dan tekanan darah, asalkan tidak berlebihan dan selalu didahului pemanasan selama sepuluh menit.", "forum"),
    ("Bagaimana maksud jawaban dokter yang kemarin itu?", "Maaf dok, maksud saya apakah obat itu diminum sebelum atau sesudah makan, karena di kemasannya tidak tertulis apa apa dan saya takut salah meminumnya.", "forum"),
    ("Kenapa tulisan di layar saya rusak � begini?", "Tulisan itu rusak karena berkasnya dibaca dengan cara yang salah, jadi mintalah berkas yang baru lalu bukalah lagi dengan program yang sesuai di komputer Anda.", "forum"),
    ("Langkah apa yang perlu saya ambil?", "Langkah yang perlu diambil, : istirahat cukup, minum air, atau kompres, dan lainnya. Perhatikan: satu, dua. Sebab: a. Tidak ada.", "forum"),
)

#: (old, new, n): corrections, for the flags of an audit
CORRECTIONS: tuple[tuple[str, str, int], ...] = (
    ("gastritis", "gastrik", 3), ("nefritis", "nefriti", 1), ("itis", "isi", 2), ("dbd", "dbt", 5), ("tidak", "tidka", 4), ("tanpak", "tanpa", 1), ("red", "rod", 7), ("ring", "wing", 2), ("small", "smell", 2), ("garus", "harus", 1),
    ("berkembang", "kembang", 1), ("xqzt", "xqza", 1), ("economy", "ecology", 9),
)

#: (text): answers with wrong corrections and words to correct at run time
ANSWERS: tuple[str, ...] = (
    "Silahkan minum obat, karna resiko kecil. Diagnosa dokter: Karna demam.", "APOTIK itu jauh. Apotik dekat", "aktifitas  harian", "ada Silahkan di tengah", "Nova karan\nKaran itu", "",
)


def frame(spark: SparkSession, rows: tuple, names: str) -> DataFrame:
    """(id, names) of made-up rows."""
    return spark.createDataFrame([(FIRST - i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"id long, {names}")


def values(rows: tuple, names: str) -> str:
    """The same as SQL."""
    said = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    told = ", ".join("(" + ", ".join(said(x) for x in (FIRST - i, *(r if isinstance(r, tuple) else (r,)))) + ")" for i, r in enumerate(rows))
    return f"(select * from (values {told}) as v(id, {', '.join(n.split()[0] for n in names.split(', '))}))"


NAMES = "q string, a string, source string"


def with_questions(pairs: DataFrame) -> DataFrame:
    """(id, q, a, source) of pairs of turns and of the made-up questions."""
    own = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "q", "a", F.lit("conversations").alias("source"))
    return own.unionByName(frame(pairs.sparkSession, QUESTIONS, NAMES))


#: The same as SQL, over the relation pairs.
WITH_QUESTIONS = f"qa as (select conv_id * 1000 + turn as id, q, a, 'conversations' as source from pairs union all select id, q, a, source from {values(QUESTIONS, NAMES)})"
