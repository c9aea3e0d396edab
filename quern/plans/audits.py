"""Queries that audit: detector rates, alignment with an earlier version, verdicts; and spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import passes as P
from quern.functions import text as T
from quern.operators import audit as A
from quern.operators import leaks as L
from quern.operators import typo as Y
from quern.operators.profile import flag_counts
from quern.operators.selection import shuffle_key
from quern.plans import samples
from quern.plans.tables import PAIRS, SPLIT, documents, pairs, split_documents, table

DANGLING = ("the", "and", "of", "in", "to", "la", "de", "und", "le", "hand", "as", "er")
_LAST = rf"lower(regexp_extract(regexp_replace({{0}}, '\s+$', ''), '{R.LAST_WORD.replace(chr(39), chr(39) * 2)}', 1))"
_TERMINAL = R.TERMINAL.replace("'", "''")


def detectors(spark, d):
    """Detectors on whole documents and made-up answers."""
    rows = documents(spark, d).select("doc_id", "text").union(samples.frame(spark, samples.QUESTIONS, samples.NAMES).select("id", "a"))
    c = "text"
    return rows.select(
        "doc_id", T.over_strip(c).alias("over_strip"), F.array_join(T.over_strip_reasons(c), ",").alias("reasons"), T.citation_tail(c).alias("citation_tail"), T.truncated(c).alias("truncated"), T.truncated(c, DANGLING).alias("dangling"),
        T.doctor_leak(c).alias("doctor"), F.md5(T.question_signature(c)).alias("signature"), T.last_word(c).alias("last_word"), T.looks_medical(F.regexp_extract(c, "^([A-Za-z]+)", 1)).alias("medical"),
    )


_LEAD = R.LEAD_MARKS.replace("'", "''")
_SIG = "regexp_replace(lower({0}), '[^0-9a-z]+', '', 'g')"
_FIRST_WORD = "lower(regexp_extract(text, '^([A-Za-z]+)', 1))"
_CUT = "case when r = '' or regexp_matches(r, '{terminal}') or last in {closing} then false else last in {words} or last = '' end"
DETECTORS = rf"""with d as (select doc_id, text from documents union all select id, a from {samples.values(samples.QUESTIONS, samples.NAMES)}),
t as (select *, regexp_replace(text, '{_LEAD}', '') as t, regexp_replace(text, '\s+$', '') as r, {_SIG.format("text")} as n from d),
f as (select *, lower(regexp_extract(t, '^([A-Za-z]+)', 1)) as first, {_LAST.format("text")} as last, regexp_matches(t, '{R.PREPOSITION_COPULA}') as copula, regexp_matches(t, '^\p{{Ll}}') as low from t)
select doc_id, case when t = '' then null when first in {R.CONNECTORS_HIGH} or copula then 'high' when first in {R.CONNECTORS_LOW} or low then 'low' end as over_strip,
concat_ws(',', case when first in {R.CONNECTORS_HIGH} then 'lead_connector_high:' || first end, case when first in {R.CONNECTORS_LOW} then 'lead_connector_low:' || first end, case when copula then 'prep_copula_lead' end, case when low then 'lowercase_start' end) as reasons,
regexp_matches(right(r, 90), '{R.BARE_TAIL}') or regexp_matches(right(r, 90), '{R.DANGLING_TAIL}') or regexp_matches(right(r, 90), '{R.INFORMATION_TAIL}') as citation_tail,
{_CUT.format(terminal=_TERMINAL, closing=tuple(R.SIGN_OFF_WORDS), words=tuple(R.DANGLING_WORDS))} as truncated, {_CUT.format(terminal=_TERMINAL, closing=tuple(R.SIGN_OFF_WORDS), words=DANGLING)} as dangling,
regexp_matches(text, '(?i)\b(dr\.?|drg\.?|dokter)\s+({"|".join(R.KNOWN_DOCTORS)})\b') or len(list_filter(regexp_extract_all(text, '{R.DOCTOR_ABBREVIATED}', 2), lambda x: lower(x) not in {tuple(R.DOCTOR_STOP)})) > 0 as doctor,
md5(case when length(n) < 40 then n else right(n, 80) end) as signature, lower(regexp_extract(text, '{R.LAST_WORD.replace(chr(39), chr(39) * 2)}', 1)) as last_word,
{_FIRST_WORD} in {R.MEDICAL_HINTS} or regexp_matches({_FIRST_WORD}, '^.{{2,}}({"|".join(R.MEDICAL_SUFFIXES)})$') as medical from f"""


def _detectors():
    return {"citation_tail": T.citation_tail, "truncation": T.truncated, "over_strip": lambda c: T.over_strip(c).isNotNull(), "doctor": T.doctor_leak}


def detector_rates(spark, d):
    """What the detectors find in questions and answers of pairs of turns and of made-up rows, by split."""
    rows = samples.with_questions(pairs(spark, d))
    digit = F.conv(F.substring(shuffle_key("id"), 1, 2), 16, 10).cast("int")
    split = F.when(digit < 205, "train").when(digit < 230, "val").otherwise("test")
    return A.rates(rows.withColumn("split", split), ("q", "a"), _detectors(), "split")


RATES = rf"""with {PAIRS}, {samples.WITH_QUESTIONS}, h as (select *, unhex(substr(md5(id::varchar || '|42'), 1, 2)) as h from qa), s as (select *, case when h < '\xCD' then 'train' when h < '\xE6' then 'val' else 'test' end as split from h),
d as (select split, 'q' as field, q as text from s union all select split, 'a', a from s),
t as (select *, regexp_replace(text, '{_LEAD}', '') as t, regexp_replace(text, '\s+$', '') as r from d),
f as (select *, lower(regexp_extract(t, '^([A-Za-z]+)', 1)) as first, {_LAST.format("text")} as last, regexp_matches(t, '{R.PREPOSITION_COPULA}') as copula, regexp_matches(t, '^\p{{Ll}}') as low from t),
g as (select split, field, count(*) as total, count(*) filter (where regexp_matches(right(r, 90), '{R.BARE_TAIL}') or regexp_matches(right(r, 90), '{R.DANGLING_TAIL}') or regexp_matches(right(r, 90), '{R.INFORMATION_TAIL}')) as citation_tail,
  count(*) filter (where {_CUT.format(terminal=_TERMINAL, closing=tuple(R.SIGN_OFF_WORDS), words=tuple(R.DANGLING_WORDS))}) as truncation,
  count(*) filter (where t <> '' and (first in {R.CONNECTORS_HIGH} or copula or first in {R.CONNECTORS_LOW} or low)) as over_strip,
  count(*) filter (where regexp_matches(text, '(?i)\b(dr\.?|drg\.?|dokter)\s+({"|".join(R.KNOWN_DOCTORS)})\b') or len(list_filter(regexp_extract_all(text, '{R.DOCTOR_ABBREVIATED}', 2), lambda x: lower(x) not in {tuple(R.DOCTOR_STOP)})) > 0) as doctor from f group by all),
l as (unpivot g on citation_tail, truncation, over_strip, doctor into name category value n)
select category, split, field, n, total, n::double / total as rate from l union all select category, 'ALL', 'ALL', sum(n)::bigint, sum(total)::bigint, sum(n)::double / sum(total) from l group by category"""


def aligned_heads(spark, d):
    """Answers without their first sentence, beside the whole ones found by the question."""
    p = pairs(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    later = p.withColumn("a", F.regexp_replace("a", r"^[^.!?]*[.!?]\s*", ""))
    return A.aligned(later, p, "q", "a", "id").select("id", F.md5("original").alias("original"), F.md5(T.alnum("head")).alias("head"), "head_class")


def restored_heads(spark, d):
    p = pairs(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    later = p.withColumn("a", F.regexp_replace("a", r"^[^.!?]*[.!?]\s*", ""))
    return A.restored(A.aligned(later, p.withColumn("a", F.concat(F.lit("demam tinggi "), "a")), "q", "a", "id"), "id")


ALIGNED = rf"""with {PAIRS}, n as (select conv_id * 1000 + turn as id, a, {_SIG.format("q")} as nq, regexp_replace(a, '^[^.!?]*[.!?]\s*', '') as f from pairs), s as (select *, case when length(nq) < 40 then nq else right(nq, 80) end as sig from n),
j as (select x.id, x.f, y.a as o, {_SIG.format("x.f")} as nf, {_SIG.format("y.a")} as no from s x left join s y on x.sig = y.sig)
select id, md5(o) as original, case when nf <> '' and nf <> no and ends_with(no, nf) then md5(left(no, length(no) - length(nf))) end as head from j"""


_TOKENS = "regexp_extract_all(head, '[A-Za-z]+')"
_LOW = f"list_transform({_TOKENS}, lambda x: lower(x))"
HEADS = rf"""with {PAIRS}, n as (select conv_id * 1000 + turn as id, a, {_SIG.format("q")} as nq, regexp_replace(a, '^[^.!?]*[.!?]\s*', '') as f from pairs), s as (select *, case when length(nq) < 40 then nq else right(nq, 80) end as sig from n),
j as (select x.id, x.f, y.a as o, {_SIG.format("x.f")} as nf, {_SIG.format("y.a")} as no from s x left join s y on x.sig = y.sig),
h as (select *, case when nf <> '' and nf <> no and ends_with(no, nf) then regexp_extract(o, '^([^.!?]*[.!?])', 1) end as head from j)
select id, md5(o) as original, md5({_SIG.format("head")}) as head, case when head is null then null when len({_TOKENS}) = 0 or regexp_matches(head, '{R.FORUM_HEAD}') then 'forum' when len(list_intersect({_LOW}, {list(R.HEAD_GREETINGS)})) > 0 then 'greeting'
  when len(list_filter({_TOKENS}, lambda x: regexp_matches(x, '^[A-Z]'))) >= greatest(1, len({_TOKENS}) - 1) and len(list_intersect({_LOW}, {list(R.HEAD_TERMS)})) = 0 then 'name' else 'content' end as head_class from h"""


def aligned_counts(spark, d):
    return aligned_heads(spark, d).drop("head_class")


def residual_artefacts(spark, d):
    """The checks of a finished set, over pairs of turns and made-up rows."""
    return flag_counts(samples.with_questions(pairs(spark, d)), A.residual_flags("q", "a"), ("source",))


def _either(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"regexp_matches(q, '{p}') or regexp_matches(a, '{p}')"


_NAME_AT_END = r"[.!?]\s+([A-Z][a-z]+)(\s+[A-Z][a-z]+)?\s*$"
_RESIDUAL = {
    "B1_drName_trail": rf"regexp_matches(a, '{R.DOCTOR_TRAIL}')",
    "B1_greeting_lead": r"regexp_matches(a, '(?i)^\s*(hai|halo|alo|hallo|hello|hi|hey|selamat\s+(pagi|siang|sore|malam))\b')",
    "B3_article_tail": rf"regexp_matches(a, '{R.ARTICLE_TAIL}')",
    "B1_drName": _either(R.DOCTOR_INSIDE), "B1_titled_name": _either(R.TITLED), "B1_lead_bang": _either(R.LEAD_BANG), "B1_leaked_name": _either(r"(?i)\b(ainul)\b"), "B2_placeholder": _either(R.PLACEHOLDER_ANY),
    "B4_citation": _either(R.CITATION), "B5_emoji": _either(R.EMOJI), "B5_emoticon": _either(r"(^|[^\w])(:-?\)|:-?\(|:-?D|;-?\)|=\)|:'\(|:\||:[pP]|<3|:3|\^\^)($|[^\w])"),
    "B1_trail_name": f"regexp_extract(a, '{_NAME_AT_END}', 1) <> '' and lower(regexp_extract(a, '{_NAME_AT_END}', 1)) not in {R.TRAIL_NAME_STOP}",
    "B6_glued": "regexp_matches(q, '[a-z][A-Z]') or regexp_matches(a, '[a-z][A-Z]')",
}


def _flagged(flags: dict[str, str], head: str) -> str:
    cols = ", ".join(f'count(*) filter (where {c}) as "{n}"' for n, c in flags.items())
    names = ", ".join(f'"{n}"' for n in flags)
    return f"with {PAIRS}, {samples.WITH_QUESTIONS}{head}, f as (select source, count(*) as rows, {cols} from qa group by source) unpivot f on {names} into name flag value n"


RESIDUAL = _flagged(_RESIDUAL, "")


def validation(spark, d):
    """Expected counts, fields and leaks of splits, as checks."""
    s = split_documents(spark, d).select("split", "text", F.md5(T.alnum("text")).alias("sig"))
    one = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("text").rlike(r"\S")).alias("blank"), F.countDistinct("split").alias("splits"))
    shared = L.common_keys(s, "sig", "split").agg(F.sum("common").alias("common"))
    row = one.join(F.broadcast(shared), F.lit(True))
    return row.select(F.expr("stack(4, 'rows', n > 0, 'fields', blank = 0, 'splits', splits = 3, 'leaks', coalesce(common, 0) = 0) as (check, passed)"))


def final_verdict(spark, d):
    """The verdict on the splits of pairs of turns and of made-up rows: leaks, duplicates, openings that are left."""
    rows = samples.with_questions(pairs(spark, d))
    digit = F.conv(F.substring(shuffle_key("id"), 1, 2), 16, 10).cast("int")
    return A.verdict(A.final_checks(rows.withColumn("split", F.when(digit < 205, "train").when(digit < 230, "val").otherwise("test")), "split"))


def validation_verdict(spark, d):
    return A.verdict(validation(spark, d))


VALIDATION = rf"""with {SPLIT}, s as (select split, text, md5({_SIG.format("text")}) as sig from split), c as (select count(*) as common from (select sig from s group by sig having count(distinct split) > 1)),
k as (select count(*) > 0 as rows, count(*) filter (where not regexp_matches(text, '\S')) = 0 as fields, count(distinct split) = 3 as splits from s), u as (select rows, fields, splits, (select common = 0 from c) as leaks from k)"""
CHECKS = f"""{VALIDATION} unpivot u on rows, fields, splits, leaks into name "check" value passed"""
VERDICT = f"""{VALIDATION}, l as (unpivot u on rows, fields, splits, leaks into name c value passed) select case when bool_and(passed) then 'PASS' else 'FAIL' end as verdict, coalesce(string_agg(c, ',' order by c) filter (where not passed), '') as failed from l"""


# ------------------------------------------------------------------ spelling: part names are the dictionary


def _dictionary(spark, d):
    entries = table(spark, d, "part").select("p_name", F.lower("p_type").alias("kind"), F.lit("wrong").alias("bad"))
    return Y.dictionary(entries, ("p_name", "kind"), "bad", "bad")[0]


def word_frequency(spark, d):
    return Y.word_counts(documents(spark, d), "text").where("n >= 3")


FREQUENCY = "with w as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) select word, count(*) as n from w group by word having count(*) >= 3"


def inner_capitals(spark, d):
    return Y.inner_capitals(documents(spark, d), "text")


CAPITALS = r"""with m as (select regexp_replace(text, '([a-z,])\s([A-Z])', '\1' || chr(1) || '\2', 'g') as t from documents), n as (select regexp_replace(t, '([a-z,])\s([A-Z])', '\1' || chr(1) || '\2', 'g') as t from m),
w as (select unnest(regexp_extract_all(t, chr(1) || '([A-Z][a-z]+)', 1)) as w from n) select lower(w) as word, count(*) as n from w group by 1"""


def dictionary_words(spark, d):
    return _dictionary(spark, d)


DICTIONARY = "with w as (select unnest(regexp_extract_all(lower(p_name), '[a-z]+')) as word from part union all select unnest(regexp_extract_all(lower(p_type), '[a-z]+')) from part) select distinct word from w where length(word) >= 2"


def known_stems(spark, d):
    words = Y.word_counts(documents(spark, d), "text").select("word")
    return Y.with_valid_stem(words, words.where("length(word) = 4"))


STEMS = (
    "with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents), v as (select word from w where length(word) = 4), p as (select unnest("
    + str(["", *R.PREFIXES])
    + ") as p), s as (select unnest("
    + str(["", *R.SUFFIXES])
    + """) as s),
c as (select w.word, substr(word, length(p) + 1, length(word) - length(p) - length(s)) as stem from w, p, s where starts_with(word, p) and ends_with(substr(word, length(p) + 1), s) and length(word) - length(p) - length(s) >= case when p = '' and s = '' then 1 else 3 end)
select distinct c.word from c join v on c.stem = v.word"""
)


def edit_neighbours(spark, d):
    """Rare words one edit from frequent ones."""
    n = Y.word_counts(documents(spark, d), "text")
    low, high = R.WORD_CHARS
    return Y.edit_candidates(n.where(f"n <= {R.RARE_COUNT} and length(word) between {low} and {high}"), n.where(f"n >= {R.TARGET_COUNT} and length(word) >= {low}"))


EDITS = f"""with c as (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by word),
k as (select word, n, unnest(list_distinct(list_append([substr(word, 1, i - 1) || substr(word, i + 1) for i in range(1, length(word) + 1)], word))) as key from c where length(word) >= 4),
p as (select distinct a.word, b.word as target from k a join k b using (key) where a.n <= {R.RARE_COUNT} and length(a.word) <= 18 and b.n >= {R.TARGET_COUNT}) select word, target from p where damerau_levenshtein(word, target) = 1"""


def correction_flags(spark, d):
    """Made-up corrections judged by words of the corpus, with part names for the dictionary and regions for names: flags in order, and the order to look at them."""
    counts = Y.word_counts(documents(spark, d), "text")
    subs = samples.frame(spark, samples.CORRECTIONS, "old string, new string, n int").drop("id")
    names = table(spark, d, "part").select(F.lower(F.regexp_extract("p_name", "^([a-z]+)", 1)).alias("word")).where("word = 'small'").distinct()
    told = Y.with_knowledge(subs, counts, _dictionary(spark, d), names).withColumn("flags", Y.risk_flags())
    return told.where(F.size("flags") > 0).select("old", "new", "n", F.array_join("flags", ",").alias("flags"), Y.priority("flags").cast("long").alias("place"))


_KNOWN = "(select distinct unnest(regexp_extract_all(lower(p_name), '[a-z]+')) as word from part union select distinct unnest(regexp_extract_all(lower(p_type), '[a-z]+')) from part)"
_HINTED = f"(old in {R.MEDICAL_HINTS} or regexp_matches(old, '^.{{2,}}({'|'.join(R.MEDICAL_SUFFIXES)})$'))"
CORRECTION_FLAGS = f"""with s as (select old, new, n from {samples.values(samples.CORRECTIONS, "old string, new string, n int")}), v as (select word from {_KNOWN} where length(word) >= 2),
p as (select unnest({["", *R.PREFIXES]}) as p), x as (select unnest({["", *R.SUFFIXES]}) as x),
stems as (select distinct old from s, p, x where starts_with(old, p) and ends_with(substr(old, length(p) + 1), x) and (p || x = '' or length(old) - length(p) - length(x) >= 3) and substr(old, length(p) + 1, length(old) - length(p) - length(x)) in (select word from v)
  and (p = '' or length(old) - length(p) >= 3)),
seen as (select word, count(*) as c from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by word),
j as (select s.*, coalesce(c, 0) as c, levenshtein(old, new) as e from s left join seen on old = word),
f as (select old, new, n, {_HINTED} as medis, old in (select old from stems) as valid, old in {R.ACRONYMS} as akronim, old in {R.CRITICAL_WORDS} or new in {R.CRITICAL_WORDS} as kritis, old = 'small' and exists (select 1 from part where p_name like 'small%') as nama,
  e >= 3 or substr(old, 1, 1) <> substr(new, 1, 1) or abs(length(old) - length(new)) >= 2 as jauh, e, new not in (select word from v where length(word) >= 2) as baku, c from j)
select old, new, n, concat_ws(',', case when medis then 'MEDIS' end, case when valid then 'BUKAN_TYPO' end, case when akronim then 'AKRONIM' end, case when kritis then 'KRITIS' end, case when nama then 'NAMA?' end, case when jauh then 'JAUH(d=' || e || ')' end, case when baku then 'TARGET_TDK_BAKU' end,
  case when c >= 8 then 'SERING(' || c || ')' end) as flags, (case when medis then 0 when valid then 1 when kritis or akronim then 2 when nama then 3 when baku then 4 else 9 end)::bigint as place
from f where medis or valid or akronim or kritis or nama or jauh or baku or c >= 8"""


REVERTED = r"""with p as (select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') as p from documents),
w as (select doc_id, text, array_to_string(list_transform(p, lambda x, i: case when lower(x) not in ('thing', 'that') or regexp_matches(x, '^[A-Z]+$')
  or (regexp_matches(x, '^[A-Z]') and i > 1 and case when rtrim(p[i - 1], ' ') = '' then i > 2 else not regexp_matches(p[i - 1], '[.!?\n] *$') end) then x
  else case when regexp_matches(x, '^[A-Z]') then 'Thi' else 'thi' end || case lower(x) when 'thing' then 'nk' else 's' end end), '') as c from p)
select doc_id, md5(lower(text)) as back, md5(c) as corrected from w"""


def runtime_corrected(spark, d):
    """Made-up answers and whole documents, corrected as at run time by the curated list and a made-up official one."""
    texts = documents(spark, d).select(F.col("doc_id").alias("id"), "text").union(samples.frame(spark, samples.ANSWERS, "text string"))
    words = texts.select(F.explode(T.words("text")).alias("word")).distinct()
    official = spark.createDataFrame([("dekat", "dekad"), ("jauh", "jauhh"), ("itu", "ituu"), ("minum", "minumm")], "old string, new string")
    valid = spark.createDataFrame([("minum",), ("dokter",)], "word string")
    fixes = {r.old: r.new for r in Y.runtime_corrections(words, valid, official).collect()}  # at most the curated and the official list
    return texts.select("id", Y.corrected("text", fixes).alias("c")).select("id", F.md5("c.text").alias("text"), F.col("c.n").cast("long").alias("n"))


def spelling_corrections(spark, d):
    """What would be corrected if frequent words of the corpus were the dictionary."""
    n = Y.word_counts(documents(spark, d), "text")
    valid = n.where("n >= 100").select("word")
    none = spark.createDataFrame([], "old string, new string")
    return Y.corrections(n, Y.inner_capitals(documents(spark, d), "text"), valid, none)


def spelling_changes(spark, d):
    """Replaced words after two of them were corrected, with how often and the first document."""
    docs = documents(spark, d).select("doc_id", "text")
    fixed = Y.apply(docs, "text", {"the": "tge", "on": "om"}).withColumnRenamed("text", "after")
    return Y.changes(docs.join(fixed, "doc_id"), "doc_id", "text", "after")


CHANGES = """with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents), s as (select doc_id, lower(w) as old, case lower(w) when 'the' then 'tge' else 'om' end as new from w where lower(w) in ('the', 'on'))
select old, new, count(*) as n, min(doc_id) as example from s group by all"""


def spelling_reverted(spark, d):
    """Documents with two words wrongly corrected, put back; md5 of what comes out, and whether it is the text."""
    docs = documents(spark, d).select("doc_id", "text")
    fixed = Y.apply(docs, "text", {"the": "tge", "on": "om"})
    both = docs.join(fixed.withColumnRenamed("text", "after"), "doc_id")
    back = P.reverted({"the>tge": "", "on>om": ""})
    return both.select("doc_id", F.md5(F.lower(back(F.col("text"), F.col("after")))).alias("back"), F.md5(Y.corrected("text", {"thing": "think", "that": "this"})["text"]).alias("corrected"))


QUERIES = {
    "detectors": (detectors, DETECTORS), "detector_rates": (detector_rates, RATES), "aligned_counts": (aligned_counts, ALIGNED), "aligned_heads": (aligned_heads, HEADS), "restored_heads": (restored_heads, None),
    "residual_artefacts": (residual_artefacts, RESIDUAL), "validation": (validation, CHECKS), "validation_verdict": (validation_verdict, VERDICT), "final_verdict": (final_verdict, None), "word_frequency": (word_frequency, FREQUENCY), "inner_capitals": (inner_capitals, CAPITALS),
    "dictionary_words": (dictionary_words, DICTIONARY), "known_stems": (known_stems, STEMS), "edit_neighbours": (edit_neighbours, EDITS), "spelling_corrections": (spelling_corrections, None), "spelling_changes": (spelling_changes, CHANGES), "correction_flags": (correction_flags, CORRECTION_FLAGS), "runtime_corrected": (runtime_corrected, None),
    "spelling_reverted": (spelling_reverted, REVERTED),
}
