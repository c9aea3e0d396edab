"""Queries that describe tables: distributions, percentiles, crosstabs, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import audit as A
from quern.operators import profile as P
from quern.operators.vectors import by_profile
from quern.plans import samples
from quern.plans.tables import PAIRS, SPLIT, documents, pairs, split_documents, table

LIMITS = (512, 1024, 1536, 2048)


def source_distribution(spark, d):
    return P.shares(documents(spark, d), "source")


SOURCES = "select source, count(*) as n, 100.0::double * count(*) / sum(count(*)) over () as percent from documents group by source"


def lang_by_source(spark, d):
    return P.rolled_up(split_documents(spark, d), "split", "lang")


LANGS = f"with {SPLIT} select split, lang, count(*) as n, grouping(split)::int as all_split, grouping(lang)::int as all_lang from split group by rollup(split, lang)"


def domain_by_split(spark, d):
    domains = {"northern": ("der", "und"), "southern": ("la ", "de "), "western": ("the", "ing")}
    return split_documents(spark, d).withColumn("domain", T.domain("text", domains, "none")).groupBy("split", "domain").agg(F.count(F.lit(1)).alias("n"))


_KW = "(contains(lower(text), '{}')::int + contains(lower(text), '{}')::int)"
DOMAINS = f"""with {SPLIT}, h as (select split, {_KW.format("der", "und")} as a, {_KW.format("la ", "de ")} as b, {_KW.format("the", "ing")} as c from split)
select split, case when greatest(a, b, c) = 0 then 'none' when a = greatest(a, b, c) then 'northern' when b = greatest(a, b, c) then 'southern' else 'western' end as domain, count(*) as n from h group by all"""


def length_stats(spark, d):
    return P.length_stats(documents(spark, d).select("lang", F.length("text").cast("long").alias("chars")), "chars", ("lang",))


STATS = "select lang, count(*) as n, min(length(text)) as least, list_sort(list(length(text)))[1 + count(*) // 2] as median, max(length(text)) as most from documents group by lang"


def floor_percentiles(spark, d):
    return P.floor_percentiles(documents(spark, d).select("lang", T.word_count("text").cast("long").alias("words")), "words", (0.05, 0.5, 0.95, 0.99), ("lang",))


_W = r"len(regexp_extract_all(text, '\S+'))"
FLOORS = f"""with w as (select lang, list_sort(list({_W})) as v, count(*) as n from documents group by lang)
select lang, n, v[1 + floor(0.05 * (n - 1))::int] as p5, v[1 + floor(0.5 * (n - 1))::int] as p50, v[1 + floor(0.95 * (n - 1))::int] as p95, v[1 + floor(0.99 * (n - 1))::int] as p99 from w"""


def linear_percentiles(spark, d):
    p = P.linear_percentiles(documents(spark, d).select("lang", F.length("text").alias("chars")), "chars", (0.05, 0.25, 0.5, 0.75, 0.95), ("lang",))
    return p.select("lang", *[F.round(c, 6).alias(c) for c in p.columns[1:]])


LINEAR = "select lang, " + ", ".join(f"round(quantile_cont(length(text)::double, {p / 100}), 6) as p{p}" for p in (5, 25, 50, 75, 95)) + " from documents group by lang"


def truncation_counts(spark, d):
    return P.above(documents(spark, d).select(F.floor(T.word_count("text") * 1.3).alias("tokens")), "tokens", LIMITS)


_TOKENS = f"floor({_W} * 1.3)"
ABOVE = "select " + ", ".join(f"count(*) filter (where {_TOKENS} > {x}) as above_{x}" for x in LIMITS) + " from documents"


def recommended_length(spark, d):
    t = documents(spark, d).select("lang", F.floor(T.word_count("text") * 1.3).alias("tokens"))
    return P.recommended(t, "tokens", (512, 1024, 2048, 4096, 8192), ("lang",)).select("largest", F.col("limit").cast("long").alias("limit"), F.col("rounded").cast("long").alias("rounded"))


RECOMMENDED = f"""with p as (select quantile_cont({_TOKENS}::double, 0.99) as p from documents group by lang), m as (select max(p) as largest from p)
select largest, (select min(x) from (values (512), (1024), (2048), (4096), (8192)) v(x) where x >= largest)::bigint as "limit", (ceil(largest / 128) * 128)::bigint as rounded from m"""


def category_crosstab(spark, d):
    return P.crosstab(split_documents(spark, d), "lang", "split", ["train", "val", "test"])


_SHARE = "100.0::double * count(*) filter (where split = '{0}') / sum(count(*) filter (where split = '{0}')) over () as percent_{0}"
CROSSTAB = f"""with {SPLIT}, s as (select lang, {", ".join(_SHARE.format(x) for x in ("train", "val", "test"))} from split group by lang), g as (select *, greatest(percent_train, percent_val, percent_test) - least(percent_train, percent_val, percent_test) as deviation from s)
select *, deviation > 2.0 as uneven from g"""


def language_share(spark, d):
    docs = documents(spark, d)
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)).alias("english"), F.countDistinct("lang").alias("langs"))


SHARE = "select source, count(*) as n, avg(case when lang = 'en' then 1.0::double else 0.0 end) as english, count(distinct lang) as langs from documents group by source"


def clipped_lengths(spark, d):
    return P.clipped(documents(spark, d).select("source", F.length("text").alias("chars")), "chars", "source").select("source", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


CLIPPED = "with c as (select quantile_cont(length(text)::double, 0.95) as cut from documents) select source, round(avg(least(length(text)::double, cut)), 6) as mean, round(max(least(length(text)::double, cut)), 6) as most from documents cross join c group by source"


def noise_scan(spark, d):
    """What looks like noise in the answers of pairs of turns and of made-up rows."""
    return P.flag_counts(samples.with_questions(pairs(spark, d)), A.suspicious_flags("a"), ("source",))


_SUSPICIOUS = {
    "terlalu_pendek": r"length(regexp_replace(a, '^\s+|\s+$', '', 'g')) < 20",
    "sapaan_awal": r"regexp_matches(a, '(?i)^(Hai|Halo|Alo|Hi|Hello|Hallo|Salam|Selamat|Dear|@\w+|Terima\s*kasih|Terimakasih|Thanks|Thank\s*you)\b')",
    "mention": r"regexp_matches(a, '@\w+')", "url": r"regexp_matches(a, '(?i)https?://|www\.')", "html": "regexp_matches(a, '(?i)<[a-z]+>|&nbsp;|&amp;')", "markdown_dump": r"regexp_matches(a, '#{2,}|\|\s*-{2,}')",
    "placeholder": r"regexp_matches(a, '(?i)\[deleted\]|\[removed\]|lorem ipsum|\bN/A\b|\bTBD\b')", "kode_aneh": r"regexp_matches(a, '\{[^}]*\}|\[\[[^\]]*\]\]')",
}


def _flagged(flags: dict[str, str]) -> str:
    cols = ", ".join(f"count(*) filter (where {c}) as {n}" for n, c in flags.items())
    return f"with {PAIRS}, {samples.WITH_QUESTIONS}, f as (select source, count(*) as rows, {cols} from qa group by source) unpivot f on {', '.join(flags)} into name flag value n"


NOISE = _flagged(_SUSPICIOUS)


def artefact_flags(spark, d):
    """What an audit counts in pairs of turns and made-up rows."""
    return P.flag_counts(samples.with_questions(pairs(spark, d)), A.artefact_flags("q", "a", F.col("source")), ("source",))


_CODE = "(?i)(ICD[- ]?11 code|ICD[- ]?10 code|kode ICD|ICD[- ]?11 classification|what (condition|disease) does .* represent|ICD[- ]?11 code for)"
_HELLO = r"(?i)^\s*(hi|hai|halo|hello|dear|hallo)\b"
_THOUGHT = r"(?i)<think>\s*</think>|<thinking>\s*</thinking>"
ARTEFACTS = _flagged(
    {
        "icd_or_hidr_lookup": f"regexp_matches(q, '{_CODE}') or regexp_matches(a, '{_CODE}') or source in ('icd11', 'hidr')", "greeting_with_name": rf"regexp_matches(a, '{_HELLO}[\s,]+[A-Z][a-z]+')", "greeting_leading": f"regexp_matches(a, '{_HELLO}')",
        "empty_think_tags": f"regexp_matches(a, '{_THOUGHT}') or regexp_matches(q, '{_THOUGHT}')", "empty_answer": r"not regexp_matches(a, '\S')",
    }
)


def mixed_languages(spark, d):
    """Languages of question and answer by source, told by profiles of frequent words, and the pairs that are in two."""
    told = by_profile(LANGUAGES, "a", "a")(by_profile(LANGUAGES, "q", "q")(samples.with_questions(pairs(spark, d))))
    return told.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a_lang") == "id").alias("a_id"), F.count_if(A.mixed_languages("q_lang", "a_lang")).alias("mixed"))


LANGUAGES = {"id": ("dan", "yang", "tidak", "saya", "untuk", "pada", "dokter"), "en": ("the", "of", "and", "in", "is", "for", "you")}


def _told(c: str) -> str:
    hits = {k: f"len(list_filter(regexp_extract_all(lower({c}), '[' || chr(92) || 'p{{L}}]+'), lambda w: w in {v}))" for k, v in LANGUAGES.items()}
    most = f"greatest({', '.join(hits.values())})"
    return f"case when length(trim({c})) < 12 then 'unknown' when {most} = 0 then 'unknown' {' '.join(f"when {n} = {most} then '{k}'" for k, n in hits.items())} end"


MIXED = f"with {PAIRS}, {samples.WITH_QUESTIONS}, t as (select source, {_told('q')} as x, {_told('a')} as y from qa) select source, count(*) as n, count(*) filter (where y = 'id') as a_id, count(*) filter (where x in ('id', 'en') and y in ('id', 'en') and x <> y) as mixed from t group by source".replace("{{", "{").replace("}}", "}")


def enumerations(spark, d):
    """Whole documents and made-up answers with their enumerations laid out."""
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "text").union(samples.frame(spark, samples.QUESTIONS, samples.NAMES).select("id", "a"))
    return rows.select("id", F.md5(T.enumerations("text")).alias("laid_out"), F.regexp_count(T.enumerations("text"), F.lit("(?m)^- ")).cast("long").alias("parts"))


_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_ITEM = _STRIPPED.format(r"regexp_replace(regexp_replace(x, '^[ .]+|[ .]+$', '', 'g'), '^(atau|dan|serta)\s+', '')")
_LEAD = r"regexp_replace(" + _STRIPPED.format(r"regexp_extract(s, '^(.{{3,90}}?):\s*(.+)$', 1)") + ", ',+$', '')"
_REST = r"regexp_extract(s, '^(.{{3,90}}?):\s*(.+)$', 2)"
ENUMERATIONS = rf"""with t as (select doc_id as id, text from documents union all select id, a from {samples.values(samples.QUESTIONS, samples.NAMES)}),
s as (select id, list_filter(string_split(regexp_replace({_STRIPPED.format(r"regexp_replace(text, '\s+', ' ', 'g')")}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as ss from t),
l as (select id, array_to_string(list_transform(ss, lambda s: case when {_LEAD} <> '' and length({_REST}) - length(replace({_REST}, ',', '')) >= 2
  then '**' || upper(substr({_LEAD}, 1, 1)) || substr({_LEAD}, 2) || ':**' || chr(10) || array_to_string(list_transform(list_filter(list_transform(string_split_regex({_REST}, ',\s*'), lambda x: {_ITEM}), lambda x: x <> '' and not regexp_full_match(x, '(?i)(dan|atau)?\s*lain[- ]?(lain|nya|sebagainya)?')), lambda x: '- ' || x), chr(10)) else s end), chr(10) || chr(10)) as t from s)
select id, md5(t) as laid_out, len(regexp_extract_all(t, '(?m)^- '))::bigint as parts from l""".replace("{{", "{").replace("}}", "}")


def top_words(spark, d):
    words = documents(spark, d).select(F.explode(T.words("text")).alias("word"))
    return P.most_common(words, "word", 50)


WORDS = "with w as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) select word, count(*) as n from w group by word order by n desc, word limit 50"


def cumulative_lengths(spark, d):
    return P.cumulative_share(documents(spark, d).select(F.length("text").cast("long").alias("chars")), "chars")


CUMULATIVE = "select distinct length(text) as chars, cume_dist() over (order by length(text)) as share from documents"


def quality_by_label(spark, d):
    """Whether labelled documents that are toxic or poor differ in length."""
    docs, labels = documents(spark, d), table(spark, d, "labels")
    return labels.join(docs, "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"), F.countDistinct("source").alias("sources"))


QUALITY = "select quality, toxic, count(*) as n, avg(n_chars) as mean, count(distinct source) as sources from labels join documents using (doc_id) group by all"


def throughput(spark, d):
    """Mean and deviation of a measure by kind."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.countDistinct("user_id").alias("users"))


THROUGHPUT = "select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, count(distinct user_id) as users from events group by event_type"


def series_ends(spark, d):
    """The mean of the first and the last fifth of a daily series."""
    day = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return P.ends_of_series(day, "day", "n").select(F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


SERIES = """with t as (select ts::date as day, count(*) as n from events group by 1), r as (select n, row_number() over (order by day) as r, count(*) over () as c from t)
select round(avg(n) filter (where r <= greatest(1, floor(c * 0.2))), 6) as first, round(avg(n) filter (where r > c - greatest(1, floor(c * 0.2))), 6) as last from r"""


def repeat_ratio(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'")
    return t.select("conv_id", "turn", P.repeat_ratio(T.words("text", "[a-z0-9]+")).alias("ratio"))


REPEATS = """with w as (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') as w from conversations where role = 'assistant')
select conv_id, turn, case when len(w) >= 4 then 1 - len(list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]))::double / (len(w) - 3) else 0.0 end as ratio from w"""

QUERIES = {
    "source_distribution": (source_distribution, SOURCES), "lang_by_source": (lang_by_source, LANGS), "domain_by_split": (domain_by_split, DOMAINS), "length_stats": (length_stats, STATS), "floor_percentiles": (floor_percentiles, FLOORS),
    "linear_percentiles": (linear_percentiles, LINEAR), "truncation_counts": (truncation_counts, ABOVE), "recommended_length": (recommended_length, RECOMMENDED), "category_crosstab": (category_crosstab, CROSSTAB), "language_share": (language_share, SHARE),
    "clipped_lengths": (clipped_lengths, CLIPPED), "noise_scan": (noise_scan, NOISE), "artefact_flags": (artefact_flags, ARTEFACTS), "mixed_languages": (mixed_languages, MIXED), "enumerations": (enumerations, ENUMERATIONS), "top_words": (top_words, WORDS), "cumulative_lengths": (cumulative_lengths, CUMULATIVE),
    "quality_by_label": (quality_by_label, QUALITY), "throughput": (throughput, THROUGHPUT), "series_ends": (series_ends, SERIES), "repeat_ratio": (repeat_ratio, REPEATS),
}
