"""Queries that score: lexicons, lengths, composites, vectors, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import rules as R
from quern.functions import text as T
from quern.operators import evaluation as E
from quern.operators import vectors as V
from quern.plans import samples
from quern.plans.tables import PAIRS, documents, pairs, table

LEXICON = ("the", "on", "er", "in", "la", "de", "le", "und", "ein", "thing", "ing", "of")
NAMED = {"northern": ("der", "und", "ein"), "southern": ("la ", "de ", "que"), "western": ("the", "ing", "tion")}
_W = r"len(regexp_extract_all({}, '\S+'))"
_HITS = "len(list_intersect(regexp_extract_all(lower({}), '[a-z]+'), " + str(list(LEXICON)) + "))"


def lexicon_scores(spark, d):
    c = "text"
    n = T.word_count(c)
    return documents(spark, d).select(
        "doc_id", T.lexicon_hits(c, LEXICON).cast("long").alias("hits"), T.diversity(T.words(c, r"[a-z0-9_]+")).alias("diversity"), T.length_score(n).alias("short_knee"), T.length_score(n, 40).alias("long_knee"),
        T.domain(c, NAMED, "none").alias("domain"), T.in_language(c, F.col("source"), ("the", "and", "ing", "tion"), ("src1",)).alias("in_language"), T.readable_quality(c, F.lit(0.5)).alias("quality"), T.length_score(F.lit(0)).alias("nothing"),
    )


def _length(n: str, low: int) -> str:
    return f"case when {n} < {low} then {n} / {low}.0::double when {n} <= 250 then 1.0 else greatest(0.0, 1 - ({n} - 250) / 150.0::double) end"


def _kw(terms) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{t}')::int" for t in terms) + ")"


_MOST = f"greatest({', '.join(_kw(t) for t in NAMED.values())})"
LEXICON_SQL = rf"""with w as (select *, {_W.format("text")} as n, regexp_extract_all(lower(text), '[a-z0-9_]+') as t from documents)
select doc_id, {_HITS.format("text")} as hits, case when len(t) > 0 then len(list_distinct(t))::double / len(t) else 0.0 end as diversity, {_length("n", 20)} as short_knee, {_length("n", 40)} as long_knee,
case when {_MOST} = 0 then 'none' {" ".join(f"when {_kw(t)} = {_MOST} then '{k}'" for k, t in NAMED.items())} end as domain,
coalesce(contains(lower(source), 'src1'), false) or {_kw(("the", "and", "ing", "tion"))} >= 3 as in_language,
0.5::double + case when length(text) between 200 and 2000 then 0.02::double else 0.0 end + case when regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?]$') then 0.01::double else 0.0 end as quality, 0.0::double as nothing from w"""


def medical_scores(spark, d):
    """The fixed lexicon, domains and language words, over whole documents and made-up answers."""
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "source").union(samples.frame(spark, samples.QUESTIONS, samples.NAMES).select("id", "a", "source"))
    return rows.select("id", T.lexicon_hits("text").cast("long").alias("terms"), T.domain("text").alias("domain"), T.in_language("text", F.col("source")).alias("in_language"), F.round(T.cheap_score("text", F.lit(0.5)), 9).alias("cheap"))


_TOP = f"greatest({', '.join(_kw(t) for t in R.DOMAINS.values())})"
_TERMS = f"len(list_intersect(regexp_extract_all(lower(text), '[a-z]+'), {list(R.MEDICAL_TERMS)}))"
MEDICAL = f"""with t as (select doc_id as id, text, source from documents union all select id, a, source from {samples.values(samples.QUESTIONS, samples.NAMES)}), n as (select *, {_W.format("text")} as n, {_TERMS} as terms from t)
select id, terms, case when {_TOP} = 0 then 'umum' {" ".join(f"when {_kw(t)} = {_TOP} then '{k}'" for k, t in R.DOMAINS.items())} end as domain,
coalesce({" or ".join(f"contains(lower(source), '{x}')" for x in R.LANGUAGE_SOURCES)}, false) or {_kw(R.LANGUAGE_WORDS)} >= 3 as in_language,
round(0.4 * 0.5::double + 0.3 * ({_length("n", 20)}) + 0.3 * least(terms / 8.0::double, 1.0), 9) as cheap from n"""


def composite(spark, d):
    """Of all pairs: a bag-of-words relevance in place of a model's, scaled over the table, and what comes of it."""
    p = pairs(spark, d).select("conv_id", "turn", "a", T.jaccard(T.words("q"), T.words("a")).alias("relevance"))
    ends = p.agg(F.min("relevance").alias("low"), F.max("relevance").alias("high"))
    p = p.join(F.broadcast(ends), F.lit(True)).withColumn("scaled", T.scaled(F.col("relevance"), F.col("low"), F.col("high")))
    return p.select("conv_id", "turn", F.round("scaled", 9).alias("scaled"), F.round(T.cheap_score("a", F.lit(0.9), LEXICON), 9).alias("cheap"), F.round(T.composite_score("a", F.lit(0.9), F.col("scaled"), LEXICON), 9).alias("composite"))


COMPOSITE = rf"""with {PAIRS}, t as (select conv_id, turn, a, list_distinct(regexp_extract_all(lower(q), '[a-z]+')) as x, list_distinct(regexp_extract_all(lower(a), '[a-z]+')) as y from pairs),
j as (select *, case when len(x) + len(y) > 0 then len(list_intersect(x, y))::double / (len(x) + len(y) - len(list_intersect(x, y))) else 0.0 end as rel from t),
s as (select *, case when max(rel) over () > min(rel) over () then (rel - min(rel) over ()) / (max(rel) over () - min(rel) over ()) else 0.0 end as scaled, {_W.format("a")} as n, regexp_extract_all(lower(a), '[a-zA-Z0-9_]+') as w, least({_HITS.format("a")} / 8.0::double, 1.0) as med from j)
select conv_id, turn, round(scaled, 9) as scaled, round(0.4 * 0.9::double + 0.3 * ({_length("n", 20)}) + 0.3 * med, 9) as cheap,
round(0.2 * 0.9::double + 0.15 * ({_length("n", 40)}) + 0.3 * scaled + 0.2 * med + 0.15 * (case when len(w) > 0 then len(list_distinct(w))::double / len(w) else 0.0 end), 9) as composite from s"""


def vector_relevance(spark, d):
    """The cosine of each vector with the next of its label."""
    v = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    n = v.select("vec_id", "label", "embedding", F.lead("embedding").over(w).alias("next")).where("next is not null")
    return V.relevance(n, "embedding", "next").select("vec_id", F.round("relevance", 6).alias("relevance"), (F.col("relevance") >= 0.1).alias("kept"))


VECTORS = """with n as (select vec_id, embedding, lead(embedding) over (partition by label order by vec_id) as next from embeddings), c as (select vec_id, list_cosine_similarity(embedding::double[], next::double[]) as r from n where next is not null)
select vec_id, round(r, 6) as relevance, r >= 0.1 as kept from c"""


def _predictions(spark, d):
    """Each answer as the prediction of the next answer of its conversation; every third question gets options, every fifth answer a yes or no."""
    p = pairs(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = p.select("conv_id", "turn", "q", F.col("a").alias("pred"), F.lead("a").over(w).alias("ref")).where("ref is not null")
    rows = rows.join(spark_lang(spark, d), "conv_id")
    k = F.col("conv_id") + F.col("turn")
    kind = lambda c: F.when(k % 3 == 0, F.concat(F.lit("Answer: "), F.substring(F.lit("ABCDE"), (F.length(c) % 5 + 1).cast("int"), F.lit(1)), F.lit(") "), c)).when(k % 5 == 1, F.concat(F.when(F.length(c) % 2 == 0, "Yes, ").otherwise("No, "), c)).otherwise(c)
    question = F.when(k % 3 == 0, F.concat(F.col("q"), F.lit("\nA) one\nB) two"))).otherwise(F.col("q"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "lang", question.alias("question"), kind(F.col("pred")).alias("pred"), kind(F.col("ref")).alias("ref"))


def spark_lang(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", F.when(F.col("conv_id") % 2 == 0, "en").otherwise("id").alias("lang"))


def _kind(c: str) -> str:
    k = "(conv_id + turn)"
    return f"case when {k} % 3 = 0 then 'Answer: ' || substr('ABCDE', length({c}) % 5 + 1, 1) || ') ' || {c} when {k} % 5 = 1 then case when length({c}) % 2 = 0 then 'Yes, ' else 'No, ' end || {c} else {c} end"


_LETTER = lambda c: "coalesce(" + ", ".join(f"nullif(upper(regexp_extract({c}, '{p}', 1)), '')" for p in R.LETTERS) + ")"
_YES = lambda c: rf"(case lower(regexp_extract(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '{R.YES_NO}', 1)) when 'ya' then 'yes' when 'tidak' then 'no' when 'mungkin' then 'maybe' when '' then null else lower(regexp_extract(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '{R.YES_NO}', 1)) end)"
PREDICTIONS = rf"""{PAIRS}, l as (select *, lead(a) over (partition by conv_id order by turn) as b from pairs),
preds as (select conv_id * 1000 + turn as idx, case when conv_id % 2 = 0 then 'en' else 'id' end as lang, case when (conv_id + turn) % 3 = 0 then q || chr(10) || 'A) one' || chr(10) || 'B) two' else q end as question, {_kind("a")} as pred, {_kind("b")} as ref from l where b is not null),
bucketed as (select *, case when regexp_matches(question, '\n\s*[A-E]\)') then 'mcqa' when {_YES("ref")} is not null then 'yesno' else 'open' end as bucket,
{_LETTER("pred")} as pl, {_LETTER("ref")} as rl, {_YES("pred")} as py, {_YES("ref")} as ry, regexp_extract_all(lower(pred), '[a-z0-9]+') as pt, regexp_extract_all(lower(ref), '[a-z0-9]+') as rt from preds),
overlap as (select p.idx, sum(least(p.n, r.n))::bigint as c from (select idx, w, count(*) as n from (select idx, unnest(pt) as w from bucketed) group by all) p join (select idx, w, count(*) as n from (select idx, unnest(rt) as w from bucketed) group by all) r using (idx, w) group by p.idx),
scored as (select b.*, case bucket when 'mcqa' then coalesce(pl = rl, false)::int::double when 'yesno' then coalesce(py = ry, false)::int::double end as accuracy,
case when bucket = 'open' then case when coalesce(c, 0) = 0 then 0.0 else 2.0::double * c / (len(pt) + len(rt)) end end as token_f1 from bucketed b left join overlap using (idx))"""


def prediction_scores(spark, d):
    return E.scored(_predictions(spark, d)).select("idx", "lang", "bucket", "accuracy", "token_f1")


def metric_grouping_sets(spark, d):
    long = E.long_scores(E.scored(_predictions(spark, d)), "idx", ("bucket", "lang"), ("accuracy", "token_f1"))
    return E.by_keys(long).select("key", "metric", F.round("mean", 9).alias("mean"), "n")


GROUPING = f"""with {PREDICTIONS}, long as (select bucket, lang, 'accuracy' as metric, accuracy as score from scored where accuracy is not null union all select bucket, lang, 'token_f1', token_f1 from scored where token_f1 is not null)
select case when grouping(bucket) = 0 and grouping(lang) = 0 then 'bucket:' || bucket || '|lang:' || lang when grouping(bucket) = 0 then 'bucket:' || bucket when grouping(lang) = 0 then 'lang:' || lang else 'overall' end as key,
metric, round(avg(score), 9) as mean, count(*) as n from long group by grouping sets ((metric, bucket), (metric, bucket, lang), (metric, lang), (metric))"""


def closed_grouping_sets(spark, d):
    s = E.scored(_predictions(spark, d)).withColumn("bucket", F.when(F.col("bucket") == "open", "open").otherwise("closed"))
    return E.by_keys(E.long_scores(s, "idx", ("bucket", "lang"), ("accuracy", "token_f1"))).where("key like 'bucket:%'").select("key", "metric", F.round("mean", 9).alias("mean"), "n")


CLOSED = f"""with {PREDICTIONS}, long as (select case when bucket = 'open' then bucket else 'closed' end as bucket, lang, 'accuracy' as metric, accuracy as score from scored where accuracy is not null union all select 'open', lang, 'token_f1', token_f1 from scored where token_f1 is not null)
select 'bucket:' || bucket || case when grouping(lang) = 0 then '|lang:' || lang else '' end as key, metric, round(avg(score), 9) as mean, count(*) as n from long group by grouping sets ((metric, bucket), (metric, bucket, lang))"""


def unparsed_references(spark, d):
    s = E.scored(_predictions(spark, d))
    return s.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.option_letter("ref").isNull()).alias("no_letter"), F.count_if(T.yes_no("ref").isNull()).alias("no_answer")).withColumn("small", F.col("n") < R.SMALL_CELL)


UNPARSED = f"with {PREDICTIONS} select bucket, count(*) as n, count(*) filter (where rl is null) as no_letter, count(*) filter (where ry is null) as no_answer, count(*) < 30 as small from bucketed group by bucket"


def whitespace_f1(spark, d):
    return _predictions(spark, d).select("idx", T.token_f1("pred", "ref", r"\S+").alias("f1"))


WHITESPACE = rf"""with {PREDICTIONS}, t as (select idx, regexp_extract_all(lower(pred), '\S+') as x, regexp_extract_all(lower(ref), '\S+') as y from preds),
o as (select p.idx, sum(least(p.n, r.n))::bigint as c from (select idx, w, count(*) as n from (select idx, unnest(x) as w from t) group by all) p join (select idx, w, count(*) as n from (select idx, unnest(y) as w from t) group by all) r using (idx, w) group by p.idx)
select idx, case when coalesce(c, 0) = 0 then 0.0 else 2.0::double * c / (len(x) + len(y)) end as f1 from t left join o using (idx)"""


def rouge_l(spark, d):
    return E.scored(_predictions(spark, d)).select("idx", "rouge_l").where("rouge_l is not null")


def bootstrap_ci(spark, d):
    long = E.long_scores(E.scored(_predictions(spark, d)), "idx", ("bucket",), ("accuracy", "token_f1", "rouge_l"))
    return E.bootstrap(long, ("bucket", "metric"), 500)


def paired_bootstrap(spark, d):
    s = E.scored(_predictions(spark, d)).where("bucket = 'open'")
    a, b = (s.select("idx", F.col(m).alias("score")) for m in ("rouge_l", "token_f1"))
    return E.paired_bootstrap(a, b, "idx", rounds=500)


def _runs(spark, d):
    s = E.by_keys(E.long_scores(E.scored(_predictions(spark, d)), "idx", ("bucket", "lang"), ("accuracy", "token_f1")))
    base = s.select(F.lit("m_baseline").alias("label"), "key", "metric", F.col("mean").alias("value"))
    return base.union(base.where("key <> 'overall'").withColumns({"label": F.lit("m_finetuned"), "value": F.col("value") + 0.1}))


def run_deltas(spark, d):
    return E.run_deltas(_runs(spark, d)).select("label", "key", "metric", F.round("value", 9).alias("value"), F.round("base_value", 9).alias("base_value"), F.round("delta", 9).alias("delta"), "reached")


RUNS = f"""with g as ({GROUPING.replace("round(avg(score), 9)", "avg(score)")}) select 'm_finetuned' as label, key, metric, round(mean + 0.1, 9) as value, round(mean, 9) as base_value, round(mean + 0.1 - mean, 9) as delta, mean + 0.1 >= 0.3 as reached from g where key <> 'overall'"""

def best_checkpoint(spark, d):
    """Of each customer's orders the cheapest, the earliest of equals: the shape of choosing a checkpoint."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    return E.best_checkpoint(o, "o_orderkey", "o_totalprice", "o_custkey")


CHECKPOINT = "select o_custkey, o_orderkey, round(o_totalprice, 2) as o_totalprice from orders qualify row_number() over (partition by o_custkey order by round(o_totalprice, 2), o_orderkey) = 1"


def spot_check_rates(spark, d):
    forms = table(spark, d, "labels").join(documents(spark, d).select("doc_id", "source"), "doc_id")
    return E.spot_check_rates(forms, "source", ("quality", "toxic"))


SPOT = "select source, count(*) as n, avg(quality::double) as quality_rate, avg(toxic::double) as toxic_rate from labels join documents using (doc_id) group by source"


def pilot_checks(spark, d):
    """The checks of a short run, on daily counts in place of a loss."""
    log = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))
    out = table(spark, d, "conversations").where("role = 'assistant'").select("text", F.col("text").rlike("[a-z]").alias("ok"))
    return E.pilot_checks(log, out, "day", "loss", "text", "ok")


PILOT = """with log as (select ts::date as day, avg(value) as loss from events group by 1), r as (select loss, row_number() over (order by day) as r, count(*) over () as c from log),
e as (select avg(loss) filter (where r <= greatest(1, floor(c * 0.2))) as first, avg(loss) filter (where r > c - greatest(1, floor(c * 0.2))) as last, max(loss) as highest, arg_min(loss, r) as begin, bool_and(loss is not null and not isnan(loss) and not isinf(loss)) as finite from r),
w as (select text, regexp_extract_all(lower(text), '[a-z0-9]+') as w from conversations where role = 'assistant'),
t as (select avg(regexp_matches(text, '[a-z]')::int::double) as ok, max(case when len(w) >= 4 then 1 - len(list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]))::double / (len(w) - 3) else 0.0 end) as repeats from w),
k as (select last < first as trend, highest <= 2 * begin as no_explosion, finite, ok >= 0.9 as language, repeats <= 0.3 as no_repeats from e cross join t)
unpivot k on trend, no_explosion, finite, language, no_repeats into name "check" value passed"""

QUERIES = {
    "lexicon_scores": (lexicon_scores, LEXICON_SQL), "medical_scores": (medical_scores, MEDICAL), "composite": (composite, COMPOSITE), "vector_relevance": (vector_relevance, VECTORS), "prediction_scores": (prediction_scores, f"with {PREDICTIONS} select idx, lang, bucket, accuracy, token_f1 from scored"),
    "metric_grouping_sets": (metric_grouping_sets, GROUPING), "closed_grouping_sets": (closed_grouping_sets, CLOSED), "unparsed_references": (unparsed_references, UNPARSED), "whitespace_f1": (whitespace_f1, WHITESPACE), "rouge_l": (rouge_l, None),
    "bootstrap_ci": (bootstrap_ci, None), "paired_bootstrap": (paired_bootstrap, None), "run_deltas": (run_deltas, RUNS), "best_checkpoint": (best_checkpoint, CHECKPOINT), "spot_check_rates": (spot_check_rates, SPOT), "pilot_checks": (pilot_checks, PILOT),
}
