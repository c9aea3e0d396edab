"""Queries that select, sample and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import selection as S
from quern.plans.tables import documents

_KEY = "md5(doc_id::varchar || '|42')"


def _scored(spark, d):
    return documents(spark, d).select("doc_id", "source", "lang", "n_chars", T.diversity(T.words("text", "[a-z]+")).alias("score"))


SCORED = """scored as (select doc_id, source, lang, n_chars, case when len(w) > 0 then len(list_distinct(w))::double / len(w) else 0.0 end as score from (select *, regexp_extract_all(lower(text), '[a-z]+') as w from documents))"""


def top_scored(spark, d):
    return S.top(_scored(spark, d), 250, "score", "doc_id").select("doc_id", "score")


TOP = f"with {SCORED} select doc_id, score from scored order by score desc, doc_id limit 250"


def top_with_borderline(spark, d):
    return S.top_with_borderline(_scored(spark, d), 250, "score", "doc_id").select("doc_id", "score", "cut", "status")


BORDERLINE = f"""with {SCORED}, r as (select *, row_number() over (order by score desc, doc_id) as rank from scored), c as (select min(score) as cut from r where rank <= 250)
select doc_id, score, cut, case when rank <= 250 then 'selected' when score >= cut - 0.02 then 'borderline' else 'rejected' end as status from r cross join c"""


def random_sample(spark, d):
    return S.sample(documents(spark, d).select("doc_id"), 100, "doc_id")


SAMPLE = f"select doc_id from documents order by {_KEY}, doc_id limit 100"


def split_80_10_10(spark, d):
    return S.split(documents(spark, d).select("doc_id"), "doc_id")


SPLIT_3 = f"""with r as (select doc_id, row_number() over (order by {_KEY}, doc_id) as rank, count(*) over () as n from documents)
select doc_id, case when rank <= n * 80 // 100 then 'train' when rank <= n * 80 // 100 + n * 10 // 100 then 'val' else 'test' end as split from r"""


def stratified_split(spark, d):
    return S.stratified_split(documents(spark, d).select("doc_id", "lang"), "lang", "doc_id", 600, 100, 100)


def _half(n: str, of: str) -> str:
    return f"({n} // {of} + case when 2 * ({n} % {of}) > {of} or (2 * ({n} % {of}) = {of} and ({n} // {of}) % 2 = 1) then 1 else 0 end)"


STRATIFIED = f"""with r as (select doc_id, lang, row_number() over (partition by lang order by {_KEY}, doc_id) as rank, count(*) over (partition by lang) as n from documents)
select doc_id, lang, case when rank <= {_half("n * 100", "800")} then 'val' when rank <= 2 * {_half("n * 100", "800")} then 'test' else 'train' end as split from r"""


def stratified_reduce(spark, d):
    return S.stratified_reduce(documents(spark, d).select("doc_id", "source"), "source", "doc_id", 150)


REDUCE = f"""with r as (select doc_id, source, {_KEY} as s, row_number() over (partition by source order by {_KEY}, doc_id) as rank, count(*) over (partition by source) as n, count(*) over () as total from documents)
select doc_id, source from r where total <= 150 or rank <= greatest(1, {_half("n * 150", "total")}) order by case when total <= 150 then 0 else 1 end, s, doc_id limit case when (select count(*) from documents) <= 150 then 1000000000 else 150 end"""


def largest_remainder(spark, d):
    return S.largest_remainder(_scored(spark, d), "lang", "score", "doc_id", 77).select("doc_id", "lang")


REMAINDER = f"""with {SCORED}, g as (select lang, count(*) as n, sum(count(*)) over ()::bigint as total from scored group by lang), f as (select *, n * 77 // total as k, n * 77 % total as r from g),
a as (select lang, k + case when row_number() over (order by r desc, lang nulls first) <= 77 - sum(k) over () then 1 else 0 end as k from f),
r as (select *, row_number() over (partition by lang order by score desc, doc_id) as rank from scored)
select doc_id, r.lang from r join a on r.lang is not distinct from a.lang where rank <= k"""


def best_of_stratum(spark, d):
    return S.per_stratum(_scored(spark, d), "source", "score", "doc_id", 3).select("source", "doc_id")


BEST = f"with {SCORED} select source, doc_id from scored qualify row_number() over (partition by source order by score desc, doc_id) <= 3"


def oversample(spark, d):
    return S.oversample(documents(spark, d).select("doc_id", "lang"), F.col("lang") == "es", "doc_id", 0.25).select("doc_id", F.col("copy").cast("long").alias("copy"))


OVERSAMPLE = f"""with c as (select count(*) filter (where lang = 'es') as n, count(*) filter (where lang <> 'es') as m from documents), g as (select n, m, least(floor(m * 0.25::double / 0.75::double), n * 2) - n as extra from c),
r as (select doc_id, row_number() over (order by {_KEY}, doc_id) as rank from documents where lang = 'es')
select doc_id, 0::bigint as copy from documents union all select doc_id, 1::bigint from r cross join g where n > 0 and n::double / (n + m) < 0.25 and rank <= extra"""


def quota_fill(spark, d):
    return S.quota_fill(documents(spark, d).select("doc_id", "lang", "n_chars"), F.col("lang") == "de", "doc_id", "n_chars", 600_000).select("doc_id")


QUOTA = f"""with r as (select doc_id, sum(n_chars) over (order by case when lang = 'de' then 0 else 1 end, {_KEY}, doc_id rows between unbounded preceding and 1 preceding) as before from documents)
select doc_id from r where coalesce(before, 0) < 600000"""

QUERIES = {
    "top_scored": (top_scored, TOP), "top_with_borderline": (top_with_borderline, BORDERLINE), "random_sample": (random_sample, SAMPLE), "split_80_10_10": (split_80_10_10, SPLIT_3), "stratified_split": (stratified_split, STRATIFIED),
    "stratified_reduce": (stratified_reduce, REDUCE), "largest_remainder": (largest_remainder, REMAINDER), "best_of_stratum": (best_of_stratum, BEST), "oversample": (oversample, OVERSAMPLE), "quota_fill": (quota_fill, QUOTA),
}
