"""Audits: rates of detectors, alignment with an earlier version, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import ladders as L
from quern.functions import passes as P
from quern.functions import text as T


def rates(df: DataFrame, fields: tuple[str, ...], detectors: dict, by: str) -> DataFrame:
    """(by, field, category, n, total, rate), with ALL for every level of by and field: one pass of counts, then their sums.

    detectors: category and a function of a column that gives a condition.
    """
    aggs = [F.count_if(F.coalesce(f(F.col(field)), F.lit(False))).alias(f"{field}__{name}") for field in fields for name, f in detectors.items()]
    one = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *aggs)
    stack = ", ".join(f"'{field}', '{name}', {field}__{name}" for field in fields for name in detectors)
    long = one.select(by, "total", F.expr(f"stack({len(aggs)}, {stack}) as (field, category, n)"))
    cube = long.groupBy("category", by, "field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    every = long.groupBy("category").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("category", F.lit("ALL").alias(by), F.lit("ALL").alias("field"), "n", "total")
    return cube.unionByName(every).withColumn("rate", F.col("n") / F.col("total"))


def aligned(final: DataFrame, pool: DataFrame, q: str, a: str, key: str) -> DataFrame:
    """(key, a, original, head, head_class) for each earlier answer to the same question, found by the question's signature; head is what was
    lost at its beginning, if the later one is its end."""
    f = final.select(key, F.col(a).alias("a"), T.question_signature(q).alias("sig"))
    p = pool.select(T.question_signature(q).alias("sig"), F.col(a).alias("original")).join(f.select("sig").distinct(), "sig", "left_semi")
    head = P.head_lost(F.col("original"), F.col("a"))
    out = f.join(p, "sig", "left").withColumn("head", head)
    return out.select(key, "a", "original", "head", F.when(F.col("head").isNotNull(), T.head_class("head")).alias("head_class"))


def restored(rows: DataFrame, key: str) -> DataFrame:
    """rows of aligned() whose head held a medical term, with it put back."""
    lost = rows.where("head_class = 'content'")
    return lost.withColumn("a", P.head_restored(F.col("head"), F.col("a"))).select(key, "a")


def verdict(checks: DataFrame, name: str = "check", passed: str = "passed") -> DataFrame:
    """(verdict, failed): whether all checks passed, and those that didn't."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col(passed), F.col(name)))), ",")
    return checks.agg(F.when(F.bool_and(passed), "PASS").otherwise("FAIL").alias("verdict"), failed.alias("failed"))


def final_checks(rows: DataFrame, split: str, q: str = "q", a: str = "a", most: int = 50) -> DataFrame:
    """(check, passed) of a finished set: no pair in two splits, none twice in one, no answer that the opening pass would still shorten by over `most` characters."""
    sig = F.md5(F.concat_ws(" ", F.lower(T.strip(q)), F.lower(T.strip(a))))
    cut = F.length(a) - F.length(L.without_opening(F.col(a))) > most
    one = rows.select(F.col(split).alias("split"), sig.alias("sig"), cut.alias("cut")).groupBy("sig", "split").agg(F.count(F.lit(1)).alias("n"), F.max("cut").alias("cut"))
    per = one.groupBy("sig").agg(F.count(F.lit(1)).alias("splits"), F.max("n").alias("n"), F.max("cut").alias("cut"))
    told = per.agg(F.coalesce(F.max("splits") <= 1, F.lit(True)).alias("leaks"), F.coalesce(F.max("n") <= 1, F.lit(True)).alias("duplicates"), F.coalesce(~F.max("cut"), F.lit(True)).alias("over_strip"))
    return told.select(F.expr("stack(3, 'leaks', leaks, 'duplicates', duplicates, 'over_strip', over_strip) as (check, passed)"))


def residual_flags(q: Column | str, a: Column | str) -> dict[str, Column]:
    """What a finished set should have none of: some only looked for in the answer, the others in each text by itself."""
    q, a = T.col(q), T.col(a)
    name = F.lower(F.regexp_extract(a, R.TRAIL_NAME, 1))
    flags = {n: a.rlike(p) for n, p in R.LEFT_IN_ANSWERS.items()} | {n: q.rlike(p) | a.rlike(p) for n, p in R.LEFT_IN_EITHER.items()}
    return flags | {"B1_trail_name": (name != "") & ~name.isin(*R.TRAIL_NAME_STOP), "B6_glued": T.glued_count(q) + T.glued_count(a) > 0}


def suspicious_flags(a: Column | str) -> dict[str, Column]:
    """What looks like noise in an answer."""
    a = T.col(a)
    return {R.TOO_SHORT: F.length(T.strip(a)) < R.TOO_SHORT_CHARS} | {n: a.rlike(p) for n, p in R.SUSPICIOUS.items()}


def artefact_flags(q: Column | str, a: Column | str, source: Column) -> dict[str, Column]:
    """What an audit counts: code questions, greetings with and without a name, empty thoughts, empty answers."""
    q, a = F.coalesce(T.col(q), F.lit("")), F.coalesce(T.col(a), F.lit(""))
    return {
        "icd_or_hidr_lookup": q.rlike(R.CODE_QUESTION) | a.rlike(R.CODE_QUESTION) | F.coalesce(source.isin(*R.CODE_SOURCES), F.lit(False)),
        "greeting_with_name": a.rlike(R.GREETED_BY_NAME), "greeting_leading": a.rlike(R.GREETED), "empty_think_tags": a.rlike(R.EMPTY_THOUGHT) | q.rlike(R.EMPTY_THOUGHT), "empty_answer": ~a.rlike(r"\S"),
    }


def mixed_languages(q_lang: Column | str, a_lang: Column | str, known: tuple[str, ...] = ("id", "en")) -> Column:
    """Whether question and answer are told to be of two of the known languages."""
    q, a = T.col(q_lang), T.col(a_lang)
    return F.coalesce(q.isin(*known) & a.isin(*known) & (q != a), F.lit(False))
