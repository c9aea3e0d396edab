"""The curation pipelines end to end: basic, leak-free, gated, strict, final. Each takes rows (id, q, a, source) and gives rows with a split.

Steps that rewrite or compare the whole table are written to the shared folder, so that the next one doesn't repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ladders as L
from quern.functions import passes as P
from quern.functions import text as T
from quern.operators import dedup as D
from quern.operators import gates as G
from quern.operators import selection as S
from quern.operators import vectors as V
from quern.plans import chats, samples
from quern.plans.tables import pairs
from quern.shared import written


def basic(rows: DataFrame, cap: int = 5) -> DataFrame:
    """Clean, drop short and greeting answers, one row per question, a cap on answers that begin alike, 80/10/10."""
    r = rows.withColumns({"q": T.clean_basic("q"), "a": T.clean_basic("a")})
    r = G.survivors(r, [G.short_answer_gate(), G.greeting_gate()])
    key = F.lower(T.strip("q"))
    r = D.first_per_key(r.where(key != ""), key, ["id"])
    r = D.cap_per_key(r, F.substring(T.strip("a"), 1, 120), ["id"], cap)
    return S.split(r, "id")


def leak_free(rows: DataFrame, target: int, minority: Column | None = None) -> DataFrame:
    """Splits without common or similar rows, opening greetings stripped, quality, a share of the minority, a stratified reduction of train."""
    sig = F.md5(F.concat_ws(" ", F.lower(T.strip("q")), F.lower(T.strip("a"))))
    r = written(S.split(D.first_per_key(rows, sig, ["id"]), "id"), "deduplicated")
    sets = r.select("id", "split", D.shingles(F.lower(F.concat("q", F.lit(" "), "a")), 5, r"\S+", "whole").alias("items"))
    near, members = D.similar_pairs(sets.select("id", "items"), "id", "items", 0.9)
    r = written(r.join(D.greedy_keep(near, members, "id"), "id", "left_semi"), "distinct")
    r = r.withColumn("a", L.without_opening(F.col("a")))
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("a").alias("content")))
    strict = F.col("split") != "test"
    r = written(r.where(~F.when(strict, G.low_quality(message)).otherwise(G.low_quality(message, False))).where(~G.code_lookup("q")), "quality")
    train, rest = r.where("split = 'train'"), r.where("split <> 'train'")
    if minority is not None:
        train = S.oversample(train, minority, "id", 0.5).drop("copy")
    return S.stratified_reduce(train, "source", "id", target).unionByName(rest)


def scored(rows: DataFrame, terms: tuple[str, ...], pre: int | None = None) -> DataFrame:
    """rows with relevance (a bag-of-words cosine, for want of a model) and composite; only the `pre` best by the cheap score, if given."""
    r = rows.withColumn("lang_conf", F.coalesce("a_prob", F.lit(0.0)))
    if pre is not None:
        r = S.top(r.withColumn("cheap", T.cheap_score("a", F.col("lang_conf"), terms)), pre, "cheap", "id").drop("cheap")
    r = written(V.relevance(r.withColumns({"_q": V.bag("q"), "_a": V.bag("a")}), "_q", "_a").drop("_q", "_a"), "relevance")
    ends = F.broadcast(r.agg(F.min("relevance").alias("_low"), F.max("relevance").alias("_high")))
    scaled = T.scaled(F.col("relevance"), F.col("_low"), F.col("_high"))
    return r.join(ends, F.lit(True)).withColumn("composite", T.composite_score("a", F.col("lang_conf"), scaled, terms)).drop("_low", "_high")


def passed(rows: DataFrame, gates: list[G.Gate], languages: V.Scorer, family: tuple[str, ...], terms: tuple[str, ...], least: float = 0.0, pre: int | None = None) -> DataFrame:
    """What all gates in order keep, with a composite: artefacts and personal data rewritten between them, exact and similar duplicates dropped."""
    r = rows.where(G.first_failed([G.format_gate()]).isNull()).withColumns({"q": P.normalized(F.col("q")), "a": P.normalized(F.col("a"))})
    r = G.survivors(r, [G.encoding_gate()]).withColumns({"q": L.clean_question(F.col("q")), "a": L.clean_answer(F.col("a"))})
    r = G.survivors(written(r, "rewritten"), [G.artefact_gate(), *gates])
    r = r.withColumns({"q": L.redacted(F.col("q"))["text"], "a": L.redacted(F.col("a"))["text"]})
    r = languages(r)
    r = G.survivors(r, [G.language_gate("q_lang", "q_prob", "a_lang", "a_prob", family)])
    r = written(D.first_per_key(r, D.pair_key("q", "a"), ["id"]), "exact")
    near, members = D.similar_pairs(r.select("id", D.shingles("q").alias("items")), "id", "items", 0.8)
    r = r.join(D.greedy_keep(near, members, "id"), "id", "left_semi")
    return G.survivors(scored(r, terms, pre), [G.relevance_gate(least=least)])


def gated(rows: DataFrame, train: int, val: int, test: int) -> DataFrame:
    """Of rows that passed, the best by composite, in stratified splits without similar questions across them."""
    best = S.top(rows, train + val + test, "composite", "id").withColumn("domain", T.domain("q"))
    return across_splits(S.stratified_split(best, "domain", "id", train, val, test))


def across_splits(rows: DataFrame) -> DataFrame:
    """Validation and test rows go whose question is similar to one of train, or of a row before them."""
    r = written(rows.withColumn("place", F.struct(F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2).alias("split"), F.col("id").alias("id"))), "splits")
    near, members = D.similar_pairs(r.select("place", D.shingles("q").alias("items")), "place", "items", 0.8)
    kept = D.greedy_keep(near, members, "place")
    return r.join(kept.withColumn("_kept", F.lit(True)), "place", "left").where("split = 'train' or _kept").drop("place", "_kept")


def strict(rows: DataFrame, entities: V.Scorer | None, train: int, val: int, test: int) -> DataFrame:
    """Strict cleaning, the checks after it, leading names, the last gate, and a new selection; rows need a composite."""
    r = rows.withColumns({"_q": L.strict_question(P.normalized(F.col("q"))), "_a": L.strict_answer(P.normalized(F.col("a")))})
    r = r.withColumns({"q": F.col("_q.text"), "a": F.col("_a.text"), "q_glued": F.col("_q.glued"), "a_glued": F.col("_a.glued")}).drop("_q", "_a")
    r = written(G.survivors(r, [G.glued_gate("q_glued", "a_glued"), G.recheck_gate(), G.echo_gate()]).drop("q_glued", "a_glued"), "strict")
    for c, name in (("q", "q_entities"), ("a", "a_entities")):
        scorer = entities or V.capitalised_entities(c, name)
        r = scorer(r)
    r = G.survivors(r, [G.person_gate("q_entities", "a_entities")]).drop("q_entities", "a_entities")
    best = S.top(r, train + val + test, "composite", "id").withColumn("domain", T.domain("q"))
    return across_splits(S.stratified_split(best, "domain", "id", train, val, test))


def final(rows: DataFrame, target: int) -> DataFrame:
    """Noise goes, answers are unique exactly and nearly, train has `target` rows by the largest remainders, and no eval row is like a train row."""
    r = G.survivors(rows, [G.noise_gate()]).withColumn("quality", T.readable_quality("a", F.col("composite")))
    r = written(D.best_per_key(r, F.concat_ws("|", "split", T.alnum("a")), F.col("quality"), "id"), "answers")
    order = F.struct(F.when(F.col("split") == "train", 0).otherwise(1).alias("split"), (-F.col("quality")).alias("quality"), F.col("id").alias("id"))
    kept = D.greedy_keep(*D.bucketed_pairs(r.withColumn("place", order), "place", "a"), "place").select(F.col("place.id").alias("id"))
    r = written(r.join(kept, "id", "left_semi"), "unique")
    train = S.largest_remainder(r.where("split = 'train'"), "domain", "quality", "id", target)
    return train.unionByName(r.where("split <> 'train'"))


# ------------------------------------------------------------------ registered over the conversations

#: The reference's sizes: train, val and test of the gated and the strict selection, and train after the reduction.
SIZES, REDUCED = (30_000, 3_000, 3_000), 20_000


def _rows(spark, d):
    """Pairs of turns and made-up rows, in five sources."""
    return samples.with_questions(pairs(spark, d)).withColumn("source", F.concat(F.lit("s"), F.pmod(F.floor(F.col("id") / 1000), F.lit(5))))


def curate_basic(spark, d):
    return basic(_rows(spark, d)).select("id", "split")


BASIC = r"""with next as (select conv_id, turn, role, text as q, lead(role) over w as next_role, lead(text) over w as a from conversations window w as (partition by conv_id order by turn)),
pairs as (select conv_id, turn, q, a from next where role = 'user' and next_role = 'assistant'), {rows},
c as (select id, {q} as q, {a} as a from qa), s as (select * from c where length({ta}) >= 80 and not (regexp_matches(a, '{greeting}') and length(a) < 150)),
u as (select * from s where lower({tq}) <> '' qualify row_number() over (partition by lower({tq}) order by id) = 1), k as (select * from u qualify row_number() over (partition by substr({ta}, 1, 120) order by id) <= 5),
r as (select id, row_number() over (order by md5(id::varchar || '|42'), id) as rank, count(*) over () as n from k)
select id, case when rank <= n * 80 // 100 then 'train' when rank <= n * 80 // 100 + n * 10 // 100 then 'val' else 'test' end as split from r"""
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]{{1,80}}>', ' ', 'g'), 'https?://\S+|www\.\S+', '', 'g'), '[ ' || chr(9) || ']{{2,}}', ' ', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_GENERIC = r"(?i)^(Hello[,.]?\s*Thank you for (asking|consulting)|Hi+[.,]?\s*(Thank you|Hope this message|I have gone through)|Hi+[.,]?\s*Thank you for consulting in Chat Doctor\.\s*$)"
BASIC = BASIC.replace("{q}", _CLEAN.format("q")).replace("{a}", _CLEAN.format("a")).replace("{ta}", _TRIM.format("a")).replace("{tq}", _TRIM.format("q")).replace("{greeting}", _GENERIC).replace("{rows}", samples.WITH_QUESTIONS)


def curate_leak_free(spark, d):
    return leak_free(_rows(spark, d), REDUCED).select("id", "split")


_PROFILES = {"en": ("the", "of", "and", "in", "to", "is", "that"), "fr": ("le", "la", "les", "de", "et"), "de": ("der", "die", "und", "das", "ein"), "es": ("el", "los", "que", "y", "en")}


def _passed(spark, d):
    both = lambda df: V.by_profile(_PROFILES, "a", "a")(V.by_profile(_PROFILES, "q", "q")(df))
    return passed(_rows(spark, d), [G.length_gate(min_a=5, max_a=200), G.invisible_gate(), G.deflection_gate(), G.spam_gate()], both, ("en", "fr", "de", "es"), chats.WORDS)


def curate_gated(spark, d):
    return gated(_passed(spark, d), *SIZES).select("id", "domain", "split")


def curate_strict(spark, d):
    return strict(_passed(spark, d), None, *SIZES).select("id", "split")


def curate_final(spark, d):
    return final(gated(_passed(spark, d), *SIZES), REDUCED).select("id", "split")


QUERIES = {
    "curate_basic": (curate_basic, BASIC), "curate_leak_free": (curate_leak_free, None), "curate_gated": (curate_gated, None), "curate_strict": (curate_strict, None), "curate_final": (curate_final, None),
}
