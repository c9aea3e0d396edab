"""Gates with reasons: a ladder of conditions is one CASE expression, and its funnel one aggregation.

A row is charged to its first failing gate, so a funnel has the numbers of filtering in sequence.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import rules as R
from quern.functions import text as T


class Gate(NamedTuple):
    name: str
    #: (reason, condition under which a row falls), the first that holds counts
    reasons: tuple[tuple[str, Column], ...]


def first_failed(gates: list[Gate]) -> Column:
    """gate:reason of the first that a row fails, null for survivors."""
    found = [F.when(F.coalesce(cond, F.lit(False)), F.lit(f"{g.name}:{reason}")) for g in gates for reason, cond in g.reasons]
    return F.coalesce(*found)


def survivors(df: DataFrame, gates: list[Gate]) -> DataFrame:
    return df.where(first_failed(gates).isNull())


def funnel(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """(ord, gate, reason, n_in, n_dropped, n_out) for every gate and reason, in order; gates that drop nothing too."""
    spark = df.sparkSession
    failed = df.groupBy(first_failed(gates).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    order = [(i, g.name, r, f"{g.name}:{r}") for i, (g, r) in enumerate((g, r) for g in gates for r, _ in g.reasons)]
    steps = spark.createDataFrame(order, "ord int, gate string, reason string, failed string").join(failed, "failed", "left")
    total = failed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.join(F.broadcast(total), F.lit(True)).select("ord", "gate", "reason", "total", F.coalesce("n", F.lit(0)).alias("n_dropped"))
    steps = steps.withColumn("n_in", F.col("total") - F.coalesce(F.sum("n_dropped").over(before), F.lit(0)))
    return steps.select("ord", "gate", "reason", "n_in", "n_dropped", (F.col("n_in") - F.col("n_dropped")).alias("n_out"))


def format_gate(q: str = "q", a: str = "a") -> Gate:
    blank = lambda c: ~F.col(c).rlike(r"\S")
    return Gate("G1_format", (("non_string_or_null", F.col(q).isNull() | F.col(a).isNull()), ("empty_field", blank(q) | blank(a))))


def encoding_gate(q: str = "q", a: str = "a") -> Gate:
    return Gate("G2_encoding", (("mojibake", F.contains(F.col(q), F.lit(R.REPLACEMENT)) | F.contains(F.col(a), F.lit(R.REPLACEMENT))),))


def artefact_gate(a: str = "a") -> Gate:
    c = F.col(a)
    return Gate("G5_artifacts", (("doctor_name_embedded", c.rlike(R.DOCTOR_NAME)), ("named_greeting", c.rlike(R.NAMED_GREETING)), ("patient_followup_as_answer", c.rlike(R.PATIENT_FOLLOW_UP))))


def length_gate(q: str = "q", a: str = "a", min_q: int = R.MIN_QUESTION_CHARS, max_q: int = R.MAX_QUESTION_WORDS, min_a: int = R.MIN_ANSWER_WORDS, max_a: int = R.MAX_ANSWER_WORDS) -> Gate:
    n = T.word_count(a)
    same = F.lower(T.strip(q)) == F.lower(T.strip(a))
    return Gate("G4_length", (("question_too_short", F.length(q) < min_q), ("question_too_long", T.word_count(q) > max_q), ("answer_too_short", n < min_a), ("answer_too_long", n > max_a), ("q_equals_a", same)))


def invisible_gate(a: str = "a") -> Gate:
    return Gate("G6_invisible_ref", (("invisible_ref", F.col(a).rlike(R.INVISIBLE)),))


def deflection_gate(a: str = "a", pattern: str = R.DEFLECTION, terms=tuple(R.MEDICAL_TERMS)) -> Gate:
    only = (T.word_count(a) < R.DEFLECTION_WORDS) & F.col(a).rlike(pattern) & (T.lexicon_hits(a, terms) < R.DEFLECTION_TERMS)
    return Gate("G9_deflection", (("deflection_only", only),))


def spam_gate(q: str = "q", a: str = "a", spam: str = R.SPAM, profanity: str = R.PROFANITY) -> Gate:
    both = F.concat(F.col(q), F.lit(" "), F.col(a))
    return Gate("G10_toxic_spam", (("spam", both.rlike(spam)), ("profanity", both.rlike(profanity))))


def language_gate(q_lang: str, q_prob: str, a_lang: str, a_prob: str, family=R.LANGUAGE_FAMILY) -> Gate:
    bad = lambda lang, prob, least: ~F.col(lang).isin(*family) | (F.col(prob) < least)
    return Gate("G3_language", (("answer", bad(a_lang, a_prob, R.LANGUAGE_ANSWER)), ("question", bad(q_lang, q_prob, R.LANGUAGE_QUESTION))))


def language_reason(q_lang: str, q_prob: str, a_lang: str, a_prob: str, family=R.LANGUAGE_FAMILY) -> Column:
    """answer_<label> or question_<label> of the first that language_gate() holds against a row, else null."""
    bad = lambda lang, prob, least: ~F.col(lang).isin(*family) | (F.col(prob) < least)
    return F.when(bad(a_lang, a_prob, R.LANGUAGE_ANSWER), F.concat(F.lit("answer_"), a_lang)).when(bad(q_lang, q_prob, R.LANGUAGE_QUESTION), F.concat(F.lit("question_"), q_lang))


def relevance_gate(relevance: str = "relevance", least: float = R.RELEVANCE) -> Gate:
    return Gate("G8_relevance", (("off_topic", F.col(relevance) < least),))


def recheck_gate(q: str = "q", a: str = "a") -> Gate:
    n = T.word_count(a)
    only = (n < R.DEFLECTION_WORDS) & F.col(a).rlike(R.DEFLECTION) & (T.lexicon_hits(a) < R.DEFLECTION_TERMS)
    return Gate(
        "B7_recheck",
        (("question_short", F.length(q) < R.MIN_QUESTION_CHARS), ("answer_short", n < R.MIN_ANSWER_WORDS), ("answer_long", n > R.MAX_ANSWER_WORDS), ("deflection_only", only), ("named_greeting", F.col(a).rlike(R.NAMED_GREETING))),
    )


def glued_gate(q_glued: str, a_glued: str, most: int = R.MAX_GLUED) -> Gate:
    return Gate("B6_glued", (("too_broken", F.greatest(q_glued, a_glued) > most),))


def echo_gate(q: str = "q", a: str = "a") -> Gate:
    return Gate("echo", (("echo", T.is_echo(q, a)), ("patient_utterance", T.patient_speaks(a))))


def noise_gate(a: str = "a", platform: str = R.NOISE_PLATFORM, greeting: str = R.NOISE_GREETING, url: str = R.NOISE_URL, least: int = R.NOISE_CHARS) -> Gate:
    c = F.col(a)
    return Gate("noise", (("platform_ref", c.rlike(platform)), ("greeting", c.rlike(greeting)), ("url", c.rlike(url)), ("too_short", F.length(c) < least)))


def short_answer_gate(a: str = "a", least: int = R.SHORT_ANSWER_CHARS) -> Gate:
    return Gate("short_answer", (("short", F.length(T.strip(a)) < least),))


def greeting_gate(a: str = "a", pattern: str = R.GENERIC_GREETING, below: int = R.GREETING_CHARS) -> Gate:
    return Gate("generic_greeting", (("greeting", F.col(a).rlike(pattern) & (F.length(a) < below)),))


def low_quality(messages: Column | str, strict: bool = True, banned=R.BANNED) -> Column:
    """Answers of under 20 or over 3000 characters or with a banned string, or questions of under 5."""
    low, high = R.ANSWER_CHARS

    def bad(m: Column) -> Column:
        c = m["content"]
        answer = (F.length(T.strip(c)) < low) | (F.length(c) > high)
        if strict:
            answer = answer | reduce(lambda x, y: x | y, [F.contains(F.lower(c), F.lit(b)) for b in banned])
        return ((m["role"] == "assistant") & answer) | ((m["role"] == "user") & (F.length(T.strip(c)) < 5))

    return F.exists(T.col(messages), bad)


def code_lookup(c: Column | str, source: Column | None = None, sources: tuple[str, ...] = ()) -> Column:
    """Questions for the code of something, or rows of sources that are nothing else. c: a text, or messages of which any may ask."""
    t = T.col(c)
    asks = F.contains(t, F.lit("What is the")) & F.contains(F.lower(t), F.lit("code")) & F.contains(t, F.lit("ICD")) & (F.length(t) < 200)
    return asks | source.isin(*sources) if source is not None and sources else asks


def any_code_lookup(messages: Column | str, source: Column | None = None, sources: tuple[str, ...] = ()) -> Column:
    """code_lookup() of any of the messages."""
    asks = F.exists(T.col(messages), lambda m: code_lookup(m["content"]))
    return asks | source.isin(*sources) if source is not None and sources else asks


def content_lookup(question: Column | str) -> Column:
    """Code questions by what is asked alone."""
    low = F.lower(F.coalesce(T.col(question), F.lit("")))
    return F.contains(low, F.lit("icd")) & F.contains(low, F.lit("code"))


def high_person(entities: Column | str, least: float = R.PERSON_SCORE) -> Column:
    """Whether a recogniser's entities have a person that is no common word."""

    def person(e: Column) -> Column:
        w = F.trim(e["word"])
        return (e["entity_group"] == "PER") & (e["score"] >= least) & ~F.lower(w).isin(*R.PERSON_STOP) & (F.length(w) >= R.PERSON_LENGTH)

    return F.exists(T.col(entities), person)


def person_gate(q_entities: str, a_entities: str, q: str = "q", a: str = "a", stripped: str | None = None) -> Gate:
    either = lambda p: F.col(q).rlike(p) | F.col(a).rlike(p)
    leaked = r"(?i)\b(?:" + "|".join(R.LEAKED_NAMES) + r")\b"
    fragment = F.col(a).rlike(R.NAME_FRAGMENT) & (F.col(stripped) if stripped else F.lit(False))
    return Gate(
        "B1_person",
        (("answer_person", high_person(a_entities)), ("question_person", high_person(q_entities)), ("doctor_name", either(R.DOCTOR_INSIDE)), ("leaked_name", either(leaked)), ("echo_or_utterance", T.is_echo(q, a) | T.patient_speaks(a)), ("name_fragment", fragment)),
    )
