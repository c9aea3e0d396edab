"""What each kind of source gives: questions and answers (q, a) of its own columns, with its own filters.

Fields are stripped; those that say nothing ('', none, nan) count as missing, and rows without a question or an answer go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import text as T
from quern.sources import builders as B
from quern.sources.readers import first_of


def _pairs(df: DataFrame, q: Column, a: Column, keep: tuple[str, ...], least_q: int = 1, least_a: int = 1, most_a: int | None = None) -> DataFrame:
    """Rows with a question and an answer of some length; longer answers are cut before a word."""
    out = df.select(*keep, T.strip(q).alias("q"), T.strip(a).alias("a"))
    out = out.where((F.coalesce(F.length("q"), F.lit(0)) >= least_q) & B.known(F.col("a")) & (F.length("a") >= least_a))
    return out.withColumn("a", T.truncate_words("a", most_a)) if most_a else out


def plain(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(question, answer): answers of 50 characters or more, cut at 2000."""
    return _pairs(df, F.col("question"), F.col("answer"), keep, least_a=R.PLAIN_ANSWER_CHARS, most_a=R.TRUNCATE_CHARS)


def instructions(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(instruction, input, output): the input after the instruction, if it says anything; answers as plain()."""
    asked = B.instruction(T.strip("instruction"), T.strip("input"))
    return _pairs(df, asked, F.col("output"), keep, least_a=R.PLAIN_ANSWER_CHARS, most_a=R.TRUNCATE_CHARS)


def dialogues(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Questions of 20 characters or more and answers of 100 or more, cut at 2000, from columns of several names."""
    low, most = R.SOURCE_ANSWER_CHARS
    return _pairs(df, first_of(df, "input", "question", "instruction"), first_of(df, "output", "answer", "response"), keep, R.SOURCE_QUESTION_CHARS, low, most)


def decisions(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(question, long_answer, final_decision): the decision before the answer, if there is one."""
    d = T.strip("final_decision")
    return _pairs(df.where(B.known(F.col("long_answer"))), F.col("question"), B.decision_answer(F.when(B.known(d), d), T.strip("long_answer")), keep)


def choices(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(question, opa, opb, opc, opd, cop, exp): the options below the question, and the right one with why. Rows without a number go."""
    options = ["opa", "opb", "opc", "opd"]
    asked = B.options(T.strip("question"), [T.strip(c) for c in options])
    return _pairs(df.where(T.strip("question") != ""), asked, B.option_answer("cop", options, "exp"), keep)
