"""Questions and answers made of records: typed answers, options, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import text as T


def joined_items(items: Column, most: int, by: str) -> Column:
    return F.array_join(F.slice(items, 1, most), by)


def filled(text: str, **fields: Column) -> Column:
    """text with its {fields} filled in; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[fields[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def typed_answer(kind: Column | str, ideal: Column, exact: Column) -> Column:
    """The ideal answer, after what is exact of it, an array of strings: a yes or no, up to five things, or up to ten items. Without an ideal answer there is none."""
    k = T.col(kind)
    some = F.coalesce(F.size(exact) > 0, F.lit(False))
    verdict = F.when(F.lower(F.get(exact, 0)) == "yes", "Yes").otherwise("No")
    lead = (
        F.when(k == "yesno", verdict)
        .when(k == "factoid", joined_items(exact, R.MOST_ENTITIES, ", "))
        .when(k == "list", F.concat(F.lit("These include: "), joined_items(exact, R.MOST_ITEMS, "; ")))
    )
    told = F.when(some & lead.isNotNull(), F.concat(lead, F.lit(". "), ideal)).otherwise(ideal)
    return F.when(F.coalesce(ideal, F.lit("")) == "", F.lit("")).otherwise(told)


def decision_answer(decision: Column | str, text: Column | str) -> Column:
    d, t = T.col(decision), T.col(text)
    return F.when(d.isNull(), t).otherwise(F.concat(T.capitalised(d), F.lit(". "), t))


def options(question: Column | str, choices: list[Column | str]) -> Column:
    lines = [F.concat(F.lit(f"{chr(65 + i)}) "), T.col(c)) for i, c in enumerate(choices)]
    return F.concat_ws("\n", T.col(question), *lines)


def option_answer(index: Column | str, choices: list[Column | str], why: Column | str | None = None) -> Column:
    """The chosen option by its number from 0, and why. A number that no option has is marked with ?; null has no answer."""
    i = T.col(index)
    letter = F.coalesce(F.get(F.array(*[F.lit(chr(65 + n)) for n in range(len(choices))]), i), F.lit("?"))
    text = F.coalesce(F.get(F.array(*[F.coalesce(T.strip(c), F.lit("")) for c in choices]), i), F.lit(""))
    out = F.when(i.isNotNull(), F.concat(F.lit("The correct answer is **"), letter, F.lit(") "), text, F.lit("**.")))
    if why is None:
        return out
    w = T.strip(why)
    return F.when(known(w), F.concat(out, F.lit(" "), w)).otherwise(out)


def known(c: Column) -> Column:
    """Whether a field of a sheet says anything."""
    return F.coalesce(~F.lower(T.strip(c)).isin(*R.EMPTY_VALUES), F.lit(False))


def instruction(text: Column | str, given: Column | str) -> Column:
    g = F.trim(T.col(given))
    return F.when(g.isNull() | F.lower(g).isin("", "none", "nan"), T.col(text)).otherwise(F.concat(T.col(text), F.lit("\n"), T.col(given)))


def templates(df: DataFrame, pairs: list[tuple[Column, Column, Column]], *keep: str) -> DataFrame:
    """A row per record and pair (condition, question, answer) whose condition holds."""
    made = [F.when(cond, F.struct(q.alias("q"), a.alias("a"))) for cond, q, a in pairs]
    return df.select(*keep, F.explode(F.array_compact(F.array(*made))).alias("p")).select(*keep, "p.q", "p.a")


def code_rows(df: DataFrame, code: str, title: str, chapter: str, note: str, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, code, title, chapter, name, note) of a sheet of codes: categories with a code and a title of over three characters, none of the extension chapter; name is the chapter's."""
    t = T.strip(T.code_title(title))
    names = F.create_map(*[F.lit(x) for kv in R.CHAPTERS.items() for x in kv])
    ch = T.strip(chapter)
    rows = df.where((F.col(kind) == "category") & known(F.col(code)) & ~F.coalesce(ch == "X", F.lit(False)) & (F.length(t) > 3))
    return rows.select(*keep, T.strip(code).alias("code"), t.alias("title"), ch.alias("chapter"), F.coalesce(F.element_at(names, ch), F.lit(R.NO_CHAPTER)).alias("name"), F.coalesce(T.strip(note), F.lit("")).alias("note"))


def code_templates(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two questions for each of code_rows(), a third if its note has over 20 characters."""
    fields = {x: F.col(x) for x in ("code", "title", "chapter", "name", "note")}
    conditions = (F.lit(True), F.lit(True), F.length("note") > R.LEAST_NOTE)
    return templates(df, [(c, filled(q, **fields), filled(a, **fields)) for c, (q, a) in zip(conditions, (R.CODE_OF, R.MEANING_OF, R.NOTE_OF), strict=True)], *keep)


def indicator_templates(df: DataFrame, name: str, topic: str, data: str, dimension: str, short: str, data_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Up to three questions for each indicator with a name: what its short name measures, its dataset, its topic; what a sheet doesn't say is left out."""
    f = {k: T.strip(c) for k, c in (("name", name), ("topic", topic), ("data", data), ("short", short))}
    f["dimension"] = F.when(known(F.col(dimension)), filled(R.DIMENSION, dimension=T.strip(dimension))).otherwise(R.NO_DIMENSION)
    f["id"] = F.when(known(F.col(data_id)), filled(R.DATA_ID, id=T.strip(data_id))).otherwise("")
    pairs = [(known(F.col(short)), R.SHORT_FOR), (known(F.col(data)), R.DATA_OF), (known(F.col(topic)), R.TOPIC_OF)]
    return templates(df.where(known(F.col(name))), [(c, filled(q, **f), filled(a, **f)) for c, (q, a) in pairs], *keep)


def with_name(df: DataFrame, dimension: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """A lookup with a default. A small dimension is broadcast by its size, which Spark knows; a large one is joined."""
    return df.join(dimension.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))
