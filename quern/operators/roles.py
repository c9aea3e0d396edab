"""Chat samples: arrays of (role, content), the three ways to read a role, pairs of turns, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import col

SYSTEM = "Answer with care, and say where a professional should be asked."


def samples(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, messages): each conversation's turns in order."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return grouped.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def of_role(messages: Column | str, role: str) -> Column:
    return F.transform(F.filter(col(messages), lambda m: m["role"] == role), lambda m: m["content"])


def first(messages: Column | str, role: str) -> Column:
    return F.get(of_role(messages, role), 0)


def last(messages: Column | str, role: str) -> Column:
    return F.try_element_at(of_role(messages, role), F.lit(-1))


def joined(messages: Column | str, *roles: str) -> Column:
    chosen = F.filter(col(messages), lambda m: m["role"].isin(*roles))
    return F.array_join(F.transform(chosen, lambda m: m["content"]), " ")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(question: Column, answer: Column, system: str = SYSTEM) -> Column:
    return F.array(message("system", F.lit(system)), message("user", question), message("assistant", answer))


def merge_system(messages: Column | str) -> Column:
    """The last system text goes before the first user turn; without a user turn it becomes one."""
    m = col(messages)
    told = F.coalesce(last(m, "system"), F.lit(""))
    rest = F.filter(m, lambda x: x["role"] != "system")
    first_user = F.array_position(F.transform(rest, lambda x: x["role"]), F.lit("user"))
    merged = F.transform(
        rest,
        lambda x, i: F.when((i + 1 == first_user) & (told != ""), F.struct(x["role"].alias("role"), F.concat(F.trim(told), F.lit("\n\n"), x["content"]).alias("content"))).otherwise(x),
    )
    return F.when((told == "") | (first_user > 0), merged).otherwise(F.concat(F.array(message("user", told)), rest))


def with_system(messages: Column | str, system: str = SYSTEM) -> Column:
    return F.concat(F.array(message("system", F.lit(system))), F.filter(col(messages), lambda x: x["role"] != "system"))


def render(messages: Column | str, generate: bool = False, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    turns = F.transform(col(messages), lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), m["content"], F.lit(f"{end}\n")))
    return F.concat(F.array_join(turns, ""), F.lit(f"{begin}assistant\n" if generate else ""))


def prompt(question: Column, system: str = SYSTEM) -> Column:
    return render(F.array(message("system", F.lit(system)), message("user", question)), True)


def prompt_and_reference(messages: Column | str) -> tuple[Column, Column]:
    asked = F.filter(col(messages), lambda m: m["role"].isin("system", "user"))
    return render(asked, True), F.coalesce(first(messages, "assistant"), F.lit(""))


def reference_after(rendered: Column | str, marker: str = "<|im_start|>assistant\n") -> Column:
    return F.substring_index(col(rendered), marker, -1)


def qa_pairs(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, q, a) for every user turn that an assistant turn follows."""
    w = Window.partitionBy(key).orderBy(turn)
    rows = turns.select(key, turn, F.col(role).alias("_role"), F.col(text).alias("q"), F.lead(role).over(w).alias("_next"), F.lead(text).over(w).alias("a"))
    return rows.where("_role = 'user' and _next = 'assistant'").select(key, turn, "q", "a")


def has_roles(messages: Column | str, *roles: str) -> Column:
    """Whether every role is there and no content is blank."""
    m = col(messages)
    names = F.transform(m, lambda x: x["role"])
    there = F.lit(True)
    for r in roles:
        there = there & F.array_contains(names, r)
    return there & ~F.exists(m, lambda x: ~F.coalesce(x["content"], F.lit("")).rlike(r"\S"))
