"""What splits share: anti joins, counts of common keys, unions and differences, benchmark contamination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.dedup import bucketed_pairs, greedy_keep, shingles
from quern.shared import written


def without_keys_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key no row of the other table has; rows without a key stay."""
    return df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def common_keys(df: DataFrame, key: str, group: str) -> DataFrame:
    """(a, b, common): how many keys each two groups share, 0 for those that share none. Each key is a row per group first."""
    pairs = df.select(key, group).distinct().groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("gs")).where(F.size("gs") > 1)
    one = pairs.select(F.explode(F.expr("flatten(transform(gs, x -> transform(filter(gs, y -> y > x), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    counts = one.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    every = groups.select(F.col(group).alias("a")).join(groups.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    return every.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("common"))


def union_all(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """All rows of all parts, columns by name, with the part's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(n)) for n, df in parts.items()])


def not_chosen(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_anti")


def grams(c: Column | str, size: int, pattern: str = "[a-z0-9]+") -> Column:
    """The different runs of `size` tokens of the lower-cased text, as hashes; none of shorter texts."""
    return shingles(c, size, pattern, "none")


def contamination(docs: DataFrame, tests: DataFrame, size: int, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, shared): how many runs of `size` tokens a document shares with a test item."""
    d = docs.select(doc, F.explode(grams(text, size)).alias("gram"))
    t = tests.select(item, F.explode(grams(text, size)).alias("gram"))
    return d.join(t, "gram").groupBy(doc, item).agg(F.count(F.lit(1)).alias("shared"))


def rare_keywords(pairs: DataFrame, keyword: str, group: str, most: int = 3) -> DataFrame:
    """Pairs whose keyword at most `most` groups have."""
    often = pairs.select(keyword, group).distinct().groupBy(keyword).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return pairs.join(often, keyword, "left_anti")


def eval_reasons(rows: DataFrame, train: DataFrame, key: str, q: str = "q", a: str = "a", least: float = 0.8) -> DataFrame:
    """(key, reason) of evaluation rows, the first of: leak_ans, leak_q (train has the same letters and digits), leak_near (a train
    answer is similar to it), dup_ans, dup_near (an earlier evaluation answer that stays is the same, or similar); null for rows that stay."""
    e = rows.select(F.col(key).alias("k"), T.alnum(q).alias("nq"), T.alnum(a).alias("na"), F.col(a).alias("text"))
    ban_a = train.select(T.alnum(a).alias("na")).distinct().withColumn("leak_ans", F.lit(True))
    ban_q = train.select(T.alnum(q).alias("nq")).distinct().withColumn("leak_q", F.lit(True))
    e = written(e.join(ban_a, "na", "left").join(ban_q, "nq", "left"), "eval")
    side = lambda df, n: df.select(F.struct(F.lit(n).alias("side"), F.col("k").alias("k")).alias("place"), "text")
    open_ = e.where("leak_ans is null and leak_q is null")
    both = side(train.select(F.col(key).alias("k"), F.col(a).alias("text")), 0).union(side(open_, 1))
    pairs, members = bucketed_pairs(both, "place", "text", least)
    linked = pairs.select("a", "b").union(pairs.select("b", "a")).union(members.select("a", F.col("a").alias("b"))).distinct()
    trained = members.where("place.side = 0").select(F.col("a").alias("b")).distinct()
    near = members.where("place.side = 1").join(linked.join(trained, "b").select("a").distinct(), "a").select(F.col("place.k").alias("k"))
    e = written(e.join(near.withColumn("leak_near", F.lit(True)), "k", "left"), "eval")
    rest = e.where("leak_ans is null and leak_q is null and leak_near is null")
    first = rest.groupBy("na").agg(F.min("k").alias("first"))
    rest = written(rest.join(first, "na").select("k", "text", (F.col("k") != F.col("first")).alias("dup_ans")), "answers")
    kept = greedy_keep(*bucketed_pairs(rest.where("not dup_ans"), "k", "text", least), "k").withColumn("stays", F.lit(True))
    out = e.join(rest.select("k", "dup_ans"), "k", "left").join(kept, "k", "left")
    reason = F.when(F.col("leak_ans"), "leak_ans").when(F.col("leak_q"), "leak_q").when(F.col("leak_near"), "leak_near").when(F.col("dup_ans"), "dup_ans").when(F.col("stays").isNull(), "dup_near")
    return out.select(F.col("k").alias(key), reason.alias("reason"))
