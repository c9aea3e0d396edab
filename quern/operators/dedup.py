"""Duplicates: by key, capped, and by the similarity of shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from quern.functions import passes as P
from quern.functions import text as T
from quern.shared import dropped, few_rows, written, written_at


def first_per_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by the order. An aggregation: equal keys are one row per task before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return kept.select("_row.*")


def best_per_key(df: DataFrame, key: Column, quality: Column, order: str) -> DataFrame:
    """The row of each key with the highest quality, the first of equals."""
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct((-quality).alias("q"), F.col(order).alias("o"))).alias("_row"))
    return kept.select("_row.*")


def cap_per_key(df: DataFrame, key: Column, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key; tasks keep no more of a key before the shuffle."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_key", "_n")


def message_digest(messages: Column | str) -> Column:
    """md5 of the stripped, lower-cased user and assistant texts, joined by a blank."""
    m = F.filter(T.col(messages), lambda x: x["role"].isin("user", "assistant"))
    return F.md5(F.array_join(F.transform(m, lambda x: F.lower(T.strip(x["content"]))), " "))


def pair_key(q: Column | str, a: Column | str) -> Column:
    return T.squeeze(F.lower(F.concat(T.col(q), F.lit(" ||| "), T.col(a))))


def shingles(c: Column | str, size: int = 3, pattern: str = r"\w+", short: str = "words") -> Column:
    """Hashes of the different runs of `size` tokens. Shorter texts: their words, or (short='whole') all of them as one, or (short='none') nothing."""
    nothing = F.array().cast("array<bigint>")

    def runs(ws: Column) -> Column:
        n = F.size(ws)
        grams = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(T.run_of(ws, i, size)))
        less = {"words": F.transform(ws, lambda w: F.xxhash64(w)), "whole": F.array(F.xxhash64(F.array_join(ws, " "))), "none": nothing}[short]
        return F.when(n >= size, F.array_distinct(grams)).when(n > 0, F.array_distinct(less)).otherwise(nothing)

    return F.get(F.transform(F.array(F.coalesce(T.words(c, pattern), F.array().cast("array<string>"))), runs), 0)


def _klass(items: Column) -> Column:
    """Tells sets apart, by 128 bits."""
    return F.struct(F.xxhash64(items).alias("x"), F.xxhash64(F.lit(1), items).alias("y"))


#: Items are counted in one document of so many, for an order of items; an item counts as often from so many of these on. At most
#: so many are told to all workers, and so many keys are broadcast.
COUNTED, OFTEN, MOST_OFTEN, MOST_KEYS = 16, 4, 1 << 20, 1 << 20


def _often(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The items that are often met, sorted, and how often each is, in the documents that are counted."""
    part = sets.where(F.pmod(F.xxhash64("a"), F.lit(COUNTED)) == 0).select(F.explode("items").alias("item"))
    counts = written(part.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN), "often")
    least, total = OFTEN, 0
    for n, items in sorted(counts.groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):
        least, total = n, total + items
        if total > MOST_OFTEN:
            least += 1
            break
    told = counts.where(F.col("n") >= least).toPandas().sort_values("item")
    return told["item"].to_numpy(np.int64), told["n"].to_numpy(np.int64)


def _in_parts(f: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """f(keys, sizes, items) over batches of (key, items), about half a million items at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ends, items, at = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 19), "right")) - 1)
                yield f(batch.column(0).slice(at, to - at), np.diff(ends[at : to + 1]).astype(np.int64), items[ends[at] : ends[to]])
                at = to

    return run


def _first_items(often: Broadcast, least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """(a, n, rest, item) of the first n - ceil(least * n) + 1 items of each set in the order of (often, item); rest is how many items that one and those after it are."""

    def rows(keys: pa.Array, n: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(n)), n)
        known, count = often.value
        at = np.minimum(np.searchsorted(known, item), max(len(known) - 1, 0))
        rank = np.where(known[at] == item, count[at], 0) if len(known) else np.zeros(len(item), np.int64)
        order = np.lexsort((item, rank, row))
        item, row = item[order], row[order]
        place = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        keep = np.flatnonzero(place < (n - np.ceil(n * least - 1e-9).astype(np.int64) + 1)[row])
        row, item, rest = row[keep], item[keep], n[row[keep]] - place[keep]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(rest.astype(np.int32)), pa.array(item)], ["a", "n", "rest", "item"])

    return _in_parts(rows)


def _parities(keys: pa.Array, n: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
    """(a, bits): for each set a bit for an item or two, the parity of how many of its items have that place by their last bits; a power of two of them."""
    size = np.left_shift(64, np.ceil(np.log2(np.maximum(n / 64, 1))).astype(np.int64))
    begin = np.cumsum(size) - size
    odd = np.bincount(np.repeat(begin, n) + (item & np.repeat(size - 1, n)), minlength=int(size.sum())) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little")
    ends = np.append(begin, size.sum()) // 8
    return pa.RecordBatch.from_arrays([keys, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])], ["a", "bits"])


def _few(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if it is small; a join that shuffles, if not."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def similar_pairs(sets: DataFrame, key: str, items: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) for pairs of different sets with a Jaccard similarity of `least` or more, and (key, a) members.

    Lossless prefix filter: two sets that similar share one of their first n - ceil(least * n) + 1 items in an order that
    is the same for all sets; where they meet, what comes after it must leave room for the overlap. Any order is
    lossless; this one has items that are often met at the end. Pairs that meet are compared by the parities of their items'
    places first: as many places differ at most as items do. Only first items are dealt out, parities of sets that meet,
    and whole sets of pairs that pass. Equal sets are one class, which its smallest key stands for; classes are what pairs are made of.
    Returns (pairs, members).
    """
    spark = sets.sparkSession
    few_rows(spark)
    base = written(sets.select(F.col(key).alias("k"), F.array_sort(items).alias("items")).withColumn("klass", _klass(F.col("items"))), "sets")
    first = written(base.groupBy("klass").agg(F.min("k").alias("a")), "classes")
    members = base.select("k", "klass").join(first, "klass").select("k", "klass", "a")
    later = written(members.where("k <> a").select("k", "klass").distinct(), "later")
    reps = base.where(F.col("k").isNotNull() & (F.size("items") > 0)).join(_few(later), ["k", "klass"], "left_anti").select(F.col("k").alias("a"), "items")
    keyed = StructField("a", base.schema["k"].dataType)
    schema = StructType([keyed, StructField("n", IntegerType()), StructField("rest", IntegerType()), StructField("item", LongType())])
    prefix = written(reps.mapInArrow(_first_items(spark.sparkContext.broadcast(_often(reps)), least), schema), "prefixes")
    room = F.expr("least(x.rest, y.rest)") * (1 + least) + 1e-9 >= F.expr("x.n + y.n") * least
    met = prefix.alias("x").join(prefix.alias("y"), F.expr("x.item = y.item")).where(F.expr("x.a < y.a") & room)
    found = written(met.select("x.a", "x.n", F.col("y.a").alias("b"), F.col("y.n").alias("m")).distinct(), "met")
    ids = written(found.select("a").union(found.select("b")).distinct(), "met-keys")
    bits = written(reps.join(_few(ids), "a", "left_semi").mapInArrow(_in_parts(_parities), StructType([keyed, StructField("bits", BinaryType())])), "parities")
    apart = P.odd_places("bits", "others") * (1 + least) <= F.expr("n + m") * (1 - least) + 1e-9
    both = found.join(bits, "a").join(bits.select(F.col("a").alias("b"), F.col("bits").alias("others")), "b")
    found = written(both.where(apart).select("a", "b").distinct(), "candidates")
    ids = written(found.select("a").union(found.select("b")).distinct(), "candidate-keys")
    whole = reps.join(_few(ids), "a", "left_semi")
    pairs = found.join(whole, "a").join(whole.select(F.col("a").alias("b"), F.col("items").alias("others")), "b").withColumn("similarity", T.jaccard(F.col("items"), F.col("others")))
    # a key that has several rows is one
    pairs = pairs.where(F.col("similarity") >= least).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pairs, members.select(F.col("k").alias(key), "a")


def class_members(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(key, a): each row with the smallest key of its class of equal sets, as similar_pairs() has them."""
    base = written(sets.select(F.col(key).alias("k"), _klass(F.array_sort(items)).alias("klass")), "classes")
    return base.join(base.groupBy("klass").agg(F.min("k").alias("a")), "klass").select(F.col("k").alias(key), "a")


def with_class_size(members: DataFrame) -> DataFrame:
    return members.join(members.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a").select(*members.columns, "n")


def greedy_keep(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Keys that stay if rows are taken in order of key and one goes if a row that stayed before is similar to it.

    Rounds: what has no undecided earlier neighbour stays, its neighbours go. Members of a class after its first go.
    """
    spark = pairs.sparkSession
    live, path = written_at(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "neighbours")
    gone = None
    while not live.isEmpty():
        blocked = live.select(F.col("b").alias("x")).distinct()
        stays = live.select(F.col("a").alias("x")).distinct().join(blocked, "x", "left_anti")
        goes = written(live.join(stays, live["a"] == stays["x"]).select(F.col("b").alias("x")).distinct(), "gone")
        gone = goes if gone is None else gone.union(goes)
        kept = live.join(goes, live["b"] == goes["x"], "left_anti")
        live, last = written_at(kept.join(goes, kept["a"] == goes["x"], "left_anti"), "neighbours")
        dropped(spark, path)
        path = last
    firsts = members.where(F.col(key) == F.col("a")).select(key)
    if gone is None:
        return firsts
    return firsts.join(gone, F.col(key) == F.col("x"), "left_anti")


def similar_to(sets: DataFrame, others: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """Keys of sets for which others has a set with that similarity, from one join of both."""
    both = sets.select(F.struct(F.lit(0).alias("side"), F.col(key).alias("key")).alias("k"), items).union(others.select(F.struct(F.lit(1).alias("side"), F.col(key).alias("key")).alias("k"), items))
    pairs, members = similar_pairs(both, "k", items, least)
    same = pairs.select("a", "b").union(members.select("a", F.col("a").alias("b"))).distinct()
    near = same.union(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reach = members.where("k.side = 1").select(F.col("a").alias("b")).distinct()
    classes = near.join(reach, "b").select("a").distinct()
    return members.where("k.side = 0").join(classes, "a").select(F.col("k.key").alias(key))


def bucketed_sets(df: DataFrame, key: str, text: str, prefix: int = 200) -> DataFrame:
    """(key, items): the words of each row, with its first `prefix` letters and digits, its bucket, as part of every item."""
    # bound, or the bucket would be made again for every word
    items = T.let(F.substring(T.alnum(text), 1, prefix), lambda b: F.transform(F.array_distinct(T.words(text)), lambda w: F.xxhash64(b, w)))
    return df.select(key, F.coalesce(items, F.array().cast("array<bigint>")).alias("items"))


def bucketed_pairs(df: DataFrame, key: str, text: str, least: float = 0.8, prefix: int = 200) -> tuple[DataFrame, DataFrame]:
    """similar_pairs() of sets of words, for rows with the same first `prefix` letters and digits.

    The bucket is part of every item, so sets of different buckets share nothing and a large bucket is no list of pairs.
    """
    return similar_pairs(bucketed_sets(df, key, text, prefix), key, "items", least)
