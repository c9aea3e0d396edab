"""Vectors and model scores: cosine, MinHash bands, and the interface of models that are not part of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import text as T

#: A scorer adds documented columns to a table: a language and its probability, a relevance, entities.
Scorer = Callable[[DataFrame], DataFrame]


def relevance(df: DataFrame, q: str, a: str, name: str = "relevance") -> DataFrame:
    return df.withColumn(name, T.cosine(F.col(q), F.col(a)))


def bag(c: Column | str, size: int = 64) -> Column:
    """Counts of words by hash, a vector that needs no model."""
    # the words are worked out once, not for each place
    counts = lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("float"))
    return T.let(F.transform(T.words(c), lambda w: F.pmod(F.xxhash64(w), F.lit(size))), counts)


def by_profile(profiles: dict[str, tuple[str, ...]], text: str, name: str, least: int = R.LANGUAGE_CHARS) -> Scorer:
    """Language by the share of words that its list has, for want of a model: <name>_lang and <name>_prob; unknown below `least` characters."""

    def run(df: DataFrame) -> DataFrame:
        # the words, and then the counts, are worked out once
        count = lambda ws, terms: F.size(F.filter(ws, lambda w: w.isin(*terms)))
        counts = T.let(T.words(text, r"[\p{L}]+"), lambda ws: F.array(*[count(ws, terms) for terms in profiles.values()]))

        def judged(hits: Column) -> Column:
            total, most = F.aggregate(hits, F.lit(0), lambda a, b: a + b), F.array_max(hits)
            lang = F.lit("unknown")
            for i, k in reversed(list(enumerate(profiles))):
                lang = F.when((most > 0) & (F.get(hits, i) == most), k).otherwise(lang)
            return F.struct(F.when(F.length(F.trim(text)) < least, "unknown").otherwise(lang).alias("lang"), F.when(total > 0, most / total).otherwise(F.lit(0.0)).alias("prob"))

        told = df.withColumn("_told", T.let(counts, judged))
        return told.withColumns({f"{name}_lang": F.col("_told.lang"), f"{name}_prob": F.col("_told.prob")}).drop("_told")

    return run


def capitalised_entities(text: str, name: str) -> Scorer:
    """Titled or doubly capitalised words as persons, for want of a recogniser: an array of (entity_group, score, word)."""
    entity = "array<struct<entity_group: string, score: double, word: string>>"

    def run(df: DataFrame) -> DataFrame:
        found = F.regexp_extract_all(F.substring(text, 1, 1000), F.lit(R.DOCTOR_INSIDE + "|" + R.TITLED), F.lit(0))
        made = F.transform(found, lambda w: F.struct(F.lit("PER").alias("entity_group"), F.lit(0.95).alias("score"), w.alias("word")))
        return df.withColumn(name, made.cast(entity))

    return run


def lead_names(df: DataFrame, text: str, scorer: Scorer, entities: str) -> DataFrame:
    """(name): first words of texts that the recogniser, seeing each alone, takes for a person."""
    c = F.col(text)
    first = F.regexp_extract(c, R.LEAD_NAME, 1)
    second = F.regexp_replace(F.regexp_extract(c, R.LEAD_NAMES, 2), r"\.+$", "")
    words = df.where(c.rlike(R.LEAD_NAME)).select(F.explode(F.array(first, second)).alias("name")).where("name <> ''").distinct()
    return scorer(words).where(F.exists(entities, lambda e: (e["entity_group"] == "PER") & (e["score"] >= R.LEAD_NAME_SCORE))).select("name")


def minhash(items: Column | str, hashes: int = 96, seed: int = R.SEED) -> Column:
    """The least of each of `hashes` hashes of an array of numbers; equal for empty sets."""
    least = lambda c, i: F.array_min(F.transform(c, lambda x: F.xxhash64(F.lit(seed + i), x)))
    # the items are worked out once, not for each hash
    return T.let(T.col(items), lambda c: F.array(*[F.coalesce(least(c, i), F.lit(2**63 - 1)) for i in range(hashes)]))


def with_minhash(sets: DataFrame, key: str, items: str, hashes: int = 96, seed: int = R.SEED, name: str = "sig") -> DataFrame:
    """(key, sig): minhash() of each row whose set isn't empty, as an aggregation over its items: compiled, where a column's loop over an array isn't."""
    one = sets.select(F.monotonically_increasing_id().alias("_row"), key, items).select("_row", key, F.explode(items).alias("_x"))
    least = [F.min(F.xxhash64(F.lit(seed + i), "_x")).alias(f"_{i}") for i in range(hashes)]
    return one.groupBy("_row", key).agg(*least).select(key, F.array(*[f"_{i}" for i in range(hashes)]).alias(name))


def bands(signature: Column | str, hashes: int = 96, rows: int = 4) -> Column:
    """A key for each band of rows; sets with an equal band are candidates."""
    return T.let(T.col(signature), lambda c: F.transform(F.sequence(F.lit(0), F.lit(hashes // rows - 1)), lambda b: F.xxhash64(b, F.slice(c, b * rows + 1, rows))))
