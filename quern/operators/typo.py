"""Spelling: word counts, dictionaries, corrections by one edit, and what they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import rules as R
from quern.functions import passes as P
from quern.functions import text as T
from quern.shared import written

WORD = "[A-Za-z]+"


def word_counts(df: DataFrame, text: str, pattern: str = "[a-z]+") -> DataFrame:
    return df.select(F.explode(T.words(text, pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def inner_capitals(df: DataFrame, text: str) -> DataFrame:
    """(word, n): capitalised words within a sentence, lower-cased; likely names."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<=[a-z,])\s([A-Z][a-z]+)"), F.lit(1))
    return df.select(F.explode(F.transform(found, F.lower)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dictionary(entries: DataFrame, columns: tuple[str, ...], wrong: str, right: str) -> tuple[DataFrame, DataFrame]:
    """(word) of all the columns, and (old, new) where one wrong form stands for one right one that may replace it."""
    parts = [entries.select(F.explode(T.words(c)).alias("word")) for c in columns]
    words = parts[0]
    for p in parts[1:]:
        words = words.union(p)
    a, b = T.words(wrong), T.words(right)
    pairs = entries.where((F.size(a) == 1) & (F.size(b) == 1)).select(F.get(a, 0).alias("old"), F.get(b, 0).alias("new"), F.col(right).alias("_by"))
    may = (F.length("new") >= 4) & (F.substring("old", 1, 1) == F.substring("new", 1, 1)) & (F.abs(F.length("old") - F.length("new")) <= 2) & (F.col("old") != F.col("new"))
    official = pairs.where(may).groupBy("old").agg(F.min_by("new", "_by").alias("new"))
    return words.where("length(word) >= 2").distinct(), official


def stems(word: Column | str) -> Column:
    """The word and what is left of it without a known prefix, suffix or both, of three letters at least."""
    w = T.col(word)
    cut = lambda c, p: F.when(c.startswith(p) & (F.length(c) - len(p) >= R.STEM_CHARS), F.substring(c, F.lit(len(p) + 1), F.length(c)))
    end = lambda c, s: F.when(c.endswith(s) & (F.length(c) - len(s) >= R.STEM_CHARS), F.substring(c, F.lit(1), F.length(c) - len(s)))
    found = [w, *[end(w, s) for s in R.SUFFIXES]]
    for p in R.PREFIXES:
        r = cut(w, p)
        found += [r, *[end(r, s) for s in R.SUFFIXES]]
    return F.array_distinct(F.array_compact(F.array(*found)))


def with_valid_stem(words: DataFrame, valid: DataFrame, word: str = "word") -> DataFrame:
    """Words of which a stem is in the dictionary."""
    tried = words.select(word, F.explode(stems(word)).alias("_stem")).join(valid.select(F.col("word").alias("_stem")).distinct(), "_stem", "left_semi")
    return words.join(tried.select(word).distinct(), word, "left_semi")


def edit_candidates(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(word, target) one edit apart. Words and targets meet by what one deletion makes of them, so no two lists are compared pairwise."""
    left = words.select("word", F.explode(P.deletion_keys(F.col("word"))).alias("key"))
    right = targets.select(F.col("word").alias("target"), F.explode(P.deletion_keys(F.col("word"))).alias("key"))
    return left.join(right, "key").select("word", "target").distinct().where(P.is_one_edit(F.col("word"), F.col("target")))


def may_replace(old: Column | str, new: Column | str) -> Column:
    a, b = T.col(old), T.col(new)
    return (F.length(b) >= R.WORD_CHARS[0]) & (F.abs(F.length(a) - F.length(b)) <= R.STEP_CHARS) & (a != b)


def corrections(counts: DataFrame, capitals: DataFrame, valid: DataFrame, official: DataFrame, target_count: int = R.TARGET_COUNT) -> DataFrame:
    """(old, new) for words that no dictionary, stem or name explains. Rare ones: by hand, by the official list, or the most
    frequent word one edit away; any others: by the official list. What is put is a word of the dictionary."""
    hand = counts.sparkSession.createDataFrame(list(R.CORRECTED_BY_HAND.items()), "word string, by_hand string")
    listed = official.select(F.col("old").alias("word"), F.col("new").alias("listed")).where(may_replace("word", "listed"))
    named = counts.join(capitals.select("word"), "word", "left_anti")
    unknown = written(named.join(with_valid_stem(named, valid).select("word"), "word", "left_anti").select("word", "n"), "unknown")
    rare = unknown.where(f"n <= {R.RARE_COUNT} and length(word) between {R.WORD_CHARS[0]} and {R.WORD_CHARS[1]}").where(~F.col("word").isin(*R.NEVER_CORRECTED)).select("word")
    targets = counts.where(f"n >= {target_count} and length(word) >= {R.WORD_CHARS[0]}").join(valid, "word", "left_semi")
    near = edit_candidates(rare, targets).join(targets.select(F.col("word").alias("target"), "n"), "target")
    near = near.groupBy("word").agg(F.max_by("target", F.struct("n", "target")).alias("near"))
    first = rare.join(hand, "word", "left").join(listed, "word", "left").join(near, "word", "left").select("word", F.coalesce("by_hand", "listed", "near").alias("new")).where("new is not null")
    second = unknown.select("word").join(listed, "word").join(first, "word", "left_anti").select("word", F.col("listed").alias("new"))
    out = first.union(second).select(F.col("word").alias("old"), "new").where(may_replace("old", "new"))
    return out.join(valid.select(F.col("word").alias("new")).distinct(), "new", "left_semi").select("old", "new")


def apply(df: DataFrame, text: str, fixes: dict[str, str]) -> DataFrame:
    """df with words of the text replaced by a bounded table of corrections, capitals kept."""
    if not fixes:
        return df
    table = F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv])

    def word(w: Column) -> Column:
        new = F.element_at(table, F.lower(w))
        return F.coalesce(F.when(w.rlike("^[A-Z]"), F.initcap(new)).otherwise(new), w)

    parts = F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(F.transform(parts, word), "")))


def runtime_corrections(words: DataFrame, valid: DataFrame, official: DataFrame, aggressive: bool = False, by_hand: dict[str, str] | None = None) -> DataFrame:
    """(old, new) of the words (word) of answers at run time: by hand, else, if no dictionary or stem explains them, by the official
    list, or (aggressive) the one word of the dictionary that is one edit away, if there is just one."""
    hand = words.sparkSession.createDataFrame(list((R.CURATED if by_hand is None else by_hand).items()), "word string, by_hand string")
    low, high = R.WORD_CHARS
    own = words.select(F.lower("word").alias("word")).distinct().where(F.length("word").between(low, high) & ~F.col("word").isin(*R.NEVER_AT_RUN))
    unknown = own.join(with_valid_stem(own, valid), "word", "left_anti").join(hand, "word", "left_anti")
    listed = official.select(F.col("old").alias("word"), F.col("new").alias("listed")).where(may_replace("word", "listed"))
    out = unknown.join(listed, "word", "left")
    if aggressive:
        near = edit_candidates(unknown, valid.where(F.length("word") >= low).select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("near")).where("n = 1")
        out = out.join(near.select("word", "near"), "word", "left")
    else:
        out = out.withColumn("near", F.lit(None).cast("string"))
    found = out.select("word", F.coalesce("listed", "near").alias("new")).union(own.join(hand, "word"))
    return found.where("new is not null and new <> word").select(F.col("word").alias("old"), "new")


def corrected(c: Column | str, fixes: dict[str, str]) -> Column:
    """(text, n) at run time: words replaced by a bounded table, and how many. Words of under 4 or over 18 letters, in capitals, or
    capitalised within a sentence stay."""
    table = F.create_map(*[F.lit(x) for kv in (fixes or {"": ""}).items() for x in kv])

    def word(parts: Column, w: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(".")).otherwise(F.rtrim(F.get(parts, i - 1)))
        inside = F.when(before == "", i > 1).otherwise(~T.last_chars(before, 1).rlike(r"[.!?\n]"))
        new = F.element_at(table, F.lower(w))
        kept = ~F.length(w).between(*R.WORD_CHARS) | w.rlike("^[A-Z]+$") | (w.rlike("^[A-Z]") & inside)
        return F.when(new.isNull() | kept, w).when(w.rlike("^[A-Z]"), T.capitalised(new)).otherwise(new)

    def told(parts: Column, done: Column) -> Column:
        differs = F.aggregate(F.zip_with(parts, done, lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x)
        return F.struct(F.array_join(done, "").alias("text"), differs.alias("n"))

    parts = F.regexp_extract_all(T.col(c), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return T.let(parts, lambda p: T.let(F.transform(p, lambda w, i: word(p, w, i)), lambda done: told(p, done)))


def changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(old, new, n, example): replaced words with how often and the first row that has them."""
    s = pairs.select(key, F.explode(P.replaced_words(F.col(before), F.col(after))).alias("s"))
    return s.groupBy(F.lower("s.old").alias("old"), F.lower("s.new").alias("new")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example"))


def with_knowledge(subs: DataFrame, counts: DataFrame, valid: DataFrame, names: DataFrame) -> DataFrame:
    """Substitutions (old, new, …) with what a dictionary, the corpus and likely names say: old_listed, old_valid, new_listed, is_name, seen."""
    words = subs.select(F.col("old").alias("word")).distinct()
    has = lambda df, c, name: df.select(F.col("word").alias(c)).distinct().withColumn(name, F.lit(True))
    out = subs.join(has(valid, "old", "old_listed"), "old", "left").join(has(with_valid_stem(words, valid), "old", "old_valid"), "old", "left")
    out = out.join(has(valid, "new", "new_listed"), "new", "left").join(has(names, "old", "is_name"), "old", "left")
    out = out.join(counts.select(F.col("word").alias("old"), F.col("n").alias("seen")), "old", "left")
    told = {c: F.coalesce(c, F.lit(False)) for c in ("old_listed", "old_valid", "new_listed", "is_name")}
    return out.withColumns(told | {"seen": F.coalesce("seen", F.lit(0))}).select(*subs.columns, *told, "seen")


def risk_flags(old: Column | str = "old", new: Column | str = "new") -> Column:
    """Reasons to look again at a correction of with_knowledge(), in order."""
    a, b = T.col(old), T.col(new)
    edits, seen = F.levenshtein(a, b), F.col("seen")
    far = (edits >= R.FAR_EDITS) | (F.substring(a, 1, 1) != F.substring(b, 1, 1)) | (F.abs(F.length(a) - F.length(b)) >= R.FAR_LENGTH)
    flags = [
        (T.looks_medical(a), F.lit("MEDIS")), (F.col("old_valid"), F.lit("BUKAN_TYPO")), (a.isin(*R.ACRONYMS), F.lit("AKRONIM")), (a.isin(*R.CRITICAL_WORDS) | b.isin(*R.CRITICAL_WORDS), F.lit("KRITIS")),
        (F.col("is_name"), F.lit("NAMA?")), (far, F.format_string("JAUH(d=%d)", edits)), (~F.col("new_listed"), F.lit("TARGET_TDK_BAKU")), (seen >= R.OFTEN_SEEN, F.format_string("SERING(%d)", seen)),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for c, name in flags]))


def priority(flags: Column | str) -> Column:
    """The place of the most serious flag, by which, and then by the number of times, corrections are looked at."""
    order = F.create_map(*[F.lit(x) for kv in R.FLAG_ORDER.items() for x in kv])
    place = F.transform(T.col(flags), lambda f: F.coalesce(F.element_at(order, F.regexp_replace(f, r"\(.*", "")), F.lit(R.LAST_FLAG)))
    return F.coalesce(F.array_min(place), F.lit(R.LAST_FLAG))


def flag_counts(df: DataFrame, flags: str, n: str) -> DataFrame:
    """(flag, types, applied): how many corrections have each flag, and how often they were made."""
    one = df.select(F.explode(F.transform(flags, lambda f: F.regexp_replace(f, r"\(.*", ""))).alias("flag"), F.col(n).alias("_n"))
    return one.groupBy("flag").agg(F.count(F.lit(1)).alias("types"), F.sum("_n").alias("applied"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


