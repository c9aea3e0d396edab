"""Top rows, samples and splits of exact size. Shuffles are orders by md5, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import rules as R
from quern.shared import ranked, written


def shuffle_key(key: Column | str, seed: int = R.SEED) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(str(seed))))


#: Rows up to which the first of an order are gathered in one place; more are cut off by their rank.
GATHERED = 10_000


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the order. They are a set: whichever way they are found, their own order isn't told."""
    if n <= GATHERED:
        return df.orderBy(*order).limit(n)
    return ranked(df, order, name="_rank").where(F.col("_rank") <= n).drop("_rank")


def top(df: DataFrame, n: int, score: str, key: str) -> DataFrame:
    return first_rows(df, [F.col(score).desc(), F.col(key).asc()], n)


def top_with_borderline(df: DataFrame, n: int, score: str, key: str, band: float = R.BORDERLINE) -> DataFrame:
    """df with status selected, borderline (within `band` below the last selected score) or rejected."""
    r = written(ranked(df, [F.col(score).desc(), F.col(key).asc()]), "ranked")
    cut = r.where(F.col("rank") <= n).agg(F.min(score).alias("cut"))
    status = F.when(F.col("rank") <= n, "selected").when(F.col(score) >= F.col("cut") - band, "borderline").otherwise("rejected")
    return r.join(F.broadcast(cut), F.lit(True)).withColumn("status", status).drop("rank")


def sample(df: DataFrame, n: int, key: str, seed: int = R.SEED) -> DataFrame:
    """n rows without replacement."""
    return first_rows(df.withColumn("_s", shuffle_key(key, seed)), [F.col("_s").asc(), F.col(key).asc()], n).drop("_s")


def split(df: DataFrame, key: str, train: int = 80, val: int = 10, seed: int = R.SEED) -> DataFrame:
    """df with split train, val or test by hundredths of all rows, rounded down."""
    r = ranked(df.withColumn("_s", shuffle_key(key, seed)), [F.col("_s"), F.col(key)]).drop("_s")
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))
    a, b = F.floor(F.col("_n") * train / 100), F.floor(F.col("_n") * val / 100)
    return r.join(n, F.lit(True)).withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test")).drop("rank", "_n")


def half_even(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator rounded to the nearest whole number, halves to the even one, in whole numbers."""
    q, r = F.floor(numerator / denominator), numerator % denominator
    up = (2 * r > denominator) | ((2 * r == denominator) & (q % 2 == 1))
    return (q + F.when(up, 1).otherwise(0)).cast("long")


def stratified_split(df: DataFrame, stratum: str, key: str, train: int, val: int, test: int, seed: int = R.SEED) -> DataFrame:
    """df with split: of each stratum its share of val and test, by the order of the shuffle, and train for the rest."""
    need = train + val + test
    r = ranked(df.withColumn("_s", shuffle_key(key, seed)), [F.col("_s"), F.col(key)], (stratum,)).drop("_s")
    n = df.groupBy(F.col(stratum).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_g", half_even(F.col("_n") * val, F.lit(need)).alias("_v"), half_even(F.col("_n") * test, F.lit(need)).alias("_t"))
    named = F.when(F.col("rank") <= F.col("_v"), "val").when(F.col("rank") <= F.col("_v") + F.col("_t"), "test").otherwise("train")
    return r.join(n, F.col(stratum).eqNullSafe(F.col("_g"))).withColumn("split", named).drop("rank", "_g", "_v", "_t")


def stratified_reduce(df: DataFrame, stratum: str, key: str, target: int, seed: int = R.SEED) -> DataFrame:
    """Each stratum's share of `target` rows, one at least, and of those the first `target` of the shuffle."""
    r = ranked(df.withColumn("_s", shuffle_key(key, seed)), [F.col("_s"), F.col(key)], (stratum,))
    total = df.count()
    if total <= target:
        return df
    n = df.groupBy(F.col(stratum).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_g", F.greatest(F.lit(1), half_even(F.col("_n") * target, F.lit(total))).alias("_k"))
    kept = r.join(n, F.col(stratum).eqNullSafe(F.col("_g"))).where(F.col("rank") <= F.col("_k"))
    return first_rows(kept, [F.col("_s").asc(), F.col(key).asc()], target).select(*df.columns)


def largest_remainder(df: DataFrame, stratum: str, quality: str, key: str, target: int) -> DataFrame:
    """The best rows of each stratum, as many as its exact share rounded down and one more for the largest remainders."""
    df = written(df, "scored")  # else the score would be worked out for each count, sample and sort
    n = df.groupBy(F.col(stratum).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    if total <= target:
        return df
    n = n.withColumns({"_k": F.floor(F.col("_n") * target / total), "_r": (F.col("_n") * target) % total})
    left = F.lit(target) - F.sum("_k").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("_r").desc(), F.col("_g").asc_nulls_first()))
    n = n.select("_g", (F.col("_k") + F.when(place <= left, 1).otherwise(0)).alias("_k"))
    r = ranked(df, [F.col(quality).desc(), F.col(key).asc()], (stratum,))
    return r.join(n, F.col(stratum).eqNullSafe(F.col("_g"))).where(F.col("rank") <= F.col("_k")).select(*df.columns)


def per_stratum(df: DataFrame, stratum: str, quality: str, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(F.col(quality).desc(), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def oversample(df: DataFrame, minority: Column, key: str, share: float, most: int = 2, seed: int = R.SEED) -> DataFrame:
    """All rows, and the minority's first rows of the shuffle again until it has the share or `most` times its rows; copy counts from 0."""
    small, large = df.where(minority), df.where(~minority)
    n, m = small.count(), large.count()
    goal = min(int(m * share / (1 - share)), n * most)
    base = df.withColumn("copy", F.lit(0))
    if n == 0 or n / max(1, n + m) >= share or goal <= n:
        return base
    r = ranked(small.withColumn("_s", shuffle_key(key, seed)), [F.col("_s"), F.col(key)]).drop("_s")
    extra = F.lit(goal - n)
    times = F.floor(extra / n) + F.when(F.col("rank") <= extra % n, 1).otherwise(0)
    more = r.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))) if goal - n >= n else r.where(F.col("rank") <= goal - n).withColumn("copy", F.lit(1))
    return base.unionByName(more.drop("rank"))


def quota_fill(df: DataFrame, first: Column, key: str, weight: str, most: int, seed: int = R.SEED) -> DataFrame:
    """Rows of the first class, then the others by the shuffle, while the sum of weights before a row is below `most`."""
    t = df.withColumn("_c", F.when(first, 0).otherwise(1)).withColumn("_s", shuffle_key(key, seed))
    r = written(ranked(t, [F.col("_c"), F.col("_s"), F.col(key)]), "quota")
    step = 4096
    blocks = r.groupBy(F.floor(F.col("rank") / step).alias("_b")).agg(F.sum(weight).alias("_w"))
    before = blocks.select("_b", F.coalesce(F.sum("_w").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_b").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    out = r.withColumn("_b", F.floor(F.col("rank") / step)).join(before, "_b").withColumn("_sum", F.col("_before") + F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return out.where(F.col("_sum") < most).select(*df.columns)
