"""Distributions, percentiles of three kinds, crosstabs, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T


def shares(df: DataFrame, *by: str) -> DataFrame:
    """(by, n, percent of all rows)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def most_common(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(key)).limit(k)


def rolled_up(df: DataFrame, *by: str) -> DataFrame:
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(b).cast("int").alias(f"all_{b}") for b in by])


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, one column per rank): the values at places from 0 in sorted order; a rank may use the column n.

    The values are counted first, so what is sorted is different values, not rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    return upto.groupBy(*by, "n").agg(*[F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(name) for name, rank in ranks.items()])


def length_stats(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Smallest, upper median and largest value."""
    return at_ranks(df, value, {"least": F.lit(0), "median": F.floor(F.col("n") / 2), "most": F.col("n") - 1}, by)


def floor_percentiles(df: DataFrame, value: str, at: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The value at the place p (n - 1), rounded down."""
    return at_ranks(df, value, {f"p{round(100 * p)}": F.floor(p * (F.col("n") - 1)) for p in at}, by)


def linear_percentiles(df: DataFrame, value: str, at: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Interpolated between neighbours."""
    rows = df.groupBy(*by) if by else df
    return rows.agg(*[F.percentile(value, p).alias(f"p{round(100 * p)}") for p in at])


def above(df: DataFrame, value: str, limits: tuple[int, ...]) -> DataFrame:
    """One row: how many values are above each limit."""
    return df.agg(*[F.count_if(F.col(value) > x).alias(f"above_{x}") for x in limits])


def recommended(df: DataFrame, value: str, limits: tuple[int, ...], by: tuple[str, ...], p: float = 0.99, step: int = 128) -> DataFrame:
    """(largest, limit, rounded): the largest percentile of any group, the least limit not below it, and it rounded up to a step."""
    top = linear_percentiles(df, value, (p,), by).agg(F.max(f"p{round(100 * p)}").alias("largest"))
    fits = F.array_min(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x >= F.col("largest")))
    return top.select("largest", fits.alias("limit"), (F.ceil(F.col("largest") / step) * step).alias("rounded"))


def crosstab(df: DataFrame, category: str, group: str, groups: list[str], limit: float = 2.0) -> DataFrame:
    """(category, percent of each group, deviation, uneven): the share of a category in each group, and how far apart they are."""
    wide = df.groupBy(category).pivot(group, groups).agg(F.count(F.lit(1))).na.fill(0, groups)
    all_rows = Window.partitionBy()
    share = {g: 100.0 * F.col(g) / F.sum(g).over(all_rows) for g in groups}
    out = wide.select(category, *[c.alias(f"percent_{g}") for g, c in share.items()])
    cols = [F.col(f"percent_{g}") for g in groups]
    return out.withColumn("deviation", F.greatest(*cols) - F.least(*cols)).withColumn("uneven", F.col("deviation") > limit)


def flag_counts(df: DataFrame, flags: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, flag, n, rows): for each flag the rows that have it, in one pass."""
    rows = df.groupBy(*by) if by else df
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"f_{n}") for n, c in flags.items()])
    stack = ", ".join(f"'{n}', f_{n}" for n in flags)
    return one.select(*by, "rows", F.expr(f"stack({len(flags)}, {stack}) as (flag, n)"))


def clipped(df: DataFrame, value: str, by: str, p: float = 0.95) -> DataFrame:
    """(by, mean and most of the values, clipped at the percentile of all)."""
    cut = df.agg(F.percentile(value, p).alias("cut"))
    v = F.least(F.col(value).cast("double"), F.col("cut"))
    return df.join(F.broadcast(cut), F.lit(True)).groupBy(by).agg(F.avg(v).alias("mean"), F.max(v).alias("most"))


def cumulative_share(df: DataFrame, value: str) -> DataFrame:
    """(value, share of rows not above it), from counts of values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(value, (upto / F.sum("_c").over(Window.partitionBy())).alias("share"))


def ends_of_series(df: DataFrame, order: str, value: str, share: float = 0.2) -> DataFrame:
    """(first, last): the means of the first and the last `share` of a series; for one row per step of a run."""
    w, n = Window.orderBy(order), F.count(F.lit(1)).over(Window.partitionBy())
    r = df.select(F.col(value).alias("_v"), F.row_number().over(w).alias("_r"), n.alias("_n"))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return r.agg(F.avg(F.when(F.col("_r") <= k, F.col("_v"))).alias("first"), F.avg(F.when(F.col("_r") > F.col("_n") - k, F.col("_v"))).alias("last"))


def repeat_ratio(tokens: Column, size: int = 4) -> Column:
    """The share of runs of `size` tokens that occurred before; 0 for shorter texts."""

    def ratio(t: Column) -> Column:
        n = F.size(t) - size + 1
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: T.run_of(t, i, size))
        return F.when(n >= 1, 1 - F.size(F.array_distinct(runs)) / n).otherwise(F.lit(0.0))

    return T.let(tokens, ratio)
