"""Writers. None overwrites what it reads, and a debug run has a root of its own."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def root(base: str, debug: bool = False, version: str | None = None) -> str:
    """Where a run writes: debug runs apart, versions beside each other."""
    return "/".join(x for x in (base.rstrip("/"), "debug" if debug else None, version) if x)


def json_lines(df: DataFrame, path: str, columns: list[Column | str] | None = None, mode: str = "errorifexists") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).json(path)


def splits(df: DataFrame, path: str, split: str = "split", format: str = "json", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(split).format(format).save(path)


def split_stats(df: DataFrame, split: str, domain: str, length: str) -> DataFrame:
    return df.groupBy(split, domain).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("least"), F.max(length).alias("most"))


def tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def two(df: DataFrame, path: str, flagged: Column, summary: DataFrame, mode: str = "errorifexists") -> None:
    """Flagged rows, and a summary beside them."""
    json_lines(df.where(flagged), f"{path}/flagged", mode=mode)
    json_lines(summary, f"{path}/summary", mode=mode)


def data_card(steps: DataFrame, title: str) -> str:
    """A funnel as text: one line per step, so its rows are few."""
    lines = [f"# {title}", "", "| step | reason | in | dropped | out |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r.gate} | {r.reason} | {r.n_in} | {r.n_dropped} | {r.n_out} |" for r in steps.orderBy("ord").collect()]
    return "\n".join(lines) + "\n"


def report(spark_df: DataFrame) -> str:
    """A report of few rows as JSON."""
    return json.dumps([r.asDict(True) for r in spark_df.collect()], ensure_ascii=False, indent=1)
