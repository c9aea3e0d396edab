"""The folder that all executors share, tables written to it, and ranks over a whole table."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all runs in this process, else an error: executors elsewhere wouldn't see it."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file:///tmp/checkpoints/quern-{app}"
        os.makedirs(_own[app].removeprefix("file://"), exist_ok=True)
    return _own[app]


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quern-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and outlives the executors that made it."""
    return written_at(df, what)[0]


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """written(), and where it is, so that dropped() may delete it once nothing reads it."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a batch that goes to Python, where the session says nothing else: texts may be long.
BATCH_ROWS = 2000


def few_rows(spark: SparkSession) -> None:
    """Smaller batches for texts than the default, unless the session has a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_ROWS))


def ranked(df: DataFrame, order: list, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """df with the number, from 1, of each row in the order, in each group of `by`.

    A sort of the whole table by ranges, then row numbers in ranges plus the rows before: no task holds more than a
    range, however large a group is. There is a row per range and per group beside it, so `by` is for few groups.
    """
    keys = [*(F.col(b) for b in by), *order]
    t = written(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranked")
    ranges = t.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = t.join(ranges, "_range").withColumn(name, (inner + F.col("_before")).cast("long"))
    if by:
        groups = t.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        ahead = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.select(*[F.col(b).alias(f"_{b}") for b in by], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
        same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
        out = out.join(groups, same).withColumn(name, F.col(name) - F.col("_ahead"))
    return out.select(*df.columns, name)
