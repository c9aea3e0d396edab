"""The same gates on streams: expressions need no state; duplicates are remembered as long as the watermark says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.gates import Gate, first_failed
from quern.shared import shared_path


def read(spark: SparkSession, path: str, schema, format: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """A folder of files as a stream, or a single file of a folder."""
    reader = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def labelled(stream: DataFrame, gates: list[Gate]) -> DataFrame:
    return stream.withColumn("failed", first_failed(gates))


def unique(stream: DataFrame, key: Column, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the delay."""
    return stream.withColumn("_key", key).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, ts: str, by: list[str], length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(begin, by, n): rows of each stretch of time."""
    w = F.window(ts, length)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), *by, "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a bounded stream gives: run until all there is has been read, into the shared folder."""
    spark = stream.sparkSession
    out, state = shared_path(spark, "stream"), shared_path(spark, "state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
