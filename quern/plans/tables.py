"""The tables that the registered queries read, and the relations that several of them begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import roles
from quern.operators.selection import shuffle_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.samples(table(spark, sf_dir, "conversations"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, q, a) of user turns that an assistant turn follows."""
    return roles.qa_pairs(table(spark, sf_dir, "conversations"))


PAIRS = """next as (select conv_id, turn, role, text as q, lead(role) over w as next_role, lead(text) over w as a from conversations window w as (partition by conv_id order by turn)),
pairs as (select conv_id, turn, q, a from next where role = 'user' and next_role = 'assistant')"""

MESSAGES = """messages as (select conv_id, turn, role, coalesce(text, '') as content from conversations)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a split of each by its own md5: about 80, 10 and 10 of a hundred."""
    digit = F.conv(F.substring(shuffle_key("doc_id"), 1, 2), 16, 10).cast("int")
    return documents(spark, sf_dir).withColumn("split", F.when(digit < 205, "train").when(digit < 230, "val").otherwise("test"))


SPLIT = """split as (select *, case when h < '\\xCD' then 'train' when h < '\\xE6' then 'val' else 'test' end as split
from (select *, unhex(substr(md5(doc_id::varchar || '|42'), 1, 2)) as h from documents))"""
