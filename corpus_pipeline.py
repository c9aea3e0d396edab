"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination and mixing, each over all that its
predecessor kept.

A stage takes (spark, docs, sf_dir) and gives the columns of documents; the last adds how often the mix takes each. All
stages read texts whole, however long; other columns are left out, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.decontam import decontaminate
from quern.llm.langid import identify_languages
from quern.llm.mixing import mix_sources
from quern.llm.neardup import similar_groups
from quern.llm.phrase_dedup import phrase_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least probability of the language told.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language go on; what has no letter (null texts are such), or is told with less than SURE, goes. Repeated rows are judged alike; a null doc_id is judged like any other."""
    told = identify_languages(docs, keep=COLUMNS)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays. A trie join of SimHash fingerprints proposes links; a link is a
    similarity of five-word shingles of 0.8 or more, verified on the whole sets.

    Rows that share a doc_id are one document and stay or go together; a null doc_id comes before all others; null and
    empty texts are equal.
    """
    groups = similar_groups(docs.select("doc_id", "text"), 5, 0.8)
    later = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    return docs.select(*COLUMNS).join(later, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; a text that loses words has one space between the others, and one that loses all goes.

    Rows that share a doc_id never remove each other's words; a null doc_id comes before all others; a null text has no
    words and stays.
    """
    out = phrase_dedup(docs, keep=("lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    rest = out.where(~cut | (F.col("n_removed") < F.col("n_words")))
    return rest.select("doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go, and with them all rows that share their doc_id, null for one; a null text has no words and stays."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = written(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("gone")).distinct(), "contaminated")
    return docs.select(*COLUMNS).join(hit, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with how often; a null text has size 0, null sources are one source, repeated rows are taken alike."""
    return mix_sources(docs.select(*COLUMNS)).where("mix_repeats > 0")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Naive Bayes and the joins of phrases aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
