"""The registered queries of this subpackage: each operator over its whole table, with the digests asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontam, fingerprint, langid, mixing, phrase_dedup, url_filter, warc
from quern.llm.neardup import near_duplicates
from quern.llm.suffix_dedup import substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bloom_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: F.coalesce(i.cast("string"), F.lit("null")))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(marks).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("r"))
    return chat.read_back(chat.format_chats(rows.union(more.select("r.*")))).drop("turns")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), keep_text=False)
    taken = F.col("mix_size") * F.col("mix_repeats")
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint.with_near(fingerprint.document_fingerprints(table(spark, sf_dir, "documents")))
    like = fingerprint.likeness
    return f.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.hexed(F.col("fp")).alias("fingerprint"), fingerprint.hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        like(F.col("fp"), F.col("edited_fp")).alias("near_edited"), like(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )


def op8_simhash_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op9_phrase_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.phrase_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_bloom_cascade_url_filter": op2_bloom_cascade_url_filter,
        "op3_decontaminate": op3_decontaminate,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_chat_prefix_tree": op5_chat_prefix_tree,
        "op6_mix_sources": op6_mix_sources,
        "op7_simhash_fingerprints": op7_simhash_fingerprints,
        "op8_simhash_trie_dedup": op8_simhash_trie_dedup,
        "op9_phrase_automata_dedup": op9_phrase_automata_dedup,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op2_bloom_cascade_url_filter": url_filter.SQL,
        "op3_decontaminate": decontam.SQL,
        "op5_chat_prefix_tree": chat.SQL,
        "op6_mix_sources": mixing.SQL,
        "op9_phrase_automata_dedup": phrase_dedup.SQL,
    }
