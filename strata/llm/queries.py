"""Thin registered queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, fill_in_middle, lm_scoring, matroska, near_dedup, pii, quality_ngram, sentencepiece_codec, source_mixing, substring_dedup, toxicity, url_filter
from .common import table
from .oracles import ORACLES  # noqa: F401


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = substring_dedup.repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return stripped.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, chain)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ngram.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("leaks").cast("long").alias("n_items"), F.transform("leaks", lambda x: x.item_id).alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x.distance)).alias("least_distance"), (F.size("leaks") > 0).alias("leaked"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(table(spark, sf_dir, "documents"), sentencepiece_codec.load())


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_nodes(*conversation_trie.rebuilt(conversation_trie.hashed_turns(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_toxicity, op4_matroska, op5_near_dedup, op6_quality, op7_decontamination, op8_url_filter, op9_lm_scoring, op10_sentencepiece, op11_source_mixing, op12_fill_in_middle, op13_conversation_trie)
}
