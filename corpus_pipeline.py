"""Corpus pipeline over ``documents``: toxicity, near-duplicates, decontamination, personal data, encoding.

Each stage works on all rows its predecessor kept.  The first four return the columns of
their input; the last returns ids.  Null texts pass the filters as empty texts.  Near-duplicates are
judged by text, not by id: a row with a null id is a copy as any other (one with an id stays
rather than it), and unrelated texts that share an id all stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontamination, near_dedup, pii, sentencepiece_codec, toxicity
from strata.llm.common import delete, shared_folder, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dedup.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontamination.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars``, where there is one, follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, ids``."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.load()).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaked), ("pii", redact), ("sentencepiece", encode)]

#: SQL can't express the learned and codec stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs, top, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{top}/{k}")
        if before:
            delete(spark, before)
        before = f"{top}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)
