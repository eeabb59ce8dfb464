"""What a merge did, as rows, JSON lines and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(decided: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``section, what, n``: decisions, and conflicts by field."""
    d = decided.groupBy(F.col("decision").alias("what")).agg(F.count("*").alias("n")).withColumn("section", F.lit("decisions"))
    c = conflicts.groupBy(F.col("field").alias("what")).agg(F.count("*").alias("n")).withColumn("section", F.lit("conflicts"))
    return d.unionByName(c).select("section", "what", "n")


def markdown(rows: DataFrame) -> DataFrame:
    """One row of Markdown from a summary."""
    line = F.concat(F.lit("| "), "section", F.lit(" | "), "what", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return rows.agg(F.concat(F.lit("| section | what | n |\n|---|---|---|\n"), body).alias("text"))


def write(decided: DataFrame, conflicts: DataFrame, folder: str) -> None:
    """The report beside the conflicts: ``summary`` (Markdown text) and ``conflicts`` (JSON lines)."""
    markdown(summary(decided, conflicts)).write.mode("overwrite").text(f"{folder}/summary")
    conflicts.write.mode("overwrite").json(f"{folder}/conflicts")
